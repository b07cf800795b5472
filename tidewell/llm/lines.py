"""Line dedup: frequent lines stay in one document only, found by levelled sorted runs of line hashes.

Documents come in batches. A batch's line hashes are merged against the runs that earlier batches left: those that a run has
settled (found often enough, and a later document keeps the line) add nothing, the others become a run of their own, with how many
documents hold them and the last of these. A level that holds ``FANOUT`` runs is compacted into one run of the next. All runs are
tables of the same number of buckets, sorted by hash, so merging needs no shuffle; a batch's new hashes alone are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.bytestext import passes
from tidewell.llm.sparktools import arrow_batches, partitions, released, unused
from tidewell.sources.shared import shared_folder

#: Runs that a level holds before they become one of the next.
FANOUT = 2
#: The most frequent lines (24 bytes each) that are sent to all tasks; of more, each batch of texts joins its own.
MOST_SENT = 1 << 21
#: Seed of the 128-bit hash of a line.
SEED = 13
_RUN = "h1 long, h2 long, n long, last long"


class Lines:
    """The lines of some texts: begin and end of each and of its key in ``data``, the key's code points, and the lines of each text."""

    def __init__(self, texts):
        self.data = texts.data
        low = texts.lowered()
        low[texts.ends] = 10
        ends = np.flatnonzero(low == 10)
        self.begin = np.concatenate(([0], ends[:-1] + 1))
        self.end = ends
        self.per_text = np.diff(np.searchsorted(ends, texts.ends), prepend=-1)
        space = (low == 32) | ((low >= 9) & (low <= 13))
        # keys run from a line's first byte that is no blank to its last
        solid = np.flatnonzero(~space)
        first, last = np.searchsorted(solid, self.begin), np.searchsorted(solid, self.end)
        blank = first == last
        solid = np.append(solid, 0)
        self.key_begin = np.where(blank, self.begin, solid[first])
        self.key_end = np.where(blank, self.begin, solid[last - 1] + 1)
        points = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))
        self.key_points = points[self.key_end] - points[self.key_begin]
        self.low = low

    def hashes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines with keys of so many code points, both halves of the hashes of their keys)."""
        long = np.flatnonzero(self.key_points >= least)
        low, digest = self.low.tobytes(), xxhash.xxh3_128_digest
        made = b"".join(digest(low[a:b], SEED) for a, b in zip(self.key_begin[long].tolist(), self.key_end[long].tolist(), strict=True))
        both = np.frombuffer(made, ">i8").reshape(-1, 2).astype(np.int64)
        return long, both[:, 0], both[:, 1]


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, n, last): of each task's documents how many hold each line, and the largest doc_id; needs doc_id and text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for part in passes(b.column("text")):
                lines = Lines(part)
                long, h1, h2 = lines.hashes(least_chars)
                text = np.repeat(np.arange(len(part)), lines.per_text)[long]
                order = np.lexsort((text, h2, h1))
                h1, h2, text = h1[order], h2[order], text[order]
                new = np.append(True, (np.diff(h1) != 0) | (np.diff(h2) != 0)) if len(h1) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                once = new | np.append(True, np.diff(text) != 0)[: len(new)]
                if len(first):
                    n = np.add.reduceat(once.astype(np.int64), first)
                    last = np.maximum.reduceat(ids[part.rows][text], first)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[first], h2[first], n, last)], names=["h1", "h2", "n", "last"])

    rows = docs.select("doc_id", "text").mapInArrow(run, _RUN)
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


#: Stands for a null doc_id, below all others.
NO_ID = -(1 << 63)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, last): the hash of a line, how many documents hold it, and the last of them.

    Each run is a table of ``buckets`` buckets by hash in the session's shared folder, so joins of runs are merges without a shuffle.
    ``add`` takes a batch of documents, in any order of batches; ``frequent`` gives the lines found often enough in all batches.
    """

    def __init__(self, spark: SparkSession, least_docs: int = 3, least_chars: int = 20, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.least_docs, self.least_chars, self.fanout = spark, least_docs, least_chars, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = []

    def add(self, docs: DataFrame) -> None:
        new = line_hashes(docs, self.least_chars)
        for name in self.names():
            # an earlier run that has the line settled leaves nothing to add
            run = self.spark.table(name).where(F.col("n") >= self.least_docs)
            met = (new["h1"] == run["h1"]) & (new["h2"] == run["h2"]) & (new["last"] <= run["last"])
            new = new.join(run.hint("merge"), met, "left_anti")
        self._put(self._write(new), 0)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            held, self.levels[level] = self.levels[level], []
            self._put(self._write(self._merged(held)), level + 1)
            for old in held:
                self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """Sorted runs as one: counts add up, the later document counts."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = a.alias("a"), b.alias("b")
            met = a.join(b.hint("merge"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
            n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            return met.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"), n.cast("long").alias("n"), F.greatest("a.last", "b.last").alias("last"))

        return reduce(two, map(self.spark.table, names))

    def _write(self, rows: DataFrame) -> str:
        name = f"tidewell_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/{name}"
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        """Forget a run and delete its files, which no later step reads."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark).rstrip('/')}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Forget all runs; nothing that was taken from them lazily can be read any more."""
        for name in self.names():
            self._drop(name)
        self.levels = []

    def frequent(self) -> DataFrame:
        """(h1, h2, last) of the lines that at least ``least_docs`` documents hold; the runs must stay while it is used."""
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, last long")
        return self._merged(names).where(F.col("n") >= self.least_docs).select("h1", "h2", "last")


def batches_by_id(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The documents as so many ranges of doc_id, the largest ids first; null ids are in the last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    edges = [low + (high + 1 - low) * k // batches for k in range(1, batches)]
    at = F.col("doc_id")
    out = [docs.where(at >= edges[-1])] if edges else []
    out += [docs.where((at >= a) & (at < b)) for b, a in zip(edges[::-1], edges[-2::-1], strict=False)]
    return [*out, docs.where((at < edges[0]) | at.isNull())] if edges else [docs]


def _without(lines: Lines, gone: np.ndarray) -> list[bytes]:
    """The texts' lines that are not gone, joined."""
    data, out, at = lines.data.tobytes(), [], 0
    stay, begin, end = (~gone).tolist(), lines.begin.tolist(), lines.end.tolist()
    for n in lines.per_text.tolist():
        out.append(b"\n".join(data[begin[k] : end[k]] for k in range(at, at + n) if stay[k]))
        at += n
    return out


def _found(frequent: np.ndarray, last: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a line is frequent, the document that keeps it); frequent: sorted pairs of hashes."""
    pairs = np.empty(len(h1), frequent.dtype)
    pairs["h1"], pairs["h2"] = h1, h2
    if not len(frequent):
        return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
    # pairs with equal first halves are as good as never found, so a few steps to the right reach the second half
    at = np.searchsorted(frequent["h1"], h1)
    hit, keeper = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
    while True:
        inside = np.minimum(at, len(frequent) - 1)
        same = (at < len(frequent)) & (frequent["h1"][inside] == h1)
        if not same.any():
            return hit, keeper
        met = same & (frequent["h2"][inside] == h2)
        hit |= met
        keeper[met] = last[inside[met]]
        at = at + 1


_PAIR = np.dtype([("h1", np.int64), ("h2", np.int64)])
_OUT = "n_lines long, n_dropped long, kept string"


def _dropping(docs: DataFrame, least_chars: int, frequent: DataFrame, text: str, key: str) -> DataFrame:
    """docs and _OUT's columns, with frequent (h1, h2, last) sent to all tasks."""
    spark = docs.sparkSession
    t = frequent.toArrow()
    h = np.empty(len(t), _PAIR)
    h["h1"], h["h2"] = t.column("h1").to_numpy(), t.column("h2").to_numpy()
    order = np.argsort(h, order=("h1", "h2"))
    sent = spark.sparkContext.broadcast((h[order], t.column("last").to_numpy()[order]))
    names = [*docs.columns, "n_lines", "n_dropped", "kept"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = sent.value
        for b in batches:
            ids = b.column(key).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n_lines, n_dropped, kept = [], [], []
            for part in passes(b.column(text)):
                lines = Lines(part)
                long, h1, h2 = lines.hashes(least_chars)
                at = np.repeat(np.arange(len(part)), lines.per_text)
                hit, keeper = _found(known, last, h1, h2)
                gone = np.zeros(len(lines.begin), bool)
                gone[long] = hit & (keeper != ids[part.rows][at[long]])
                n_lines.append(lines.per_text)
                n_dropped.append(np.bincount(at[gone], minlength=len(part)))
                kept += _without(lines, gone)
            if len(b):
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_lines, n_dropped)]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns, pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), _OUT]))


def _dropping_by_join(docs: DataFrame, least_chars: int, frequent: DataFrame, text: str, key: str) -> DataFrame:
    """The same without sending frequent anywhere: lines are rows that are joined by hash, and only the lines to be dropped go on.

    Each row of docs needs an identity to be joined by again: its lines' hashes name it by a hash of its columns, and equal rows
    lose the same lines.
    """
    row, named = unused("row", docs), docs.columns
    spot = F.struct(*[F.xxhash64(F.lit(k), *[F.col(c) for c in (key, text)]) for k in (1, 2)])
    docs = docs.withColumn(row, spot)

    @released
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_row = 0
            for part in passes(b.column("text_")):
                lines = Lines(part)
                long, h1, h2 = lines.hashes(least_chars)
                at = np.repeat(np.arange(len(part)), lines.per_text)
                place = np.arange(len(at)) - np.repeat(np.cumsum(lines.per_text) - lines.per_text, lines.per_text)
                take = pa.array(at[long] + at_row)
                yield pa.RecordBatch.from_arrays([b.column("row_").take(take), b.column("id_").take(take), pa.array(place[long].astype(np.int32)), pa.array(h1), pa.array(h2)], names=["row_", "id_", "place", "h1", "h2"])
                at_row += len(part)

    spots = "struct<col1:bigint,col2:bigint>"
    lines = docs.select(F.col(row).alias("row_"), F.coalesce(key, F.lit(NO_ID)).alias("id_"), F.col(text).alias("text_")).mapInArrow(numbered, f"row_ {spots}, id_ long, place int, h1 long, h2 long")
    gone = lines.join(frequent, ["h1", "h2"]).where("id_ <> last").groupBy("row_").agg(F.collect_set("place").alias("gone_"))
    met = docs.join(gone.select(F.col("row_").alias(row), F.col("gone_").alias(unused("gone", docs))), row, "left").drop(row)
    dropped = met.columns[-1]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            listed = b.column(dropped).to_pylist()
            n_lines, n_dropped, kept, at_row = [], [], [], 0
            for part in passes(b.column(text)):
                lines = Lines(part)
                begins = np.cumsum(lines.per_text) - lines.per_text
                gone = np.zeros(len(lines.begin), bool)
                for k in range(len(part)):
                    gone[begins[k] + np.array(listed[at_row + k] or [], np.int64)] = True
                    n_dropped.append(len(listed[at_row + k] or []))
                n_lines += lines.per_text.tolist()
                kept += _without(lines, gone)
                at_row += len(part)
            columns = [b.column(c) for c in named]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*named, "n_lines", "n_dropped", "kept"])

    return met.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != row), _OUT]))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, most_sent: int = MOST_SENT) -> DataFrame:
    """docs (doc_id, text) with n_lines, n_dropped and kept: lines that many documents hold stay in the last of them only.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of at least ``least_chars`` code points
    that at least ``least_docs`` documents hold lose all their lines except in the largest doc_id that holds them (there all stay).
    The other lines, as they were, are joined by \\n into kept. Keys are told apart by hashes of 128 bits.

    A null or empty text is one empty line. Each row is a document, also where doc_ids repeat: all rows of the largest doc_id keep the line.
    Null doc_ids lie below all others. Repeated rows give repeated results; other columns are ignored. An empty table gives an empty one.

    The documents go in ``batches`` ranges of doc_id, the last first, through LineRuns. The lines found frequent are sent
    to all tasks if there are at most ``most_sent`` (a proven size), else they are joined by hash.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = LineRuns(spark, least_docs, least_chars)
    for batch in batches_by_id(docs, batches):
        runs.add(batch)
    frequent = runs.frequent()
    if frequent.count() > most_sent:
        return _dropping_by_join(docs, least_chars, frequent, "text", "doc_id")
    out = _dropping(docs, least_chars, frequent, "text", "doc_id")
    runs.clear()
    return out
