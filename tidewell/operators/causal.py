"""Joins by time: strict prefixes, as-of in both directions, neighbours, intervals. Keys are columns, times micros."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.sequence import passed


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without zone, in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def strictly_before(keys: str | Sequence[str], at: str):
    """The frame of all rows of the key with a smaller time; rows of equal time are not in it."""
    return W.partitionBy(*_keys(keys)).orderBy(at).rangeBetween(W.unboundedPreceding, -1)


def prefix_digests(rows: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """Adds n_context, how many texts of the key come strictly before, and context_sha256, the digest of those joined by line ends.

    A key's rows pass once in order while one running digest is carried on, so no task holds a key's texts. Null texts
    don't count; rows of equal time aren't in each other's context, and follow each other by text in later ones.
    """
    kept = [c for c in rows.columns if c != text]
    rows = rows.select(*kept, text)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema if f.name != text)}, n_context long, context_sha256 string"
    own, time = kept.index(key), kept.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, digest, n, waiting = None, False, hashlib.sha256(), 0, []
        for b in batches:
            counts, digests = [], []
            for k, t, x in zip(b.column(own).to_pylist(), b.column(time).to_pylist(), b.column(len(kept)).to_pylist(), strict=True):
                if not begun or k != last[0]:
                    digest, n, waiting = hashlib.sha256(), 0, []
                elif t != last[1]:
                    for w in waiting:
                        digest.update(("\n" + w if n else w).encode())
                        n += 1
                    waiting = []
                begun, last = True, (k, t)
                if x is not None:
                    waiting.append(x)
                counts.append(n)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array(digests, pa.string())], [*kept, "n_context", "context_sha256"])

    return passed(rows, [key], [at, text]).mapInArrow(run, schema)


def causal_count(rows: DataFrame, keys: str | Sequence[str], at: str, name: str = "n_before") -> DataFrame:
    """How many rows of the key come strictly before each; linear in the rows, no pairs are made."""
    return rows.withColumn(name, F.count("*").over(strictly_before(keys, at)))


def asof_backward(rows: DataFrame, keys: str | Sequence[str], at: str, when: Column, value: Column, name: str) -> DataFrame:
    """The value of the latest row of the key strictly before each for which ``when`` holds; null if none.

    One sort of the key, whatever the distance. Of several at one time, the largest value.
    """
    best = F.max_by(F.when(when, value), F.when(when, F.struct(F.col(at), value))).over(strictly_before(keys, at))
    return rows.withColumn(name, best)


def asof_forward(rows: DataFrame, keys: str | Sequence[str], at: str, when: Column, value: Column, name: str) -> DataFrame:
    """The value of the earliest row strictly after each for which ``when`` holds; of several at one time, the smallest.

    In falling order of time what comes after has gone before, so the frame grows row by row like asof_backward's.
    """
    after = W.partitionBy(*_keys(keys)).orderBy(F.col(at).desc()).rangeBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.min_by(F.when(when, value), F.when(when, F.struct(F.col(at), value))).over(after))


def neighbours(rows: DataFrame, keys: str | Sequence[str], order: Sequence[str], first: int, last: int, value: Column, name: str) -> DataFrame:
    """The values of rows first..last places away in order, as an array from the earliest."""
    return rows.withColumn(name, F.collect_list(value).over(W.partitionBy(*_keys(keys)).orderBy(*order).rowsBetween(first, last)))


#: How much coarser each grid of interval_join is than the one before, and how many there are.
COARSER, GRIDS = 16, 12


def _grid(lo: Column, hi: Column, width: int) -> Column:
    """The first grid on which a span covers no more than COARSER + 1 slices."""
    out = F.lit(GRIDS - 1)
    for k in range(GRIDS - 2, -1, -1):
        out = F.when(hi - lo <= F.lit(float(width) * COARSER ** (k + 1)), k).otherwise(out)
    return out


def _cells(lo: Column, hi: Column, width: int, grid: int) -> Column:
    """(grid_, slice_) of a span on one grid."""
    size = F.lit(float(width) * COARSER**grid)
    return F.transform(F.sequence(F.floor(lo / size), F.floor(hi / size)), lambda s: F.struct(F.lit(grid).alias("grid_"), s.alias("slice_")))


def _slices(lo: Column, hi: Column, width: int, grids: list[int]) -> Column:
    """The cells of a span on its own grid and on all coarser ones of ``grids``."""
    none = F.array().cast("array<struct<grid_:int,slice_:bigint>>")
    return F.flatten(F.array(*[F.when(_grid(lo, hi, width) <= g, _cells(lo, hi, width, g)).otherwise(none) for g in grids]))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of the same key whose closed spans [from, to] overlap. Columns of both sides, the keys once.

    Spans are put on a grid of ``width``, so a pair is met in the slices that both cover, and kept only in the
    first of them. The join is an equality of key and slice: long keys spread over many tasks, and no key is a
    nested loop. A span of many slices goes to a coarser grid instead, on which the others stand as well, so that it makes
    some twenty rows at most, however long it is; a pair is met on the coarser one's grid. Spans that end before
    they begin, or have no beginning or end, overlap nothing. Choose a width near the usual span. Column names but the keys must differ.
    """
    (a, b), (c, d) = left_span, right_span
    sides = [left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))]
    own = [_grid(F.col(a), F.col(b), width), _grid(F.col(c), F.col(d), width)]
    used = sides[0].select(own[0].alias("g")).union(sides[1].select(own[1].alias("g"))).distinct()
    grids = sorted(r[0] for r in used.collect())  # GRIDS rows at most
    if not grids:
        grids = [0]
    x, y = (s.withColumn("cell_", F.explode(_slices(F.col(p), F.col(q), width, grids))) for s, (p, q) in zip(sides, (left_span, right_span), strict=True))
    x, y = (t.select(*[F.col(n) for n in t.columns if n != "cell_"], "cell_.grid_", "cell_.slice_") for t in (x, y))
    met = x.join(y, [*keys, "grid_", "slice_"])
    size = F.lit(1.0)
    for g in grids:
        size = F.when(F.col("grid_") == g, F.lit(float(width) * COARSER**g)).otherwise(size)
    first = F.floor(F.greatest(F.col(a), F.col(c)) / size)
    here = F.greatest(_grid(F.col(a), F.col(b), width), _grid(F.col(c), F.col(d), width)) == F.col("grid_")
    return met.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & here & (F.col("slice_") == first)).drop("grid_", "slice_")


def superseded_reads(reads: DataFrame, writes: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Reads with the write that makes each stale: last_activity < began_at <= captured_at <= terminal_at.

    reads: (keys, read_id, last_activity, captured_at); writes: (keys, write_id, began_at, terminal_at). Of several writes the
    one that began first, then the smallest id. Reads without one are not returned: an anti join with them accepts.
    """
    spans = reads.withColumn("captured_to", F.col("captured_at"))
    met = interval_join(spans, writes, keys, ("captured_at", "captured_to"), ("began_at", "terminal_at"), width)
    met = met.where(F.col("last_activity") < F.col("began_at"))
    return met.groupBy(*keys, "read_id").agg(F.min_by("write_id", F.struct("began_at", "write_id")).alias("write_id"), F.min("began_at").alias("began_at"))
