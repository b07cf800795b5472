"""Two tokenizers side by side: where they cut the same texts, which pieces they cut differently, and which tokens they use."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidewell.llm.bytestext import Texts, passes

#: A tokenizer here gives a token's id and where it ends in the text, in characters; tokens follow each other without gaps.
Tokenizer = Callable[[str], list[tuple[int, int]]]


#: A task hands on texts once they have so many tokens; a longer text goes alone.
BATCH_TOKENS = 1 << 18


def encoded(rows: DataFrame, text: str, name: str, tokenizer: Tokenizer) -> DataFrame:
    """Adds {name}_ids and {name}_ends; a null text has no tokens. A task holds the tokens of a few texts at a time, as plain numbers."""
    schema = StructType([*rows.schema.fields, StructField(f"{name}_ids", ArrayType(LongType())), StructField(f"{name}_ends", ArrayType(IntegerType()))])
    own = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                begin, ids, ends, offsets = at, array("q"), array("i"), [0]
                while at < b.num_rows and len(ids) < BATCH_TOKENS:
                    x = b.column(own)[at].as_py()
                    for i, e in tokenizer(x) if x is not None else ():
                        ids.append(i)
                        ends.append(e)
                    offsets.append(len(ids))
                    at += 1
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(v, dtype))) for v, dtype in ((ids, np.int64), (ends, np.int32))]
                yield pa.RecordBatch.from_arrays([*b.slice(begin, at - begin).columns, *lists], schema.names)

    return rows.mapInArrow(run, schema)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds n_a and n_b (tokens), n_cuts (places where both cut), n_same (stretches that are one token in both) and first_difference
    (the first character of the first token of a that b hasn't, or null). Tokens without characters count in n_a and n_b alone."""
    # a token's stretch as one number, start and end, since sets of numbers are hashed and sets of structs are compared one by one
    ends = lambda n: F.array_distinct(F.filter(f"{n}_ends", lambda e: e > 0))
    spans = lambda c: F.zip_with(F.slice(F.concat(F.array(F.lit(0)), c), F.lit(1), F.size(c)), c, lambda s, e: s.cast("long") * (1 << 32) + e)
    out = rows.withColumns({"cut_a_": ends(a), "cut_b_": ends(b)}).withColumns({"span_a_": spans(F.col("cut_a_")), "span_b_": spans(F.col("cut_b_"))})
    long = lambda c: c.cast("long")
    out = out.withColumns({
        "n_a": long(F.size(f"{a}_ends")), "n_b": long(F.size(f"{b}_ends")), "n_cuts": long(F.size(F.array_intersect("cut_a_", "cut_b_"))),
        "n_same": long(F.size(F.array_intersect("span_a_", "span_b_"))), "first_difference": F.shiftright(F.array_min(F.array_except("span_a_", "span_b_")), 32),
    })
    return out.drop("cut_a_", "cut_b_", "span_a_", "span_b_")


def differing_pieces(rows: DataFrame, text: str, a: str, b: str) -> DataFrame:
    """(piece, split_a, split_b, n): the stretches between two neighbouring common cuts that a and b split differently, over all texts.

    A text passes once, both ends side by side; rows leave a task as pieces, which are counted before they are shuffled.
    """
    schema = "piece string, split_a array<string>, split_b array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, ends_a, ends_b = (batch.column(c)[row].as_py() for c in range(3))
                out, at, j, left, right = [], 0, 0, [], []
                ends_b = [e for e in ends_b if e > 0]
                for end in ends_a:
                    if end > (left[-1] if left else at):
                        left.append(end)
                    while j < len(ends_b) and ends_b[j] <= end:
                        if ends_b[j] > (right[-1] if right else at):
                            right.append(ends_b[j])
                        j += 1
                    if left and right and left[-1] == right[-1]:
                        if left != right:
                            out.append((x[at:end], *([x[p:q] for p, q in zip([at, *cuts], cuts, strict=False)] for cuts in (left, right))))
                        at, left, right = end, [], []
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.list_(pa.string())) for k in (1, 2))], ["piece", "split_a", "split_b"])

    found = rows.select(F.coalesce(text, F.lit("")), f"{a}_ends", f"{b}_ends").mapInArrow(run, schema)
    return found.groupBy("piece", "split_a", "split_b").agg(F.count("*").alias("n"))


def used_ids(rows: DataFrame, name: str) -> DataFrame:
    """(id, n): each id that the texts use, and how often."""
    return rows.select(F.explode(f"{name}_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def vocabulary_differences(a: DataFrame, b: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(id, token_a, token_b) where two vocabularies (id, token) don't map an id to the same token; of ``used`` ids (id) alone, if given."""
    left, right = a.select("id", F.col("token").alias("token_a")), b.select("id", F.col("token").alias("token_b"))
    met = left.join(right, "id", "full_outer")
    if used is not None:
        met = used.select("id").distinct().join(met, "id", "left")
    return met.where(~F.col("token_a").eqNullSafe(F.col("token_b")) | F.col("token_a").isNull())


class Runs:
    """A tokenizer whose tokens are the longest runs of characters of one class, or each character alone in a class of ``single``.

    classes: the bytes of each class, ASCII alone; all other characters are of one more class. Tokens hang on no text beside them, so that a stretch between two
    cuts is cut as it stands alone. Ids are the tokens' CRC-32.
    """

    def __init__(self, classes: Sequence[bytes], single: Sequence[int] = ()):
        if any(c >= 128 for k in classes for c in k):
            raise ValueError("a class holds ASCII characters alone")
        self.kinds, self.single = np.full(256, len(classes), np.uint8), tuple(single)
        for k, known in enumerate(classes):
            self.kinds[[*known]] = k

    def cuts(self, part: Texts) -> np.ndarray:
        """Whether a token ends before each byte; a text's last token ends before the byte behind the text."""
        kind = self.kinds[part.data]
        kind[part.ends] = 255
        cut = np.empty(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        for k in self.single:
            alone = kind == k
            if k == self.kinds[255]:
                alone &= (part.data & 0xC0) != 0x80
            cut |= alone
        cut[part.starts] = False
        return cut

    def __call__(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for part in passes(pa.array([text])):
            ends, first = np.flatnonzero(self.cuts(part)), 0
            for last, end in zip(ends.tolist(), np.cumsum((part.data & 0xC0) != 0x80)[ends - 1].tolist(), strict=True):
                out.append((zlib.crc32(part.data[first:last].tobytes()), end))
                first = last
        return out


def _per_text(marked: np.ndarray, part: Texts) -> np.ndarray:
    """How many of the ascending places in ``marked`` lie behind each text's first byte, up to the byte behind the text."""
    return np.searchsorted(marked, part.ends, "right") - np.searchsorted(marked, part.starts, "right")


def _starts(ends: np.ndarray, n: np.ndarray, part: Texts) -> np.ndarray:
    """Where the tokens begin that end there; n: how many each text has."""
    out = np.empty(len(ends), np.int64)
    out[1:] = ends[:-1]
    some = n > 0
    out[(np.cumsum(n) - n)[some]] = part.starts[some]
    return out


def _measured(part: Texts, a: Runs, b: Runs) -> list[pa.Array]:
    """What ``agreement`` adds, for each text of a pass."""
    cut_a, cut_b = a.cuts(part), b.cuts(part)
    ends_a, ends_b, both = np.flatnonzero(cut_a), np.flatnonzero(cut_b), np.flatnonzero(cut_a & cut_b)
    n_a, n_b = _per_text(ends_a, part), _per_text(ends_b, part)
    from_a, from_b = _starts(ends_a, n_a, part), _starts(ends_b, n_b, part)
    shared = cut_b[ends_a]
    same = np.zeros(len(ends_a), bool)
    same[shared] = from_a[shared] == from_b[cut_a[ends_b]]
    odd = np.append(from_a[~same], len(part.data))  # a text's tokens that the other one hasn't begin in [start, end)
    first = odd[np.searchsorted(odd, part.starts)]
    none = first >= part.ends
    before = np.append(0, np.cumsum((part.data & 0xC0) != 0x80))
    place = before[np.where(none, part.starts, first)] - before[part.starts]
    counts = [n_a, n_b, _per_text(both, part), _per_text(ends_a[same], part)]
    return [*(pa.array(n.astype(np.int64)) for n in counts), pa.array(place.astype(np.int64), mask=none)]


def compared(rows: DataFrame, text: str, a: Runs, b: Runs) -> DataFrame:
    """The rows without their text, with what ``agreement`` adds of two tokenizers by runs, in one pass over the bytes that keeps no tokens."""
    added = ("n_a", "n_b", "n_cuts", "n_same", "first_difference")
    others = [c for c in rows.columns if c != text]
    schema = StructType([*(rows.schema[c] for c in others), *(StructField(c, LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch.column(len(others))):
                own = batch.slice(part.rows.start, part.rows.stop - part.rows.start).columns[: len(others)]
                yield pa.RecordBatch.from_arrays([*own, *_measured(part, a, b)], schema.names)

    return rows.select(*others, text).mapInArrow(run, schema)


def _stretches(part: Texts, a: Runs, b: Runs) -> pa.StringArray:
    """The stretches between two neighbouring common cuts that a and b split differently."""
    cut_a, cut_b = a.cuts(part), b.cuts(part)
    last = np.flatnonzero(cut_a & cut_b)
    first = _starts(last, _per_text(last, part), part)
    tokens = np.cumsum(cut_a, dtype=np.int32) + np.cumsum(cut_b, dtype=np.int32)
    odd = tokens[last] - tokens[first] > 2  # a stretch without a cut inside is one token of both
    first, last = first[odd], last[odd]
    edge = np.zeros(len(part.data) + 1, np.int8)
    edge[first] += 1
    edge[last] -= 1
    letters = part.data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offsets = np.append(0, np.cumsum(last - first)).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters))


def _split(part: Texts, tokenizer: Runs) -> pa.ListArray:
    """Each text's tokens."""
    ends = np.flatnonzero(tokenizer.cuts(part))
    n = _per_text(ends, part)
    behind = np.zeros(len(part.data), bool)
    behind[part.ends] = True
    offsets = np.append(0, np.cumsum(ends - _starts(ends, n, part))).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(part.data[~behind]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), tokens)


def pieces_apart(rows: DataFrame, text: str, a: Runs, b: Runs) -> DataFrame:
    """What ``differing_pieces`` gives, of two tokenizers by runs: stretches are counted first and each different one is split once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch.column(0)):
                counted = _stretches(part, a, b).value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["piece", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch.column(0)):
                own = batch.slice(part.rows.start, part.rows.stop - part.rows.start)
                yield pa.RecordBatch.from_arrays([own.column(0), _split(part, a), _split(part, b), own.column(1)], ["piece", "split_a", "split_b", "n"])

    counts = rows.select(text).mapInArrow(found, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(split, "piece string, split_a array<string>, split_b array<string>, n long")
