"""Phrase collocations: counts of padded longest windows, summed to shorter phrases by ROLLUP, and scored by their weakest cut.

Every word occurrence is the head of one window of the longest length: the word and the words that its lead columns
hold, padded with empty words where its piece ends. Only such windows are counted; a shorter phrase's count is
the sum over all windows that begin with it, which ROLLUP takes for all lengths at once.

Windows are nearly all different, so they are cut short before they are shuffled: hashes of the prefixes of all windows
are counted first, and a window ends before the first prefix whose hash is found fewer than ``least`` times. A hash is found at
least as often as any phrase that has it, so no phrase of ``least`` occurrences loses one; what is left is counted by its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.bytestext import mix, passes
from tidewell.llm.sparktools import arrow_batches, released, written

#: Bytes of text whose windows are counted together before they leave a task.
CHUNK_BYTES = 5 << 20
#: Bytes of text for each slot that prefix hashes are dealt to, and the fewest slots, as a power of two.
SLOT_BYTES, LEAST_SLOT_BITS = 4 << 20, 8
#: The most frequent prefix hashes (8 bytes each) that are sent to all tasks; more of them are sent as marks in 2**MARK_BITS bits.
MOST_SENT, MARK_BITS = 1 << 23, 29
#: Pre-selection groups of the last ranking, from many to few.
SALTS = (256, 16)

#: Byte classes: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Windows:
    """The windows of some texts: ``ids`` of the words (into ``words``, -1 for padding) by place and column, and ``lang`` codes."""

    def __init__(self, words: pa.Array, ids: np.ndarray, lang: np.ndarray, langs: list[str]):
        self.words, self.ids, self.lang, self.langs = words, ids, lang, langs

    def counted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lang, ids, n) of the different rows of language and ids."""
        size = len(self.words) + 1
        if len(self.langs) * size ** ids.shape[1] < 1 << 62:
            key = self.lang.astype(np.int64)
            for k in range(ids.shape[1]):
                key = key * size + (ids[:, k] + 1)
            key, n = np.unique(key, return_counts=True)
            out = np.empty((len(key), ids.shape[1]), np.int64)
            for k in range(ids.shape[1] - 1, -1, -1):
                key, out[:, k] = np.divmod(key, size)
            return key, out - 1, n
        both, n = np.unique(np.column_stack((self.lang, ids)), axis=0, return_counts=True)
        return both[:, 0], both[:, 1:], n

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the languages and of the words."""
        one = lambda x: xxhash.xxh64_intdigest(x or b"", 7)
        return np.array([one(x.encode()) for x in self.langs], np.uint64), np.array([one(x) for x in self.words.cast(pa.binary()).to_pylist()], np.uint64)


def _with_word(h: np.ndarray, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The hashes of prefixes one word longer."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + words[ids])


def windows(texts: pa.Array, langs: pa.Array, size: int, pass_bytes: int = CHUNK_BYTES) -> Iterator[Windows]:
    for part in passes(texts, pass_bytes):
        part.data[part.ends] = 10  # no piece crosses texts
        data = part.lowered()
        kind = _CLASS[data]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        if not len(first):
            continue
        piece = np.cumsum(kind == 2, dtype=np.int32)[first]
        offsets = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
        letters = data[kind == 0]
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        at = found.indices.to_numpy(zero_copy_only=False)
        ids = np.full((len(first), size), -1, np.int32)
        ids[:, 0] = at
        for k in range(1, size):  # lead columns
            same = piece[k:] == piece[:-k]
            ids[:-k, k][same] = at[k:][same]
        per_text = np.diff(np.searchsorted(first, np.append(part.starts, len(data))))
        code = langs[part.rows].dictionary_encode()
        yield Windows(found.dictionary, ids, np.repeat(code.indices.to_numpy(zero_copy_only=False), per_text), code.dictionary.to_pylist())


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Windows]:
    """The windows of a task's texts, some CHUNK_BYTES of text at a time."""

    def made(held: list[pa.RecordBatch]) -> Iterator[Windows]:
        t = pa.Table.from_batches(held).combine_chunks()
        lang = t.column("lang").combine_chunks().fill_null("und")
        yield from windows(t.column("text"), lang, size)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= CHUNK_BYTES:
            yield from made(held)
            held, n = [], 0
    if held:
        yield from made(held)


def _prefix_counts(size: int, slot_bits: int) -> Callable:
    """Of each chunk and slot the prefix hashes: those found once, the others, and how often these are found (255: or more)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            of_lang, of_word = chunk.hashes()
            cells, counts = [], []
            for k in range(1, size + 1):
                full = chunk.ids[:, k - 1] >= 0
                lang, ids, n = Windows(chunk.words, chunk.ids, chunk.lang[full], chunk.langs).counted(chunk.ids[full, :k])
                h = of_lang[lang]
                for j in range(k):
                    h = _with_word(h, of_word, ids[:, j])
                cells.append(h >> np.uint64(32 - slot_bits))
                counts.append(np.minimum(n, 255).astype(np.uint8))
            cell, n = np.concatenate(cells), np.concatenate(counts)
            order = np.argsort(cell)
            cell, n = cell[order], n[order]
            slot, low = (cell >> np.uint64(32)).astype(np.int32), cell.astype(np.uint32)
            edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
            rows = {"slot": [], "once": [], "more": [], "counts": []}
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    one = n[a:b] == 1
                    rows["slot"].append(slot[a])
                    rows["once"].append(low[a:b][one].tobytes())
                    rows["more"].append(low[a:b][~one].tobytes())
                    rows["counts"].append(n[a:b][~one].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["slot"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("once", "more", "counts"))], names=list(rows))

    return run


def _frequent_cells(least: int) -> Callable:
    """A slot's prefix hashes that are found at least so often in all chunks together."""

    def run(t: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32) for c in ("once", "more")])
        n = np.ones(len(low), np.int64)
        more = b"".join(t.column("counts").to_pylist())
        n[len(n) - len(more) :] = np.frombuffer(more, np.uint8)
        order = np.argsort(low)
        low, n = low[order], n[order]
        begins = np.flatnonzero(np.append(True, np.diff(low) > 0)) if len(low) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, begins) if len(begins) else n
        kept = low[begins[total >= least]].astype(np.uint64) | np.uint64(t.column("slot")[0].as_py()) << np.uint64(32)
        return pa.table({"n": pa.array([len(kept)], pa.int64()), "cells": pa.array([kept.tobytes()], pa.binary())})

    return run


def _places(cell: np.ndarray, slot_bits: int) -> Iterator[np.ndarray]:
    """The two places of hashes among the marks: each slot has its own stretch of them."""
    bits = max(3, MARK_BITS - slot_bits)
    slot = (cell >> np.uint64(32)) << np.uint64(bits)
    for factor in (1, 0x9E3779B1):
        yield slot | ((cell * np.uint64(factor)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


class Marks:
    """A set of hashes that holds all it was given and a few others: a hash is in it if both its places are marked."""

    def __init__(self, slots: np.ndarray, marks: list[bytes], slot_bits: int):
        bits = max(3, MARK_BITS - slot_bits)
        self.slot_bits, self.table = slot_bits, np.zeros(1 << (slot_bits + bits - 3), np.uint8)
        for slot, m in zip(slots, marks, strict=True):
            at = int(slot) << (bits - 3)
            self.table[at : at + len(m)] = np.frombuffer(m, np.uint8)

    def has(self, cell: np.ndarray) -> np.ndarray:
        found = np.ones(len(cell), bool)
        for at in _places(cell, self.slot_bits):
            found &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class Listed:
    """A set of hashes as a sorted array."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def has(self, cell: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(cell), bool)
        return self.cells[np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)] == cell


def _marked(slot_bits: int) -> Callable:
    """The marks of each slot's hashes."""
    bits = max(3, MARK_BITS - slot_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cells in b.column(0).to_pylist():
                cell = np.frombuffer(cells, np.uint64)
                if len(cell):
                    one = np.zeros(1 << bits, np.uint8)
                    for at in _places(cell, slot_bits):
                        one[(at & np.uint64((1 << bits) - 1)).astype(np.int64)] = 1
                    marks = np.packbits(one, bitorder="little").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[0] >> np.uint64(32))], pa.int64()), pa.array([marks], pa.binary())], names=["slot", "marks"])

    return run


def _frequent(docs: DataFrame, size: int, least: int) -> tuple[DataFrame, int, int]:
    """(n, cells) of each slot: the hashes of prefixes that are found at least so often; how many they are, and the bits of their slots."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slot_bits = min(30, max(LEAST_SLOT_BITS, int(total // SLOT_BYTES).bit_length()))
    counted = docs.mapInArrow(_prefix_counts(size, slot_bits), "slot int, once binary, more binary, counts binary")
    cells = written(counted.groupBy("slot").applyInArrow(_frequent_cells(min(least, 255)), "n long, cells binary"))
    return cells, cells.agg(F.sum("n")).first()[0] or 0, slot_bits


def _collected(cells: DataFrame) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(r[0] for r in cells.select("cells").collect()), np.uint64))


def frequent_prefixes(docs: DataFrame, size: int, least: int) -> tuple[np.ndarray | None, int]:
    """The sorted hashes of prefixes that are found at least so often, null if they are too many to be sent, and the bits of their slots."""
    cells, n, slot_bits = _frequent(docs, size, least)
    return (None if n > MOST_SENT else _collected(cells)), slot_bits


def prefix_set(docs: DataFrame, size: int, least: int) -> tuple[Listed | Marks, int]:
    """A set that holds the hashes of all prefixes that are found at least so often, in bounded memory, and the bits of their slots.

    Too many to be listed are marked on the executors, slot by slot. Hashes that the marks hold beside them leave some windows longer than need be and change no count.
    """
    cells, n, slot_bits = _frequent(docs, size, least)
    if n <= MOST_SENT:
        return Listed(_collected(cells)), slot_bits
    marked = cells.select("cells").mapInArrow(_marked(slot_bits), "slot long, marks binary").collect()
    return Marks([r[0] for r in marked], [r[1] for r in marked], slot_bits), slot_bits


def window_counts(docs: DataFrame, size: int, least: int) -> DataFrame:
    """(lang, w1 .. w<size>, n): how often windows are found, each cut short before its first infrequent prefix, with empty words behind.

    A window whose first word is infrequent is all empty, so that each language's counts sum to its words.
    """
    known, slot_bits = prefix_set(docs, size, least)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for chunk in _chunks(batches, size):
            of_lang, of_word = chunk.hashes()
            alive, h = np.arange(len(chunk.ids)), of_lang[chunk.lang]
            for k in range(size):
                stay = chunk.ids[alive, k] >= 0
                alive, h = alive[stay], h[stay]
                h = _with_word(h, of_word, chunk.ids[alive, k])
                good = frequent.has(h >> np.uint64(32 - slot_bits))
                chunk.ids[alive[~good], k:] = -1
                alive, h = alive[good], h[good]
            lang, ids, n = chunk.counted(chunk.ids)
            words = pa.concat_arrays([chunk.words, pa.array([""])])
            columns = [pa.array(chunk.langs, pa.string()).take(pa.array(lang))]
            columns += [words.take(pa.array(np.where(ids[:, k] < 0, len(words) - 1, ids[:, k]))) for k in range(size)]
            out = pa.Table.from_arrays([*columns, pa.array(n, pa.int64())], names=["lang", *(f"w{k + 1}" for k in range(size)), "n"])
            yield from out.to_batches(max_chunksize=50_000)

    words = ", ".join(f"w{k + 1} string" for k in range(size))
    rows = docs.mapInArrow(run, f"lang string, {words}, n long")
    return rows.groupBy("lang", *(f"w{k + 1}" for k in range(size))).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, size: int, least: int) -> DataFrame:
    """(lang, size, phrase, f): all phrases of 1 to ``size`` words found at least so often; of size 0 each language's number of words."""
    names = [f"w{k + 1}" for k in range(size)]
    rows = window_counts(docs, size, least).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # the bits of g: which columns, from the last, are summed over
    length = F.lit(None).cast("int")
    for k in range(size + 1):
        length = F.when(F.col("g") == (1 << (size - k)) - 1, k).otherwise(length)
    rows = rows.withColumn("size", length).where("size is not null")  # without the total of all languages
    last = F.element_at(F.array(F.lit("-"), *names), F.col("size") + 1)
    rows = rows.where((F.col("size") == 0) | ((F.col("f") >= least) & (last != "")))
    return rows.select("lang", "size", F.concat_ws(" ", *[F.when(F.col("size") > k, F.col(c)) for k, c in enumerate(names)]).alias("phrase"), "f")


def _first_of_each(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key with their rank: first of many parts of a key, then of fewer, so that no task sorts a whole key."""
    tie = F.xxhash64("phrase")
    for n in SALTS:
        salted = rows.withColumn("salt", F.pmod(tie, F.lit(n)))
        rows = salted.withColumn("rank", F.row_number().over(W.partitionBy(key, "salt").orderBy(*order))).where(F.col("rank") <= most).drop("salt", "rank")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, size: int = 3, least: int = 10, most: int = 2000, inside: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``size`` words found at least ``least`` times.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs; phrases lie within
    pieces. A phrase found a times is cut after its first k words into parts found l and r times; its score is the least of
    floor(1000000 a a / (l r)), of equals that of the smallest k. Left out are phrases inside a longer candidate that is found at
    least ``inside`` percent as often. n: the language's words. All counts and products are exact (decimals of 38 digits).

    A null language is ``und``; null and empty texts have no words, and a language without words has no rows. Rows count as
    they stand, repeated ones repeatedly, whatever their doc_id; other columns are ignored. Ties of score and a go by the
    phrase's bytes. An empty table gives an empty one. A word has no length limit.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select("text", "lang")
    counts = written(phrase_counts(docs, size, least))  # frequent phrases alone
    phrases = counts.where("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    # each candidate's most frequent longer one, from the longer ones' parts
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(i, n))))
    longer = found.where("size > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where((F.col("longer").isNull()) | (100 * F.col("longer").cast("decimal(20,0)") < inside * F.col("a").cast("decimal(20,0)")))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("size") - k).alias("right")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns({f"{c}_": v for c, v in whole.items()}).withColumn("score", F.expr("(a_ * a_ * 1000000BD) div (l_ * r_)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    ranked = _first_of_each(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
