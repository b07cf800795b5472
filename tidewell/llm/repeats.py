"""Repeated passages: sparse suffix buckets, a tree of LCP intervals each, and the removal of later occurrences.

Every string of ``min_len`` bytes holds an anchor: the k-gram with the smallest hash, the leftmost of ties.
Equal strings have their anchors at the same place, so equal strings always meet in the bucket of their anchor. The strings
of consecutive starts with one anchor form a context of at most 2 * min_len bytes. Equal contexts are reduced to
their first by a map-side-combined minimum; the different contexts of a bucket get an enhanced suffix array.

A bucket of too many different contexts is split by further bytes: contexts are cut into pieces by the anchor's place in the
string, and a piece's bucket is named by all bytes that its strings share. The narrower the places, the more bytes are shared, up to
whole strings, which are equal in a bucket; so a bucket of any size ends in small ones, each with a suffix array of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import Texts, firsts, mix, passes, powers, raw_texts, substring_hash
from tidewell.llm.sparktools import arrow_batches, cut, partitions, released, unused

#: Bytes in a repeated string at least, and in an anchor.
MIN_LEN, GRAM = 100, 24
#: Contexts whose suffixes are sorted together, whole buckets only; different contexts in a bucket before it is split; pieces of a split.
TOGETHER, KINDS, WAYS = 4096, 2048, 4
#: Bits of a place: the context's start, the anchor's place in it, and how many starts it has beyond the first.
ANCHOR_BITS = 12


def placed(lo: np.ndarray, anchor: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A place as one number, in the order of the starts."""
    return (lo << (2 * ANCHOR_BITS)) | (anchor << ANCHOR_BITS) | more


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    few = (1 << ANCHOR_BITS) - 1
    return place >> (2 * ANCHOR_BITS), (place >> ANCHOR_BITS) & few, place & few


def named(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of the strings of a context: equal strings around different anchors are different contexts."""
    return mix(substring_hash(prefix, first, last) + anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + more.astype(np.uint64))


def contexts(texts: Texts, min_len: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each context in a pass: its text, its place in the text, anchor and context hashes."""
    data, prefix = texts.data, texts.prefix()
    none = np.zeros(0, np.int64)
    if len(data) <= min_len:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    grams = len(data) - gram + 1
    h = mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][:grams])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    width, span = min_len - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    windows = np.maximum(texts.ends - texts.starts - min_len + 1, 0)
    s = np.repeat(texts.starts - firsts(windows), windows) + np.arange(windows.sum())
    if not len(s):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (low[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(s) != 1))))
    lo, hi, a = s[begins], s[np.append(begins[1:], len(s)) - 1], anchor[begins]
    text = np.searchsorted(texts.starts, lo, "right") - 1
    place = placed(lo - texts.starts[text], a - lo, hi - lo)
    return text, place, h[a], named(prefix, lo, hi + min_len, a - lo, hi - lo)


def lcp_tree(lcp: np.ndarray, seen: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The common-prefix interval tree of sorted suffixes, by one stack scan: all nodes of depth >= least.

    lcp[i] is the common prefix length of suffixes i - 1 and i, lcp[0] is 0; seen[i] ranks suffix i by where it starts. Returns
    the nodes' depth, first and last suffix and earliest suffix, and for each suffix the deepest node that holds an earlier one, or -1. A
    closed node hands its earliest suffix alone to the node above it, so each suffix is settled once, however deep the tree.
    """
    depth, first, last, low = [], [], [], []
    earlier, rank, stack = [-1] * len(seen), seen.tolist(), []
    for i, d in enumerate([*lcp[1:].tolist(), 0] if len(seen) else []):
        carried, left = i, i
        while stack and depth[stack[-1]] > d:
            k = stack.pop()
            other = low[k]
            if rank[other] < rank[carried]:
                earlier[carried], carried = k, other
            else:
                earlier[other], low[k] = k, carried
            last[k], left = i, first[k]
        if d < least:
            continue
        if stack and depth[stack[-1]] == d:
            k = stack[-1]
            other = low[k]
            if rank[other] < rank[carried]:
                earlier[carried] = k
            else:
                earlier[other], low[k] = k, carried
        else:
            stack.append(len(depth))
            depth.append(d)
            first.append(left)
            last.append(left)
            low.append(carried)
    return tuple(np.array(x, np.int64) for x in (depth, first, last, low, earlier))


@dataclass
class Repeats:
    """Suffixes in order (string of, start at), and maximal repeats as intervals of them.

    length, first, last, low: a repeat's bytes, its first, last and earliest suffix. later: for each suffix the
    bytes of the longest maximal repeat that settles it, 0 if none does.
    """

    of: np.ndarray
    at: np.ndarray
    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    later: np.ndarray


def maximal_repeats(data: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray, least: int) -> Repeats:
    """All maximal repeats of at least ``least`` bytes among strings data[first:last], matches never crossing strings.

    order: (string, start) pairs are ranked by order[string] + start - first[string]. A repeat is an LCP interval whose
    occurrences have different bytes before them, or start a string. One that could be extended to the left in all occurrences is not
    reported, as the extended one is; nor does it settle a suffix, as the suffix before is settled by the extended one.
    """
    n_suffix = np.maximum(last - first - least + 1, 0)
    of = np.repeat(np.arange(len(first)), n_suffix)
    at = np.repeat(first - firsts(n_suffix), n_suffix) + np.arange(n_suffix.sum())
    none = np.zeros(0, np.int64)
    if not len(at):
        return Repeats(*[none] * 7)
    # only suffixes that share their first ``least`` bytes with another can be in a deep enough interval
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=prefix[1:])
    head = substring_hash(prefix, at, at + least)
    by_head = np.argsort(head, kind="stable")
    same = np.concatenate(([False], head[by_head][1:] == head[by_head][:-1], [False]))
    keep = np.sort(by_head[same[1:] | same[:-1]])
    of, at = of[keep], at[keep]
    if not len(at):
        return Repeats(*[none] * 7)
    room = last[of] - at
    wide = int(room.max())
    padded = np.concatenate((data, np.zeros(wide, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[at]
    rows[np.arange(wide)[None, :] >= room[:, None]] = 0
    by_bytes = np.argsort(np.ascontiguousarray(rows).view(f"V{wide}").ravel(), kind="stable")
    rows, of, at, room = rows[by_bytes], of[by_bytes], at[by_bytes], room[by_bytes]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.concatenate(([0], np.minimum(common, np.minimum(room[1:], room[:-1]))))
    before = np.where(at > first[of], data[at - 1].astype(np.int64), -1 - np.arange(len(at)))
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    depth, lb, rb, low, earlier = lcp_tree(lcp, order[of] + at - first[of], least)
    diverse = changes[lb] != changes[rb]
    later = np.where((earlier >= 0) & np.append(diverse, False)[earlier], np.append(depth, 0)[earlier], 0)
    return Repeats(of, at, depth[diverse], lb[diverse], rb[diverse], low[diverse], later)


def _anchored(docs: DataFrame, min_len: int, gram: int) -> DataFrame:
    """(key, whole, doc_id, place): the contexts of all texts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for texts in passes(b.column(1)):
                text, place, anchor, whole = contexts(texts, min_len, gram)
                cols = [anchor.view(np.int64), whole.view(np.int64), ids[texts.rows][text].astype(np.int64), place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "whole", "doc_id", "place"])

    return docs.mapInArrow(run, "key long, whole long, doc_id long, place long")


def _cut_out(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings data[first : first + length]."""
    ends = np.cumsum(length)
    take = np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take]))])


STRINGS = "key long, doc_id long, place long, since int, bytes binary"


def _strings(docs: DataFrame, chosen: DataFrame, min_len: int) -> DataFrame:
    """(key, doc_id, place, since, bytes) for contexts (key, doc_id, place). A text's contexts, one a byte at most and fewer than a thirtieth in
    most, travel to it as one list, which is smaller than the text's own row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw_texts(b.column(1))
            places = b.column(2)
            n = places.value_lengths().to_numpy(zero_copy_only=False)
            flat = places.flatten()
            place, key = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            doc = np.repeat(np.arange(len(n)), n)
            ids = b.column(0).to_numpy(zero_copy_only=False)[doc]
            lo, _, more = unplaced(place)
            for k in range(0, len(doc), 50_000):
                part = slice(k, k + 50_000)
                cells = _cut_out(data, offsets[doc[part]] + lo[part], more[part] + min_len)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(ids[part]), pa.array(place[part]), pa.array(np.zeros(len(cells), np.int32)), cells], STRINGS.replace(",", "").split()[::2])

    wanted = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("place", "key")).alias("places"))
    return docs.join(wanted, "doc_id").mapInArrow(run, STRINGS)


def _split(strings: DataFrame, width: int, part: int, min_len: int) -> DataFrame:
    """Pieces (key, whole, doc_id, place, since, bytes) of contexts whose anchors lie at ``since`` to since + width - 1 in their strings.

    A piece has the strings with the anchor at ``part`` neighbouring places; its key is a hash of the bytes that all strings
    with the anchor at these places share with it, min_len - part + 1 of them.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw_texts(b.column(4))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=prefix[1:])
            powers(len(prefix))
            ids, place, since = (b.column(k).to_numpy() for k in (1, 2, 3))
            lo, anchor, more = unplaced(place)
            for step in range(0, width, part):
                low = since + step
                high = np.minimum(low + part, since + width) - 1
                nearest, farthest = np.maximum(low, anchor - more), np.minimum(high, anchor)
                fit = np.flatnonzero(nearest <= farthest)
                if not len(fit):
                    continue
                a, near, far, begin = anchor[fit], nearest[fit], farthest[fit], offsets[fit]
                key = named(prefix, begin + a - low[fit], begin + a - high[fit] + min_len, low[fit], np.full(len(fit), part))
                whole = named(prefix, begin + a - far, begin + a - near + min_len, far, far - near)
                cells = _cut_out(data, begin + a - far, far - near + min_len)
                cols = [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[fit]), pa.array(placed(lo[fit] + a - far, far, far - near)), pa.array(low[fit].astype(np.int32)), cells]
                yield pa.RecordBatch.from_arrays(cols, ["key", "whole", "doc_id", "place", "since", "bytes"])

    return strings.mapInArrow(run, STRINGS.replace("key long", "key long, whole long"))


def _buckets(docs: DataFrame, min_len: int, gram: int, kinds: int) -> tuple[DataFrame, DataFrame]:
    """(copies, strings): places of contexts that occur more than once, and the different strings of buckets that hold several.

    copies: (group, doc_id, start, length, is_first). strings: as in STRINGS, no key with more than ``kinds`` of them.
    """
    if min_len - gram >= 1 << ANCHOR_BITS:
        raise ValueError(f"min_len must be less than gram + {1 << ANCHOR_BITS}")
    rows = _anchored(docs, min_len, gram)
    # kept before it is joined: Spark splits a hot key of a join only between two plain exchanges
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    rows = cut(rows.join(shared, "key"))
    width, more, copies, cold = min_len - gram + 1, [], [], []
    while True:
        heads = cut(rows.groupBy("key", "whole").agg(F.min(F.struct("doc_id", "place", *more)).alias("head"), F.count("*").alias("n")))
        start, length = F.shiftright("place", 2 * ANCHOR_BITS).cast("int"), (F.col("place").bitwiseAND(F.lit((1 << ANCHOR_BITS) - 1)) + min_len).cast("int")
        again = rows.join(heads.where("n > 1").select("key", "whole", F.struct("head.doc_id", "head.place").alias("head")), ["key", "whole"])
        copies.append(again.select(F.col("whole").alias("group"), "doc_id", start.alias("start"), length.alias("length"), (F.struct("doc_id", "place") == F.col("head")).alias("is_first")))
        several = cut(heads.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
        chosen = heads.select("key", "head.*").join(several, "key")
        few, many = (chosen.where(F.col("kinds") <= kinds), chosen.where(F.col("kinds") > kinds))
        take = (lambda x: x.select(*STRINGS.replace(",", "").split()[::2])) if more else (lambda x: _strings(docs, x, min_len))
        cold.append(take(few))
        if width == 1 or not several.where(F.col("kinds") > kinds).limit(1).count():
            break
        part = -(-width // WAYS)
        rows, width, more = cut(_split(take(many), width, part, min_len)), part, ["since", "bytes"]
    for other in copies[1:]:
        copies[0] = copies[0].union(other)
    for other in cold[1:]:
        cold[0] = cold[0].union(other)
    return copies[0], cold[0]


def _arrays(strings: DataFrame, min_len: int, all_of_them: bool) -> DataFrame:
    """Suffix arrays of whole buckets. (doc_id, start, length): what later suffixes are settled with. With all_of_them
    (part, low, high, length, doc_id, start): repeats as intervals of a part's suffixes, with the earliest one's place, and suffixes (low:
    the number in the part, high and length null)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            data, offsets = raw_texts(t.column("bytes"))
            data = data[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            ids, start = t.column("doc_id").to_numpy(), unplaced(t.column("place").to_numpy())[0]
            by_id = np.unique(ids, return_inverse=True)[1]
            found = maximal_repeats(data, offsets[:-1], offsets[1:], (by_id << 40) + start, min_len)
            doc, pos = ids[found.of], (start[found.of] + found.at - offsets[found.of]).astype(np.int32)
            if not all_of_them:
                some = np.flatnonzero(found.later)
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(pos[some]), pa.array(found.later[some].astype(np.int32))], ["doc_id", "start", "length"])
                return
            key, n, many = t.column("key")[0].as_py(), len(found.length), len(doc)
            blank = pa.nulls(many, pa.int64())
            cols = [
                pa.array(np.full(n + many, key, np.int64)),
                pa.array(np.concatenate((found.first, np.arange(many)))),
                pa.concat_arrays([pa.array(found.last), blank]),
                pa.concat_arrays([pa.array(found.length.astype(np.int32)), blank.cast(pa.int32())]),
                pa.array(np.concatenate((doc[found.low], doc))),
                pa.array(np.concatenate((pos[found.low], pos))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["part", "low", "high", "length", "doc_id", "start"])

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) >= TOGETHER:
                key = held.column("key").to_numpy()
                new = np.flatnonzero(key != key[-1])
                if len(new):  # the last bucket may go on
                    yield from work(held.slice(0, new[-1] + 1))
                    held = held.slice(new[-1] + 1)
        if held is not None and len(held):
            yield from work(held)

    dealt = strings.repartition(partitions(strings.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "part long, low long, high long, length int, doc_id long, start int" if all_of_them else "doc_id long, start int, length int")


def occurrences(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """(group, length, doc_id, start, is_first): maximal repeat groups with all their occurrences, in bytes.

    docs: (doc_id, text), doc_id distinct and not null. The groups cover every string of min_len bytes that
    occurs twice: each occurrence of such a string lies in an occurrence of a group that also holds the
    string's other ones, once with is_first. A repeat longer than a context appears as overlapping groups; a context that occurs in
    several places is a group, and stands in others by its first place. Repeats are kept as intervals of the suffixes and joined with them
    here, so that the nested ones are written out only for who asks for them.
    """
    arrow_batches(docs.sparkSession)
    copies, strings = _buckets(docs, min_len, gram, kinds)
    tree = cut(_arrays(strings, min_len, True))
    nodes = tree.where("high is not null").select("part", "low", "high", "length", F.struct("doc_id", "start").alias("head"))
    members = tree.where("high is null").select("part", F.col("low").alias("rank"), "doc_id", "start")
    deep = members.join(nodes, "part").where("rank between low and high")
    # a repeat's name: its first place and length, hashed
    deep = deep.select(F.xxhash64("head", "length").alias("group"), "length", "doc_id", "start", (F.struct("doc_id", "start") == F.col("head")).alias("is_first"))
    return copies.select("group", "length", "doc_id", "start", "is_first").union(deep)


def later_stretches(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """(doc_id, start, length): stretches that together cover the bytes of all strings of min_len bytes that start earlier as well.

    docs as in occurrences. One row at most for each later copy of a context and each suffix, however many repeats hold it.
    """
    arrow_batches(docs.sparkSession)
    copies, strings = _buckets(docs, min_len, gram, kinds)
    return copies.where("not is_first").select("doc_id", "start", "length").union(_arrays(strings, min_len, False))


def one_text_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with distinct doc_ids: of rows that repeat one, the smallest text; null ids are left out, null texts are empty."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, whole_characters: bool = False, kinds: int = KINDS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text without the bytes of strings that start earlier as well.

    Earlier: in a document of smaller doc_id, or before in the same document, judged on the input. spans are the removed
    runs (start, end) in bytes. kept is binary; with whole_characters a run gives up the bytes of
    characters that it holds in part, so that kept is UTF-8. Null texts are empty; rows without a doc_id are
    left out; of rows that repeat a doc_id the smallest text is taken; extra columns are ignored; an empty
    table gives an empty result. A text longer than a pass makes a pass of its own, so a task needs some thirty times
    its longest text.
    """
    rows = one_text_each(docs)
    later = later_stretches(rows, min_len, gram, kinds)
    spans = later.groupBy("doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("runs"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw_texts(b.column(1))
            ids, runs, out = b.column(0), b.column(2), {"spans": [], "kept": []}
            for i in range(len(b)):
                text = data[offsets[i] : offsets[i + 1]]
                edges = np.zeros(len(text) + 1, np.int32)
                if runs[i].is_valid:
                    flat = runs[i].values
                    np.add.at(edges, flat.field(0).to_numpy(), 1)
                    np.add.at(edges, flat.field(1).to_numpy(), -1)
                gone = np.cumsum(edges)[:-1] > 0
                if whole_characters and gone.any():
                    char = np.cumsum((text & 0xC0) != 0x80) - 1
                    gone = (np.bincount(char, ~gone) == 0)[char]
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).astype(np.int32)
                out["spans"].append([{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                out["kept"].append(text[~gone].tobytes())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(out["spans"], span), pa.array(out["kept"], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """docs, all columns, with each text cut down to what does not start earlier as well; n_chars follows the text.

    Rows as in remove_repeats: one for each doc_id, so of rows that repeat a doc_id one stays.
    """
    own_id, own_text, row = (unused(c, docs) for c in ("own_id", "own_text", "row"))
    cut_texts = remove_repeats(docs, min_len, gram, whole_characters=True).select(F.col("doc_id").alias(own_id), F.decode("kept", "UTF-8").alias(own_text))
    rest = docs.where("doc_id is not null")
    if rest.groupBy("doc_id").agg(F.count("*").alias(row)).where(F.col(row) > 1).limit(1).count():
        rest = rest.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.struct(F.coalesce("text", F.lit("")), F.xxhash64("*"))).alias(row)).select(f"{row}.*")
    out = rest.drop("text").join(cut_texts, F.col("doc_id") == F.col(own_id))
    new = {"text": F.col(own_text), "n_chars": F.length(own_text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
