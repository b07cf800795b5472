"""SimHash fingerprints and the exact linking of those at few differing bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import Texts, firsts, mix, passes
from tidewell.llm.sparktools import arrow_batches, connected_components, cut, partitions, released, unused, whole_groups

#: Fingerprints in one tile, and in one step of a tile's comparison.
TILE, STEP = 1024, 256
#: Keys of a shingle set, and the smallest hashes in each.
MIN_KEYS, MIN_ROWS = 16, 4


def _shingles(texts: Texts, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all word shingles of a pass, and how many each text has."""
    data = texts.lowered()
    first, last, per_text = texts.words(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~space
    keep[last] = True  # the blank after each word
    data[space] = 32
    joined = data[keep].tobytes()
    at = np.concatenate(([0], np.cumsum(last - first + 1)))  # where each word begins in joined
    shingles = np.where(per_text >= words, per_text - words + 1, np.minimum(per_text, 1))
    word0 = np.repeat(firsts(per_text), shingles) + np.arange(shingles.sum()) - np.repeat(firsts(shingles), shingles)
    width = np.repeat(np.minimum(per_text, words), shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(at[word0].tolist(), (at[word0 + width] - 1).tolist(), strict=True)),
        np.uint64,
        len(word0),
    )
    return hashes, shingles


def _prints(hashes: np.ndarray, shingles: np.ndarray, lanes: int) -> np.ndarray:
    prints = np.zeros((len(shingles), lanes), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        for part in np.array_split(some, max(1, len(hashes) // 100_000)):
            if not len(part):
                continue
            lo = firsts(shingles)[part[0]]
            for lane in range(lanes):
                own = hashes[lo : lo + shingles[part].sum()]
                own = mix(own + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) if lane else own
                bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, firsts(shingles[part]), axis=0, dtype=np.int64)
                prints[part, lane] = np.packbits(2 * ones > shingles[part][:, None], axis=1).view(">u8").ravel()
    return prints


def _fingerprints(column: pa.Array, words: int, seed: int, lanes: int = 1) -> np.ndarray:
    """(texts, lanes): lane 0 is made of the shingles' hashes, further ones of those hashes mixed anew."""
    out = [_prints(*_shingles(texts, words, seed), lanes) for texts in passes(column)]
    return np.concatenate(out) if out else np.zeros((0, lanes), np.uint64)


def _sets(texts: Texts, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingle hashes of each text of a pass, in order, how many they are, and a digest of each text's set."""
    hashes, shingles = _shingles(texts, words, seed)
    of = np.repeat(np.arange(len(shingles)), shingles)
    order = np.lexsort((hashes, of))
    hashes = hashes[order]  # of is in order already
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes = hashes[new]
    sizes = np.bincount(of[new], minlength=len(shingles))
    node, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        node[some] = mix(np.add.reduceat(mix(hashes), firsts(sizes)[some]) + sizes[some].astype(np.uint64))
    return hashes, sizes, node


def _min_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, MIN_KEYS): each key joins the smallest of the text's hashes in MIN_ROWS orders of the hashes."""
    out, some = np.zeros((len(sizes), MIN_KEYS), np.uint64), np.flatnonzero(sizes)
    if not len(some):
        return out
    at = firsts(sizes)[some]
    orders = mix(np.arange(1, 2 * MIN_KEYS * MIN_ROWS + 1, dtype=np.uint64)).reshape(MIN_KEYS, MIN_ROWS, 2)
    for k in range(MIN_KEYS):
        key = np.zeros(len(some), np.uint64)
        for turn, by in orders[k]:
            key = mix(key + np.minimum.reduceat((hashes ^ turn) * (by | np.uint64(1)), at))
        out[some, k] = key
    return out


def names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, lanes))]


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, lanes: int = 1) -> DataFrame:
    """(doc_id, fp, fp1, ...): the SimHash of each whole text's word shingles, 64 bits a lane, as signed longs.

    A-Z are lower-cased; words are runs of bytes other than blank and 9 to 13; a text of fewer words is
    one shingle; null and wordless texts have fingerprint 0. Rows with a null doc_id keep it.
    """
    arrow_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = _fingerprints(b.column(1), words, seed, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in prints.T)], ["doc_id", *names(lanes)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names(lanes)))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with a[i], b[j] at most radius bits apart; (n, lanes) each, sorted by bit count.

    Tiles whose ranges of bit counts are more than radius apart are skipped.
    """
    count_a, count_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    left, right = [], []
    for i in range(0, len(a), step):
        ca = count_a[i : i + step]
        lo = np.searchsorted(count_b, int(ca[0]) - radius)
        hi = np.searchsorted(count_b, int(ca[-1]) + radius, "right")
        for j in range(lo, hi, step):
            bits = sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(np.uint16) for x, y in zip(a[i : i + step].T, b[j : min(j + step, hi)].T, strict=True))
            x, y = np.nonzero(bits <= radius)
            left.append(x + i)
            right.append(y + j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position connected with each of n positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_links(fp: np.ndarray, node: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a tile (side 0), or between two tiles (sides 1 and 2)."""
    order = np.argsort(np.bitwise_count(fp).sum(axis=1, dtype=np.int64), kind="stable")
    fp, node, side = fp[order], node[order], side[order]
    if side[0] == 0 or (side == side[0]).all():
        i, j = close_pairs(fp, fp, radius)
    else:
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        i, j = close_pairs(fp[a], fp[b], radius)
        i, j = a[i], b[j]
    apart = i != j
    root = forest(len(fp), i[apart], j[apart])
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return node[moved], node[root[moved]]


def disjoint_bands(radius: int) -> list[Column]:
    """Keys of one lane: two fingerprints at most radius bits apart are equal in one of radius + 1 bands of bits."""
    bands = radius + 1
    width = [64 // bands + (k < 64 % bands) for k in range(bands)]
    return [F.shiftrightunsigned("fp", sum(width[:k])).bitwiseAND(F.lit((1 << width[k]) - 1)) for k in range(bands)]


def sliding_bands(lanes: int) -> list[Column]:
    """Keys of several lanes: the 16 bits from each eighth bit on, around the end."""
    out, cols = [], names(lanes)
    for k in range(8 * lanes):
        this, at = cols[k // 8], 8 * (k % 8)
        low = F.shiftrightunsigned(this, at).bitwiseAND(F.lit(0xFFFF))
        out.append(low if at < 56 else low.bitwiseOR(F.shiftleft(F.col(cols[(k // 8 + 1) % lanes]).bitwiseAND(F.lit(0xFF)), 8)))
    return out


def tiles(rows: DataFrame, n: str, cols: list[str], lanes: int, radius: int, tile: int) -> DataFrame:
    """(band, key, p, q, side, *cols): rows (band, key, n: rows of the key, *cols) dealt by tile, each tile's together."""
    prints = names(lanes)
    small = rows.where(F.col(n) <= tile).select("band", "key", F.lit(-1).alias("p"), F.lit(-1).alias("q"), F.lit(0).alias("side"), *cols)
    # a large group: tile = range of bit counts * salts + salt; a row goes to each pair of tiles of near ranges
    ones = sum((F.bit_count(c) for c in prints[1:]), F.bit_count(prints[0]))
    last = 64 * lanes // (radius + 1)
    big = rows.where(F.col(n) > tile).withColumn("salts", F.ceil(F.col(n) / (2 * tile)).cast("int")).withColumn("r", F.floor(ones / (radius + 1)).cast("int"))
    big = big.withColumn("t", F.col("r") * F.col("salts") + F.pmod(F.xxhash64(*prints), "salts").cast("int"))
    lo, hi = F.greatest(F.lit(0), F.col("r") - 1) * F.col("salts"), (F.least(F.lit(last), F.col("r") + 1) + 1) * F.col("salts") - 1
    big = big.withColumn("o", F.explode(F.sequence(lo, hi))).select("band", "key", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), F.when(F.col("t") == F.col("o"), 0).when(F.col("t") < F.col("o"), 1).otherwise(2).alias("side"), *cols)
    unit = ["band", "key", "p", "q"]
    return small.union(big).repartition(partitions(rows.sparkSession), *unit).sortWithinPartitions(*unit)


def by_tile(pair: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """For mapInArrow over tiles: (u, v) of pair for the rows of each tile."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1)) + 1
            made = [pair(x) for x in np.split(rows, cuts) if len(x) > 1]
            u, v = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1))
            whole = np.concatenate(held)
            new = np.flatnonzero((whole[:, :4] != whole[-1, :4]).any(axis=1))
            if len(new):  # the last tile may go on in the next batch
                yield from work(whole[: new[-1] + 1])
                whole = whole[new[-1] + 1 :]
            held = [whole]
        if held and len(held[0]):
            yield from work(held[0])

    return run


def links(prints: DataFrame, radius: int = 4, lanes: int = 1, keys: list[Column] | None = None, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect the same nodes as all pairs of rows at most radius bits apart that share a key.

    prints: (node, fp, ...), fingerprints distinct. keys: disjoint bands, by which no pair is lost, if not given. A key's group
    of at most ``tile`` rows is one tile, compared by exclusive-or and bit counts. A larger group is cut into tiles by ranges
    of bit counts and a salt; only tiles of the same or of neighbouring ranges, which alone can lie within the radius,
    are paired. Of the pairs in a tile (pair) its spanning forest is returned.
    """
    keys, cols = keys or disjoint_bands(radius), names(lanes)
    rows = prints.select(*cols, "node", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), key.alias("key")) for k, key in enumerate(keys)])).alias("b")).select(*cols, "node", "b.band", "b.key")
    sizes = cut(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(sizes, ["band", "key"])
    dealt = tiles(rows, "n", ["node", *cols], lanes, radius, tile)
    pair = lambda x: _tile_links(np.ascontiguousarray(x[:, 6:]).view(np.uint64), x[:, 5], x[:, 4], radius)
    return dealt.mapInArrow(by_tile(pair), "u long, v long").distinct()


def _components(docs: DataFrame, words: int, seed: int, lanes: int, radius: int, keys: list[Column] | None) -> DataFrame:
    cols = names(lanes)
    prints = cut(fingerprints(docs, words, seed, lanes).where("doc_id is not null"))
    distinct = cut(prints.groupBy(*cols).agg(F.min("doc_id").alias("node")))
    found = connected_components(links(distinct, radius, lanes, keys))
    named = distinct.join(found, "node", "left").select(*cols, F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, cols).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of 64-bit fingerprints.

    Equal fingerprints always link, the zero fingerprint of empty texts included, and no link is lost. Rows without a doc_id
    are left out, since they can be neither named nor kept; a repeated doc_id gives a row for each
    of its rows. Extra columns are ignored; an empty table gives an empty result.
    """
    return _components(docs, words, seed, 1, radius, None)


#: Words in a shingle, lanes of the longer fingerprint and the radius of its candidates, and the similarity of a link:
#: similarity 0.8 of shingle sets differs in 39 of 256 bits on average (in 48 where 4 shingles meet 5), 0.55 in 64.
SIMILAR_WORDS, SIMILAR_LANES, SIMILAR_RADIUS, SIMILAR = 5, 4, 64, 0.8


def _similar_prints(docs: DataFrame, words: int, lanes: int, seed: int) -> DataFrame:
    """(doc_id, node, n, keys, fp, fp1, ...): node is the digest of the text's shingle set, n the set's size."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in passes(b.column(1)):
                hashes, sizes, node = _sets(t, words, seed)
                prints, keys = _prints(hashes, sizes, lanes).view(np.int64), _min_keys(hashes, sizes).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * MIN_KEYS), pa.array(keys.ravel()))
                cols = [b.column(0)[t.rows.start : t.rows.stop], pa.array(node.view(np.int64)), pa.array(sizes), listed, *(pa.array(np.ascontiguousarray(x)) for x in prints.T)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", "keys", *names(lanes)])

    schema = "doc_id long, node long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in names(lanes))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, shingles): the sets of nodes (node, doc_id), made again from those documents' texts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in passes(b.column(0)):
                hashes, sizes, node = _sets(t, words, seed)
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), listed], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    # a repeated doc_id brings texts that nobody asked for
    return texts.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def spanning(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) between n nodes make a lightest spanning forest: parts take their lightest links until none joins two."""
    label, picked, left = np.arange(n), [], np.arange(len(i))
    while len(left := left[label[i[left]] != label[j[left]]]):
        order = weight[left] * len(left) + np.arange(len(left))  # no two alike
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[i[left]], order)
        np.minimum.at(best, label[j[left]], order)
        picked.append(left[np.unique(best[best < np.iinfo(np.int64).max] % len(left))])
        so_far = np.concatenate(picked)
        label = forest(n, i[so_far], j[so_far])
    return np.concatenate(picked) if picked else left


def _candidates(t: pa.Table, lanes: int, radius: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits): rows of a tile that may be similar, have different labels, and share no key of a smaller number."""
    cols = {c: t.column(c).to_numpy() for c in ("side", "node", "label", "n", "band")}
    fp = np.stack([t.column(c).to_numpy() for c in names(lanes)], axis=1).view(np.uint64)
    keys = t.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    order, side = np.lexsort((cols["node"], np.bitwise_count(fp).sum(axis=1, dtype=np.int64))), cols["side"]
    none = np.zeros(0, np.int64)
    if side[0] == 0:
        i, j = close_pairs(fp[order], fp[order], radius)
        i, j = order[i[j < i]], order[j[j < i]]
    elif (side == side[0]).all():
        return none, none, none
    else:
        a, b = order[side[order] == 1], order[side[order] == 2]
        i, j = close_pairs(fp[a], fp[b], radius)
        i, j = a[i], b[j]
    size, label, band = cols["n"], cols["label"], int(cols["band"][0])
    fit = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
    i, j = i[fit], j[fit]
    for k in range(band):
        apart = keys[i, k] != keys[j, k]
        i, j = i[apart], j[apart]
    return i, j, np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)


UNIT = ("band", "key", "p", "q")


def _over_tiles(tiled: DataFrame, work: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """What ``work`` makes of each tile's rows."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, UNIT):
            made = work(t) if len(t) > 1 else {}
            if made and len(next(iter(made.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made.values()], list(made))

    return tiled.mapInArrow(run, schema)


def _similar_tiles(nodes: DataFrame, lanes: int, radius: int, tile: int = TILE) -> DataFrame:
    """The nodes (node, label, n, keys, fp, ...) dealt by tile for each key that nodes of different labels share."""
    cols = ["node", "label", "n", "keys", *names(lanes)]
    rows = nodes.select(*cols, F.posexplode("keys").alias("band", "key"))
    # a key whose nodes are all of one label has nothing to compare
    sizes = cut(rows.groupBy("band", "key").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "key", "rows"))
    return tiles(rows.join(sizes, ["band", "key"]), "rows", cols, lanes, radius, tile)


def _exactly(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, seed: int, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets' intersection over their union is at least ``least``."""
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = cut(_shingle_sets(docs, nodes.join(needed, "node").select("node", "doc_id"), words, seed))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("both"))
    return cut(both.where(F.col("common") >= F.lit(least) * (F.col("both") - F.col("common")) - 1e-9).select("u", "v"))


def in_common(shingles: pa.Array, i: np.ndarray, j: np.ndarray, step: int = 2048) -> np.ndarray:
    """How many values the lists i and j have in common, for each pair; a list's values differ. By bits of the values that lists share."""
    n = shingles.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    _, value, times = np.unique(shingles.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row, value = row[shared[value]], number[value[shared[value]]]
    width, out = int(shared.sum()), np.zeros(len(i), np.int64)
    for k in range(0, width, 1 << 14):  # some thousand values at a time, so that the bits of all lists stay small
        own = (value >= k) & (value < k + (1 << 14))
        bits = np.zeros((len(n), min(1 << 14, width - k) // 8 + 8), np.uint8)
        at = value[own] - k
        np.bitwise_or.at(bits, (row[own], at >> 3), (1 << (at & 7)).astype(np.uint8))
        bits = np.ascontiguousarray(bits[:, : bits.shape[1] // 8 * 8]).view(np.uint64)
        for a in range(0, len(i), step):
            out[a : a + step] += np.bitwise_count(bits[i[a : a + step]] & bits[j[a : a + step]]).sum(axis=1, dtype=np.int64)
    return out


def similar_documents(docs: DataFrame, words: int = SIMILAR_WORDS, lanes: int = SIMILAR_LANES, radius: int = SIMILAR_RADIUS, seed: int = 42, least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of similarity ``least`` or more.

    Similarity is that of the sets of 5-word-shingle hashes, intersection over union, taken from the sets themselves; no link
    is made without it. Candidates are pairs of fingerprints of the sets, 64 * lanes bits, at most radius bits apart that share one of
    16 keys, each of the smallest hashes in four orders: 0.9998 of the pairs of similarity 0.8 share one, and of those all but few in a
    thousand lie within the radius. First the lightest spanning forest of each tile's candidates is decided, a link a row at most. What is
    then still apart but has candidates goes once more to its tiles, now with its sets, and all candidates between different groups are
    decided there: tiles write links and never pairs, however many resemble each other without being similar enough.

    Empty and null texts are alike. Rows as in near_duplicates.
    """
    arrow_batches(docs.sparkSession)
    prints = cut(_similar_prints(docs, words, lanes, seed).where("doc_id is not null"))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n", "keys", *names(lanes))]).withColumn("label", F.col("node")))
    some = nodes.where("n > 0")

    def nearest(t: pa.Table) -> dict:
        i, j, bits = _candidates(t, lanes, radius, least)
        kept = spanning(len(t), i, j, bits)
        u, v = (t.column("node").to_numpy()[x[kept]] for x in (i, j))
        return {"u": np.minimum(u, v), "v": np.maximum(u, v)}

    pairs = cut(_over_tiles(_similar_tiles(some, lanes, radius, tile), nearest, "u long, v long").distinct())
    first = _exactly(pairs, docs, nodes, words, seed, least)
    found = cut(connected_components(first).withColumnRenamed("component", "label"))
    some = cut(some.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))

    def apart(t: pa.Table) -> dict:
        i, j, _ = _candidates(t, lanes, radius, least)
        rows = np.unique(np.concatenate((i, j)))
        return {c: t.column(c).to_numpy()[rows] for c in (*UNIT, "side", "node")}

    left = cut(_over_tiles(_similar_tiles(some, lanes, radius, tile), apart, "band int, key long, p int, q int, side int, node long"))
    wanted = left.select("node").distinct()
    sets = cut(_shingle_sets(docs, nodes.join(wanted, "node").select("node", "doc_id"), words, seed).join(some.drop("doc_id"), "node"))

    def decided(t: pa.Table) -> dict:
        i, j, _ = _candidates(t, lanes, radius, least)
        both, size, node = in_common(t.column("shingles").combine_chunks(), i, j), t.column("n").to_numpy(), t.column("node").to_numpy()
        alike = both >= least * (size[i] + size[j] - both) - 1e-9
        root = forest(len(t), i[alike], j[alike])
        moved = np.flatnonzero(root != np.arange(len(t)))
        return {"u": node[moved], "v": node[root[moved]]}

    again = left.join(sets, "node").repartition(partitions(docs.sparkSession), *UNIT).sortWithinPartitions(*UNIT)
    second = _over_tiles(again, decided, "u long, v long")
    found = connected_components(first.union(second))
    named = cut(nodes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    least_id = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "fp", "node").join(named.join(least_id, "component").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


def keep_first_of_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with one document of each group of similar documents: the one with the smallest doc_id.

    Rows without a doc_id go; of rows that repeat a doc_id, the one with the smallest text stays (null first).
    """
    row, kept_id = unused("row", docs), unused("kept_id", docs)
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").agg(F.count("*").alias(row)).where(F.col(row) > 1).limit(1).count():
        least = docs.groupBy("doc_id").agg(F.min_by(F.struct("*"), F.struct("text", F.xxhash64("*"))).alias(row))
        docs = least.select(f"{row}.*")
    kept = similar_documents(docs, **how).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id))
    return docs.join(kept, F.col("doc_id") == F.col(kept_id), "left_semi")
