"""Language-model scoring: online logistic mixing of hashed-context bit predictors, beside a word-count base.

A byte is coded by a binary tree, the Huffman code of all training bytes; an end mark follows each text. Each decision in
the tree is predicted by one bit predictor per context order: the log-odds of both outcomes' counts, from all training texts, at
the tree's node in the context, a key of 64 bits. Their log-odds are mixed with weights that a gate picks: how often the
longest context was seen at the node. A last table, by gate and mixed log-odds, refines the probability. A text starts with the weights
and the table that all training texts give, and both go on learning in it from its first bytes. The sum of the decisions' log
probabilities is the text's.

The counts are kept by context, so they grow with the corpus: texts are dealt into chunks, and a chunk asks for its own contexts' counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import Texts, firsts, passes, raw_texts, substring_hash
from tidewell.llm.quality import held_out
from tidewell.llm.sparktools import arrow_batches, cut, released, written

#: Context orders in bytes, at most 4; counts from which each gate reaches, gates.
ORDERS, GATE_FROM = (2, 3, 4), (0, 1, 2, 3, 5, 10, 30, 100)
GATES = len(GATE_FROM)
#: What is added to the counts of both outcomes; cells of the refining table per gate, their width in log-odds; the rows that a trained cell counts for in a text.
ADDED, CELLS, CELL_WIDTH, PRIOR = 0.05, 24, 0.75, 40.0
#: Symbols of a text before its first update, and between two once their number has doubled to that; the step of an update.
FIRST_BLOCK, BLOCK, RATE = 32, 8192, 0.01
#: Rounds of fitting the weights that a text starts with, and what those are before.
ROUNDS, START = 3, 0.4
#: Bytes that a numpy pass takes in scoring, small enough for its arrays to stay in cache.
PASS = 1 << 17
#: Bytes of text in a chunk.
CHUNK_BYTES = 32_000_000
END, SYMBOLS = 256, 257
#: Bits of a context: its bytes; above them how many there are, and above that the order's number. Bits of a symbol below it in a pair.
BYTE_BITS, ORDER_AT, SYMBOL_BITS = 32, 35, 9
#: The end token's key among the words' hashes.
END_WORD = np.uint64(1)


@dataclass
class Code:
    """A binary tree over 257 symbols: symbol s takes the decisions at[s] : at[s] + size[s], each a node (0 to 255) and an outcome."""

    at: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, nodes = {}, {}, len(counts)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], side[x], side[y] = nodes, nodes, 0, 1
            heapq.heappush(heap, (a + b, nodes, nodes))
            nodes += 1
        paths = []
        for s in range(len(counts)):
            path, x = [], s
            while x in parent:
                path.append((parent[x] - len(counts), side[x]))
                x = parent[x]
            paths.append(path[::-1])
        size = np.array([len(p) for p in paths])
        return Code(firsts(size), size, np.array([n for p in paths for n, _ in p]), np.array([b for p in paths for _, b in p], np.int8))

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each symbol takes, and which, one symbol's after the other's."""
        n = self.size[symbols]
        path = np.arange(n.sum())
        path += np.repeat(self.at[symbols] - np.cumsum(n) + n, n)
        return n, path


def symbols_of(texts: Texts) -> np.ndarray:
    symbols = texts.data.astype(np.int64)
    symbols[texts.ends] = END
    return symbols


def context_keys(texts: Texts, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """For each order the context of each symbol: the bytes before it in its text, as many as the order, fewer at the start."""
    data = texts.data.astype(np.int64)
    whole = np.zeros(len(data), np.int64)
    for k in range(max(orders), 0, -1):
        whole[k:] |= data[:-k] << (8 * (k - 1))
    out, lens = [], texts.ends - texts.starts
    for number, order in enumerate(orders):
        key = (whole & ((1 << (8 * order)) - 1)) | (order << BYTE_BITS) | (number << ORDER_AT)
        for k in range(order):  # a context never reaches before its text
            at = texts.starts[lens >= k] + k
            key[at] = (whole[at] & ((1 << (8 * k)) - 1)) | (k << BYTE_BITS) | (number << ORDER_AT)
        out.append(key)
    return out


def shorter(key: np.ndarray, number: int, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The context of a lower order in a context of the highest."""
    have = np.minimum((key >> BYTE_BITS) & 7, orders[number])
    return (key & ((1 << (8 * have)) - 1)) | (have << BYTE_BITS) | (number << ORDER_AT)


def shorter_column(key: Column, number: int, orders: tuple[int, ...] = ORDERS) -> Column:
    have = F.least(F.shiftright(key, BYTE_BITS).bitwiseAND(F.lit(7)), F.lit(orders[number]).cast("long"))
    low = F.lit(None).cast("long")
    for k in range(orders[number] + 1):
        low = F.when(have == k, key.bitwiseAND(F.lit((1 << (8 * k)) - 1).cast("long"))).otherwise(low)
    return low + have * F.lit(1 << BYTE_BITS) + F.lit(number << ORDER_AT).cast("long")


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[new], np.add.reduceat(n, new) if len(new) else n


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log-odds of outcome 1."""
    return np.log((ones + ADDED) / (zeros + ADDED))


def gate_of(total: np.ndarray) -> np.ndarray:
    return np.searchsorted(GATE_FROM, total, "right") - 1


def cell_of(z: np.ndarray) -> np.ndarray:
    z = z * z.dtype.type(1 / CELL_WIDTH)
    z += CELLS / 2
    return np.clip(z, 0, CELLS - 1, out=z).astype(np.int64)


def squash(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.exp(-z)
        p += 1
        return 1 / p


@dataclass
class Mixer:
    """The tree, and what a text starts with: weights (gates, orders) and the refining table (gates, cells), of outcome 1."""

    code: Code
    weights: np.ndarray
    refined: np.ndarray


class Predictors:
    """The bit predictors of some contexts, and their predictions for the pairs (highest context, symbol) that texts bring.

    A pair settles a symbol's decisions: each one's log-odds in every order, and its gate. They are made when a pair first comes.
    """

    def __init__(self, code: Code, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, orders: tuple[int, ...] = ORDERS):
        """contexts, symbols, counts: how often a symbol follows a context, one entry for each pair."""
        self.code, self.orders, self.tables = code, orders, []
        for number in range(len(orders)):
            own = np.flatnonzero(contexts >> ORDER_AT == number)
            known, at = np.unique(contexts[own], return_inverse=True)
            n, path = code.decisions(symbols[own])
            place = ((np.repeat(at, n) << 8 | code.node[path]) << 1) | code.bit[path]
            place, total = summed([place], [np.repeat(counts[own], n)])
            self.tables.append((known, np.append(place, [-1, -1]), np.append(total, [0, 0])))
        self.pair, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a row for each decision: the log-odds by order, then its gate and above it the outcome
        self.used, self.rows = 0, np.zeros((1024, len(orders) + 1), np.float32)

    def counts(self, number: int, context: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often both outcomes came at nodes in contexts of an order; 0 for those never seen."""
        known, place, total = self.tables[number]
        if not len(known):
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        want = np.where(known[at] == context, (at << 8 | node) << 1, -2)
        at = np.searchsorted(place[:-2], want)
        zero = place[at] == want
        zeros = np.where(zero, total[at], 0)
        at += zero
        return zeros, np.where(place[at] == want + 1, np.where(want < 0, 0, total[at]), 0)

    def find(self, pair: np.ndarray) -> np.ndarray:
        """Where the decisions of each of some different pairs, in order, begin."""
        at = np.searchsorted(self.pair, pair)
        new = np.flatnonzero(np.append(self.pair, -1)[at] != pair)
        if len(new):
            n, path = self.code.decisions(pair[new] & ((1 << SYMBOL_BITS) - 1))
            end = self.used + len(path)
            if end > len(self.rows):
                self.rows = np.pad(self.rows, ((0, 2 * end - len(self.rows)), (0, 0)))
            top, node = np.repeat(pair[new] >> SYMBOL_BITS, n), self.code.node[path]
            for number in range(len(self.orders)):
                zeros, ones = self.counts(number, shorter(top, number, self.orders) if number < len(self.orders) - 1 else top, node)
                self.rows[self.used : end, number] = odds(zeros, ones)
            self.rows[self.used : end, -1] = gate_of(zeros + ones) + GATES * self.code.bit[path]
            self.pair, self.begin = np.insert(self.pair, at[new], pair[new]), np.insert(self.begin, at[new], self.used + np.cumsum(n) - n)
            self.used = end
            fresh_ones = np.zeros(len(pair), np.int64)
            fresh_ones[new] = 1
            at += np.cumsum(fresh_ones) - fresh_ones  # as many came in before it
        return self.begin[at]


def block_of(k: np.ndarray) -> np.ndarray:
    """The number of the block that a text's k-th symbol lies in: FIRST_BLOCK symbols, as many again, then doubling up to BLOCK."""
    doubled = BLOCK.bit_length() - FIRST_BLOCK.bit_length()
    early = np.array([0, *(x.bit_length() for x in range(1, BLOCK // FIRST_BLOCK))], np.int16)
    return np.where(k < BLOCK, early[np.minimum(k // FIRST_BLOCK, len(early) - 1)], doubled + k // BLOCK).astype(np.int16)


def score_texts(texts: Texts, mixer: Mixer, predictors: Predictors) -> np.ndarray:
    """log10 of each text's probability, its end mark included.

    All texts' blocks of one number are predicted together with what each text has learned so far; then the text's
    weights take a step along the gradient, and its refining table counts the outcomes.
    """
    code, many = mixer.code, len(texts)
    lens = texts.ends - texts.starts + 1
    text = np.repeat(np.arange(many), lens)
    block, last = block_of(np.arange(len(text)) - np.repeat(texts.starts, lens)), np.repeat(block_of(lens - 1), lens)
    # by block, and in it first the texts that have another one: they go on learning
    turn = 2 * block + (block == last)
    by_turn = np.argsort(turn, kind="stable")
    text, turn = text[by_turn], turn[by_turn]
    symbols = symbols_of(texts)
    pair, which = np.unique((context_keys(texts, predictors.orders)[-1] << SYMBOL_BITS | symbols)[by_turn], return_inverse=True)
    n = code.size[symbols[by_turn]]
    to = np.cumsum(n)
    at = np.arange(to[-1])
    at += np.repeat(predictors.find(pair)[which] - to + n, n)
    rows = predictors.rows.take(at, axis=0)
    x, gate = rows.T[:-1], rows[:, -1].astype(np.int64)
    bit = (gate >= GATES).astype(np.int8)
    group = np.repeat(text * GATES, n)
    group += gate & (GATES - 1)
    # where each turn ends, and where a text begins in one
    ends = np.append(0, to)[np.cumsum(np.bincount(turn, minlength=2 * (int(turn[-1]) // 2) + 2))].reshape(-1, 2)
    begins = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (turn[1:] != turn[:-1]))))
    own, of = (to - n)[begins], text[begins]
    weights = [np.tile(w, many) for w in mixer.weights.T.astype(np.float32)]
    start = np.tile(mixer.refined.ravel(), many)
    refined, seen = start.astype(np.float32), np.zeros((len(start), 2))
    out, begin = np.zeros(many), 0
    for middle, end in ends.tolist():
        part = slice(begin, end)
        g = group[part]
        z = weights[0].take(g)
        z *= x[0][part]
        for w, c in zip(weights[1:], x[1:], strict=True):
            more = w.take(g)
            more *= c[part]
            z += more
        cell = g * CELLS
        cell += cell_of(z)
        p = squash(z)
        q = refined.take(cell)
        q += p
        q *= 0.5
        q -= 1 - bit[part]
        some = slice(*np.searchsorted(own, (begin, end)))
        out[of[some]] += np.add.reduceat(np.log(np.abs(q, out=q), out=q), own[some] - begin, dtype=np.float64)
        go = middle - begin
        if go:
            b, g, cell = bit[begin:middle], g[:go], cell[:go]
            cell <<= 1
            cell |= b
            new = np.bincount(cell, minlength=2 * len(start)).reshape(-1, 2)
            seen += new
            step = RATE / np.sqrt(new.reshape(len(weights[0]), -1).sum(axis=1) + 1.0)
            err = b - p[:go]
            for w, c in zip(weights, x, strict=True):
                w += step * np.bincount(g, err * c[begin:middle], len(w))
            refined = ((seen[:, 1] + PRIOR * start) / (seen[:, 0] + seen[:, 1] + PRIOR)).astype(np.float32)
        begin = end
    return out / np.log(10)


def node_counts(code: Code, row: np.ndarray, symbols: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """(rows, nodes, 2): how often each outcome came at each node, for rows of (symbol, count)."""
    n, path = code.decisions(symbols)
    place = ((np.repeat(row, n) * 256 + code.node[path]) << 1) | code.bit[path]
    return np.bincount(place, np.repeat(counts.astype(float), n), rows * 512).reshape(rows, 256, 2)


def statistics(mixer: Mixer, lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int, last: bool) -> np.ndarray:
    """What a batch of highest contexts adds to the fit: whole numbers, so sums do not depend on their order.

    lists: for each order (row, symbol, count), what follows the row's context of that order. Every decision of the
    training texts is predicted from the counts without its own. Gives each gate's gradient and curvature of the log
    likelihood in the weights; if last, each cell's outcomes.
    """
    code = mixer.code
    counts = [node_counts(code, *x, rows) for x in lists]
    row, symbols, times = lists[-1]
    n, path = code.decisions(symbols)
    row, times, node, bit = np.repeat(row, n), np.repeat(times.astype(float), n), code.node[path], code.bit[path]
    x = []
    for table in counts:
        c = table[row, node]
        c[np.arange(len(c)), bit] -= 1
        x.append(odds(c[:, 0], c[:, 1]))
    gate = gate_of(c.sum(axis=1))
    z = sum(mixer.weights[gate, j] * v for j, v in enumerate(x))
    if last:
        cell = gate * CELLS + cell_of(z)
        return np.concatenate([np.bincount(cell, v, GATES * CELLS) for v in (times * bit, times)]).astype(np.int64)
    p = squash(z)
    sums = [times * (bit - p) * v for v in x] + [times * p * (1 - p) * x[i] * x[j] for i in range(len(x)) for j in range(i + 1)]
    return np.concatenate([np.bincount(gate, np.rint(v * 1024), GATES) for v in sums]).astype(np.int64)


def stepped(mixer: Mixer, sums: np.ndarray) -> Mixer:
    """One Newton step of each gate's weights, damped so that gates of few decisions stay."""
    n = mixer.weights.shape[1]
    sums = sums.reshape(-1, GATES) / 1024
    weights = mixer.weights.copy()
    for g in range(GATES):
        curve = np.zeros((n, n))
        for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1)):
            curve[i, j] = curve[j, i] = sums[n + k, g]
        weights[g] = np.clip(weights[g] + np.linalg.solve(curve + np.eye(n) * 10, sums[:n, g]), -1, 3)
    return Mixer(mixer.code, weights, mixer.refined)


def fresh(code: Code, orders: tuple[int, ...] = ORDERS) -> Mixer:
    """A mixer before it has seen anything: equal weights, a table that refines nothing."""
    middle = squash((np.arange(CELLS) - CELLS / 2 + 0.5) * CELL_WIDTH)
    return Mixer(code, np.full((GATES, len(orders)), START), np.tile(middle, (GATES, 1)))


def refined_by(mixer: Mixer, sums: np.ndarray) -> Mixer:
    ones, all_ = sums.reshape(2, GATES, CELLS).astype(float)
    return Mixer(mixer.code, mixer.weights, (ones + 8 * mixer.refined) / (all_ + 8))


def word_keys(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a pass as hashes, words first and then one end for each text, and each one's text.

    A-Z are lower-cased; a word is a run of bytes other than blank and 9 to 13.
    """
    data = texts.lowered()
    first, last, n = texts.words(data)
    keys = np.concatenate((substring_hash(texts.prefix(data), first, last), np.full(len(texts), END_WORD)))
    return keys, np.concatenate((np.repeat(np.arange(len(texts)), n), np.arange(len(texts))))


class Counts:
    """Counts by 64-bit key, found by the key's upper bits and a few steps on in key order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.drop = np.uint64(64 - max(1, (4 * len(keys)).bit_length()))
        cells = (self.keys >> self.drop).astype(np.int64)
        many = np.bincount(cells, minlength=1 << int(np.uint64(64) - self.drop))
        self.begin, self.most = np.cumsum(many) - many, int(many.max()) if len(keys) else 0

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of the keys, 0 for others."""
        out = np.zeros(len(keys), np.int64)
        at = self.begin[(keys >> self.drop).astype(np.int64)] if self.most else np.zeros(0, np.int64)
        for step in range(self.most):
            place = np.minimum(at + step, len(self.keys) - 1)
            hit = self.keys[place] == keys
            out[hit] = self.counts[place[hit]]
        return out


ROW = "chunk int, kind int, key long, n long"
WORD, PAIR, ASKED = 0, 1, 2


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One chunk's rows (chunk, kind, key, n): its words and pairs with their counts in training texts, and its contexts of all orders."""
    chunk, words, word_n, pairs, pair_n = None, [], [], [], []
    for b in batches:
        known = ~b.column(2).to_numpy(zero_copy_only=False)
        chunk = b.column(0)[0].as_py() if len(b) else chunk
        for t in passes(b.column(1)):
            key, of = word_keys(t)
            u, at = np.unique(key, return_inverse=True)
            words.append(u.view(np.int64))
            word_n.append(np.bincount(at, known[t.rows][of], len(u)).astype(np.int64))
            own = np.repeat(known[t.rows], t.ends - t.starts + 1)
            u, n = np.unique((((context_keys(t)[-1] << SYMBOL_BITS) | symbols_of(t)) << 1) | own, return_counts=True)
            pairs.append(u >> 1)
            pair_n.append(n * (u & 1))
    words, word_n = summed(words, word_n)
    pairs, pair_n = summed(pairs, pair_n)
    top = pairs >> SYMBOL_BITS
    asked = np.concatenate([np.unique(shorter(top, k)) for k in range(len(ORDERS) - 1)] + [np.unique(top)])
    pairs, pair_n = pairs[pair_n > 0], pair_n[pair_n > 0]
    sizes = [len(words), len(pairs), len(asked)]
    if chunk is not None:
        cols = [np.full(sum(sizes), chunk, np.int32), np.repeat(np.array([WORD, PAIR, ASKED], np.int32), sizes), np.concatenate((words, pairs, asked)), np.concatenate((word_n, pair_n, np.zeros(len(asked), np.int64)))]
        for k in range(0, sum(sizes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], ["chunk", "kind", "key", "n"])


def followers(pairs: DataFrame) -> list[DataFrame]:
    """For each order (key, next): contexts and what followed them, each entry a symbol with its count in the bits above.

    pairs: (key, n) of the highest order, from which the lower orders' counts are added up. next has 257 entries at most.
    """
    rows = pairs.select(F.shiftright("key", SYMBOL_BITS).alias("key"), F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1)).alias("symbol"), "n")
    out = []
    for number in range(len(ORDERS)):
        own = rows if number == len(ORDERS) - 1 else rows.groupBy(shorter_column(F.col("key"), number).alias("key"), "symbol").agg(F.sum("n").alias("n"))
        entry = F.shiftleft("n", SYMBOL_BITS).bitwiseOR(F.col("symbol"))
        out.append(cut(own.groupBy("key").agg(F.collect_list(entry).alias("next"))))
    return out


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, symbol and count of each entry of a column of lists."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), flat & ((1 << SYMBOL_BITS) - 1), flat >> SYMBOL_BITS


def fit_mixer(contexts: list[DataFrame], code: Code) -> Mixer:
    """The weights and the refining table that texts start with, from all training texts.

    A decision depends on the highest context and the symbol alone, since lower contexts are part of it; so each pair is
    predicted once and counts as often as it occurs. Tasks add up whole numbers, of which a few hundred come back.
    """
    rows = contexts[-1].withColumnRenamed("next", f"next{len(ORDERS) - 1}")
    for k in range(len(ORDERS) - 1):
        low = contexts[k].select(F.col("key").alias("low"), F.col("next").alias(f"next{k}"))
        rows = rows.join(low, shorter_column(F.col("key"), k) == F.col("low")).drop("low")
    rows = cut(rows.select(*[f"next{k}" for k in range(len(ORDERS))]))
    mixer = fresh(code)

    def total(last: bool) -> np.ndarray:
        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = sum((statistics(mixer, [_entries(c) for c in b.columns], len(b), last) for b in batches if len(b)), start=np.int64(0))
            if np.ndim(sums):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "v"])

        got = rows.mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()
        n = len(ORDERS)
        out = np.zeros(2 * GATES * CELLS if last else GATES * (n + n * (n + 1) // 2), np.int64)
        for r in got:
            out[r[0]] = r[1]
        return out

    for _ in range(ROUNDS):
        mixer = stepped(mixer, total(False))
    return refined_by(mixer, total(True))


def score(docs: DataFrame, folds: int = 7, fold: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row's whole text.

    base_score: sum over the text's words and its end of log10((c + 1) / (N + V + 1)), c: the token's count, N: all, V: distinct, in
    the texts that are not held out. score: log10 of the mixing model's probability of the bytes and the end; bits_per_byte is the same in
    bits, over the number of bytes (1 for an empty text). The counts by context, the tree, the weights that texts start
    with and the first refining table come from all those texts; inside a text weights and table go on learning. Null
    texts are empty: an end only. A row without a doc_id is learned from and scored like any other, repeated rows count each; extra
    columns are ignored; an empty table gives an empty result. A text of any length is scored whole, in a pass of its own if it is
    longer than one, with memory of some thousand bytes for each of its bytes.

    Texts are dealt by a hash into chunks of about ``chunk_bytes``, one a task. A chunk asks once for each of its distinct
    words and contexts, so these have as many rows as chunks at most, and no table of all of them is sent anywhere. A task reads its
    chunk in Arrow batches, contexts and words first. The larger the corpus, the larger a chunk should be.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    held = held_out(F.col("doc_id"), folds, fold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    rows = rows.select("doc_id", "text", held.alias("held_out"), chunk.alias("chunk"))

    @released
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _learn(batches)

    learned = written(rows.select("chunk", "text", "held_out").repartitionById(chunks, "chunk").mapInArrow(learn, ROW))
    dealt = learned.where(F.col("kind") == WORD).select("chunk", "key")
    words = cut(learned.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"))
    all_n, distinct = words.agg(F.sum("n"), F.count("*")).first()
    all_n = all_n or 0
    per_token = np.log10(all_n + distinct + 1)

    pairs = cut(learned.where(F.col("kind") == PAIR).groupBy("key").agg(F.sum("n").alias("n")))
    by_symbol = np.zeros(SYMBOLS, np.int64)
    for r in pairs.groupBy(F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1)).alias("symbol")).agg(F.sum("n")).collect():
        by_symbol[r[0]] = r[1]
    contexts = followers(pairs)
    mixer = fit_mixer(contexts, Code.of(by_symbol))
    shared = spark.sparkContext.broadcast(mixer)  # of fixed size

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    every = contexts[0]
    for other in contexts[1:]:
        every = every.union(other)
    parts = [
        learned.where(F.col("kind") == ASKED).select("chunk", "key").join(every, "key").select("chunk", F.lit(0).alias("kind"), "key", none("n", "long"), "next", none("doc_id", "long"), none("held_out", "boolean"), none("text", "string")),
        dealt.join(words, "key").select("chunk", F.lit(1).alias("kind"), "key", "n", none("next", "array<long>"), none("doc_id", "long"), none("held_out", "boolean"), none("text", "string")),
        rows.select("chunk", F.lit(2).alias("kind"), none("key", "long"), none("n", "long"), none("next", "array<long>"), "doc_id", "held_out", "text"),
    ]

    @released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, predictors, counts = shared.value, None, None
        known: list[list[np.ndarray]] = [[], [], [], [], []]
        for b in batches:
            kind = b.column("kind").to_numpy()
            edge = np.searchsorted(kind, range(4))
            context, word, text = (b.slice(edge[k], edge[k + 1] - edge[k]) for k in range(3))
            row, symbols, n = _entries(context.column("next"))
            for held, x in zip(known, (context.column("key").to_numpy()[row], symbols, n, word.column("key").to_numpy(), word.column("n").to_numpy()), strict=True):
                held.append(x)
            if not len(text):
                continue
            if predictors is None:  # kinds come in order, so all contexts and words are there
                found = [np.concatenate(x).astype(np.int64) for x in known]
                known = [[], [], [], [], []]
                predictors, counts = Predictors(mixer.code, *found[:3]), Counts(found[3].view(np.uint64), found[4])
            column, cols = text.column("text"), {"score": [], "n_tokens": [], "n_known": [], "base_score": []}
            for t in passes(column, PASS):
                cols["score"].append(score_texts(t, mixer, predictors))
            for t in passes(column):
                keys, of = word_keys(t)
                count = counts.of(keys)
                cols["n_tokens"].append(np.bincount(of, minlength=len(t)))
                cols["n_known"].append(np.bincount(of, count > 0, len(t)).astype(np.int64))
                cols["base_score"].append(np.bincount(of, np.log10(count + 1.0), len(t)) - cols["n_tokens"][-1] * per_token)
            done = {k: pa.array(np.concatenate(v)) for k, v in cols.items()}
            bits = -done["score"].to_numpy() * np.log2(10) / np.maximum(np.diff(raw_texts(column)[1]), 1)
            yield pa.RecordBatch.from_arrays([text.column("doc_id"), text.column("held_out"), *(done[k] for k in ("n_tokens", "n_known", "base_score", "score")), pa.array(bits)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    dealt_rows = parts[0].union(parts[1]).union(parts[2]).repartitionById(chunks, "chunk").sortWithinPartitions("kind").drop("chunk")
    out = dealt_rows.mapInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
