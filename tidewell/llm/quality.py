"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.llm.bytestext import Texts, firsts, mix, passes, substring_hash
from tidewell.llm.neural import Adam, temperature
from tidewell.llm.sparktools import arrow_batches, released, unused

#: Buckets that words are hashed to, dimensions, non-zero entries of an index vector, neighbours on each side.
BUCKETS, DIMS, NONZERO, REACH = 8192, 32, 2, 2
#: Numbers in a document's pool: mean and deviation by dimension, two on neighbouring words, and the length.
POOL = 2 * DIMS + 3
#: Labelled rows that the network is fitted on at most (those with the smallest hashes of doc_id), and its shape.
SAMPLE, HIDDEN, EPOCHS, RATE = 20_000, 32, 60, 3e-3
#: A document is predicted good from this score on.
CUT = 0.3


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's sparse ternary index vector."""
    r = np.random.default_rng(4242)
    where = np.stack([r.permutation(DIMS)[:NONZERO] for _ in range(BUCKETS)])
    return where, r.choice([-1, 1], (BUCKETS, NONZERO))


def word_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The words of a pass as bucket numbers, and how many each text has.

    A word is a run of letters (bytes from 128 on count as such), of digits, or of other visible bytes.
    """
    data = texts.data
    kind = np.full(256, 3, np.uint8)
    kind[[32, *range(9, 14)]] = 0
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    k = kind[data]
    edge = np.flatnonzero(np.diff(k, prepend=np.uint8(0)))
    first, last = edge, np.append(edge[1:], len(data))
    seen = k[first] > 0
    first, last = first[seen], last[seen]
    n = np.diff(np.searchsorted(first, np.append(texts.starts, len(data))))
    return (substring_hash(texts.prefix(), first, last) % np.uint64(BUCKETS)).astype(np.int64), n


def context_sums(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS + 1): for each word bucket the sum of its neighbours' index vectors over all documents, and its count.

    Every task adds up its texts in one table of fixed size, and the tables are added per bucket; sums are
    integers, so they do not depend on the order.
    """
    arrow_batches(docs.sparkSession)
    names = [f"c{k}" for k in range(DIMS + 1)]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, sign = index_entries()
        total = np.zeros(BUCKETS * DIMS)
        count = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for texts in passes(b.column(0)):
                w, n = word_buckets(texts)
                doc = np.repeat(np.arange(len(texts)), n)
                count += np.bincount(w, minlength=BUCKETS)
                for step in range(1, REACH + 1):
                    one = doc[step:] == doc[:-step]
                    left, right = w[:-step][one], w[step:][one]
                    for a, c in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIMS + where[c, k], sign[c, k], BUCKETS * DIMS)
        some = np.flatnonzero(count)
        sums = total.reshape(BUCKETS, DIMS)[some].astype(np.int64)
        cols = [some, *sums.T, count[some]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["bucket", *names])

    rows = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    out = np.zeros((BUCKETS, DIMS + 1), np.int64)
    for r in rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).collect():  # BUCKETS rows at most
        out[r[0]] = r[1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors after taking off the mean over all words."""
    vectors, count = sums[:, :-1].astype(float), sums[:, -1:].astype(float)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    mean = (vectors * count).sum(axis=0) / max(count.sum(), 1)
    return np.where(count > 0, vectors - mean, 0).astype(np.float32)


def pool(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each whole text's word vectors, the mean squared distance of neighbouring words'
    vectors, the share of words equal to the one before, and the log of the number of words."""
    w, n = word_buckets(texts)
    out = np.zeros((len(texts), POOL))
    some, begin = np.flatnonzero(n), firsts(n)
    for part in np.array_split(some, max(1, len(w) // 50_000)):
        if not len(part):
            continue
        lo = begin[part[0]]
        v = vectors[w[lo : lo + n[part].sum()]]
        at, count = firsts(n[part]), n[part][:, None]
        mean = np.add.reduceat(v, at, axis=0, dtype=np.float64) / count
        out[part, :DIMS] = mean
        out[part, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0, dtype=np.float64) / count - mean**2, 0))
        step = np.zeros((len(v), 2))
        difference = v[1:] - v[:-1]
        step[1:, 0] = np.einsum("ij,ij->i", difference, difference)
        own = w[lo : lo + len(v)]
        step[1:, 1] = own[1:] == own[:-1]
        step[at] = 0  # a text's first word has none before it
        out[part, 2 * DIMS : 2 * DIMS + 2] = np.add.reduceat(step, at, axis=0) / count
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """A two-layer network over standardized pools; score = sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Fit on four fifths of the rows by Adam on the log loss, and the temperature on the rest.

    With no rows, or rows of one class, the network is constant: the smoothed share of class 1.
    """
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))), 1.0)
    if len(np.unique(y)) < 2:
        return flat
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    hold, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z, t = (x - mean) / scale, y.astype(float)
    w = {"w1": r.normal(0, width**-0.5, (width, hidden)), "b1": np.zeros(hidden), "w2": r.normal(0, hidden**-0.5, hidden), "b2": np.array(flat.b2)}
    opt = Adam(w, RATE)
    for _ in range(epochs):
        shuffled = r.permutation(own)
        for k in range(0, len(shuffled), 128):
            i = shuffled[k : k + 128]
            a = np.tanh(z[i] @ w["w1"] + w["b1"])
            g = (1 / (1 + np.exp(-np.clip(a @ w["w2"] + w["b2"], -60, 60))) - t[i]) / len(i)
            back = g[:, None] * w["w2"] * (1 - a * a)
            opt.step({"w1": z[i].T @ back + 1e-4 * w["w1"], "b1": back.sum(axis=0), "w2": a.T @ g + 1e-4 * w["w2"], "b2": np.array(g.sum())})
    net = Network(mean, scale, w["w1"], w["b1"], w["w2"], float(w["b2"]), 1.0)
    half = net.logits(x[hold])[:, None] / 2
    net.temperature = temperature(np.hstack((-half, half)), y[hold].astype(int))
    return net


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and the network from at most ``sample`` labelled rows that are not held out.

    The rows are those with the smallest hashes of doc_id. Labels that are null, or that differ for a doc_id, are
    not learned; of texts that repeat a doc_id the smallest is.
    """
    spark = docs.sparkSession
    vectors = word_vectors(context_sums(docs))
    shared = spark.sparkContext.broadcast(vectors)  # BUCKETS * DIMS numbers, whatever the corpus
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = known.join(rows.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in passes(b.column(2)):
                x = pool(texts, shared.value)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(texts.rows.start, len(texts)) for k in (0, 1)), flat], ["doc_id", "quality", "pool"])

    # of rows that repeat a doc_id one is left before anything is collected: ``sample`` rows at most
    chosen = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted(chosen.mapInArrow(run, "doc_id long, quality int, pool array<double>").collect(), key=lambda r: r[0])
    return vectors, fit(np.array([r[2] for r in got], float).reshape(len(got), POOL), np.array([r[1] for r in got], int))


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, name: str = "score") -> DataFrame:
    """docs with one more column: the quality score of each row's whole text. One pass, no shuffle."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pool(texts, shared.value[0]) for texts in passes(b.column(at))]
            score = shared.value[1].score(np.concatenate(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE, cut_at: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted): a quality score for each row of docs from its text alone.

    Null and empty texts have zero pools and are scored like any other; rows with a null doc_id are scored too;
    repeated rows score alike, as do equal texts; extra columns are ignored; an empty table gives an empty result, and without
    labels of both classes all scores are the smoothed share of label 1. A text is pooled whole, whatever its length.
    """
    vectors, net = learn(docs, labels, folds, fold, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, vectors, net)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut_at: float = CUT, **how) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject (score >= cut_at)."""
    vectors, net = learn(docs, labels, **how)
    name = unused("score", docs)
    return scored(docs, vectors, net, name).where(F.col(name) >= cut_at).drop(name)
