"""Language identification by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.bytestext import passes
from tidewell.llm.neural import Adam, temperature
from tidewell.llm.quality import held_out
from tidewell.llm.sparktools import arrow_batches, released

#: Bytes in a window, of a byte's vector, in each width of filters, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 128, 6, (2, 3, 4), 12
#: Rows that the network is fitted on at most, as many of each language (those with the smallest hashes of doc_id), all of their windows; training passes.
SAMPLE, EPOCHS, RATE, BATCH = 800, 4, 4e-3, 64
#: Windows in one numpy pass.
TOGETHER = 256


def windows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Batches of whole texts as (n, WINDOW) bytes, each window's text and number of bytes, and the rows.

    A-Z are lower-cased, digits are one byte. Windows follow each other and overlap by the widest filter less one, so each
    stretch of that many bytes lies whole in a window; the last one is filled up with 0.
    """
    step = WINDOW - max(WIDTHS) + 1
    for texts in passes(column):
        data = texts.lowered()
        data[(data >= 48) & (data <= 57)] = 48
        padded = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
        lens = texts.ends - texts.starts
        n = np.where(lens > 0, np.maximum(1, -(-(lens - max(WIDTHS) + 1) // step)), 0)
        text = np.repeat(np.arange(len(texts)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = texts.starts[text] + k * step
        room = np.minimum(texts.ends[text] - at, WINDOW)
        rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at]
        rows[np.arange(WINDOW)[None, :] >= room[:, None]] = 0
        yield rows, text, room, texts.rows


@dataclass
class ByteNet:
    """Byte vectors, filters of several widths with max pooling over the window, and a softmax layer."""

    weights: dict[str, np.ndarray]
    classes: list[str]
    temperature: float = 1.0

    @staticmethod
    def fresh(classes: list[str], seed: int = 11) -> ByteNet:
        r = np.random.default_rng(seed)
        w = {"e": r.normal(0, 0.5, (256, EMBED))}
        for k in WIDTHS:
            w[f"f{k}"] = r.normal(0, (k * EMBED) ** -0.5, (k * EMBED, FILTERS))
            w[f"c{k}"] = np.zeros(FILTERS)
        w["w"] = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes)))
        w["b"] = np.zeros(len(classes))
        return ByteNet({k: v.astype(np.float32) for k, v in w.items()}, classes)

    def pool(self, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w, out = self.weights, []
        x = w["e"][rows]
        for k in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(-1, k * EMBED)
            z = (cols @ w[f"f{k}"]).reshape(len(rows), WINDOW - k + 1, FILTERS)
            if keep is not None:
                keep[k] = (cols, z.argmax(axis=1))
            out.append(np.maximum(z.max(axis=1) + w[f"c{k}"], 0))
        return np.hstack(out)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return self.pool(rows) @ self.weights["w"] + self.weights["b"]

    def grads(self, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, keep = self.weights, {}
        h = self.pool(rows, keep)
        z = h @ w["w"] + w["b"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"w": h.T @ p, "b": p.sum(axis=0), "e": np.zeros_like(w["e"])}
        back = (p @ w["w"].T) * (h > 0)
        for j, k in enumerate(WIDTHS):
            cols, best = keep[k]
            d = back[:, j * FILTERS : (j + 1) * FILTERS]
            at = (np.arange(len(rows))[:, None] * (WINDOW - k + 1) + best).ravel()
            picked = cols[at].reshape(len(rows), FILTERS, k * EMBED)
            g[f"f{k}"] = np.einsum("nfc,nf->cf", picked, d)
            g[f"c{k}"] = d.sum(axis=0)
            into = (d[:, :, None] * w[f"f{k}"].T[None]).reshape(len(rows), FILTERS, k, EMBED)
            for s in range(k):
                np.add.at(g["e"], rows[np.arange(len(rows))[:, None], best + s], into[:, :, s])
        return g


def fit(rows: np.ndarray, y: np.ndarray, hold: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
    """Train on the windows that are not on hold; the temperature is fitted on those that are."""
    net, r = ByteNet.fresh(classes, seed), np.random.default_rng(seed)
    own = np.flatnonzero(~hold)
    opt = Adam(net.weights, RATE)
    for _ in range(epochs):
        order = r.permutation(own)
        for k in range(0, len(order), BATCH):
            i = order[k : k + BATCH]
            opt.step(net.grads(rows[i], y[i]))
    if hold.any():
        net.temperature = temperature(np.concatenate([net.logits(rows[hold][k : k + TOGETHER]) for k in range(0, hold.sum(), TOGETHER)]), y[hold])
    return net


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of each row's whole text.

    Learned from the whole texts and non-null lang of at most ``sample`` rows that are not held out, as many of each language, the ones with
    the smallest hashes of doc_id; so a rare language is learned too. Of more languages than ``sample`` the most frequent are learned. A text's scores are the softmax of its windows' mean
    logits, weighted by their bytes and divided by the calibrated temperature; ties go to the first language in order.
    Null texts and texts without a letter are ``und`` with score 0; so are all if nothing can be learned. Repeated
    rows and rows without a doc_id are predicted like any other; extra columns are ignored; an empty table gives an empty result. A
    text is predicted from all its windows, whatever its length.
    """
    arrow_batches(docs.sparkSession)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where("lang is not null and doc_id is not null").where(letter & ~held_out(F.col("doc_id"), folds, fold))
    pairs = known.select("doc_id", "lang").distinct()
    per = pairs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    each = max(1, sample // max(1, per.count()))
    # about twice as many as wanted by the hash alone, so that the ranking sees a bounded number of each language
    hashed = pairs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).join(F.broadcast(per), "lang")
    near = hashed.where(F.col("h") / F.lit(float(1 << 40)) * F.col("n") <= 2 * each + 50)  # in double: a language may have any number of rows
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= each).select("doc_id", "lang")

    @released
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for win, text, _, at in windows(b.column(2)):
                ids, langs = (b.column(c).slice(at.start, at.stop - at.start).take(pa.array(text)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, langs, pa.array([x.tobytes() for x in win], pa.binary())], ["doc_id", "lang", "bytes"])

    # of rows that repeat a doc_id one is left: the windows of sample texts at most reach the driver
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(pieces, "doc_id long, lang string, bytes binary").collect()
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    classes = sorted({r[1] for r in got})
    net = None
    if classes:
        data = np.frombuffer(b"".join(bytes(r[2]) for r in got), np.uint8).reshape(-1, WINDOW)
        y = np.searchsorted(classes, [r[1] for r in got])
        net = fit(data, y, np.array([r[0] % 7 == 3 for r in got]), classes)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for win, text, room, at in windows(b.column(1)):
                n = at.stop - at.start
                total, weight = np.zeros((n, len(net.classes))), np.bincount(text, room, n)
                for k in range(0, len(win), TOGETHER):
                    part = slice(k, k + TOGETHER)
                    np.add.at(total, text[part], net.logits(win[part]) * room[part, None])
                z = total / np.maximum(weight, 1)[:, None] / net.temperature
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at.start, n), b.column(2).slice(at.start, n), pa.array([net.classes[i] for i in best], pa.string()), pa.array(p[np.arange(n), best].astype(float))], ["doc_id", "letter", "lang_pred", "score"])

    marked = rows.select("doc_id", "text", letter.alias("letter"))
    if net is None:
        out = marked.select("doc_id", F.lit(False).alias("letter"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = marked.mapInArrow(run, "doc_id long, letter boolean, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))
