"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sparktools import cut, unused, written
from tidewell.operators.sequence import global_ordinal

#: The weights that sources take in turn, the share of all words, copies of a document at most.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one group of a level of the reduction tree.
FAN_IN = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) for rows (source, size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all words; a target
    stops at ``most`` times its source's size and the excess is shared again by weight among the
    others until none is above. One row per source: all steps but two sums stay on the executors.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    per = global_ordinal(per, [F.col("source").asc_nulls_last()], "rank")
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    per = cut(per.withColumn("top", F.col("source_size") * F.lit(most)).withColumn("full", F.lit(False)))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    full = 0
    while True:
        used, open_w, n_full = per.agg(F.sum(F.when(F.col("full"), F.col("top")).otherwise(0.0)), F.sum(F.when(~F.col("full"), F.col("w"))), F.count_if("full")).first()
        rate = (share * total - (used or 0.0)) / open_w if open_w else 0.0
        over = F.col("full") | (F.col("w") * F.lit(rate) > F.col("top"))
        now = per.agg(F.count_if(over)).first()[0]
        if now == full:
            return per.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("top")).otherwise(F.col("w") * F.lit(rate)).alias("target"))
        per, full = cut(per.withColumn("full", over)), now


def pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round all but one of the fractions: pairs move size-weighted mass until one of them is 0 or 1.

    Each pair keeps size_i * part_i + size_j * part_j, and each fraction its expectation. The rows that are
    left fractional pair again, halving each time. draw: a uniform number in [0, 1) for each row.
    """
    part = part.copy()
    live = np.flatnonzero((part > 0) & (part < 1) & (size > 0))
    turn = 0
    while len(live) > 1:
        i, j = live[0 : len(live) - 1 : 2], live[1::2]
        a, b, si, sj = part[i], part[j], size[i], size[j]
        up = np.minimum((1 - a) * si, b * sj)  # words that may move from j to i
        down = np.minimum(a * si, (1 - b) * sj)  # and from i to j
        u = (draw[i] + draw[j] * 0.6180339887 + turn * 0.7548776662) % 1.0
        rise = u < down / (up + down)
        move = np.where(rise, up, -down)
        x, y = a + move / si, b - move / sj
        # the one that met its end gets the integer itself, not a rounded neighbour of it
        x = np.where(rise & (up == (1 - a) * si), 1.0, np.where(~rise & (down == a * si), 0.0, x))
        y = np.where(rise & (up == b * sj), 0.0, np.where(~rise & (down == (1 - b) * sj), 1.0, y))
        part[i], part[j] = np.clip(x, 0, 1), np.clip(y, 0, 1)
        left = live[-1:] if len(live) % 2 else live[:0]
        pair = np.where((part[i] > 0) & (part[i] < 1), i, j)
        live = np.concatenate((pair[(part[pair] > 0) & (part[pair] < 1)], left))
        turn += 1
    return part


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, fan_in: int = FAN_IN, key: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix repeats each document; with ``key``, that column as well.

    A document's expected copies are its source's target / source_size; the whole part is kept and the
    fraction rounded by pivotal dependent rounding: groups of about ``fan_in`` rows of a source are
    rounded to one fractional row at most, and those rows meet in the next level of the tree, until a
    source has one, which a hash rounds. So a source takes its target to within about one document.
    A hot source is dealt over many groups. Size 0, null text included: never rounded, 1 copy at most.
    Rows that repeat a doc_id, or have none, are rounded each on its own, in the order of hashes of their texts; rows equal in text as
    well are interchangeable. Null sources are one source; an empty table gives an empty result; extra columns are ignored. Reruns
    agree: all draws are hashes of seed, doc_id and text. A very long text counts whole and is taken like any other, so a
    source comes to within it of its target.
    """
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    own = [F.monotonically_increasing_id().alias("key")] if key is None else [F.col(key).alias("key")]
    sizes = cut(docs.select("doc_id", "source", n_words.alias("size"), F.xxhash64("text").alias("digest"), *own))
    targets = cut(source_targets(sizes, weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(F.broadcast(targets) if targets.count() < 10_000 else targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("base", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    rows = cut(rows)
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    schema = "source string, key long, doc_id long, digest long, size long, part double, n_docs long"

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "digest", "key"], kind="stable").reset_index(drop=True)
        ids = pdf["doc_id"].fillna(-1).to_numpy(np.int64).view(np.uint64)
        again = pdf.groupby(["doc_id", "digest"], dropna=False).cumcount().to_numpy(np.uint64)  # equal rows draw differently
        ids = ids ^ np.where(again > 0, pdf["digest"].to_numpy(np.int64).view(np.uint64) + again, np.uint64(0))
        z = (ids + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        draw = (z >> np.uint64(11)).astype(float) / 2.0**53
        pdf["part"] = pivot(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), draw)
        return pdf

    open_rows, done, per_group = rows.where("part > 0 and size > 0").select("source", "key", "doc_id", "digest", "size", "part", "n_docs"), [], fan_in
    while True:
        groups = F.ceil(F.col("n_docs") / F.lit(per_group))
        dealt = open_rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed + per_group)), groups))
        rounded = cut(dealt.groupBy("source", "g").applyInPandas(lambda pdf: level(pdf.drop(columns="g")), schema))
        whole = (F.col("part") == 0) | (F.col("part") == 1)
        done.append(rounded.where(whole))
        open_rows = rounded.where(~whole)
        if per_group >= most_docs:
            break
        per_group *= fan_in
    last = open_rows.withColumn("part", (F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) < F.col("part")).cast("double"))
    for d in done:
        last = last.union(d)
    picked = rows.join(last.select("key", F.col("part").alias("up")), "key", "left")
    copies = F.col("base") + F.coalesce(F.col("up"), F.lit(0.0)).cast("long")
    return picked.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), copies.cast("long").alias("copies"), *([] if key is None else [F.col("key").alias(key)]))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it; a row is any row, with or without a doc_id of its own."""
    own, times = unused("row_", docs), unused("times", docs)
    rows = written(docs.withColumn(own, F.monotonically_increasing_id()))  # kept, so that a row has one number in both uses
    copies = mix(rows, key=own, **how).where("copies > 0").select(own, F.col("copies").cast("int").alias(times))
    out = rows.join(copies, own)
    return out.withColumn(own, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
