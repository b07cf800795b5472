"""Scores of predicted texts, latencies and likelihoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import normalized_line, occurrences, prefix_length
from tidewell.operators.sequence import ordinal_within

#: Fixed value: what stands for a pasted payload in a target.
PASTE = "<|paste|>"


def row_scores(rows: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Adds the measures of each pair: equality, distance, lengths, prefix, pastes. Nulls count as empty texts."""
    t, p = F.coalesce(F.col(target), F.lit("")), F.coalesce(F.col(prediction), F.lit(""))
    most = F.greatest(F.length(t), F.length(p))
    out = rows.withColumns({"exact": t == p, "normalized_exact": normalized_line(t) == normalized_line(p), "empty": p == "", "distance": F.levenshtein(t, p), "longer": most, "target_length": F.length(t), "prefix": prefix_length(t, p)})
    out = out.withColumn("similarity", F.coalesce(1 - F.col("distance") / F.nullif(F.col("longer"), F.lit(0)), F.lit(1.0)))
    out = out.withColumn("prefix_coverage", F.col("prefix") / F.nullif(F.col("target_length"), F.lit(0)))
    return out.withColumns({"target_pastes": occurrences(F.lit(PASTE), t), "predicted_pastes": occurrences(F.lit(PASTE), p)}).withColumn("true_pastes", F.least("target_pastes", "predicted_pastes"))


def scorecard() -> list[Column]:
    """Aggregates of row_scores: macro and micro similarity, prefix coverage, paste precision and recall.

    Ratios are null where their denominator is 0; coverage means skip rows with an empty target.
    """
    ratio = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    return [
        F.count("*").alias("n"),
        F.count_if("exact").alias("n_exact"),
        F.count_if("normalized_exact").alias("n_normalized_exact"),
        F.count_if("empty").alias("n_empty"),
        F.avg("similarity").alias("macro_similarity"),
        (1 - ratio("distance", "longer")).alias("micro_similarity"),
        F.avg("prefix_coverage").alias("macro_prefix_coverage"),
        ratio("prefix", "target_length").alias("micro_prefix_coverage"),
        ratio("true_pastes", "predicted_pastes").alias("paste_precision"),
        ratio("true_pastes", "target_pastes").alias("paste_recall"),
    ]


def by_strata(scored: DataFrame, arm: str, *strata: str) -> DataFrame:
    """The scorecard over all rows of an arm and over each stratum, in one pass of grouping sets."""
    sets = [[F.col(arm)], *[[F.col(arm), F.col(s)] for s in strata]]
    return scored.groupingSets(sets, arm, *strata).agg(F.grouping_id().alias("level"), *scorecard())


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, a column for each quantile): percentiles with linear interpolation at (n - 1) q, for groups of any size.

    Values are numbered in order by ranges, and the two ranks around each quantile are picked out, so no task holds a group's values. Null values
    don't count; a group without others has no row. A null key is a group.
    """
    numbers = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x_"))
    placed = ordinal_within(numbers, keys, ["x_"], "at_")
    sizes = placed.groupBy(*[F.col(k).alias(f"{k}_own") for k in keys]).agg(F.count("*").alias("n_"))
    met = placed.join(sizes, [F.col(k).eqNullSafe(F.col(f"{k}_own")) for k in keys])
    spots = {name: (F.col("n_") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    wanted = [f(c) for c in spots.values() for f in (F.floor, F.ceil)]
    few = met.where(F.col("at_").isin(*wanted))
    pick = lambda rank: F.max(F.when(F.col("at_") == rank, F.col("x_")))
    n = F.max("n_")
    parts = {}
    for name, q in quantiles.items():
        spot = (n - 1) * F.lit(float(q))
        low, high = pick(F.floor(spots[name])), pick(F.ceil(spots[name]))
        parts[name] = F.when(F.floor(spot) == F.ceil(spot), low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)
    return few.groupBy(*keys).agg(*[c.alias(name) for name, c in parts.items()])


def latency_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, total, mean, median, p90, p95, least, most) of each group's values; percentiles are exact."""
    x = F.col(value).cast("double")
    sums = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    ranks = exact_percentiles(rows, keys, value, {"median": 0.5, "p90": 0.9, "p95": 0.95}).withColumnsRenamed({k: f"{k}_of" for k in keys})
    met = sums.join(ranks, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys], "left")
    return met.select(*keys, "n", "total", "mean", "median", "p90", "p95", "least", "most")


def likelihood_summary(nll: str, tokens: str) -> list[Column]:
    """Macro: mean of rows' means; micro: all over all. In nats."""
    return [F.avg(F.col(nll) / F.nullif(F.col(tokens), F.lit(0))).alias("macro_nll"), (F.sum(nll) / F.nullif(F.sum(tokens), F.lit(0))).alias("micro_nll")]


def bits_saved(base: str, other: str) -> Column:
    return (F.sum(F.col(base) - F.col(other)) / F.log(F.lit(2.0))).alias("bits_saved")


def weighted_nll(logprobs: Column, labels: Column, ignored: int = -100) -> Column:
    """Minus the sum of log probabilities at labels that count."""
    return -F.aggregate(F.zip_with(logprobs, labels, lambda p, y: F.when(y == ignored, 0.0).otherwise(p)), F.lit(0.0), lambda a, x: a + x)
