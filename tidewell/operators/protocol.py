"""Ledgers and gates of an experiment: exposure, budgets, generation outcomes, parity, idempotent result journals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.text import first_reason
from tidewell.operators.sequence import running

#: Fixed value: the share of accepted generations below which a stage has deteriorated.
GATE = 0.98


def expected_keys(examples: DataFrame, arms: list[str]) -> DataFrame:
    """(block, arm, example_id, place): every score of the blocks after the first, in the protocol's order."""
    first = examples.agg(F.min("block").alias("first_"))
    rows = examples.join(F.broadcast(first)).where("block > first_").select("block", "example_id", F.posexplode(F.array(*map(F.lit, arms))).alias("arm_no", "arm"))
    order = W.partitionBy("block").orderBy("arm_no", "example_id")
    return rows.select("block", "arm", "example_id", (F.row_number().over(order) - 1).alias("place"))


def exposure(examples: DataFrame, updates: DataFrame, arms: list[str]) -> DataFrame:
    """How often each example was learned from: once for every update of its block, per learning arm."""
    learned = updates.select("block").distinct().withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    return examples.join(learned, "block", "left").groupBy("example_id").agg(F.count("arm").alias("presentations"))


def disposition(finish: Column, text: Column) -> Column:
    """What became of a generation: accepted, truncated, or missing; all but accepted ones are scored as empty."""
    return first_reason((text.isNull(), "missing"), (finish == "length", "truncated"), (F.lit(True), "accepted"))


def gate(rows: DataFrame, threshold: float = GATE) -> DataFrame:
    """Per block: accepted share, and whether the stage is intact. An update waits for it."""
    share = F.avg((F.col("disposition") == "accepted").cast("double"))
    return rows.groupBy("block").agg(F.count("*").alias("n"), share.alias("accepted")).withColumn("state", F.when(F.col("accepted") >= threshold, "intact").otherwise("material_deterioration"))


def outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each disposition, one column each."""
    kinds = ["accepted", "truncated", "missing"]
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("disposition") == k).alias(k) for k in kinds])


def over_budget(operations: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Operations (kind, place, amount) at which the running amount of their kind passes its ceiling (kind, ceiling)."""
    summed = running(operations, ["kind"], ["place"], {"running": F.col("amount")})  # a kind may hold all operations
    return summed.withColumn("running", F.col("running") + F.col("amount")).join(ceilings, "kind").where("running > ceiling")


def usage(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Sums of optional usage fields; a missing one is 0."""
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(F.col(f"usage.{f}"), F.lit(0))).alias(f) for f in fields])


def parity(before: DataFrame, after: DataFrame, tolerance: float) -> DataFrame:
    """Whether a reloaded model scores as before: the largest difference in loss, unequal texts and stops, missing rows."""
    a = before.select("example_id", F.col("nll").alias("a"), F.col("prediction").alias("pa"), F.col("finish").alias("fa"))
    b = after.select("example_id", F.col("nll").alias("b"), F.col("prediction").alias("pb"), F.col("finish").alias("fb"))
    met = a.join(b, "example_id", "full_outer")
    out = met.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"), F.count_if(~F.col("pa").eqNullSafe(F.col("pb"))).alias("texts"), F.count_if(~F.col("fa").eqNullSafe(F.col("fb"))).alias("stops"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"))
    return out.withColumn("passes", (F.coalesce("largest", F.lit(0.0)) <= tolerance) & (F.col("texts") + F.col("stops") + F.col("missing") == 0))


def append_results(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> int:
    """Appends the rows whose keys a result journal does not hold yet, so that a repeated batch adds nothing. Returns how many."""
    try:
        held = spark.read.schema(rows.schema).parquet(path)
        held.limit(1).count()
        new = rows.join(held.select(*keys), keys, "left_anti")
    except AnalysisException as e:  # no journal yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new = rows
    new = new.dropDuplicates(keys).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()
