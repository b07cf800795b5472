"""Prequential evaluation: score a block with every arm, then update, then go on with the next block."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.sources.shared import cut


class Backend(Protocol):
    """A model behind an interface: scores examples under an arm and a checkpoint, and learns from a block."""

    def score(self, rows: DataFrame, arm: str, checkpoint: str) -> DataFrame: ...

    def update(self, rows: DataFrame, checkpoint: str, block: int) -> str: ...


class MockBackend:
    """A deterministic stand-in: predictions and losses are functions of the digest of arm, checkpoint and example."""

    def score(self, rows: DataFrame, arm: str, checkpoint: str) -> DataFrame:
        h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(arm), F.lit(checkpoint), F.col("example_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
        return rows.withColumn("prediction", F.substring("target", F.lit(1), (F.length("target") * (h % 5) / 4).cast("int"))).withColumn("nll", F.length("target") * (1 + (h % 100) / 100)).withColumn("tokens", F.length("target"))

    def update(self, rows: DataFrame, checkpoint: str, block: int) -> str:
        return f"{checkpoint}/{block}"


def run(examples: DataFrame, arms: list[str], backend: Backend, learning: str, start: str = "base") -> tuple[DataFrame, DataFrame]:
    """(scores, updates) for examples (example_id, block, target): blocks in order, the first one only to learn from.

    The learning arm scores a block with the checkpoint that came before it and learns from it afterwards; the other
    arms stay at the start. The loop is over blocks; inside a block all work is on frames. The last block brings no update.
    """
    blocks = [r[0] for r in examples.select("block").distinct().orderBy("block").collect()]  # one number a block
    checkpoint, scores, updates = start, None, []
    for k, block in enumerate(blocks):
        rows = examples.where(F.col("block") == block)
        if k:
            for arm in arms:
                used = checkpoint if arm == learning else start
                got = backend.score(rows, arm, used).select("block", F.lit(arm).alias("arm"), "example_id", "target", "prediction", F.col("nll").cast("double").alias("nll"), F.col("tokens").cast("long").alias("tokens"), F.lit(used).alias("checkpoint"))
                scores = got if scores is None else scores.unionByName(got)
        if k < len(blocks) - 1:
            new = backend.update(rows, checkpoint, block)
            updates.append((block, checkpoint, new))
            checkpoint = new
    spark = examples.sparkSession
    table = spark.createDataFrame(updates, "block long, parent string, checkpoint string")
    seen = examples.groupBy("block").agg(F.count("*").alias("n"))
    table = table.join(seen, "block").withColumn("seen", F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)))  # one row a block
    empty = spark.createDataFrame([], "block long, arm string, example_id string, target string, prediction string, nll double, tokens long, checkpoint string")
    return cut(scores) if scores is not None else empty, table


def protocol_violations(scores: DataFrame, updates: DataFrame, examples: DataFrame, arms: list[str], learning: str) -> DataFrame:
    """The rules of the protocol with the rows that break each."""
    first = examples.agg(F.min("block")).first()[0]
    wanted = examples.where(F.col("block") > F.lit(first)).select("block", "example_id").withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    key = ["block", "arm", "example_id"]
    parent = F.lag("checkpoint").over(W.orderBy("block"))
    used = scores.where(F.col("arm") == learning).select("block", "checkpoint").distinct()
    before = updates.select((F.col("block") + 1).alias("block"), F.col("checkpoint").alias("expected"))
    rules = [
        ("missing scores", wanted.join(scores, key, "left_anti")),
        ("scores not asked for", scores.join(wanted, key, "left_anti")),
        ("scored twice", scores.groupBy(*key).count().where("count > 1")),
        ("broken ancestry", updates.withColumn("p", parent).where("p is not null and p <> parent")),
        ("checkpoint of another block", used.join(before, "block").where("checkpoint <> expected")),
    ]
    out = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, rows in rules]
    for r in out[1:]:
        out[0] = out[0].union(r)
    return out[0]
