"""Histories and targets as token sequences with labels, spans and budgets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import sequence

#: The label of positions without loss, the end of a target, what stands for a paste.
IGNORED, END, PASTE = -100, 1, 2


def byte_tokens(text: str) -> list[int]:
    """The default tokenizer: UTF-8 bytes, after the special ids."""
    return [b + 3 for b in text.encode()]


def tokenized(rows: DataFrame, text: str, name: str = "tokens", tokenizer: Callable[[str], list[int]] = byte_tokens) -> DataFrame:
    """Adds the text's token ids by any tokenizer, in Arrow batches; a null text has none."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: tokenizer(x) if x is not None else [])

    return rows.withColumn(name, run(F.col(text)))


def packed_input(blocks: DataFrame, target: list[str], newest_first: list[Column], order: list[str], fixed: str, budget: int) -> DataFrame:
    """Per target: the tokens of the longest suffix of blocks that fits beside ``fixed`` tokens, and the blocks' spans.

    blocks: (target, order, block_id, tokens, fixed). The first block beyond the room keeps its newest tokens if any fit.
    Returns (target, input_ids, spans array of (block_id, start, end, cut)).
    """
    rows = blocks.withColumn("n_", F.size("tokens")).withColumn("room_", F.greatest(F.lit(budget) - F.col(fixed), F.lit(0)))
    kept = sequence.suffix_budget(rows, target, newest_first, "n_", "room_").where("kept is not null and kept_tokens > 0")
    part = F.slice("tokens", (F.col("n_") - F.col("kept_tokens") + 1).cast("int"), F.col("kept_tokens").cast("int"))
    kept = kept.withColumn("part_", part).select(*target, F.struct(*order, "block_id", F.col("part_").alias("ids"), (F.col("kept") == "partial").alias("cut")).alias("b"))
    got = kept.groupBy(*target).agg(F.array_sort(F.collect_list("b")).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<block_id:string,start:int,end:int,cut:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = (s["at"] + F.size(x["ids"])).cast("int")
        span = F.struct(x["block_id"].cast("string").alias("block_id"), s["at"].alias("start"), end.alias("end"), x["cut"].alias("cut"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return got.select(*target, F.flatten(F.transform("b", lambda x: x["ids"])).alias("input_ids"), F.aggregate("b", start, step)["out"].alias("spans"))


def target_tokens(segments: Column) -> Column:
    """Tokens of ordered segments (type, tokens): authored ones as they are, pastes as one mark, then one end."""
    parts = F.transform(segments, lambda s: F.when(s["type"] == "paste", F.array(F.lit(PASTE))).otherwise(s["tokens"]))
    return F.array_append(F.flatten(parts), END)


def with_labels(rows: DataFrame, inputs: str = "input_ids", target: str = "target_ids") -> DataFrame:
    """Adds sequence_ids, labels (none on the input), attention, and the causal shift: tokens_in, tokens_out, weights."""
    n = F.size(inputs)
    out = rows.withColumn("sequence_ids", F.concat(inputs, target)).withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORED), n), F.col(target)))
    out = out.withColumn("attention", F.transform("sequence_ids", lambda x: F.lit(1)))
    size = F.size("sequence_ids")
    later = F.slice("labels", F.lit(2), F.greatest(size - 1, F.lit(0)))
    return out.withColumns({
        "tokens_in": F.slice("sequence_ids", F.lit(1), F.greatest(size - 1, F.lit(0))),
        "tokens_out": F.slice("sequence_ids", F.lit(2), F.greatest(size - 1, F.lit(0))),
        "weights": F.transform(later, lambda y: F.when(y == IGNORED, 0.0).otherwise(1.0).cast("float")),
    })


def padded(rows: DataFrame, batch: str, column: str = "sequence_ids", pad: int = 0) -> DataFrame:
    """Adds padded and mask: each row filled up to the longest of its batch."""
    longest = rows.groupBy(batch).agg(F.max(F.size(column)).alias("most_"))
    out = rows.join(longest, batch)
    more = F.col("most_") - F.size(column)
    return out.withColumn("padded", F.concat(column, F.array_repeat(F.lit(pad), more))).withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(column)), F.array_repeat(F.lit(0), more))).drop("most_")


def batch_weights(rows: DataFrame, batch: str, tokens: str) -> DataFrame:
    """Adds weight: one over the batch's loss tokens, as float32."""
    total = rows.groupBy(batch).agg(F.sum(tokens).alias("total_"))
    return rows.join(total, batch).withColumn("weight", (1 / F.nullif(F.col("total_"), F.lit(0))).cast("float")).drop("total_")


def violations(rows: DataFrame, budget: int) -> DataFrame:
    """The constraints of packed rows with the number that break each: all zero is a pass."""
    ends = F.size(F.filter("target_ids", lambda x: x == END))
    spans = F.col("spans")
    joined = F.forall(F.sequence(F.lit(0), F.greatest(F.size(spans) - 2, F.lit(0))), lambda i: (F.size(spans) < 2) | (F.get(spans, i)["end"] == F.get(spans, i + 1)["start"]))
    rules = {
        "input beyond the budget": F.size("input_ids") > budget,
        "target without exactly one end": (ends != 1) | (F.element_at("target_ids", -1) != END),
        "labels and sequence differ in length": F.size("labels") != F.size("sequence_ids"),
        "loss on the input": F.exists(F.slice("labels", F.lit(1), F.greatest(F.size("input_ids"), F.lit(1))), lambda y: y != IGNORED) & (F.size("input_ids") > 0),
        "spans not contiguous": ~joined,
        "a newer block is cut": F.exists(F.slice(spans, F.lit(2), F.greatest(F.size(spans), F.lit(1))), lambda s: s["cut"]),
    }
    counted = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("violations")) for k, name in enumerate(rules)]
    return counted.select(F.inline(F.array(*pairs)))
