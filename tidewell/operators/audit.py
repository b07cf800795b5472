"""Audits as tables of rules with the number of rows that break each: a pass is all zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.proposals import best_apart

def counted(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) from frames of violating rows."""
    parts = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, rows in rules.items()]
    return reduce(DataFrame.union, parts)


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row conditions that must hold, in one pass; a null counts as broken."""
    sums = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{k}").alias("violations")) for k, n in enumerate(rules)])))


def require(audit: DataFrame) -> None:
    """Raises if a rule is broken, naming each."""
    broken = audit.where("violations > 0").collect()  # a row a rule at most
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str]) -> dict[str, DataFrame]:
    """Rules of set equality: keys of each side that the other lacks."""
    return {f"{names[0]} not in {names[1]}": a.join(b, keys, "left_anti"), f"{names[1]} not in {names[0]}": b.join(a, keys, "left_anti")}


def exact_partition(items: DataFrame, groups: DataFrame, item: str, members: str) -> dict[str, DataFrame]:
    """Rules that each item is a member of exactly one group."""
    held = groups.select(F.explode(members).alias(item))
    return {"items in no group": items.join(held, item, "left_anti"), "items in two groups": held.groupBy(item).count().where("count > 1"), "members that are no items": held.join(items, item, "left_anti")}


def causal_dataset(events: DataFrame, examples: DataFrame, exclusions: DataFrame, rejections: DataFrame) -> DataFrame:
    """The audit of a compiled dataset: writes are covered exactly once, contexts are strictly earlier, in order, and join to the text.

    events: (session_id, event_id, kind, available_at); examples as compile.examples gives them.
    """
    writes = events.where("kind = 'write'").select("event_id")
    covered = examples.select("event_id").union(exclusions.select("event_id")).union(rejections.where("kind = 'write'").select("event_id"))
    members = examples.select("event_id", "began_at", F.posexplode("context_ids").alias("place", "member_id"))
    known = members.join(events.select(F.col("event_id").alias("member_id"), "available_at"), "member_id", "left")
    before = F.lag("available_at").over(W.partitionBy("event_id").orderBy("place"))
    return counted({
        **same_keys(writes, covered, ["event_id"], ("writes", "examples and exclusions")),
        "writes covered twice": covered.groupBy("event_id").count().where("count > 1"),
        "context of unknown events": known.where("available_at is null"),
        "context not strictly earlier": known.where("available_at >= began_at"),
        "context out of order": known.withColumn("before_", before).where("available_at < before_"),
        "context and count differ": examples.where(F.size("context_ids") != F.col("n_context")),
        "input is not context and query": examples.where(F.col("model_input") != F.when(F.col("context") == "", F.col("query")).otherwise(F.concat("context", F.lit("\n"), "query"))),
    })


def corpus(blocks: DataFrame) -> DataFrame:
    """The audit of context blocks: positions without holes, redactions with a digest, gaps only between sessions."""
    n = blocks.agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    last = W.partitionBy("session_ordinal").orderBy(F.col("position").desc())
    return counted({
        "positions with holes": n.where("n > 0 and (n <> d or lo <> 0 or hi <> n - 1)"),
        "redacted without a digest": blocks.where(F.col("serialized").contains('"redacted":true') & F.col("source_sha256").isNull()),
        "gap inside a session": blocks.withColumn("r_", F.row_number().over(last)).where("block_type = 'gap' and r_ > 1"),
    })


def nested_suffixes(small: DataFrame, large: DataFrame, key: str, ids: str) -> dict[str, DataFrame]:
    """A rule that the smaller budget's blocks are the newest of the larger's."""
    met = small.select(key, F.col(ids).alias("s_")).join(large.select(key, F.col(ids).alias("l_")), key, "left")
    n = F.size("s_")
    suffix = F.slice("l_", F.greatest(F.size("l_") - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))
    return {"smaller history is no suffix of the larger": met.where(F.col("l_").isNull() | (suffix != F.col("s_")))}


def maximal_groups(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Longest groups first, then the earliest, leaving out those that share a member with one taken before.

    candidates: (keys, candidate_id, began_at, members array).
    """
    return best_apart(candidates, keys, [-F.size("members"), F.col("began_at"), F.col("candidate_id")], F.col("members"))


def tampered(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables of two manifests (table, digest) that differ or are missing."""
    e, a = expected.select("table", F.col("digest").alias("was")), actual.select("table", F.col("digest").alias("is"))
    return e.join(a, "table", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("table", "was", "is")
