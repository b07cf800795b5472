"""Which writes may be one composition: runs of neighbours, all their parts, and a choice of parts that share nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.sequence import ordinal_within, running
from tidewell.sources.shared import cut


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], goes_on, carried: Sequence[str]) -> DataFrame:
    """Adds place (from 0) and run (from 1) among a key's rows: a row goes on with the one before where goes_on(before, row) holds.

    carried: the columns that goes_on reads of both, as structs. Rows meet the one before by place and runs are numbered by ranges, so no task holds a key.
    """
    placed = ordinal_within(rows, keys, order, "place")
    prior = placed.select(*[F.col(k).alias(f"{k}_of") for k in keys], (F.col("place") + 1).alias("place_of"), F.struct(*carried).alias("before_"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys] + [F.col("place") == F.col("place_of")]
    met = placed.join(prior, on, "left").withColumn("begins_", F.when(F.coalesce(goes_on(F.col("before_"), F.struct(*carried)), F.lit(False)), 0).otherwise(1))
    numbered = running(met.select(*rows.columns, "place", "begins_"), keys, ["place"], {"run": F.col("begins_")})
    return numbered.withColumn("run", (F.col("run") + F.col("begins_")).cast("long")).drop("begins_")


def subruns(placed: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """(keys, run, first, last): all parts of at least so many neighbours of each run, as places, without their members.

    They are as many as the square of a run by their nature; a run's parts are made by as many tasks as it has first rows.
    """
    ends = placed.groupBy(*keys, "run").agg(F.min("place").alias("from_"), F.max("place").alias("to_")).where(F.col("to_") - F.col("from_") + 1 >= least)
    firsts = ends.select(*keys, "run", "to_", F.explode(F.sequence("from_", F.col("to_") - (least - 1))).alias("first"))
    spread = firsts.repartition(*keys, "first")
    return spread.select(*keys, "run", "first", F.explode(F.sequence(F.col("first") + (least - 1), "to_")).alias("last"))


def longest_unlike(placed: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """(keys, run, first, last): of the parts of each run whose ends are of different kinds, what a choice one by one takes: the longest first, then the earliest, none sharing a row.

    That is one part of a run at most, so no part is made but the one taken. The longest one leaves rows out at one end only, else it could be longer; these are all of
    the kind of the run's outermost row there or have none, so no further part with ends of different kinds is left among them. Each kind's first and last
    place says which it is: from the run's first place to its last if they are of different kinds, else the longer of what is left by cutting that
    kind off at either end. A null kind is unlike none. A run's kinds are summed, never listed, so a run may hold any share of the rows.
    """
    of = [*keys, "run"]
    kinds = placed.where(F.col(kind).isNotNull()).groupBy(*of, kind).agg(F.min("place").alias("lo_"), F.max("place").alias("hi_"))
    ends = kinds.groupBy(*[F.col(k).alias(f"{k}_of") for k in of]).agg(F.min("lo_").alias("from_"), F.max("hi_").alias("to_"), F.count("*").alias("kinds_")).where("kinds_ > 1")
    met = kinds.join(ends, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in of])
    begins, closes = F.col("lo_") == F.col("from_"), F.col("hi_") == F.col("to_")
    told = met.groupBy(*of, "from_", "to_").agg(F.bool_or(begins & closes).alias("alike_"), F.min(F.when(~begins, F.col("lo_"))).alias("later_"), F.max(F.when(~closes, F.col("hi_"))).alias("sooner_"))
    early = F.col("sooner_") - F.col("from_") >= F.col("to_") - F.col("later_")  # as long from the run's first row as to its last: the earlier one
    first = F.when(~F.col("alike_") | early, F.col("from_")).otherwise(F.col("later_"))
    last = F.when(F.col("alike_") & early, F.col("sooner_")).otherwise(F.col("to_"))
    return told.select(*of, first.alias("first"), last.alias("last"))


def best_apart(candidates: DataFrame, keys: Sequence[str], better: Sequence[Column], members: Column, rounds: int = 10_000) -> DataFrame:
    """The candidates that a choice one by one in the order of ``better`` takes: each one that shares no member with one taken before.

    A candidate is taken in a round if it is the best of all that are left at each of its members; those that share a member with it then go. That
    takes the same as the choice one by one: nothing better is left that could be taken in its place. Members' best ones are
    found by sums that are combined before they are shuffled, so no task holds a key. ``better`` must tell all candidates of a key apart.
    members: an array; a candidate without members is taken.
    """
    named = cut(candidates.withColumn("order_", F.struct(*better)).withColumn("members_", F.array_distinct(members)))
    own = [F.col(k).alias(f"{k}_k") for k in keys]
    names = [f"{k}_k" for k in keys]
    left = cut(named.select(*own, "order_", F.explode("members_").alias("member_")))
    taken = named.where(F.size("members_") == 0).select(*own, "order_")
    for _ in range(rounds):
        best = left.groupBy(*names, "member_").agg(F.min("order_").alias("best_"))
        met = left.join(best.withColumnsRenamed({k: f"{k}2" for k in names} | {"member_": "m2_"}), [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in names] + [F.col("member_") == F.col("m2_")])
        won = cut(met.groupBy(*names, "order_").agg(F.bool_and(F.col("order_") == F.col("best_")).alias("won_")).where("won_").select(*names, "order_"))
        if won.isEmpty():
            break
        taken = taken.unionByName(won)
        same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
        held = left.alias("l").join(won.alias("w"), [*same("l", "w"), F.col("l.order_") == F.col("w.order_")]).select("l.*")
        gone = left.alias("l").join(held.select(*names, "member_").alias("h"), [*same("l", "h"), F.col("l.member_") == F.col("h.member_")]).select(*[F.col(f"l.{k}") for k in names], "l.order_").distinct()
        left = cut(left.alias("l").join(gone.alias("g"), [*same("l", "g"), F.col("l.order_") == F.col("g.order_")], "left_anti"))
    else:
        raise RuntimeError(f"the choice did not settle in {rounds} rounds")
    on = [F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in keys] + [F.col("order_") == F.col("o_")]
    return named.join(taken.withColumnRenamed("order_", "o_"), on, "left_semi").select(*candidates.columns)
