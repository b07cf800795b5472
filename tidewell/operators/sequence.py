"""Ordered rows: islands, chains, blocks, viewports, bursts and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.text import novel_lines
from tidewell.sources.shared import cut

#: Fixed: first places of at most so many keys are broadcast.
_FEW_KEYS = 20_000


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], joined: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows of a key: a row goes on with the one before where ``joined`` holds.

    ``joined`` may use lag() over the same window; a key's first row begins its run 1.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    begins = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("begins_", begins).withColumn(name, F.sum("begins_").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("begins_")


def gap_sessions(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], gap: int) -> DataFrame:
    """Runs of rows less than ``gap`` microseconds apart."""
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(*order))
    return islands(rows, keys, order, F.col(at) - before < gap, "session")


def blocks(rows: DataFrame, order: Sequence[Column | str], size: int, within: Sequence[str] = ()) -> DataFrame:
    """Adds ordinal (from 0), block (ordinal div size) and block_id.

    Without ``within`` the order is global. It is then found from ranges: rows are dealt by ranges of the order, numbered inside, and
    shifted by the sizes of the ranges before, so no task holds all rows.
    """
    if within:
        ordinal = F.row_number().over(W.partitionBy(*within).orderBy(*order)) - 1
        numbered = rows.withColumn("ordinal", ordinal.cast("long"))
    else:
        numbered = global_ordinal(rows, order, "ordinal")
    block = F.floor(F.col("ordinal") / size)
    return numbered.withColumn("block", block).withColumn("block_id", F.format_string("block-%04d", block))


def global_ordinal(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Each row's place (from 0) in a global order, by sorted ranges and the counts of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits are the range's number, the lower ones the row's place in it
    marked = ranged.withColumn("mark_", F.monotonically_increasing_id())
    part, place = F.shiftright("mark_", 33), F.col("mark_").bitwiseAND(F.lit((1 << 33) - 1))
    # ranges are drawn from a sample: the rows are kept, so that both uses below see the same ones
    marked = cut(marked.withColumn("part_", part).withColumn("place_", place).drop("mark_"))
    sizes = marked.groupBy("part_").agg(F.count("*").alias("rows_"))  # one row for each range
    before = F.coalesce(F.sum("rows_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part_", before.alias("before_"))
    return marked.join(F.broadcast(starts), "part_").withColumn(name, F.col("place_") + F.col("before_")).drop("part_", "place_", "before_")


def ordinal_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Each row's place (from 0) among its key's rows; a null key is one key. A hot key is dealt over ranges like any other rows.

    Where there are few keys, counted first, their first places are broadcast, so that the rows are not shuffled once more by a key that may hold many of them.
    """
    placed = global_ordinal(rows, [*keys, *order], name)
    first = cut(placed.groupBy(*[F.col(k).alias(f"{k}_of") for k in keys]).agg(F.min(name).alias("first_")))
    if first.limit(_FEW_KEYS + 1).count() <= _FEW_KEYS:
        first = F.broadcast(first)
    on = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return placed.join(first, on).withColumn(name, F.col(name) - F.col("first_")).drop("first_", *[f"{k}_of" for k in keys])


def passed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a key in one task and in order, for a mapInArrow that carries something from row to row.

    They are dealt by a hash of the keys. A repartition by the keys themselves is left out by Spark where joins below deal by them
    already, and as mapInArrow asks for no dealing, what they read may be coalesced or broadcast at run time, each part of a union by itself, which parts a key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over the rows of the key that come before, by ranges, so that no task holds a hot key.

    Rows are dealt by ranges of key and order and summed inside; the sums of a key's ranges before, one row for each key and range, are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys, *order).withColumn("part_", F.spark_partition_id())
    ranged = cut(ranged.withColumns({f"{k}_own": v for k, v in sums.items()}))  # ranges are drawn from a sample: all uses see the same ones
    inside = W.partitionBy("part_", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumns({k: F.coalesce(F.sum(f"{k}_own").over(inside), F.lit(0)) for k in sums})
    totals = ranged.groupBy("part_", *keys).agg(*[F.coalesce(F.sum(f"{k}_own"), F.lit(0)).alias(f"{k}_own") for k in sums])
    earlier = W.partitionBy(*keys).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select(F.col("part_").alias("part_of"), *[F.col(k).alias(f"{k}_of") for k in keys], *[F.coalesce(F.sum(f"{k}_own").over(earlier), F.lit(0)).alias(f"{k}_shift") for k in sums])
    on = [F.col("part_") == F.col("part_of"), *[F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]]
    out = placed.join(shift, on)
    return out.withColumns({k: F.col(k) + F.col(f"{k}_shift") for k in sums}).select(*rows.columns, *sums)


def viewport_novelty(rows: DataFrame, keys: Sequence[str], order: Sequence[str], content: str, resets: Column | None = None) -> DataFrame:
    """Adds emitted: the lines of each viewport that the row before of its key did not show.

    The row before counts whole, whatever it emitted. A row where ``resets`` holds shows nothing and clears what was seen.
    """
    # the row before is met by its place, not in a window, so that a key's texts spread over tasks
    placed = ordinal_within(rows, keys, order, "at_")
    shown = F.when(resets, F.lit(None)).otherwise(F.col(content)) if resets is not None else F.col(content)
    prior = placed.select(*[F.col(k).alias(f"{k}_of") for k in keys], (F.col("at_") + 1).alias("after_"), shown.alias("previous_"))
    met = placed.join(prior, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys] + [F.col("at_") == F.col("after_")], "left")
    return met.withColumn("emitted", novel_lines(F.col("previous_"), F.col(content))).select(*rows.columns, "emitted")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("rank_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def suffix_budget(rows: DataFrame, target: Sequence[str], newest_first: Sequence[Column], tokens: str, budget: str | int) -> DataFrame:
    """For rows (target, block, tokens): the longest suffix of whole blocks within the budget, and the first block that misses.

    Adds used (tokens from the newest down to this block) and kept: whole, or partial for the first block beyond the
    budget if any room is left, or null for the older ones. Token counts must not be negative.
    """
    w = W.partitionBy(*target).orderBy(*newest_first).rowsBetween(W.unboundedPreceding, 0)
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    used = F.sum(tokens).over(w)
    out = rows.withColumn("used", used).withColumn("limit_", limit)
    room = F.col("limit_") - (F.col("used") - F.col(tokens))
    kept = F.when(F.col("used") <= F.col("limit_"), "whole").when(room > 0, "partial")
    return out.withColumn("kept", kept).withColumn("kept_tokens", F.when(F.col("kept") == "whole", F.col(tokens)).when(F.col("kept") == "partial", room).otherwise(0)).drop("limit_")


def suffix_edges(rows: DataFrame, key: str, order: str, tokens: str, budgets: Sequence[int]) -> DataFrame:
    """For each row and budget what suffix_budget keeps of the key's rows before it: n_whole, n_partial, n_tokens, and n_cut of these of the partial one.

    No row is paired with its history: with the tokens before each row summed, the oldest row that is kept whole is the first one whose
    sum is at most the budget less. A key's order must be distinct, token counts neither null nor negative.
    """
    own = W.partitionBy(key).orderBy(order)
    out = rows.withColumn("before_", F.coalesce(F.sum(tokens).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")).withColumn("rank_", F.row_number().over(own))
    for b in budgets:
        # ranks and sums grow together, so the frame's first row has the least of both
        near = W.partitionBy(key).orderBy("before_").rangeBetween(-b, W.currentRow)
        out = out.withColumn(f"edge_{b}_", F.min(F.struct("rank_", "before_")).over(near))
    edges = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"edge_{b}_").alias("edge")) for b in budgets])
    out = out.select(*rows.columns, "before_", "rank_", F.explode(edges).alias("e"))
    held = F.col("before_") - F.col("e.edge.before_")
    partial = (F.col("e.edge.rank_") > 1) & (held < F.col("e.budget"))
    return out.select(*rows.columns, F.col("e.budget").alias("budget"), (F.col("rank_") - F.col("e.edge.rank_")).cast("long").alias("n_whole"), partial.cast("long").alias("n_partial"), F.when(partial, F.col("e.budget").cast("long")).otherwise(held).alias("n_tokens"), F.when(partial, F.col("e.budget") - held).otherwise(0).cast("long").alias("n_cut"))


def token_spans(rows: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str) -> DataFrame:
    """Adds span_start and span_end: where each row's tokens lie when rows follow each other."""
    total = F.sum(tokens).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("span_end", total).withColumn("span_start", F.col("span_end") - F.col(tokens))
