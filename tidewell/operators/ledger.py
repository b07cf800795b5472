"""The recovery ledger of runs that were interrupted: one bounded recovery for each operation, decided from the journal of events alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import first_reason
from tidewell.operators.sequence import ordinal_within, running
from tidewell.sources.shared import cut

#: What a journal says. An operation begins, its result is committed, its marker is cleared; a run that stopped is resumed.
BEGIN, COMMIT, CLEAR, RESUME = "begin", "commit", "clear", "resume"
#: Outcomes that let a run go on, and how a refused one is named.
STALE, ABANDONED = "stale_marker_after_committed_operation", "abandoned_attempt"
UNSUPPORTED, EXHAUSTED, REPEATED, CEILING, UNREACHED = "unsupported_operation", "allowance_exhausted", "already_retried", "cost_ceiling", "not_reached"
_COST = "decimal(38,6)"
#: Fixed: 4,096 numbers of a sequence are one cell, so that a window holds a cell's rows in its plain buffer.
_CELL_BITS = 12


def _stopped(events: DataFrame) -> DataFrame:
    """(run, seq, kind, identity, cost): the resumptions whose event just before in the run is a begin or a commit, with what that one says.

    Events are dealt by run and cell of the sequence, so in one shuffle and without places for all of them: as numbers are distinct in a run, a cell holds at
    most 4,096 events. What is left of a cell is its resumptions and its last event; a resumption that begins its cell meets the last event
    of the cell before by that cell's place among the run's. Where numbers lie far apart cells hold few events each.
    """
    if not isinstance(events.schema["seq"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):  # another type is numbered first
        numbered = ordinal_within(events, ["run"], ["seq"], "at_")
        named = numbered.select("run", F.col("at_").alias("seq"), F.col("seq").alias("named_"))
        return _stopped(numbered.drop("seq").withColumnRenamed("at_", "seq")).join(named, ["run", "seq"]).select("run", F.col("named_").alias("seq"), "kind", "identity", "cost")
    sets, resumes = F.col("event").isin(BEGIN, COMMIT), F.col("event") == RESUME
    said = ("kind", "identity", "cost")  # read of begins and commits alone
    slim = events.select("run", "seq", F.shiftright(F.col("seq").cast("long"), _CELL_BITS).alias("cell_"), F.when(sets, 1).when(resumes, 2).otherwise(0).cast("byte").alias("is_"), *[F.when(sets, F.col(c)).alias(c) for c in said])
    inside = W.partitionBy("cell_", "run").orderBy("seq")  # the cell first, as it parts rows more finely
    before = {"before_": F.lag("is_").over(inside), **{f"{c}_before": F.lag(c).over(inside) for c in said}}  # column by column: a struct would be sorted beside its columns
    met = slim.withColumns({**before, "last_": F.lead("seq").over(inside).isNull()})
    kept = cut(met.where("is_ = 2 or last_"))
    ends = ordinal_within(kept.where("last_").select("run", "cell_", "is_", *said), ["run"], ["cell_"], "nth_")
    after = ends.select("run", (F.col("nth_") + 1).alias("nth_"), F.col("is_").alias("before_"), *said)
    begins = kept.where("is_ = 2 and before_ is null").select("run", "seq", "cell_").join(ends.select("run", "cell_", "nth_"), ["run", "cell_"]).join(after, ["run", "nth_"])
    found = kept.where("is_ = 2").select("run", "seq", "before_", *[F.col(f"{c}_before").alias(c) for c in said]).unionByName(begins.select("run", "seq", "before_", *said))
    return found.where("before_ = 1").select("run", "seq", *said)


def recoveries(runs: DataFrame, events: DataFrame, allowances: dict[str, int]) -> DataFrame:
    """(run, seq, kind, identity, outcome, projected) of each resumption that finds an operation's marker still set.

    runs: (run, planned, ceiling) costs; events: (run, seq, event, kind, identity, cost), seq distinct in a run, kinds with the number of
    attempts of them that a run may abandon in ``allowances``. An operation whose result was committed before left a stale marker and costs nothing. Else its
    attempt is abandoned, if its kind has an allowance left, it was not abandoned before, and the planned cost with its own greatest
    cost and those of the attempts abandoned before (``projected``) is at most the ceiling. A refusal ends the run: what follows is
    not_reached. A null cost is 0; a run without costs has no ceiling. Rows without run or seq are no events.

    The ledger is a function of the journal: reading it again, or after a crash between any two events, gives the same rows. A marker is set if the event just before
    is a begin or a commit (``_stopped``); what was abandoned before is counted by running sums over ranges, so a run may hold any share of the rows.
    """
    events = events.where("run is not null and seq is not null").select("run", "seq", "event", "kind", "identity", "cost")
    stopped = _stopped(events).withColumn("cost", F.coalesce(F.col("cost").cast(_COST), F.lit(0).cast(_COST)))
    done = events.where(F.col("event") == COMMIT).groupBy(F.col("run").alias("run_of"), F.col("kind").alias("kind_of"), F.col("identity").alias("identity_of")).agg(F.min("seq").alias("done_"))
    same = (F.col("run") == F.col("run_of")) & F.col("kind").eqNullSafe(F.col("kind_of")) & F.col("identity").eqNullSafe(F.col("identity_of"))
    judged = stopped.join(done, same, "left").drop("run_of", "kind_of", "identity_of").withColumn("stale_", F.coalesce(F.col("done_") < F.col("seq"), F.lit(False)))
    # what was abandoned before, as if nothing had been refused; a run's first refusal is right then, and nothing counts after it
    lost = F.when(F.col("stale_"), 0).otherwise(1)
    judged = running(judged, ["run"], ["seq"], {"spent_": F.when(F.col("stale_"), F.lit(0).cast(_COST)).otherwise(F.col("cost"))})
    judged = running(judged, ["run", "kind"], ["seq"], {"of_kind_": lost})
    judged = running(judged, ["run", "kind", "identity"], ["seq"], {"of_same_": lost})
    met = judged.join(runs.select("run", F.col("planned").cast(_COST).alias("planned"), F.col("ceiling").cast(_COST).alias("ceiling")), "run", "left")
    met = met.withColumn("projected", (F.coalesce("planned", F.lit(0).cast(_COST)) + F.col("cost") + F.col("spent_")).cast(_COST))
    allowed = F.create_map(*[x for k, n in allowances.items() for x in (F.lit(k), F.lit(n))])
    known = F.coalesce(F.col("kind").isin(*allowances), F.lit(False))
    outcome = first_reason(
        (~known, UNSUPPORTED),
        (F.col("stale_"), STALE),
        (F.col("of_kind_") >= F.try_element_at(allowed, F.col("kind")), EXHAUSTED),
        (F.col("of_same_") > 0, REPEATED),
        (F.col("projected") > F.col("ceiling"), CEILING),
        (F.lit(True), ABANDONED),
    )
    met = met.withColumn("outcome", outcome)
    ends = met.where(~F.col("outcome").isin(STALE, ABANDONED)).groupBy("run").agg(F.min("seq").alias("ends_"))
    met = met.join(ends, "run", "left").withColumn("outcome", F.when(F.col("seq") > F.col("ends_"), UNREACHED).otherwise(F.col("outcome")))
    return met.select("run", "seq", "kind", "identity", "outcome", F.when(F.col("outcome") == ABANDONED, F.col("projected")).alias("projected"))


def states(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run, status, n_abandoned, n_stale, worst_cost) of each run: whether it goes on, and what it may cost with what was abandoned."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    refused = F.max(F.when(~F.col("outcome").isin(STALE, ABANDONED, UNREACHED), F.col("outcome")))
    counted = ledger.groupBy("run").agg(of(ABANDONED).alias("n_abandoned"), of(STALE).alias("n_stale"), refused.alias("refused_"), F.max("projected").alias("worst_"))
    out = runs.select("run", F.col("planned").cast(_COST).alias("planned")).join(counted, "run", "left")
    status = F.when(F.col("refused_").isNotNull(), F.col("refused_")).when(F.coalesce(F.col("n_abandoned") + F.col("n_stale"), F.lit(0)) > 0, "recovering").otherwise("clean")
    return out.select("run", status.alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_abandoned", "n_stale")], F.coalesce("worst_", "planned").alias("worst_cost"))
