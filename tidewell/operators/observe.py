"""Which observation of a field a write attempt is judged by: the terminal one, or a checkpoint where that can't be trusted.

Checkpoints are (checkpointID, eventTimestampNanoseconds, axErrors, observation). One counts if it has no errors and its value is there
and whole; it can be chosen if its value differs from the field before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.functions.columns import Steps, remembered, with_steps
from tidewell.functions.targets import is_coherent, is_terminal_jump
from tidewell.sources.journal import instant

#: checkpoints' sources, the weightiest first, and the columns that hold them.
SOURCES = (("returnCheckpoints", "pre_return_checkpoint", 3), ("pasteCheckpoints", "post_paste_checkpoint", 2), ("mutationCheckpoints", "post_input_checkpoint", 1))
#: Fixed value: hints of a burst that cuts and does no more.
CUTTING = ("cut", "navigation")
CHOSEN = "struct<value:string,source:string,checkpoint_id:string,reason:string,observed_at:string,observation_id:string>"
_POINT = "struct<t:bigint,weight:int,place:int,seen:bigint,source:string,checkpoint_id:string,value:string,observed_at:string,observation_id:string>"


def _no_errors(c: Column) -> Column:
    return F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0


def points(checkpoints: Column, source: str, weight: int) -> Column:
    """The checkpoints that count, with their logical values; place falls along the array, so the first of equals is the greatest."""
    fit = lambda p: _no_errors(p["axErrors"]) & ~F.coalesce(p["observation"]["valueWasTruncated"], F.lit(False)) & p["observation"]["value"].isNotNull()
    listed = F.transform(
        checkpoints,
        lambda p, i: F.when(fit(p), F.struct(
            F.coalesce(p["eventTimestampNanoseconds"], F.lit(0)).cast("bigint").alias("t"), F.lit(weight).alias("weight"), (-i).cast("int").alias("place"), instant(p["observation"]["observedAt"]).alias("seen"),
            F.lit(source).alias("source"), p["checkpointID"].alias("checkpoint_id"), text.logical_value(p["observation"]["value"], p["observation"]["placeholderValue"]).alias("value"),
            p["observation"]["observedAt"].alias("observed_at"), p["observation"]["observationID"].alias("observation_id"),
        )),
    )
    return F.coalesce(listed, F.array().cast(f"array<{_POINT}>"))


def with_observation(writes: DataFrame) -> DataFrame:
    """Adds chosen: (value, source, checkpoint_id, reason, observed_at, observation_id), null if nothing can be trusted; needs before_value beside the record's columns.

    In this order: what was seen before a return that ended the burst; the latest checkpoint where the terminal state is missing; nothing
    where it is cut; what was seen before a last return that the terminal state doesn't hold; a last checkpoint that goes on where
    the terminal state jumps; what a cut left; the latest return or paste where the field looks as before; the latest
    checkpoint where it looks empty; the terminal state.
    """
    return with_steps(writes, _choice()).drop("p1_", "p2_", "p3_", "latest_", "return_", "path_", "end_", "terminal_")


@remembered
def _choice() -> Steps:
    steps: Steps = [{f"p{weight}_": points(F.col(name), source, weight) for name, source, weight in SOURCES}]
    before, last = F.coalesce("before_value", F.lit("")), F.col("lastEventTimestampNanoseconds")
    changed = lambda p: p.isNotNull() & (p["value"] != before)
    in_time = lambda p: last.isNull() | (p["t"] <= last)
    first = {"latest_": F.array_max(F.filter(F.concat("p3_", "p2_", "p1_"), lambda p: changed(p) & in_time(p)))}
    final_return = F.try_element_at("p3_", F.lit(-1))
    first["return_"] = F.when(changed(final_return), final_return)
    # mutation checkpoints in order of time, for the trajectory
    timed = F.array_sort(F.transform(F.filter("p1_", lambda p: p.isNotNull() & p["seen"].isNotNull()), lambda p: F.struct(p["t"].alias("t"), p["seen"].alias("seen"), p.alias("p"))))
    first["path_"] = F.transform(timed, lambda x: x["p"])
    first["terminal_"] = text.logical_value(F.col("after.value"), F.col("after.placeholderValue"))
    steps += [first, {"end_": F.try_element_at("path_", F.lit(-1))}]
    point = lambda p, reason: F.struct(p["value"].alias("value"), p["source"].alias("source"), p["checkpoint_id"].alias("checkpoint_id"), F.lit(reason).alias("reason"), p["observed_at"].alias("observed_at"), p["observation_id"].alias("observation_id")).cast(CHOSEN)
    seen, end, latest, ret = F.col("terminal_"), F.col("end_"), F.col("latest_"), F.col("return_")
    none = F.lit(None).cast(CHOSEN)
    missing = F.col("after").isNull() | ~_no_errors(F.col("afterAXErrors"))
    lost = F.coalesce(F.col("after.valueWasTruncated"), F.lit(False)) | seen.isNull()
    last_return_at = F.try_element_at("returnCheckpoints", F.lit(-1))["eventTimestampNanoseconds"]
    not_kept = ret.isNotNull() & last_return_at.eqNullSafe(last) & (seen != ret["value"]) & ~F.contains(seen, ret["value"])
    goes_on = (
        (F.size(F.coalesce("pasteCheckpoints", F.array())) == 0) & (F.size("path_") >= 2) & (end["t"] == last) & (end["seen"] >= instant(F.col("lastInputAt")))
        & (end["value"] != before) & is_terminal_jump(before, seen) & is_terminal_jump(end["value"], seen) & is_coherent(F.transform("path_", lambda p: p["value"]))
    )
    hints = F.coalesce("inputHints", F.array().cast("array<string>"))
    only_cut = F.array_contains(hints, "cut") & (F.size(F.array_except(hints, F.array(*map(F.lit, CUTTING)))) == 0)
    left = F.try_element_at(F.filter("p1_", lambda p: changed(p) & (p["t"] == last) & (F.length(p["value"]) < F.length(before))), F.lit(-1))
    true = lambda c: F.coalesce(c, F.lit(False))
    as_before = true(seen == before) & latest.isNotNull()
    chosen = (
        F.when(true(F.col("boundaryReason") == "return_pressed"), F.when(ret.isNotNull(), point(ret, "immediate_terminal_return")))
        .when(missing, F.when(latest.isNotNull(), point(latest, "terminal_invalid")))
        .when(lost, none)
        .when(true(not_kept), point(ret, "terminal_does_not_preserve_pre_return"))
        .when(true(goes_on), point(end, "terminal_ax_epoch_discontinuity"))
        .when(only_cut & true(left.isNotNull()), point(left, "cut_post_input_checkpoint"))
        .when(as_before, F.when(latest["source"] != "post_input_checkpoint", point(latest, "terminal_matches_before")))
        .when((text.trimmed(seen) == "") & latest.isNotNull(), point(latest, "terminal_unpopulated"))
        .otherwise(F.struct(seen.alias("value"), F.lit("terminal_after").alias("source"), F.lit(None).cast("string").alias("checkpoint_id"), F.lit("terminal_observation").alias("reason"), F.col("after.observedAt").alias("observed_at"), F.col("after.observationID").alias("observation_id")).cast(CHOSEN))
    )
    return [*steps, {"chosen": chosen}]
