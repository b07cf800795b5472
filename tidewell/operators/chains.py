"""Write attempts that belong together: those a navigation key cut apart, and those whose field was replaced while its first keys came.

Attempts meet their neighbours by place, not in a window over a session, so a session with very many of them spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.functions.columns import remembered
from tidewell.operators.conditioning import CONDITIONING
from tidewell.operators.sequence import ordinal_within, running
from tidewell.sources.journal import instant, records
from tidewell.sources.shared import cut, written

#: Fields of a chain that its last attempt decides, and those whose lists follow each other.
FROM_LAST = ("after", "afterAXErrors", "boundaryReason", "lastEventTimestampNanoseconds", "lastInputAt", "observedAt", "terminalDecisionAt", "terminalSnapshotAt")
JOINED = ("inputEvents", "mutationCheckpoints", "pasteCheckpoints", "returnCheckpoints")
#: What is read of the first and of the second of two neighbours, beside their clipboards.
OF_FIRST = ("boundaryReason", "inputHints", "after", "afterAXErrors", "lastInputAt", "configuredWriteDelaySeconds", "targetIdentity")
OF_SECOND = ("inputHints", "before", "beforeAXErrors", "beganAt", "targetIdentity")
#: Hints that no completed text may have, seconds between attempts where none are configured, and those that a fast start takes.
NOT_COMPLETING, DELAY, FAST = ("cut", "delete", "paste", "undo_redo"), 3.0, 1_000_000
#: What makes an editable field the same.
EDITABLE = ("elementHash", "processIdentifier", "bundleIdentifier", "windowTitle", "role", "fieldDescription", "fieldLabel")


def _hints(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _no_errors(c: Column) -> Column:
    return F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0


def _within(hints: Column, *known: str) -> Column:
    return F.size(F.array_except(hints, F.array(*map(F.lit, known)))) == 0


def _whole(o: Column) -> Column:
    return o["value"].isNotNull() & ~F.coalesce(o["valueWasTruncated"], F.lit(False))


def _value(o: Column) -> Column:
    return text.logical_value(o["value"], o["placeholderValue"])


def same_editable(a: Column, b: Column) -> Column:
    """Whether two target identities name one field."""
    out = a.isNotNull() & b.isNotNull()
    for k in EDITABLE:
        out = out & a[k].eqNullSafe(b[k])
    return out


def same_clipboard(a: Column, b: Column) -> Column:
    """Whether two attempts were conditioned on one clipboard, or both on none."""
    alike = a["changeCount"].eqNullSafe(b["changeCount"]) & a["textSHA256"].eqNullSafe(b["textSHA256"]) & a["textWasTruncated"].eqNullSafe(b["textWasTruncated"])
    return (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & alike)


def goes_on(a: Column, b: Column) -> Column:
    """Whether attempt b only goes on with attempt a after a navigation: nothing changed in between, or the field's end was completed."""
    was, now = _value(a["after"]), _value(b["before"])
    pause = instant(b["beganAt"]) - instant(a["lastInputAt"])
    near = (pause >= 0) & (pause <= F.coalesce(a["configuredWriteDelaySeconds"], F.lit(DELAY)) * 1_000_000)
    first, second = (F.coalesce(x["inputHints"], F.array().cast("array<string>")) for x in (a, b))
    base = (a["boundaryReason"] == "selection_navigation") & (F.size(first) > 0) & (F.size(second) > 0) & near & same_editable(a["targetIdentity"], b["targetIdentity"])
    base = base & same_clipboard(a["state"]["clipboard"], b["state"]["clipboard"]) & _no_errors(a["afterAXErrors"]) & _no_errors(b["beforeAXErrors"]) & _whole(a["after"]) & _whole(b["before"])
    at = lambda o: o["selectedRangeLocation"]
    length = lambda o: o["selectedRangeLength"]
    still = (was == now) & at(a["after"]).eqNullSafe(at(b["before"])) & length(a["after"]).eqNullSafe(length(b["before"]))
    typed = _within(first, "typed") & F.array_contains(second, "typed") & ~F.arrays_overlap(second, F.array(*map(F.lit, NOT_COMPLETING)))
    grown = (was != "") & (F.length(now) > F.length(was)) & F.startswith(now, was)
    ends = (length(a["after"]) == 0) & (length(b["before"]) == 0) & (at(a["after"]) == text.utf16_length(was)) & (at(b["before"]) == text.utf16_length(now))
    return F.coalesce(base & (still | (typed & grown & ends)), F.lit(False))


@remembered
def _linked() -> Column:
    return goes_on(F.col("a"), F.col("b"))


def attempts(journal: DataFrame) -> DataFrame:
    """The journal's write attempts with their conditioning parsed as state, kept: chains read them several times, and parsing them is most of the work."""
    return written(records(journal, "active_tap_write_attempt").withColumn("state", F.from_json("conditioningState", CONDITIONING)))


def merge_navigation(rows: DataFrame) -> DataFrame:
    """The attempts of sessions with chains of navigation as one attempt each; adds lineage, the record IDs that an attempt stands for.

    A chain's attempts follow each other by (beganAt, line), and each goes on with the one before. A chain with a record that has no ID stays apart.
    """
    nav, named = (F.col("boundaryReason") == "selection_navigation").alias("nav_"), F.col("recordID").isNotNull().alias("named_")
    places = ordinal_within(rows.select("session_id", "line", F.coalesce("beganAt", F.lit("")).alias("began_"), nav, named), ["session_id"], ["began_", "line"], "at_")
    places = places.where("session_id is not null and line is not null").select("session_id", "line", "at_", "nav_", "named_")
    # what two neighbours are compared by is met by line where the first one ends with a navigation, so nothing wide is moved for the others
    prior = places.where("nav_").select("session_id", (F.col("at_") + 1).alias("at_"), F.col("line").alias("prior_"))
    pairs = places.select("session_id", "line", "at_").join(prior, ["session_id", "at_"])
    part = lambda names: F.struct(*names, F.struct(F.col("state.clipboard").alias("clipboard")).alias("state"))
    a = rows.select("session_id", F.col("line").alias("prior_"), part(OF_FIRST).alias("a"))
    b = rows.select("session_id", "line", part(OF_SECOND).alias("b"))
    links = pairs.join(a, ["session_id", "prior_"]).join(b, ["session_id", "line"]).where(_linked()).select("session_id", "at_")
    # links of one chain follow each other, so their place less their rank is the same; there are few links
    island = F.col("at_") - F.row_number().over(W.partitionBy("session_id").orderBy("at_"))
    links = links.withColumn("island_", island)
    heads = links.groupBy("session_id", "island_").agg((F.min("at_") - 1).alias("head_"))
    links = links.join(heads, ["session_id", "island_"])
    members = links.select("session_id", "head_", "at_").unionByName(heads.select("session_id", "head_", F.col("head_").alias("at_")))
    members = members.join(places.select("session_id", "at_", "line", "named_"), ["session_id", "at_"])
    unnamed = members.where("not named_").select("session_id", "head_").distinct()
    members = cut(members.join(unnamed, ["session_id", "head_"], "left_anti").select("session_id", "head_", "at_", "line"))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    chain = rows.join(members, ["session_id", "line"]).groupBy("session_id", "head_").agg(F.array_sort(F.collect_list(F.struct("at_", whole.alias("r")))).alias("c_"))
    first, last = F.get("c_", F.lit(0))["r"], F.element_at("c_", -1)["r"]
    listed = lambda c: F.flatten(F.transform("c_", lambda x: F.coalesce(x["r"][c], F.array())))
    total = lambda c, kind: F.aggregate("c_", F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x["r"][c], F.lit(0))).cast(kind)
    made = {c: F.coalesce(last[c], first[c]) for c in FROM_LAST} | {c: listed(c).cast(rows.schema[c].dataType) for c in JOINED}
    made |= {"inputEventCount": total("inputEventCount", "int"), "tapTimeoutCountDuringBurst": total("tapTimeoutCountDuringBurst", "bigint"), "inputHints": F.array_sort(F.array_distinct(F.filter(listed("inputHints"), lambda h: h.isNotNull())))}
    merged = chain.select(*[made.get(c, first[c]).alias(c) for c in rows.columns], F.transform("c_", lambda x: x["r"]["recordID"]).alias("lineage"))
    alone = rows.join(members.select("session_id", "line"), ["session_id", "line"], "left_anti").withColumn("lineage", F.filter(F.array("recordID"), lambda x: x.isNotNull()))
    return alone.unionByName(merged)


def fast_starts(rows: DataFrame) -> DataFrame:
    """(session_id, line, before_ids): attempts that begin with what the attempts just before them typed, and these attempts' record IDs.

    Walking back in the journal's order, attempts whose target changed and that only typed explain a field's first text if their inputs count
    exactly its characters and all of them are of the same process and window and began in the second before. The walk is no loop: inputs
    are summed along a session, so its first attempt is the one whose sum lies the text's length lower.
    """
    bare = F.struct("line")
    slim = rows.select(
        "session_id", "line", "recordID", instant(F.col("beganAt")).alias("began_"), F.col("bundleIdentifier").alias("bundle_"), F.col("processIdentifier").alias("pid_"), F.col("targetIdentity.windowTitle").alias("title_"), F.greatest(F.coalesce("inputEventCount", F.lit(0)), F.lit(0)).cast("long").alias("n_"),
        F.coalesce((F.col("boundaryReason") == "target_changed") & _within(_hints("inputHints"), "typed") & (F.col("inputEventCount") > 0) & instant(F.col("beganAt")).isNotNull() & F.col("recordID").isNotNull(), F.lit(False)).alias("fit_"),
    )
    summed = running(slim, ["session_id"], [bare], {"at_": F.lit(1).cast("long"), "sum_": F.col("n_"), "unfit_": F.when(F.col("fit_"), 0).otherwise(1).cast("long")})
    was, before = _value(F.col("before")), F.col("before")
    first = F.try_element_at("mutationCheckpoints", F.lit(1))
    seen = _value(first["observation"])
    begins = (
        F.col("recordID").isNotNull() & instant(F.col("beganAt")).isNotNull() & _no_errors(F.col("beforeAXErrors")) & _whole(before) & (was != "") & (before["selectedRangeLength"] == 0) & (before["selectedRangeLocation"] == text.utf16_length(was))
        & first.isNotNull() & _no_errors(first["axErrors"]) & _whole(first["observation"]) & F.startswith(seen, was) & (F.length(seen) > F.length(was))
    )
    asked = rows.where(F.coalesce(begins, F.lit(False))).select("session_id", "line", F.length(was).cast("long").alias("long_"))
    late = asked.join(summed, ["session_id", "line"])
    # sums are those of the rows before
    start = summed.where("fit_").select("session_id", (F.col("sum_")).alias("from_sum_"), F.col("at_").alias("from_"), F.col("unfit_").alias("from_unfit_"), F.col("began_").alias("from_began_"))
    met = late.withColumn("from_sum_", F.col("sum_") - F.col("long_")).join(start, ["session_id", "from_sum_"])
    met = met.where((F.col("unfit_") == F.col("from_unfit_")) & (F.col("began_") - F.col("from_began_")).between(0, FAST))
    member = met.select("session_id", "line", "bundle_", "pid_", "title_", "began_", F.explode(F.sequence("from_", F.col("at_") - 1)).alias("member_"))
    other = summed.select(F.col("session_id").alias("s_"), F.col("at_").alias("a_"), F.col("recordID").alias("id_"), F.col("bundle_").alias("b_"), F.col("pid_").alias("p_"), F.col("title_").alias("t_"), F.col("began_").alias("e_"))
    pairs = member.join(other, (F.col("session_id") == F.col("s_")) & (F.col("member_") == F.col("a_")))
    title = F.col("title_").isNull() | F.col("t_").isNull() | (F.col("title_") == F.col("t_"))
    same = F.col("bundle_").eqNullSafe(F.col("b_")) & F.col("pid_").eqNullSafe(F.col("p_")) & title & (F.col("began_") - F.col("e_")).between(0, FAST)
    found = pairs.groupBy("session_id", "line").agg(F.bool_and(same).alias("all_"), F.array_sort(F.collect_list(F.struct("member_", "id_"))).alias("ids_"))
    return found.where("all_").select("session_id", "line", F.transform("ids_", lambda x: x["id_"]).alias("before_ids"))


def write_attempts(journal: DataFrame) -> DataFrame:
    """The journal's write attempts with their conditioning parsed as state, chains of navigation merged, and recovered set where a fast start lost the field before it."""
    rows = attempts(journal)
    starts = fast_starts(rows)
    merged = merge_navigation(rows).join(starts, ["session_id", "line"], "left")
    return merged.withColumn("recovered", F.col("before_ids").isNotNull()).withColumn("lineage", F.when(F.col("recovered"), F.concat("before_ids", F.array("recordID"))).otherwise(F.col("lineage"))).drop("before_ids")
