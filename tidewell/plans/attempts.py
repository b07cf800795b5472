"""Queries of write attempts as whole records, with cursors, checkpoints, clipboards and chains, made of turns and events; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import chains, compile, conditioning, grounding, proposals, reduce
from tidewell.plans.catalog import HOUR, STREAM, query, stream, table
from tidewell.plans.records import ROWS, _journal, _stamp


def _seen(value: Column, i: str, at: Column, location: Column | None = None, length: Column | None = None, probed: Column | None = None) -> Column:
    """An observation of a field; location and length of its selection in UTF-16, and the field's own strings around it."""
    none = F.lit(None).cast("int")
    probe = F.struct(F.lit("e").alias("errors_"), F.array().cast("array<string>").alias("errors"))
    parts = [F.lit(i).alias("observationID"), at.alias("observedAt"), value.alias("value"), (none if location is None else location).alias("selectedRangeLocation"), (none if length is None else length).alias("selectedRangeLength")]
    return F.struct(*parts, *([F.when(probed, probe).alias("axRangeCursorProbe")] if probed is not None else []))


#: Each turn's text with three characters after its middle written once more, and where the two begin to differ.
DOUBLED = """(SELECT *, q AS initial_,
  (SELECT coalesce(max(i), 0) FROM range(1, length(was) + 1) r(i) WHERE left(was, i) = left(now, i)) AS lead, (SELECT coalesce(max(i), 0) FROM range(1, length(was) + 1) r(i) WHERE left(was, i) = left(one, i)) AS lead_one
  FROM (SELECT *, left(was, q) || piece || substr(was, q + 1) AS now, left(was, q) || left(piece, 1) || substr(was, q + 1) AS one
  FROM (SELECT conv_id, turn, text AS was, length(text) // 2 AS p, substr(text, length(text) // 2 + 1, 3) AS piece, length(text) // 2 + length(substr(text, length(text) // 2 + 1, 3)) AS q FROM conversations)))"""


@query(f"""
WITH d AS (SELECT *, regexp_matches(substr(was, least(lead, q) + 1, greatest(lead, q) - least(lead, q)) || substr(now, least(lead, q) + 1, greatest(lead, q) - least(lead, q)), '[\\n\\r' || chr(8203) || ']') AS crossed FROM {DOUBLED}),
e AS (SELECT *, CASE WHEN was IS NULL THEN 'before_missing' WHEN piece = '' THEN 'empty_or_unreproduced_edit' END AS reason, turn % 4 IN (0, 2) AND q <> lead AND NOT crossed AS moved FROM d),
o AS (SELECT *, CASE WHEN turn % 4 = 3 THEN p WHEN moved THEN q ELSE lead END AS tm, CASE WHEN turn % 4 = 3 THEN p ELSE q END AS initial, CASE WHEN turn % 4 = 2 THEN lead_one ELSE lead END AS earliest FROM e)
SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN tm END AS edit_offset, CASE WHEN reason IS NULL THEN CASE WHEN turn % 4 = 3 THEN '{grounding.REPLACEMENT}' WHEN moved THEN '{grounding.EQUIVALENT}' ELSE '{grounding.CANONICAL}' END END AS alignment,
  CASE WHEN reason IS NULL THEN sha256(CASE WHEN turn % 4 = 3 THEN piece || piece WHEN moved THEN piece ELSE substr(now, lead + 1, length(piece)) END) END AS content_sha256,
  CASE WHEN reason IS NULL THEN CASE WHEN initial <> earliest THEN '{conditioning.DIFFERS}' WHEN tm <> initial THEN '{conditioning.MOVED}' ELSE '{conditioning.ALIGNED}' END END AS fidelity,
  CASE WHEN reason IS NULL AND turn % 4 <> 3 AND length(regexp_replace(CASE WHEN moved THEN piece ELSE substr(now, lead + 1, length(piece)) END, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) < 2 OR reason IS NULL AND turn % 4 = 3 AND length(regexp_replace(piece || piece, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')) < 2 THEN 'below_minimum_length'
    WHEN reason IS NULL AND turn % 4 = 1 THEN 'missing_semantic_cursor_context' END AS exclusion FROM o
""")
def grounded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an edit stands that could stand at several places: by the caret and what was seen in between, by the selection that it replaced, or by the smallest difference.

    Each turn is a field in which the three characters after its middle are written once more: at once, without proof, in two steps, or over
    a selection of them. Beside it the cursor's fidelity, and what keeps the write from being a target.
    """
    rows = table(spark, sf_dir, "conversations").withColumn("p", F.floor(F.length("text") / 2).cast("int"))
    rows = rows.withColumn("piece", F.substring("text", F.col("p") + 1, F.lit(3))).withColumn("q", F.col("p") + F.length("piece"))
    head, tail = F.substring("text", F.lit(1), F.col("q")), F.substring("text", F.col("q") + 1, F.length("text"))
    now, one = F.concat(head, "piece", tail), F.concat(head, F.substring("piece", 1, 1), tail)
    units = lambda c: text.utf16_length(c).cast("int")
    kind, at = F.col("turn") % 4, lambda s: _stamp(F.col("turn") * 10 + s)
    selected = kind == 3
    location = F.when(selected, units(F.substring("text", F.lit(1), F.col("p")))).otherwise(units(head))
    point = lambda v, t, i: F.struct(F.lit(t).cast("bigint").alias("eventTimestampNanoseconds"), _seen(v, i, at(t)).alias("observation"))
    points = F.when(kind == 2, F.array(point(one, 1, "m1"), point(now, 2, "m2"))).otherwise(F.array(point(now, 1, "m1")))
    cursor = F.struct(F.when(kind == 1, "numbers").otherwise(grounding.RANGE_SOURCE).alias("source"), F.lit("complete").alias("captureStatus"), F.lit("l").alias("leftContext"), F.lit("").alias("selectedText"), F.when(kind != 1, "r").alias("rightContext"))
    state = F.struct(F.lit(2).alias("schemaVersion"), cursor.alias("cursorContext"))
    journal = _journal(
        rows, "active_tap_write_attempt", F.col("conv_id"), F.col("turn"), recordID=F.concat_ws("-", "conv_id", "turn"), beganAt=at(0), terminalDecisionAt=at(8), inputHints=F.array(F.lit("typed")), boundaryReason=F.lit("write_delay_elapsed"), mutationCheckpoints=points, conditioningState=state,
        before=_seen(F.col("text"), "b", at(0), location, F.when(selected, units(F.col("piece"))).otherwise(0), kind != 1), after=_seen(now, "a", at(5)),
    )
    w = reduce.write_candidates(journal).withColumn("kind", F.lit("write"))
    good = F.col("reason").isNull()
    excluded = F.when(good, compile.target_exclusion(w, 2))
    return w.select(F.col("session_id").cast("long").alias("conv_id"), F.col("line").alias("turn"), "reason", F.when(good, F.col("offset")).alias("edit_offset"), F.when(good, F.col("alignment")).alias("alignment"), F.when(good, F.sha2("content", 256)).alias("content_sha256"), F.when(good, F.col("fidelity.status")).alias("fidelity"), excluded.alias("exclusion"))


@query(f"""
WITH d AS (SELECT conv_id, turn, turn % 6 AS k, coalesce(text, '') AS was, chr(10214) || coalesce(before, '') || chr(10215) AS clip FROM {ROWS} WHERE nth > 1)
SELECT conv_id, turn, sha256(CASE WHEN k = 3 THEN 'x' || clip || 'then' ELSE clip END) AS content_sha256,
  CASE k WHEN 1 THEN 'clipboard_changed_after_conditioning' WHEN 4 THEN 'paste_checkpoint_missing' WHEN 5 THEN 'post_paste_edit_may_modify_payload' END AS authorship,
  CASE k WHEN 0 THEN 'grounded_clipboard_transition' WHEN 2 THEN 'grounded_delayed_paste_observation' WHEN 3 THEN 'grounded_paste_ax_epoch_transition' ELSE 'complete_before_selected_observation_minimal_diff' END AS evidence,
  CASE k WHEN 0 THEN 'paste' WHEN 2 THEN 'paste' WHEN 3 THEN 'authored_text,paste,authored_text' ELSE 'unresolved_paste_transition' END AS segments FROM d
""")
def paste_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of a write was pasted: the turn before is the clipboard, pasted into the middle of a field with the turn's text.

    By turn the paste is seen at once, with another clipboard, late, across a field that starts anew, without a checkpoint, or with a deletion after it.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).withColumn("nth", F.row_number().over(w)).where("nth > 1")
    rows = rows.withColumn("was", F.coalesce("text", F.lit(""))).withColumn("clip", F.concat(F.lit("⟦"), F.coalesce("before", F.lit("")), F.lit("⟧"))).withColumn("k", F.col("turn") % 6)
    half, at = F.floor(F.length("was") / 2).cast("int"), lambda s: _stamp(F.col("turn") * 10 + s)
    k, full = F.col("k"), F.concat(F.substring("was", F.lit(1), half), "clip", F.substring("was", half + 1, F.length("was")))
    anew, time = k == 3, F.lit(1).cast("bigint")
    paste = F.struct(
        F.lit("c").alias("checkpointID"), time.alias("eventTimestampNanoseconds"), F.lit("s").alias("clipboardSnapshotID"), F.when(k == 1, 8).otherwise(7).alias("clipboardChangeCount"), F.col("clip").alias("clipboardText"),
        _seen(F.when(anew, F.concat("was", F.lit("x"))).otherwise(F.col("was")), "pre", at(1)).alias("prePasteObservation"), _seen(F.when(anew, "").when(k.isin(2, 5), F.col("was")).otherwise(full), "post", at(2)).alias("observation"),
    )
    later = F.struct(F.lit(2).cast("bigint").alias("eventTimestampNanoseconds"), _seen(full, "m", at(3)).alias("observation"))
    deleted = F.struct(F.lit("delete").alias("hint"), F.lit(True).alias("mutationCapable"), F.lit(3).cast("bigint").alias("eventTimestampNanoseconds"))
    state = F.struct(F.lit(3).alias("schemaVersion"), F.struct(F.lit("s").alias("snapshotID"), F.lit(7).alias("changeCount")).alias("clipboard"))
    journal = _journal(
        rows, "active_tap_write_attempt", F.col("conv_id"), F.col("turn"), recordID=F.concat_ws("-", "conv_id", "turn"), beganAt=at(0), terminalDecisionAt=at(8), inputHints=F.array(F.lit("paste"), F.lit("typed")), boundaryReason=F.lit("write_delay_elapsed"), conditioningState=state,
        before=_seen(F.col("was"), "b", at(0)), after=_seen(F.when(anew, "then").otherwise(full), "a", at(5)), pasteCheckpoints=F.when(k != 4, F.array(paste)), mutationCheckpoints=F.when(k == 2, F.array(later)), inputEvents=F.when(k == 5, F.array(deleted)),
    )
    w = reduce.write_candidates(journal).where("reason is null")
    return w.select(F.col("session_id").cast("long").alias("conv_id"), F.col("line").alias("turn"), F.sha2("content", 256).alias("content_sha256"), "authorship", "evidence", F.array_join(F.transform("segments", lambda s: s["type"]), ",").alias("segments"))


@query(f"""
WITH a AS (SELECT user_id, event_id, t // 43200 AS tm, 1 + event_id % 3 AS n, event_type IN ('view', 'click', 'error') AND event_id % 17 <> 3 AS fit, event_id % 11 // 10 AS pid, CASE WHEN event_type = 'click' THEN event_id % 5 ELSE 0 END AS long FROM {STREAM}),
w AS (SELECT *, array_agg({{'id': event_id, 'tm': tm, 'n': n, 'fit': fit, 'pid': pid}}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prior FROM a),
m AS (SELECT *, unnest(range(1, len(prior) + 1)) AS m FROM w WHERE long > 0 AND len(prior) > 0),
s AS (SELECT *, prior[len(prior) - m + 1:] AS own FROM m)
SELECT user_id, event_id, array_to_string(list_transform(own, lambda x: x.id), ',') AS before_ids FROM s
WHERE list_sum(list_transform(own, lambda x: x.n)) = long AND len(list_filter(own, lambda x: x.fit AND x.pid = s.pid AND s.tm - x.tm BETWEEN 0 AND 1000000)) = m
""")
def fast_start_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that begin with what the attempts just before them typed. A user's events are attempts, twelve hours of theirs a second; a click's field holds up to four characters before."""
    rows = stream(spark, sf_dir).withColumn("at", F.expr("t div 43200"))
    long = F.when(F.col("event_type") == "click", F.col("event_id") % 5).otherwise(0).cast("int")
    was, stamp = F.repeat(F.lit("x"), long), F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fit = F.col("event_type").isin("view", "click", "error") & (F.col("event_id") % 17 != 3)
    point = F.struct(_seen(F.concat(was, F.lit("y")), "m", stamp).alias("observation"))
    journal = _journal(
        rows, "active_tap_write_attempt", F.col("user_id"), F.col("event_id"), recordID=F.col("event_id").cast("string"), beganAt=stamp, inputHints=F.array(F.lit("typed")), inputEventCount=1 + F.col("event_id") % 3, boundaryReason=F.when(fit, "target_changed").otherwise("write_delay_elapsed"),
        processIdentifier=F.floor(F.col("event_id") % 11 / 10).cast("int"), before=_seen(was, "b", stamp, long, F.lit(0)), mutationCheckpoints=F.array(point),
    )
    found = chains.fast_starts(chains.attempts(journal))
    return found.select(F.col("session_id").cast("long").alias("user_id"), F.col("line").alias("event_id"), F.array_join("before_ids", ",").alias("before_ids"))


@query(f"""
WITH a AS (SELECT user_id, event_id, t // 43200 AS tm, event_type <> 'purchase' AS nav, event_id % 7 AS field, CASE WHEN event_id % 5 = 4 THEN 'z' ELSE 'v' END AS value, 1 + event_id % 3 AS n FROM {STREAM}),
l AS (SELECT *, coalesce(lag(nav) OVER w AND tm - lag(tm) OVER w - 200000 BETWEEN 0 AND 3000000 AND field // 5 = lag(field // 5) OVER w AND value = lag('v') OVER w, false) AS goes_on FROM a WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)),
i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS island FROM l)
SELECT user_id, arg_min(event_id, (tm, event_id)) AS event_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY tm, event_id) AS lineage, CAST(sum(n) AS BIGINT) AS input_events FROM i GROUP BY user_id, island
""")
def navigation_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that a navigation key cut apart as one: the next one begins within three seconds in the same field with the same text and caret. A user's events are attempts, twelve hours a second."""
    rows = stream(spark, sf_dir).withColumn("at", F.expr("t div 43200"))
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    value, field = F.when(F.col("event_id") % 5 == 4, "z").otherwise("v"), F.floor(F.col("event_id") % 7 / 5).cast("int")
    journal = _journal(
        rows, "active_tap_write_attempt", F.col("user_id"), F.col("event_id"), recordID=F.col("event_id").cast("string"), beganAt=stamp(F.col("at")), lastInputAt=stamp(F.col("at") + 200_000), inputHints=F.array(F.lit("typed")), inputEventCount=1 + F.col("event_id") % 3,
        boundaryReason=F.when(F.col("event_type") != "purchase", "selection_navigation").otherwise("write_delay_elapsed"), targetIdentity=F.struct(field.alias("elementHash")), before=_seen(value, "b", stamp(F.col("at")), F.lit(1), F.lit(0)), after=_seen(F.lit("v"), "a", stamp(F.col("at")), F.lit(1), F.lit(0)),
    )
    merged = chains.merge_navigation(chains.attempts(journal))
    return merged.select(F.col("session_id").cast("long").alias("user_id"), F.col("recordID").cast("long").alias("event_id"), F.array_join("lineage", ",").alias("lineage"), F.col("inputEventCount").cast("long").alias("input_events"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in runs no more than twelve hours apart."""
    near = lambda a, b: b["t"] - a["t"] <= 12 * HOUR
    return proposals.runs(stream(spark, sf_dir).select("user_id", "event_id", "t", "event_type"), ["user_id"], ["t", "event_id"], near, ["t"])


@query(f"""
WITH o AS (SELECT user_id, event_id, t, row_number() OVER w - 1 AS place, CASE WHEN t - lag(t) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS begins FROM {STREAM} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY place) AS run FROM o)
SELECT a.user_id, CAST(a.run AS BIGINT) AS run, a.place AS first, b.place AS last FROM r a JOIN r b ON a.user_id = b.user_id AND a.run = b.run AND a.place < b.place
""")
def run_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of two events or more of each run of neighbours, as intervals of places."""
    return proposals.subruns(_runs(spark, sf_dir), ["user_id"])


@query()
def chosen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the parts of runs that end with another kind of event than they begin with, the longest first, then the earliest, none sharing an event."""
    return proposals.longest_unlike(_runs(spark, sf_dir).where("user_id is not null"), ["user_id"], "event_type")
