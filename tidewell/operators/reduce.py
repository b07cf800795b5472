"""From journals to events: READ and WRITE candidates, a reason for every rejected record, stale reads and viewports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import ids, text
from tidewell.functions.columns import remembered
from tidewell.operators.authorship import ZERO_WIDTH, with_authorship
from tidewell.operators.causal import interval_join
from tidewell.operators.chains import write_attempts
from tidewell.operators.conditioning import BROWSERS, canonical, cursor_fidelity
from tidewell.operators.grounding import CANONICAL, EQUIVALENT, with_grounded_edit
from tidewell.operators.observe import CUTTING, with_observation
from tidewell.sources.journal import instant, records
from tidewell.sources.shared import cut

#: The least size of a window that is no auxiliary surface.
LEAST_HEIGHT, LEAST_WIDTH = 300, 100
#: A removed text this long that stands in the inserted one is a reformatting.
FORMATTING = 16
#: Hints that can only remove.
REMOVING = ("delete", "navigation")
#: How a submission may be confirmed, and the words of a control that submits.
CONFIRMED, SUBMITS = ("confirmed_field_cleared", "confirmed_placeholder_restored", "confirmed_field_disappeared"), text.SUBMIT_TERMS
#: Fixed value: why a write whose field was seen too late is no target.
RECOVERED = "pre_first_mutation_conditioning_unavailable"


def same_rect(a: Column, b: Column) -> Column:
    near = [F.abs(a[k] - b[k]) <= 1 for k in ("x", "y", "width", "height")]
    return (a.isNull() & b.isNull()) | F.coalesce(near[0] & near[1] & near[2] & near[3], F.lit(False))


def same_surface(a: Column, b: Column) -> Column:
    """Equal windows, rectangles within one point."""
    out = same_rect(a["windowBounds"], b["windowBounds"])
    for k in ("displayID", "windowID", "windowTitle", "bundleIdentifier", "processIdentifier"):
        out = out & a[k].eqNullSafe(b[k])
    return out


def unobserved_shortcut(events: Column) -> Column:
    """Whether a shortcut stands between two inputs that may change the text, so that what it did is not known."""
    numbered = F.transform(events, lambda e, i: F.struct(i.alias("i"), e["hint"].alias("hint"), F.coalesce(e["mutationCapable"], F.lit(False)).alias("mutates")))
    places = F.transform(F.filter(numbered, lambda e: e["mutates"]), lambda e: e["i"])
    return F.coalesce(F.exists(numbered, lambda e: (e["hint"] == "shortcut") & (e["i"] > F.array_min(places)) & (e["i"] < F.array_max(places))), F.lit(False))


def read_candidates(journal: DataFrame) -> DataFrame:
    """READ candidates with reason: the first case that rejects a record, or null."""
    r = records(journal, "screen_ocr_observation")
    post, box = F.col("postCaptureSurface"), F.col("windowBounds")
    own = F.struct("displayID", "windowID", "windowTitle", "windowBounds", post["bundleIdentifier"].alias("bundleIdentifier"), "processIdentifier")
    small = (F.coalesce(box["height"], F.lit(0.0)) < LEAST_HEIGHT) | (F.coalesce(box["width"], F.lit(0.0)) < LEAST_WIDTH)
    reason = text.first_reason(
        (F.col("recordID").isNull(), "missing_record_id"),
        (post.isNotNull() & ~same_surface(own, post), "surface_changed_during_capture"),
        (F.coalesce("supersedingWriteAttemptID", F.lit("")) != "", "superseded_by_write"),
        (F.coalesce(F.col("bundleIdentifier").isin(*BROWSERS) & box.isNotNull() & small, F.lit(False)), "auxiliary_surface"),
        (F.coalesce("content", F.lit("")) == "", "empty_content"),
        (F.coalesce("contentWasTruncated", F.lit(False)), "truncated_content"),
    )
    return r.select("session_id", "line", F.col("recordID").alias("record_id"), F.col("processIdentifier").alias("pid"), F.col("windowTitle").alias("window_title"), F.col("windowID").alias("window_id"), F.col("displayID").alias("display_id"), F.col("appName").alias("app_name"), "content", instant(F.col("capturedAt")).alias("captured_at"), instant(F.col("lastActivityAt")).alias("last_activity"), reason.alias("reason"))


def write_candidates(journal: DataFrame) -> DataFrame:
    """WRITE candidates: the edit that each attempt made, who wrote what of it, and the first case that rejects it.

    Attempts that a navigation cut apart are one; lineage has their record IDs. The edit is the net one between the field before and the observation
    chosen for it, placed where the checkpoints ground it. content is what was completed, segments tell typed from pasted text.
    """
    w = write_attempts(journal)
    empty = F.array().cast("array<string>")
    w = w.withColumn("hints", F.array_sort(F.array_distinct(F.coalesce("inputHints", empty))))
    w = w.withColumn("before_value", text.logical_value(F.col("before.value"), F.col("before.placeholderValue")))
    w = with_observation(w).withColumn("after_value", F.col("chosen.value"))
    w = w.withColumn("edit", text.minimal_edit(F.coalesce("before_value", F.lit("")), F.coalesce("after_value", F.lit(""))))
    w = with_authorship(with_grounded_edit(w)).withColumn("final_", F.coalesce("authored.edit", "edit"))
    # cut: a filter on the reason would else be pushed down with all that the reason is made of, and be optimized for minutes
    return cut(w.select(*_candidate()))


@remembered
def _candidate() -> list[Column]:
    """The columns of a WRITE candidate, its reason last."""
    empty = F.array().cast("array<string>")
    rebuilt = lambda e: text.apply_edit(F.col("before_value"), e["offset"], e["removed"], e["inserted"]).eqNullSafe(F.col("after_value"))
    seen, edit = F.col("observed_edit"), F.col("edit")
    within = lambda *known: F.size(F.array_except("hints", F.array(*map(F.lit, known)))) == 0
    cut_only = F.array_contains("hints", "cut") & within(*CUTTING)
    same_size = (F.length(edit["removed"]) == F.length(seen["removed"])) & (F.length(edit["inserted"]) == F.length(seen["inserted"]))
    place = F.col("state.destination")
    role, described = F.coalesce(place["role"], F.col("targetIdentity.role")), F.concat_ws(" ", place["fieldDescription"], place["fieldLabel"], "targetIdentity.fieldDescription", "targetIdentity.fieldLabel")
    unproven = (F.col("authored.resolution") != "resolved") & F.col("unresolved_paste").isNull()
    marked = F.exists("authored.segments", lambda s: (s["type"] == "authored_text") & F.contains(s["content"], F.lit(ZERO_WIDTH)))
    reason = F.coalesce(
        text.first_reason(
            (F.col("recordID").isNull(), "missing_record_id"),
            (F.coalesce("tapTimeoutCountDuringBurst", F.lit(0)) > 0, "tap_timeout_during_burst"),
            (unobserved_shortcut(F.col("inputEvents")), "unobserved_shortcut"),
            (text.is_sensitive(role, described), "sensitive_field"),
            (F.col("before").isNull(), "before_missing"),
            (F.size(F.coalesce("beforeAXErrors", empty)) > 0, "before_error"),
            (F.coalesce("before.valueWasTruncated", F.lit(False)), "before_truncated"),
            (F.col("before.value").isNull(), "before_missing"),
            (F.col("chosen").isNull() & F.coalesce("after.valueWasTruncated", F.lit(False)), "observation_truncated"),
            (F.col("after_value").isNull(), "no_observation"),
            (cut_only & (F.length("after_value") >= F.length("before_value")), "cut_did_not_contract"),
            ((seen["operation"] == "none") | ~rebuilt(seen), "empty_or_unreproduced_edit"),
            (within(*REMOVING) & (seen["inserted"] != ""), "inserted_without_insertion"),
            (~rebuilt(edit), "checkpoint_alignment_does_not_reconstruct_observation"),
            ((F.col("alignment.rule") == EQUIVALENT) & ~same_size, "checkpoint_alignment_is_not_equivalent"),
            (~F.array_contains("hints", "paste") & (F.length(edit["removed"]) >= FORMATTING) & F.contains(edit["inserted"], edit["removed"]), "formatting_change"),
        ),
        F.when(unproven, F.col("authored.resolution")),
        text.first_reason((marked, "application_generated_zero_width_scaffold"), (instant(F.col("beganAt")).isNull(), "began_at_missing")),
    )
    return [
        F.col("session_id"), F.col("line"), F.col("recordID").alias("record_id"), F.col("lineage"), F.coalesce(place["processIdentifier"], "targetIdentity.processIdentifier", F.lit(-1)).alias("pid"), F.coalesce(place["windowTitle"], "targetIdentity.windowTitle").alias("window_title"), F.col("hints"),
        F.coalesce(place["appName"], "targetIdentity.bundleIdentifier", F.lit("Unknown")).alias("app"), *[F.col(f"targetIdentity.{c}").alias(name) for c, name in (("bundleIdentifier", "bundle"), ("role", "role"), ("fieldDescription", "field_description"), ("fieldLabel", "field_label"))],
        F.col("targetIdentity.elementHash").alias("element"), F.coalesce("inputEventCount", F.lit(0)).alias("input_events"), F.col("boundaryReason").alias("boundary_reason"), F.col("before_value"), F.col("after_value"), F.col("final_.operation").alias("operation"), F.col("final_.offset").alias("offset"),
        F.col("final_.removed").alias("removed"), F.col("final_.inserted").alias("inserted"), F.col("authored.completion").alias("content"), instant(F.col("beganAt")).alias("began_at"), instant(F.col("terminalDecisionAt")).alias("terminal_at"), F.col("authored.segments").alias("segments"),
        F.col("unresolved_paste").alias("authorship"), F.col("authored.continuity").alias("continuity"), F.col("authored.evidence").alias("evidence"), F.coalesce("alignment.rule", F.lit(CANONICAL)).alias("alignment"), F.col("alignment.states").alias("alignment_states"), F.when(F.col("recovered"), RECOVERED).alias("ineligible"),
        canonical(F.col("conditioningState")).alias("conditioning"), cursor_fidelity(F.col("before_value"), F.col("before"), F.col("final_.offset")).alias("fidelity"), F.col("chosen.source").alias("observed_by"), F.col("chosen.checkpoint_id").alias("checkpoint_id"), F.col("chosen.reason").alias("observed_because"), reason.alias("reason"),
    ]


def closures(journal: DataFrame) -> DataFrame:
    """Confirmed submissions with the write record that they close; reason for those that close none.

    Other dispositions are passed over. A submission must name a settled write by its record and last observation, have found the field in
    the same state just before the action, in order of time, follow an action that submits, and have left the field empty or gone. Of several for one record the first
    line closes it.
    """
    none = F.array().cast("array<string>")
    clean = lambda c: F.size(F.coalesce(c, none)) == 0
    value = lambda o: text.logical_value(o["value"], o["placeholderValue"])
    sha = lambda c: F.sha2(c, 256)
    c = records(journal, "prompt_submission_observation").where(F.col("disposition").isin(*CONFIRMED)).withColumnsRenamed({"line": "closure_line", "recordID": "closure_id", "sourceWriteRecordID": "record_id"})
    source = records(journal, "active_tap_write_attempt").where("recordID is not null").select("session_id", F.col("recordID").alias("record_id"), F.struct("boundaryReason", "after").alias("source"), "line")
    source = source.groupBy("session_id", "record_id").agg(F.max_by("source", "line").alias("source"))
    met = c.join(source, ["session_id", "record_id"], "left")
    end, before, post, action = F.col("source.after"), F.col("preActionObservation"), F.col("postActionObservation"), F.col("action")
    settled = (F.col("source.boundaryReason") == "write_delay_elapsed") & ~F.coalesce(end["valueWasTruncated"], F.lit(False)) & end["value"].isNotNull() & (end["observationID"] == F.col("terminalObservationID"))
    same = (value(end) != "") & (sha(value(end)) == F.col("terminalValueSHA256")) & (F.length(value(end)) == F.col("terminalCharacterCount")) & clean(F.col("preActionAXErrors")) & ~F.coalesce(before["valueWasTruncated"], F.lit(False)) & (sha(value(before)) == sha(value(end)))
    timed = clean(F.col("surfaceValidationErrors")) & action["kind"].isNotNull() & (F.col("referenceRetainedAt") <= action["observedAt"]) & (action["observedAt"] <= F.col("observedAt"))
    submits = (action["kind"] == "unmodified_return") | ((action["kind"] == "pointer_click") & action["matchedSubmissionTerm"].isin(*SUBMITS))
    gone = post.isNull() & F.exists("postActionAXErrors", lambda e: F.contains(F.lower(e), F.lit("invalid_ui_element")))
    emptied = clean(F.col("postActionAXErrors")) & (value(post) == "")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    reason = text.first_reason(
        (F.col("closure_id").isNull() | F.col("source").isNull(), "closure_source_write_missing"),
        (no(settled), "closure_terminal_observation_mismatch"),
        (no(same), "closure_pre_action_state_mismatch"),
        (no(timed), "closure_action_or_timing_invalid"),
        (no(submits), "closure_action_not_semantically_submissive"),
        (no(F.when(F.col("disposition") == "confirmed_field_disappeared", gone).otherwise(emptied)), "closure_post_action_transition_invalid"),
    )
    met = met.withColumn("reason", reason)
    # the first of the valid ones for a record, by a sum that is combined before it is shuffled
    first = met.where("reason is null").groupBy("session_id", "record_id").agg(F.min("closure_line").alias("first_"))
    met = met.join(first, ["session_id", "record_id"], "left")
    again = F.when(F.col("reason").isNull() & (F.col("closure_line") > F.col("first_")), "duplicate_confirmed_closure_for_write")
    return met.select("session_id", "closure_line", "closure_id", "record_id", instant(F.col("observedAt")).alias("observed_at"), F.coalesce("reason", again).alias("reason"))


def contaminated_reads(reads: DataFrame, writes: DataFrame, width: int) -> DataFrame:
    """Reads captured inside a write of their process that show a prefix of what was written, with the longest such prefix.

    Pairs are found by IDs and times alone; texts are made ready once each and follow the pairs.
    """
    key = ["session_id", "pid"]
    r = reads.select(*key, F.col("record_id").alias("read_id"), "captured_at", F.col("captured_at").alias("captured_to"))
    w = writes.select(*key, F.col("record_id").alias("write_id"), "began_at", "terminal_at")
    met = interval_join(r, w, key, ("captured_at", "captured_to"), ("began_at", "terminal_at"), width).select("session_id", "read_id", "write_id")
    ready = lambda t, i, name: t.select("session_id", F.col("record_id").alias(i), F.lower(text.normalized_line(F.coalesce("content", F.lit("")))).alias(name))
    texts = met.join(ready(writes, "write_id", "completion"), ["session_id", "write_id"]).where(F.length("completion") >= 24).join(ready(reads, "read_id", "within_"), ["session_id", "read_id"])
    texts = texts.withColumn("shown", text.longest_contained_prefix(F.col("completion"), F.col("within_")))
    return texts.where("shown is not null").groupBy("session_id", "read_id").agg(F.max_by("write_id", F.struct("shown", "write_id")).alias("write_id"), F.max("shown").alias("shown"))


def reduce_journal(journal: DataFrame, width: int = 60_000_000) -> tuple[DataFrame, DataFrame]:
    """(events, unresolved) of the sessions: every READ and WRITE record is in one of them, with a reason in the second.

    Reads that a write overtook, and reads that show a write of their process, are set aside. Viewports
    emit the lines that the one before of their window did not show; any attempt with input in between, even
    a rejected one, clears what was seen. width: microseconds of the grid that intervals are joined on.
    """
    # each is used several times below
    reads, writes = cut(read_candidates(journal)), write_candidates(journal)
    good_reads, good_writes = reads.where("reason is null"), writes.where("reason is null")
    spans = good_writes.select("session_id", "pid", F.col("record_id").alias("write_id"), "began_at", "terminal_at")
    r = good_reads.select("session_id", "pid", F.col("record_id").alias("read_id"), "last_activity", "captured_at")
    met = interval_join(r.withColumn("captured_to", F.col("captured_at")), spans, ["session_id", "pid"], ("captured_at", "captured_to"), ("began_at", "terminal_at"), width)
    stale = met.where("last_activity < began_at").groupBy("session_id", "read_id").agg(F.min_by("write_id", F.struct("began_at", "write_id")).alias("by_write")).withColumn("why", F.lit("stale_read"))
    dirty = contaminated_reads(good_reads, good_writes, width).select("session_id", "read_id", F.col("write_id").alias("by_write"), F.lit("shows_own_write").alias("why"))
    dirty = dirty.join(stale, ["session_id", "read_id"], "left_anti")
    aside = stale.unionByName(dirty).withColumnRenamed("read_id", "record_id")
    judged = reads.join(aside, ["session_id", "record_id"], "left").withColumn("reason", F.coalesce("reason", "why")).drop("why")
    # the timeline of a session: viewports of each window, and a reset wherever an attempt had input
    views = judged.where("reason is null").select("session_id", "line", "record_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in ("pid", "window_id", "display_id")]).alias("context"), "content", F.col("captured_at").alias("at"), F.lit(1).alias("rank"))
    marks = records(journal, "active_tap_write_attempt").where("inputEventCount > 0").select("session_id", "line", instant(F.col("beganAt")).alias("at"), F.lit(0).alias("rank"))
    epochs = views.unionByName(marks, allowMissingColumns=True)
    epochs = epochs.withColumn("epoch", F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).over(W.partitionBy("session_id").orderBy("at", "rank", "line").rowsBetween(W.unboundedPreceding, 0)))
    before = F.lag("content").over(W.partitionBy("session_id", "context", "epoch").orderBy("at", "line"))
    shown = epochs.where("rank = 1").withColumn("before_", before).withColumn("emitted", text.novel_lines(F.col("before_"), F.col("content"))).select("session_id", "record_id", "emitted")
    judged = judged.join(shown, ["session_id", "record_id"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("emitted") == "", "nothing_new_in_viewport")))
    judged = cut(judged)
    closed = closures(journal)
    # the earliest closure of any record that a write stands for
    ends = good_writes.select("session_id", "line", F.explode("lineage").alias("record_id")).join(closed.where("reason is null"), ["session_id", "record_id"])
    first = ends.groupBy("session_id", "line").agg(F.min(F.struct("observed_at", "closure_line", "closure_id")).alias("closure"))
    lineage = F.array("record_id")
    read_events = judged.where("reason is null").select("session_id", "line", ids.stable_id("evt_", F.col("session_id"), lineage, F.lit(0)).alias("event_id"), F.lit("read").alias("kind"), "record_id", "pid", "window_title", F.col("app_name").alias("app"), F.col("emitted").alias("content"), F.lit(None).cast("long").alias("began_at"), F.col("captured_at").alias("available_at"))
    sources = F.concat("lineage", F.filter(F.array("closure.closure_id"), lambda x: x.isNotNull()))
    closing = F.when(F.col("closure").isNotNull(), "submission_boundary").otherwise(F.col("boundary_reason"))
    write_events = good_writes.join(first, ["session_id", "line"], "left").select(
        "session_id", "line", ids.stable_id("evt_", F.col("session_id"), sources, F.lit(0)).alias("event_id"), F.lit("write").alias("kind"), "record_id", "lineage", "pid", "window_title", "app", "bundle", "role", "field_description", "field_label", "content", "began_at", F.col("terminal_at").alias("available_at"), "operation", "offset", "removed", "inserted", "before_value", "after_value",
        "segments", "authorship", "continuity", "evidence", "alignment", "ineligible", "conditioning", "fidelity", "element", "hints", F.col("closure.observed_at").alias("submitted_at"), closing.alias("boundary_reason"),
    )
    events = write_events.unionByName(read_events, allowMissingColumns=True)
    events = cut(events.withColumn("sequence", F.row_number().over(W.partitionBy("session_id").orderBy(F.coalesce("began_at", "available_at"), F.when(F.col("kind") == "write", 0).otherwise(1), "line"))))
    rejected = judged.where("reason is not null").select("session_id", "line", "record_id", F.lit("read").alias("candidate"), "reason", "by_write")
    rejected = rejected.unionByName(writes.where("reason is not null").select("session_id", "line", "record_id", F.lit("write").alias("candidate"), "reason"), allowMissingColumns=True)
    rejected = rejected.unionByName(closed.where("reason is not null").select("session_id", F.col("closure_line").alias("line"), F.col("closure_id").alias("record_id"), F.lit("closure").alias("candidate"), "reason"), allowMissingColumns=True)
    return events, rejected
