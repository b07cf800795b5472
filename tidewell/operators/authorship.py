"""Who wrote what a write put in: typed stretches and pasted ones, as far as the record's own observations prove them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import spans, text
from tidewell.functions.columns import Steps, remembered, with_steps

SEGMENTS = spans.SEGMENTS
AUTHORSHIP = f"struct<segments:{SEGMENTS},resolution:string,completion:string,continuity:string,evidence:string,observation_id:string,edit:struct<operation:string,offset:bigint,removed:string,inserted:string>>"
#: Hints after a paste that may change it, and those that can't.
CHANGING, HARMLESS = ("delete", "cut", "undo_redo"), ("return", "navigation")
#: The editor whose list marks are no text, and these marks.
LISTING, MARKS, ZERO_WIDTH = "md.obsidian", "\n​(?:\\t)?\n(?:​\n)?-\n​ (?:\n)?", "​"
_SEEN = "struct<at:string,id:string,value:string>"


def _empty(c: Column) -> Column:
    return F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _value(o: Column) -> Column:
    return text.logical_value(o["value"], o["placeholderValue"])


def _whole(o: Column) -> Column:
    return o["value"].isNotNull() & ~_true(o["valueWasTruncated"])


def _segment(kind: str, content: Column, paste_id: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), content.alias("content"), (F.lit(None).cast("string") if paste_id is None else paste_id).alias("paste_id"))


def _segments(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda s: s["content"] != "").cast(SEGMENTS)


def judged_pastes(clipboard: Column) -> Column:
    """Each paste checkpoint as (failure, proven, start, text, paste_id): failure if it can't be used, proven if it shows exactly the clipboard put in."""

    def one(p: Column) -> Column:
        known = (p["clipboardSnapshotID"] == clipboard["snapshotID"]) & (p["clipboardChangeCount"] == clipboard["changeCount"])
        complete = _empty(p["prePasteAXErrors"]) & _empty(p["axErrors"]) & ~_true(p["clipboardTextWasTruncated"]) & (F.coalesce(p["clipboardText"], F.lit("")) != "") & _true(_whole(p["prePasteObservation"])) & _true(_whole(p["observation"]))
        failure = text.first_reason((~_true(known), "clipboard_changed_after_conditioning"), (~_true(complete), "paste_checkpoint_incomplete"))
        edit = text.minimal_edit(_value(p["prePasteObservation"]), _value(p["observation"]))
        return F.struct(failure.alias("failure"), _true(edit["inserted"] == p["clipboardText"]).alias("proven"), edit["offset"].cast("int").alias("start"), p["clipboardText"].alias("text"), F.coalesce(p["checkpointID"], F.lit("")).alias("paste_id"))

    return F.transform("pasteCheckpoints", one)


def hints_after(at: Column) -> Column:
    """The different hints of the inputs after a time."""
    later = F.filter(F.coalesce("inputEvents", F.array()), lambda e: F.coalesce(e["eventTimestampNanoseconds"], F.lit(0)) > at)
    return F.array_distinct(F.filter(F.transform(later, lambda e: e["hint"]), lambda h: h.isNotNull()))


def later_observations(paste: Column) -> Column:
    """What was seen of the field from a paste on, the paste's own checkpoint and the chosen observation with it: (at, id, value) by time, each ID once."""
    of = lambda o: F.when(_whole(o) & o["observationID"].isNotNull(), F.struct(F.coalesce(o["observedAt"], F.lit("")).alias("at"), o["observationID"].alias("id"), _value(o).alias("value"))).cast(_SEEN)
    since = lambda name: F.transform(F.filter(F.coalesce(name, F.array()), lambda c: (F.coalesce(c["eventTimestampNanoseconds"], F.lit(0)) >= paste["eventTimestampNanoseconds"]) & _empty(c["axErrors"])), lambda c: of(c["observation"]))
    used = F.struct(F.coalesce("chosen.observed_at", F.lit("")).alias("at"), F.col("chosen.observation_id").alias("id"), F.col("after_value").alias("value")).cast(_SEEN)
    every = F.filter(F.concat(F.array(of(paste["observation"])), since("mutationCheckpoints"), since("returnCheckpoints"), F.array(used)), lambda o: o["id"].isNotNull())
    ids = F.transform(every, lambda o: o["id"])
    return F.array_sort(F.filter(every, lambda o, i: F.array_position(ids, o["id"]) == i + 1))


def delayed_paste(paste: Column) -> Column:
    """The first later observation (id, edit) in which the clipboard's text was put in once, with nothing but blanks around it and nothing removed."""
    payload, was = paste["clipboardText"], _value(paste["prePasteObservation"])

    def edit_of(o: Column) -> Column:
        return F.struct(o["id"].alias("id"), text.minimal_edit(was, o["value"]).alias("edit"))

    def shows(x: Column) -> Column:
        put = x["edit"]["inserted"]
        return (x["edit"]["removed"] == "") & (text.occurrences(payload, put) == 1) & F.rlike(F.regexp_replace(F.replace(put, payload, F.lit("")), ZERO_WIDTH, ""), F.lit(r"(?U)^\s*$"))

    # nothing but the payload's own input may have come after it, and the text must have been there in the end
    sound = paste["eventTimestampNanoseconds"].isNotNull() & _empty(paste["prePasteAXErrors"]) & _whole(paste["prePasteObservation"]) & (was == F.col("before_value"))
    sound = sound & (F.size(F.array_except(hints_after(paste["eventTimestampNanoseconds"]), F.array(*map(F.lit, HARMLESS)))) == 0) & F.contains(F.col("after_value"), payload)
    met = F.filter(F.transform(later_observations(paste), edit_of), shows)
    return F.when(_true(sound), F.try_element_at(met, F.lit(1)))


def with_authorship(writes: DataFrame) -> DataFrame:
    """Adds authored: (segments, resolution, completion, continuity, evidence, observation_id, edit) of each write; edit replaces the write's where it isn't null.

    In this order: a cut writes nothing; a recovered field is its own text; a write without paste is what it put in; pastes whose checkpoints
    show exactly the conditioned clipboard put in are looked up in the final insertion; a single one may have been seen late;
    a single one may have begun a new, empty state of the field, with typed text before and after it. Everything else is set aside with
    the reason as resolution; if a paste was among the inputs, its text stays in history as one segment unresolved_paste_transition.
    """
    return with_steps(writes, _resolution()).drop("pastes_", "found_", "delayed_")


@remembered
def _resolution() -> Steps:
    hints, n = F.col("hints"), F.size(F.coalesce("pasteCheckpoints", F.array()))
    clipboard, put, now = F.col("state.clipboard"), F.col("edit.inserted"), F.col("after_value")
    steps: Steps = [{"pastes_": F.when(n > 0, judged_pastes(clipboard))}]
    spans_ = F.transform("pastes_", lambda p: F.struct(p["start"].alias("start"), p["text"].alias("text"), p["paste_id"].alias("paste_id")))
    proven = F.coalesce(F.forall("pastes_", lambda p: p["failure"].isNull() & p["proven"]), F.lit(False))
    first = F.try_element_at("pasteCheckpoints", F.lit(1))
    found = spans.paste_segments(F.coalesce(put, F.lit("")), F.coalesce("edit.offset", F.lit(0)).cast("int"), F.when(proven, spans_))
    steps.append({"found_": found, "delayed_": F.when((n == 1) & ~proven & F.try_element_at("pastes_", F.lit(1))["failure"].isNull(), delayed_paste(first))})

    none = F.lit(None)

    def case(segments: Column, completion: Column, continuity: str, evidence: str | None = None, observation: Column = none, edit: Column = none, resolution: Column | str = "resolved") -> Column:
        how = F.lit(resolution) if isinstance(resolution, str) else resolution
        return F.struct(segments.cast(SEGMENTS).alias("segments"), how.alias("resolution"), completion.alias("completion"), F.lit(continuity).alias("continuity"), F.lit(evidence).alias("evidence"), observation.cast("string").alias("observation_id"), edit.alias("edit")).cast(AUTHORSHIP)

    nothing = F.array().cast(SEGMENTS)
    aside = lambda reason: case(nothing, F.lit(""), "unresolved", resolution=reason)
    cut_only = F.array_contains(hints, "cut") & (F.size(F.array_except(hints, F.array(F.lit("cut"), F.lit("navigation")))) == 0)
    pasted = F.array_contains(hints, "paste")
    conditioned = clipboard["snapshotID"].isNotNull() & clipboard["changeCount"].isNotNull() & ~_true(clipboard["textWasTruncated"])
    failure = F.try_element_at(F.filter("pastes_", lambda p: p["failure"].isNotNull()), F.lit(1))["failure"]
    last_id = F.try_element_at("pasteCheckpoints", F.lit(-1))["observation"]["observationID"]
    globally = F.when(F.col("found_.reason").isNull(), case(F.col("found_.segments"), put, "single_ax_epoch", "grounded_clipboard_transition", last_id)).otherwise(aside(F.col("found_.reason")))
    late = F.col("delayed_.edit")
    delayed = case(_segments(_segment("paste", late["inserted"], F.coalesce(first["checkpointID"], F.lit("")))), late["inserted"], "same_ax_field_delayed_paste_observation", "grounded_delayed_paste_observation", F.col("delayed_.id"), late)
    payload = first["clipboardText"]
    changed = F.arrays_overlap(hints_after(F.coalesce(first["eventTimestampNanoseconds"], F.lit((1 << 63) - 1))), F.array(*map(F.lit, CHANGING)))
    typed_first = text.minimal_edit(F.col("before_value"), _value(first["prePasteObservation"]))["inserted"]
    epoch = _segments(_segment("authored_text", typed_first), _segment("paste", payload, F.coalesce(first["checkpointID"], F.lit(""))), _segment("authored_text", now))
    fresh = (_value(first["observation"]) == "") & ~F.contains(now, payload)
    segmented = case(epoch, F.array_join(F.transform(epoch, lambda s: s["content"]), ""), "segmented_at_grounded_paste", "grounded_paste_ax_epoch_transition", F.col("chosen.observation_id"))
    resolved = (
        F.when(_true(cut_only), case(nothing, F.lit(""), "single_ax_epoch", "cut_only_no_authored_content"))
        .when(_true(F.col("recovered")), case(_segments(_segment("authored_text", now)), now, "incomplete_pre_mutation_conditioning", "fast_start_full_field_history_only", F.col("chosen.observation_id")))
        .when((n == 0) & pasted, aside(F.lit("paste_checkpoint_missing")))
        .when(n == 0, case(_segments(_segment("authored_text", put)), put, "single_ax_epoch"))
        .when(~_true(conditioned), aside(F.lit("conditioning_clipboard_missing")))
        .when(failure.isNotNull(), aside(failure))
        .when(proven, globally)
        .when(F.col("delayed_").isNotNull(), delayed)
        .when(n > 1, aside(F.lit("paste_transition_does_not_match_clipboard")))
        .when(changed, aside(F.lit("post_paste_edit_may_modify_payload")))
        .when(_true(fresh), segmented)
        .otherwise(aside(F.lit("unproven_ax_epoch_transition")))
    )
    steps.append({"authored": resolved})
    unresolved = (F.col("authored.resolution") != "resolved") & pasted
    kept = case(_segments(_segment("unresolved_paste_transition", put)), put, "observed_document_transition_unresolved_authorship", "complete_before_selected_observation_minimal_diff", F.col("chosen.observation_id"), resolution="unresolved")
    steps.append({"unresolved_paste": F.when(unresolved, F.col("authored.resolution")), "authored": F.when(unresolved, kept).otherwise(F.col("authored"))})
    return [*steps, {"authored": _without_list_marks()}]


def _without_list_marks() -> Column:
    """Takes the marks that an editor puts between list entries out of typed text, where a typed return made them and no other such mark is left."""
    a = F.col("authored")
    marked = lambda s: F.exists(s, lambda x: (x["type"] == "authored_text") & F.contains(x["content"], F.lit(ZERO_WIDTH)))

    def clean(s: Column) -> Column:
        body = F.regexp_replace(s["content"], MARKS, "\n")
        body = F.when(F.endswith(body, F.lit("\n")) & F.endswith(s["content"], F.lit(ZERO_WIDTH + " ")), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
        body = F.when(F.startswith(body, F.lit("\n")), F.substring(body, F.lit(2), F.length(body))).otherwise(body)
        return F.struct(s["type"].alias("type"), F.when(s["type"] == "authored_text", body).otherwise(s["content"]).alias("content"), s["paste_id"].alias("paste_id"))

    bundle = F.coalesce("bundleIdentifier", "targetIdentity.bundleIdentifier")
    asked = (bundle == LISTING) & (a["resolution"] == "resolved") & F.array_contains("hints", "typed") & F.array_contains("hints", "return") & marked(a["segments"])
    replaced = F.exists(a["segments"], lambda s: (s["type"] == "authored_text") & F.rlike(s["content"], F.lit(MARKS)))
    cleaned = F.transform(a["segments"], clean)
    use = F.coalesce(asked & replaced & ~marked(cleaned), F.lit(False))
    whole = F.array_join(F.transform(cleaned, lambda s: s["content"]), "")
    source = F.coalesce(a["edit"], F.col("edit"))
    edit = F.struct(source["operation"].alias("operation"), source["offset"].alias("offset"), source["removed"].alias("removed"), whole.alias("inserted"))
    new = F.struct(cleaned.alias("segments"), a["resolution"].alias("resolution"), whole.alias("completion"), a["continuity"].alias("continuity"), F.lit("obsidian_list_scaffold_normalized_v1").alias("evidence"), a["observation_id"].alias("observation_id"), edit.alias("edit")).cast(AUTHORSHIP)
    return F.when(use, new).otherwise(a)
