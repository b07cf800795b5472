"""What a write was conditioned on: the state of its field, cursor and clipboard before the first key, and how far the cursor can be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import text

#: Fixed value: the fields of a conditioning state.
CONDITIONING = (
    "struct<schemaVersion:int,capturedAt:string,destination:struct<appName:string,bundleIdentifier:string,processIdentifier:int,windowTitle:string,resource:string,role:string,subrole:string,fieldIdentifier:string,fieldLabel:string,fieldDescription:string,placeholder:string>,"
    "cursorContext:struct<schemaVersion:int,source:string,captureStatus:string,fieldState:string,leftContext:string,selectedText:string,rightContext:string,surfacePrompt:string,selectionStartCharacters:int,selectionLengthCharacters:int,selectionStartUTF16:int,selectionLengthUTF16:int,fieldCharacterCount:int,leftContextWasTruncated:boolean,selectedTextWasTruncated:boolean,rightContextWasTruncated:boolean>,"
    "clipboard:struct<snapshotID:string,changeCount:bigint,text:string,textSHA256:string,textWasTruncated:boolean>>"
)
#: How states are captured, the least version that only holds as it was recorded, and that with the field's own strings.
CAPTURE, RECORDED, RANGE = "synchronous_before_application_mutation", 3, 2
#: Prompts that two applications show as a field's text, and browsers.
PROMPTS, BROWSERS = (("com.openai.codex", "Do anything"),), ("com.google.Chrome", "company.thebrowser.Browser")
#: The statuses of a cursor.
ALIGNED, NO_CURSOR, NO_MUTATION, DIFFERS, MOVED = "aligned", "initial_cursor_unavailable", "earliest_observed_mutation_unavailable", "initial_cursor_differs_from_earliest_observed_mutation", "terminal_edit_moved_after_aligned_start"
CHECKPOINTS = ("mutationCheckpoints", "pasteCheckpoints", "returnCheckpoints")


def canonical(json: Column) -> Column:
    """A JSON text with its keys in order and no blanks; null where it is none."""
    return F.to_json(F.try_parse_json(json))


def initial_cursor(value: Column, location: Column, length: Column) -> Column:
    """The code-point offset of a selection given in UTF-16; null unless both its ends are places of the text."""
    start, end = text.utf16_to_offset(value, location), text.utf16_to_offset(value, location + length)
    return F.when((location >= 0) & (length >= 0) & end.isNotNull(), start)


def earliest_mutation(before_value: Column) -> Column:
    """struct(at, id, offset) of the first observation that shows the field changed, by (time, ID)."""
    kind = "array<struct<axErrors:array<string>,observation:struct<observationID:string,observedAt:string,value:string,placeholderValue:string,valueWasTruncated:boolean>>>"

    def one(p: Column) -> Column:
        o = p["observation"]
        fit = (F.size(F.coalesce(p["axErrors"], F.array().cast("array<string>"))) == 0) & ~F.coalesce(o["valueWasTruncated"], F.lit(False)) & o["value"].isNotNull() & o["observationID"].isNotNull() & o["observedAt"].isNotNull()
        edit = text.minimal_edit(before_value, text.logical_value(o["value"], o["placeholderValue"]))
        return F.when(fit & (edit["operation"] != "none"), F.struct(o["observedAt"].alias("at"), o["observationID"].alias("id"), edit["offset"].alias("offset")))

    slim = lambda p: F.struct(p["axErrors"].alias("axErrors"), F.struct(*[p["observation"][k].alias(k) for k in ("observationID", "observedAt", "value", "placeholderValue", "valueWasTruncated")]).alias("observation"))
    every = F.concat(*[F.coalesce(F.transform(c, slim), F.array().cast(kind)) for c in CHECKPOINTS])
    return F.array_min(F.transform(every, one))  # a minimum passes over nulls


def fidelity_status(initial: Column, earliest: Column, terminal: Column) -> Column:
    """Whether three independent places of an edit agree: the cursor before it, the first change seen, and the net edit."""
    return F.when(initial.isNull(), NO_CURSOR).when(earliest.isNull(), NO_MUTATION).when(initial != earliest, DIFFERS).when(~terminal.eqNullSafe(initial), MOVED).otherwise(ALIGNED)


def cursor_fidelity(before_value: Column, before: Column, terminal: Column) -> Column:
    """struct(status, initial, earliest, earliest_id, terminal): the status with the places it comes from."""
    initial = initial_cursor(before_value, before["selectedRangeLocation"], before["selectedRangeLength"])

    def made(v: Column) -> Column:
        return F.struct(fidelity_status(v["i"], v["e"]["offset"], terminal).alias("status"), v["i"].alias("initial"), v["e"]["offset"].alias("earliest"), v["e"]["id"].alias("earliest_id"), terminal.alias("terminal"))

    return text.let(F.struct(initial.alias("i"), earliest_mutation(before_value).alias("e")), made)


def unpopulated_prompt(bundle: Column, description: Column, value: Column, placeholder: Column, represented: Column) -> Column:
    """The prompt that an empty field shows as its text; null for text of its user."""
    seen, hint = text.trimmed(value), text.trimmed(placeholder)
    shown = F.coalesce(represented, F.lit(False)) | F.coalesce((seen == hint) & (hint != ""), F.lit(False))
    known = F.lit(False)
    for b, p in PROMPTS:
        known = known | F.coalesce((bundle == b) & (seen == p), F.lit(False))
    known = known | F.coalesce(bundle.isin(*BROWSERS) & F.contains(F.lower(description), F.lit("prompt for gemini")) & (seen == "Ask Gemini"), F.lit(False))
    return F.when(seen != "", F.when(shown, F.coalesce(F.when(hint != "", hint), seen)).when(known, seen))


def _destination() -> Column:
    """Where the write went, from the attempt."""
    t, before = F.col("targetIdentity"), F.col("before")
    bundle = F.coalesce("state.destination.bundleIdentifier", "bundleIdentifier")
    app = F.coalesce("state.destination.appName", "targetIdentity.bundleIdentifier", F.lit("Unknown"))
    return F.struct(
        app.alias("appName"), bundle.alias("bundleIdentifier"), t["accessibilityIdentifier"].alias("fieldIdentifier"), t["fieldDescription"].alias("fieldDescription"), t["fieldLabel"].alias("fieldLabel"), before["placeholderValue"].alias("placeholder"),
        F.coalesce(F.col("state.destination.processIdentifier"), t["processIdentifier"]).alias("processIdentifier"), F.coalesce(t["role"], F.lit("")).alias("role"), t["subrole"].alias("subrole"), F.coalesce(F.col("state.destination.windowTitle"), t["windowTitle"]).alias("windowTitle"),
    )


def _state(version: int, cursor: Column) -> Column:
    return F.to_json(F.struct(
        F.lit(CAPTURE).alias("captureSemantics"), F.col("before.observedAt").alias("capturedAt"), cursor.alias("cursorContext"), _destination().alias("destination"), F.coalesce("beganAt", F.lit("")).alias("inputInterceptedAt"), F.lit(version).alias("schemaVersion"), F.coalesce("before.observationID", F.lit("")).alias("sourceObservationID"),
    ))


def range_state() -> Column:
    """The state made of the strings that the field itself gave around the cursor."""
    before, probe = F.col("before"), F.col("before.axRangeCursorProbe")
    prompt = unpopulated_prompt(F.coalesce("bundleIdentifier", F.lit("")), F.col("targetIdentity.fieldDescription"), before["value"], before["placeholderValue"], before["valueRepresentedPlaceholder"])
    none_right = (probe["right"]["axError"] == "no_value") & (probe["right"]["rangeLength"] == 1)
    status = F.when(probe["right"]["text"].isNotNull(), "complete").when(none_right, "right_provider_no_value_after_minimum_probe")
    shown = lambda c: F.when(prompt.isNull(), c).otherwise("")
    cursor = F.struct(
        status.alias("captureStatus"), F.when(prompt.isNull(), "editable_text").otherwise("unpopulated_prompt").alias("fieldState"), shown(probe["left"]["text"]).alias("leftContext"), shown(F.coalesce(probe["right"]["text"], F.lit(""))).alias("rightContext"),
        F.lit(2).alias("schemaVersion"), shown(probe["selected"]["text"]).alias("selectedText"), F.lit("accessibility_string_for_range").alias("source"), prompt.alias("surfacePrompt"),
    )
    complete = probe["left"]["text"].isNotNull() & probe["selected"]["text"].isNotNull() & status.isNotNull()
    return _state(RANGE, F.when(F.coalesce(complete, F.lit(False)), cursor))


def first_state() -> Column:
    """The state made of the field's value and its selection's numbers."""
    before, value = F.col("before"), F.col("before_value")
    at, n = before["selectedRangeLocation"], before["selectedRangeLength"]
    start = initial_cursor(value, at, n)
    size = (text.utf16_to_offset(value, at + n) - start).cast("int")
    w = text.cursor_window(value, start, size)
    cursor = F.struct(
        F.length(value).alias("fieldCharacterCount"), w["left"].alias("leftContext"), w["left_cut"].alias("leftContextWasTruncated"), w["right"].alias("rightContext"), w["right_cut"].alias("rightContextWasTruncated"), w["selected"].alias("selectedText"),
        w["selected_cut"].alias("selectedTextWasTruncated"), size.alias("selectionLengthCharacters"), n.alias("selectionLengthUTF16"), start.cast("int").alias("selectionStartCharacters"), at.alias("selectionStartUTF16"),
    )
    return _state(1, F.when(start.isNotNull(), cursor))


def resolved_state(event_state: Column, raw_state: Column) -> Column:
    """struct(state, error): the conditioning of a write, from its event's and its record's JSON and the record's columns.

    A state from version 3 on holds as it was recorded, and the event must have the same. Where the field gave strings around the cursor
    the state is made of them, and recorded states from version 2 on must be equal to it. Else the recorded state holds, and where
    there is none it is made of the field's value; an event's state must be equal to it. Anything else is an error.
    """
    version = lambda s: F.coalesce(F.get_json_object(s, "$.schemaVersion").cast("int"), F.lit(0))
    differs = lambda a, b: ~canonical(a).eqNullSafe(canonical(b))
    seen = F.col("before.value").isNotNull() & F.col("before.observedAt").isNotNull()
    probed = F.col("before.axRangeCursorProbe").isNotNull()
    ranged, made = range_state(), first_state()
    given = lambda s, e=None: F.struct(canonical(s).alias("state"), F.lit(e).cast("string").alias("error"))
    wrong = lambda e: F.struct(F.lit(None).cast("string").alias("state"), F.lit(e).alias("error"))
    clash = lambda s: s.isNotNull() & (version(s) >= RANGE) & differs(s, ranged)
    return (
        F.when(version(raw_state) >= RECORDED, F.when(differs(event_state, raw_state), wrong("conditioning_differs_from_record")).otherwise(given(raw_state)))
        .when(probed & ~seen, wrong("conditioning_observation_missing"))
        .when(probed, F.when(clash(raw_state) | clash(event_state), wrong("conditioning_differs_from_range")).otherwise(given(ranged)))
        .when(raw_state.isNotNull(), F.when(event_state.isNotNull() & differs(event_state, raw_state), wrong("conditioning_differs_from_record")).otherwise(given(raw_state)))
        .when(~seen, wrong("conditioning_observation_missing"))
        .when(event_state.isNotNull() & differs(event_state, made), wrong("conditioning_not_reconstructed"))
        .otherwise(given(made))
    )


def query_text(state: Column, timestamp: bool = False) -> Column:
    """The query of an example: what a model may know of the state; without the process, and with the clipboard where it was recorded."""
    s = F.from_json(state, CONDITIONING)
    at = F.from_json(state, "struct<cursorContext:string>")["cursorContext"]
    own = F.to_json(F.struct(*[s["cursorContext"][c].alias(c) for c in ("fieldState", "leftContext", "rightContext")], F.lit(2).alias("schemaVersion"), *[s["cursorContext"][c].alias(c) for c in ("selectedText", "surfacePrompt")]))
    cursor = F.when(s["cursorContext"]["source"] == "accessibility_string_for_range", own).when(at.isNotNull(), canonical(at)).otherwise("null")
    d = s["destination"]
    places = F.to_json(F.struct(*[d[c].alias(c) for c in sorted(("appName", "bundleIdentifier", "windowTitle", "resource", "role", "subrole", "fieldIdentifier", "fieldLabel", "fieldDescription", "placeholder"))]))
    clip = s["clipboard"]
    held = F.to_json(F.struct(clip["changeCount"].alias("changeCount"), clip["text"].alias("content"), clip["textWasTruncated"].alias("contentWasTruncated")))
    version = F.when(clip.isNull(), F.lit("2")).otherwise("3")
    stamp = F.concat(F.lit('"capturedAt":'), F.to_json(F.struct(F.coalesce(s["capturedAt"], F.lit("")).alias("x"))).substr(F.lit(6), F.length(F.coalesce(s["capturedAt"], F.lit(""))) + 2), F.lit(",")) if timestamp else F.lit("")
    clipboard = F.when(clip.isNull(), F.lit("")).otherwise(F.concat(F.lit('"clipboard":'), held, F.lit(",")))
    return F.concat(F.lit("{"), stamp, clipboard, F.lit('"cursorContext":'), cursor, F.lit(',"destination":'), F.coalesce(places, F.lit("{}")), F.lit(',"kind":"write_conditioning_state","schemaVersion":'), version, F.lit("}"))
