"""Conditioning states and cursor fidelity: each status, each way a state is resolved, and the exclusions that hang on them."""

import json

from pyspark.sql import functions as F

from tests.test_chains import attempt, load, observation, rows
from tests.test_reduce import at
from tidewell.functions import text
from tidewell.operators import compile as compiled
from tidewell.operators import conditioning as c
from tidewell.operators.reduce import reduce_journal


def seen(value, t, i):
    return {"axErrors": [], "observation": {"observationID": i, "observedAt": at(t), "value": value}}


def case(i, before, location, after, points=(), **more):
    a = attempt("s", i, more.pop("t", 1), before, after, mutationCheckpoints=[seen(*p) for p in points], **more)
    a["before"]["selectedRangeLocation"] = location
    return a


STATUS = {
    "aligned": case("aligned", "abc", 1, "aXXbc", [("aXbc", 1.1, "m")]),
    c.NO_CURSOR: case("none", "abc", 9, "aXbc", [("aXbc", 1.1, "m")]),
    c.NO_MUTATION: case("unseen", "abc", 1, "aXbc", [("abc", 1.1, "m")]),
    c.DIFFERS: case("differs", "abc", 0, "aXbc", [("aXbc", 1.2, "m"), ("abXc", 1.1, "n")]),
    c.MOVED: case("moved", "abc", 1, "Zabc", [("aXbc", 1.1, "m")]),
}


def test_each_fidelity_status(spark, tmp_path):
    r = rows(spark, tmp_path, list(STATUS.values())).withColumn("before_value", F.col("before.value"))
    r = r.withColumn("edit", text.minimal_edit(F.col("before_value"), F.col("after.value")))
    got = {x["recordID"]: x["f"] for x in r.select("recordID", c.cursor_fidelity(F.col("before_value"), F.col("before"), F.col("edit.offset")).alias("f")).collect()}
    assert {got[a["recordID"]]["status"]: a["recordID"] for a in STATUS.values()} == {s: a["recordID"] for s, a in STATUS.items()}
    assert (got["differs"]["earliest_id"], got["differs"]["earliest"], got["aligned"]["initial"]) == ("n", 2, 1)


PROBE = {"left": {"text": "le"}, "selected": {"text": ""}, "right": {"text": "ri"}, "errors": []}


def resolved(spark, tmp_path, cases):
    records = [attempt("s", i, 1 + k, "ab", "abc", **{k: v for k, v in r.items() if k not in ("event", "before")}) for k, (i, r) in enumerate(cases.items())]
    for a, r in zip(records, cases.values(), strict=True):
        a["before"] |= r.get("before", {})
    events = spark.createDataFrame([(i, json.dumps(r["event"]) if "event" in r else None) for i, r in cases.items()], "recordID string, event string")
    own = rows(spark, tmp_path, records).withColumn("before_value", text.logical_value(F.col("before.value"), F.col("before.placeholderValue"))).join(events, "recordID")
    got = own.select("recordID", c.resolved_state(F.col("event"), F.col("conditioningState")).alias("s")).select("recordID", "s.*", c.query_text(F.col("s.state")).alias("q"), c.query_text(F.col("s.state"), True).alias("timed")).collect()
    return {r["recordID"]: r for r in got}


def test_each_way_a_state_is_resolved(spark, tmp_path):
    full = {"schemaVersion": 3, "capturedAt": "now", "destination": {"appName": "A", "processIdentifier": 4}, "clipboard": {"changeCount": 2, "text": "T", "textWasTruncated": False}, "note": [1, {"b": 1, "a": 2}]}
    old = {"schemaVersion": 1, "cursorContext": {"rightContext": "r", "leftContext": "l"}}
    cases = {
        "recorded": {"conditioningState": full, "event": dict(reversed(full.items()))},
        "recorded_no_event": {"conditioningState": full},
        "recorded_other": {"conditioningState": full, "event": full | {"note": []}},
        "ranged": {"before": {"axRangeCursorProbe": PROBE}},
        "ranged_old": {"before": {"axRangeCursorProbe": PROBE}, "conditioningState": old},
        "ranged_clash": {"before": {"axRangeCursorProbe": PROBE}, "conditioningState": {"schemaVersion": 2}},
        "ranged_unseen": {"before": {"axRangeCursorProbe": PROBE, "value": None}},
        "ranged_short": {"before": {"axRangeCursorProbe": PROBE | {"right": {"axError": "no_value", "rangeLength": 1}}}},
        "prompt": {"before": {"axRangeCursorProbe": PROBE, "value": " Do anything "}, "bundleIdentifier": "com.openai.codex"},
        "old": {"conditioningState": old},
        "old_other": {"conditioningState": old, "event": {"schemaVersion": 1}},
        "made": {},
        "made_other": {"event": {"schemaVersion": 1}},
        "unseen": {"before": {"value": None}},
    }
    got = resolved(spark, tmp_path, cases)
    state = {i: json.loads(r["state"]) if r["state"] else None for i, r in got.items()}
    errors = {i: r["error"] for i, r in got.items() if r["error"]}
    assert errors == {"recorded_no_event": "conditioning_differs_from_record", "recorded_other": "conditioning_differs_from_record", "ranged_clash": "conditioning_differs_from_range", "ranged_unseen": "conditioning_observation_missing", "old_other": "conditioning_differs_from_record", "made_other": "conditioning_not_reconstructed", "unseen": "conditioning_observation_missing"}
    assert state["recorded"] == full and state["old"] == old
    assert state["ranged"]["cursorContext"] == state["ranged_old"]["cursorContext"] == {"captureStatus": "complete", "fieldState": "editable_text", "leftContext": "le", "rightContext": "ri", "schemaVersion": 2, "selectedText": "", "source": "accessibility_string_for_range"}
    assert state["ranged_short"]["cursorContext"]["captureStatus"] == "right_provider_no_value_after_minimum_probe" and state["ranged_short"]["cursorContext"]["rightContext"] == ""
    assert state["prompt"]["cursorContext"] == state["ranged"]["cursorContext"] | {"fieldState": "unpopulated_prompt", "leftContext": "", "rightContext": "", "surfacePrompt": "Do anything"}
    assert state["made"]["cursorContext"]["leftContext"] == "ab" and state["made"]["cursorContext"]["selectionStartCharacters"] == 2 and state["made"]["schemaVersion"] == 1
    # the query is canonical JSON of what a model may know
    assert json.loads(got["recorded"]["q"]) == {"clipboard": {"changeCount": 2, "content": "T", "contentWasTruncated": False}, "cursorContext": None, "destination": {"appName": "A"}, "kind": "write_conditioning_state", "schemaVersion": 3}
    assert json.loads(got["recorded"]["timed"])["capturedAt"] == "now"
    ranged = json.loads(got["ranged"]["q"])
    assert ranged["schemaVersion"] == 2 and ranged["cursorContext"] == {"fieldState": "editable_text", "leftContext": "le", "rightContext": "ri", "schemaVersion": 2, "selectedText": ""} and "processIdentifier" not in ranged["destination"]
    assert json.loads(got["old"]["q"])["cursorContext"] == {"leftContext": "l", "rightContext": "r"}
    for r in got.values():
        for q in (r["q"], r["timed"]):
            assert q is None or q == json.dumps(json.loads(q), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_exclusions_that_hang_on_the_cursor(spark, tmp_path):
    def stated(version, **cursor):
        return {"conditioningState": {"schemaVersion": version, "cursorContext": cursor}}

    whole = {"leftContext": "l", "selectedText": "", "rightContext": ""}
    long = "a sentence"
    records = [
        case("good", "abc", 1, f"a{long}bc", [(f"a{long}bc", 1.1, "m")], t=1, **stated(1, selectionStartCharacters=1)),
        case("ranged", "abc", 1, f"abc{long}", t=2, **stated(2, **whole)),
        case("ranged_part", "abc", 1, f"abc{long}", t=3, **stated(2, leftContext="l")),
        case("no_start", "abc", 1, f"abc{long}", t=4, **stated(1, leftContext="l")),
        case("unseen", "abc", 1, f"a{long}bc", t=5, **stated(1, selectionStartCharacters=1)),
        case("differs", "abc", 1, f"a{long}bc", [("abX", 5.1, "m")], t=6, **stated(1, selectionStartCharacters=1)),
        case("moved", "abc", 1, f"abc{long}", [("aXbc", 6.1, "m")], t=7, **stated(1, selectionStartCharacters=1)),
        case("other_start", "abc", 1, f"a{long}bc", [(f"a{long}bc", 7.1, "m")], t=8, **stated(1, selectionStartCharacters=2)),
        case("no_cursor", "abc", 99, f"a{long}bc", [(f"a{long}bc", 8.1, "m")], t=9, **stated(1, selectionStartCharacters=1)),
        case("short", "abc", 1, "aXbc", [("aXbc", 9.1, "m")], t=10, **stated(1, selectionStartCharacters=1)),
        case("pasted_short", "abc", 1, "aPbc", t=11, inputHints=["paste"], pasteCheckpoints=[{"checkpointID": "c", "axErrors": [], "clipboardSnapshotID": "s", "clipboardChangeCount": 1, "clipboardText": "P", "prePasteObservation": observation("abc"), "observation": observation("aPbc")}], conditioningState={"schemaVersion": 3, "cursorContext": whole, "clipboard": {"snapshotID": "s", "changeCount": 1}}),
    ]
    events, _ = reduce_journal(load(spark, tmp_path, records))
    names = {r["event_id"]: r["record_id"] for r in events.collect()}
    examples, exclusions, rejections = compiled.examples(events)
    assert {names[r["event_id"]]: r["reason"] for r in exclusions.collect()} == {
        "ranged_part": "missing_semantic_cursor_context", "no_start": "missing_initial_cursor_context", "unseen": "missing_earliest_observed_mutation", "differs": c.DIFFERS,
        "moved": "net_edit_offset_differs_from_initial_cursor", "other_start": "net_edit_offset_differs_from_initial_cursor", "no_cursor": "missing_cursor_fidelity", "short": "below_minimum_length",
    }
    made = {names[r["event_id"]]: r for r in examples.collect()}
    assert set(made) == {"good", "ranged", "pasted_short"} and rejections.count() == 0
    assert json.loads(made["ranged"]["query"])["cursorContext"] == whole and json.loads(made["pasted_short"]["query"])["schemaVersion"] == 3
    assert made["pasted_short"]["target"] == "<|paste|>"
