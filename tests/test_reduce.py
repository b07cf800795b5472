import hashlib
import json

from tidewell.operators import compile as compiled
from tidewell.operators import episodes, packing
from tidewell.operators.reduce import reduce_journal
from tidewell.plans import prequential
from tidewell.sources import journal


def at(s):
    return f"2024-01-01T00:00:{s:06.3f}Z"


def read(i, t, content, last=None, pid=1, title="w", **more):
    surface = {"displayID": 1, "windowID": 1, "windowTitle": title, "windowBounds": {"x": 0, "y": 0, "width": 800, "height": 600}, "appName": "App", "bundleIdentifier": "app", "processIdentifier": pid}
    return {"sessionID": "s", "recordType": "screen_ocr_observation", "recordID": i, "capturedAt": at(t), "lastActivityAt": at(t - 0.5 if last is None else last), "content": content, "windowTitle": title, "displayID": 1, "windowID": 1, "processIdentifier": pid, "appName": "App", "windowBounds": surface["windowBounds"], "triggerSurface": surface, "postCaptureSurface": surface, **more}


def write(i, t, end, before, after, reason="write_delay_elapsed", hints=("typed",), pid=1, **more):
    obs = lambda v: {"observationID": "o", "observedAt": at(t), "value": v, "valueWasTruncated": False}
    return {"sessionID": "s", "recordType": "active_tap_write_attempt", "recordID": i, "beganAt": at(t), "terminalDecisionAt": at(end), "inputEventCount": 3, "inputHints": list(hints), "boundaryReason": reason, "before": obs(before), "after": obs(after), "targetIdentity": {"processIdentifier": pid, "windowTitle": "w", "role": "AXTextArea", "elementHash": 5}, "tapTimeoutCountDuringBurst": 0, **more}


def closure(i, t, source, value, **more):
    seen = lambda v: {"observationID": "o", "value": v}
    base = {"sessionID": "s", "recordType": "prompt_submission_observation", "recordID": i, "observedAt": at(t), "sourceWriteRecordID": source, "terminalObservationID": "o", "terminalValueSHA256": hashlib.sha256(value.encode()).hexdigest(), "terminalCharacterCount": len(value), "disposition": "confirmed_field_cleared"}
    return base | {"referenceRetainedAt": at(t - 2), "action": {"kind": "unmodified_return", "observedAt": at(t - 1)}, "preActionObservation": seen(value), "preActionAXErrors": [], "postActionObservation": seen(""), "postActionAXErrors": []} | more


LONG = "the quick brown fox jumps over the lazy dog again"
RECORDS = [
    read("r1", 1, "alpha\nbeta"),
    read("r2", 2, "beta\ngamma\ngamma"),
    read("r3", 3, "beta\ngamma\ngamma"),
    write("w1", 4, 6, "", LONG),
    read("r4", 5, "other", last=3.9),
    read("r5", 5.5, f"x {LONG.upper()} y", last=5.4),
    read("r6", 7, "beta\ngamma"),
    write("w2", 8, 9, LONG, LONG + " and again", reason="pointer_selection_boundary"),
    write("w3", 10, 11, LONG + " and again", LONG + " and again!", reason="pointer_context_boundary"),
    write("w4", 12, 13, "a", "a"),
    write("w5", 14, 15, None, "secret", targetIdentity={"role": "AXSecureTextField", "processIdentifier": 1}),
    write("w6", 16, 17, "abc", "abcd", hints=("delete",)),
    write("w7", 18, 19, "", "ok"),
    closure("c1", 20, "w7", "ok"),
    closure("c2", 21, "w7", "ok"),
    {"sessionID": "s", "recordType": "write_sensor_health", "recordID": "h"},
    read("r7", 22, "", title="z"),
    read("r8", 23, "cut", contentWasTruncated=True),
]


def load(spark, tmp_path, records=RECORDS):
    (tmp_path / "raw.jsonl").write_text("\n\n".join(map(json.dumps, records)))
    return journal.read_journal(spark, str(tmp_path / "raw.jsonl"))


def test_reduce_gives_each_record_one_place(spark, tmp_path):
    j = load(spark, tmp_path)
    assert [r["line"] for r in j.orderBy("line").collect()] == list(range(1, len(RECORDS) + 1))
    events, rejected = reduce_journal(j)
    got = {r["record_id"]: r for r in events.collect()}
    why = {r["record_id"]: (r["reason"], r["by_write"]) for r in rejected.collect()}
    assert {k: got[k]["content"] for k in ("r1", "r2", "r6")} == {"r1": "alpha\nbeta", "r2": "gamma", "r6": "beta\ngamma"}
    assert why["r3"] == ("nothing_new_in_viewport", None) and why["r4"] == ("stale_read", "w1") and why["r5"] == ("shows_own_write", "w1")
    assert {k: why[k][0] for k in ("w4", "w5", "w6", "c2", "r7", "r8")} == {"w4": "empty_or_unreproduced_edit", "w5": "sensitive_field", "w6": "inserted_without_insertion", "c2": "duplicate_confirmed_closure_for_write", "r7": "empty_content", "r8": "truncated_content"}
    assert got["w7"]["boundary_reason"] == "submission_boundary" and got["w1"]["content"] == LONG
    assert set(got) | set(why) == {r["recordID"] for r in RECORDS} - {"h", "c1"} and not set(got) & set(why)
    shuffled, _ = reduce_journal(j.repartition(7))
    assert {(r["event_id"], r["content"], r["sequence"]) for r in shuffled.collect()} == {(r["event_id"], r["content"], r["sequence"]) for r in got.values()}


def test_examples_see_strictly_earlier_events(spark, tmp_path):
    events, _ = reduce_journal(load(spark, tmp_path))
    ex, exclusions, rejections = compiled.examples(events)
    rows = {r["target"]: r for r in ex.collect()}
    assert rows[LONG]["n_context"] == 2 and len(rows[LONG]["context_ids"]) == 2
    assert rows[LONG]["context"].count("\n") == 1 and rows[LONG]["model_input"].startswith(rows[LONG]["context"])
    assert rows[" and again"]["n_context"] == 4
    assert {r["reason"] for r in exclusions.collect()} == {"below_minimum_length"} and rejections.count() == 0


def test_episodes_join_what_goes_on(spark, tmp_path):
    events, _ = reduce_journal(load(spark, tmp_path))
    members = episodes.fold(events)
    closed = {tuple(len(m) for m in [r["members"]]) + (r["target"],): r for r in episodes.closed(events, members).collect()}
    by = {r["event_id"]: (r["episode"], r["joined_by"]) for r in members.collect()}
    names = {r["event_id"]: r["record_id"] for r in events.collect()}
    got = {names[k]: v for k, v in by.items() if k in names}
    assert got["w1"][0] != got["w2"][0] == got["w3"][0] != got["w7"][0]  # a novel read lies between w1 and w2
    assert got["w3"][1] == "same_region"
    assert (closed[(1, LONG)]["reason"], closed[(1, LONG)]["closed_by"]) == ("prediction_time_onset_unavailable", "novel_read")  # these records have no conditioning
    assert closed[(1, "ok")]["closure"] == "closed_submission"
    stateless = episodes.closed(events.drop("conditioning"), members).where("reason is null").collect()
    assert [r["target"] for r in stateless] == [LONG]
    order = events.selectExpr("session_id", "event_id", "sequence as place", "available_at")
    ctx = {r["target"]: r["context"] for r in episodes.episode_context(episodes.closed(events, members), members, order).collect()}
    assert len(ctx[LONG]) == 2 and len(ctx["ok"]) >= 4


def test_touching_regions():
    assert episodes.touches("ab", "aXb", "aXYb") and not episodes.touches("a" * 50, "X" + "a" * 50, "X" + "a" * 49 + "Z")


def test_gaps_redaction_and_blocks(spark):
    ev = spark.createDataFrame([("a", "e1", "read", 1, 10, None, "x", "w"), ("b", "e2", "write", 1, 30, 25, "hello", "w")], "session_id string, event_id string, kind string, line int, available_at long, began_at long, content string, window_title string")
    sessions = spark.createDataFrame([("a", 0), ("b", 1)], "session_id string, session_ordinal int")
    policy = spark.createDataFrame([("e1",)], "event_id string")
    blocks = compiled.corpus_blocks(ev, sessions, policy)
    rows = blocks.orderBy("position").collect()
    assert [(r["position"], r["block_type"]) for r in rows] == [(0, "event"), (1, "gap"), (2, "event")]
    assert rows[0]["serialized"] == compiled.REDACTED and len(rows[0]["source_sha256"]) == 64
    ctx = compiled.cross_session_context(compiled.contexts(ev), blocks, sessions).collect()
    assert [r["n_blocks"] for r in ctx] == [2]


def test_packing_keeps_the_newest_and_shifts(spark):
    blocks = spark.createDataFrame([("t", k, f"b{k}", "x" * n, 10) for k, n in enumerate([9, 8, 7])], "target string, place int, block_id string, text string, fixed int")
    from pyspark.sql import functions as F

    toks = packing.tokenized(blocks, "text")
    got = packing.packed_input(toks, ["target"], [F.col("place").desc()], ["place"], "fixed", 30)
    row = got.first()
    assert len(row["input_ids"]) == 20 and [(s["block_id"], s["end"] - s["start"], s["cut"]) for s in row["spans"]] == [("b0", 5, True), ("b1", 8, False), ("b2", 7, False)]
    seg = F.array(F.struct(F.lit("authored_text").alias("type"), F.array(F.lit(7), F.lit(8)).alias("tokens")), F.struct(F.lit("paste").alias("type"), F.array(F.lit(9)).alias("tokens")))
    out = packing.with_labels(got.withColumn("target_ids", packing.target_tokens(seg)))
    r = out.first()
    assert r["target_ids"] == [7, 8, packing.PASTE, packing.END] and r["labels"][:20] == [-100] * 20 and r["labels"][20:] == r["target_ids"]
    assert r["tokens_out"] == r["sequence_ids"][1:] and sum(r["weights"]) == 4 and r["weights"][18] == 0 and r["weights"][19] == 1
    assert {v["violations"] for v in packing.violations(out, 30).collect()} == {0}
    assert {v["rule"]: v["violations"] for v in packing.violations(out, 10).collect()}["input beyond the budget"] == 1
    assert packing.padded(out.union(out.withColumn("sequence_ids", F.slice("sequence_ids", 1, 3))).withColumn("b", F.lit(1)), "b").agg(F.min(F.size("padded"))).first()[0] == 24


def test_prequential_protocol(spark):
    ex = spark.createDataFrame([(f"e{k}", k // 3, "target text") for k in range(9)], "example_id string, block long, target string")
    scores, updates = prequential.run(ex, ["frozen", "own"], prequential.MockBackend(), "own")
    assert scores.count() == 12 and [r["seen"] for r in updates.orderBy("block").collect()] == [3, 6]
    bad = prequential.protocol_violations(scores, updates, ex, ["frozen", "own"], "own")
    assert {r["violations"] for r in bad.collect()} == {0}
    assert {r["rule"]: r["violations"] for r in prequential.protocol_violations(scores.limit(11), updates, ex, ["frozen", "own"], "own").collect()}["missing scores"] == 1


def test_journal_tools(spark, tmp_path):
    j = load(spark, tmp_path)
    ids = spark.createDataFrame([("r1",), ("none",)], "record_id string")
    assert journal.needed(j, ids).count() == 1 and [r[0] for r in journal.missing(j, ids).collect()] == ["none"]
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], "line int, k string, v int")
    kept, later = journal.recover(rows, ["k"], "line")
    assert {r["v"] for r in kept.collect()} == {5, 7} and [r["v"] for r in later.collect()] == [6]
    m = journal.manifest("x", {"t": rows}).first()
    assert m["n_rows"] == 3 and m["digest"] == journal.manifest("x", {"t": rows.repartition(5)}).first()["digest"]
    journal.write_jsonl(rows, str(tmp_path / "out"), ["line"])
    assert [json.loads(r["value"])["line"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [1, 2, 3]
    assert {r["digest"] for r in journal.file_digests(spark, str(tmp_path / "raw.jsonl")).collect()} == {hashlib.sha256((tmp_path / "raw.jsonl").read_bytes()).hexdigest()}


def test_viewports_belong_to_windows_not_titles(spark, tmp_path):
    a, b = {"windowID": 1, "displayID": 1}, {"windowID": 2, "displayID": 1}
    rows = [read("a1", 1, "alpha\nbeta", **a), read("b1", 2, "beta\ngamma", **b), read("a2", 3, "beta\ndelta", title="renamed", **a)]
    for r in rows:
        r["triggerSurface"] = r["postCaptureSurface"] = dict(r["triggerSurface"], windowID=r["windowID"])
    events, _ = reduce_journal(load(spark, tmp_path, rows))
    assert {r["record_id"]: r["content"] for r in events.collect()} == {"a1": "alpha\nbeta", "b1": "beta\ngamma", "a2": "delta"}


def test_shortcuts_between_changes_are_not_observed(spark, tmp_path):
    event = lambda hint: {"hint": hint, "mutationCapable": hint != "shortcut"}
    cases = {"mid": ["character", "shortcut", "character"], "end": ["character", "shortcut"], "start": ["shortcut", "character"], "none": ["character"], "empty": []}
    rows = [write(k, 10 * i + 1, 10 * i + 2, "", f"text {k}", hints=("character",), inputEvents=[event(h) for h in v]) for i, (k, v) in enumerate(cases.items())]
    rows.append(write("old", 55, 56, "", "text old", hints=("shortcut", "character")))
    events, rejected = reduce_journal(load(spark, tmp_path, [r for r in rows if float(r["beganAt"][17:23]) < 60]))
    assert {r["record_id"]: r["reason"] for r in rejected.collect()} == {"mid": "unobserved_shortcut"}
    assert {r["record_id"] for r in events.collect()} == {"end", "start", "none", "empty", "old"}


def test_journal_is_numbered_over_splits(spark, tmp_path):
    for name, n in (("one", 900), ("two", 3)):
        (tmp_path / f"{name}.jsonl").write_text("\r\n".join(json.dumps({"sessionID": name, "recordType": "x", "k": k, "pad": "y" * (k % 90)}) + "\n" * (k % 3) for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = journal.read_journal(spark, str(tmp_path / "*.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["session_id"], r["line"], json.loads(r["raw"])["k"] + 1) for r in rows) == sorted((s, k + 1, k + 1) for s, n in (("one", 900), ("two", 3)) for k in range(n))


def test_pastes_are_marks_in_targets(spark, tmp_path):
    state = lambda v: {"observationID": "o", "observedAt": at(1), "value": v}
    paste = lambda i, was, clip, now: {"checkpointID": i, "eventTimestampNanoseconds": 5, "clipboardSnapshotID": "s", "clipboardChangeCount": 1, "clipboardText": clip, "prePasteObservation": state(was), "observation": state(now)}
    known = {"hints": ("paste", "typed"), "conditioningState": {"schemaVersion": 3, "cursorContext": {"leftContext": "", "selectedText": "", "rightContext": ""}, "clipboard": {"snapshotID": "s", "changeCount": 1}}}
    rows = [
        write("kept", 1, 2, "", "see LINK here", pasteCheckpoints=[paste("p1", "see ", "LINK", "see LINK")], **known),
        write("lost", 3, 4, "", "see LXNK here", pasteCheckpoints=[paste("p2", "see ", "LINK", "see LINK")], **known),
        write("other", 5, 6, "", "plain text", pasteCheckpoints=[paste("p3", "a", "LINK", "something else")], **known),
    ]
    events, _ = reduce_journal(load(spark, tmp_path, rows))
    got = {r["record_id"]: r for r in events.collect()}
    assert [(s["type"], s["content"]) for s in got["kept"]["segments"]] == [("authored_text", "see "), ("paste", "LINK"), ("authored_text", " here")]
    assert (got["lost"]["authorship"], got["kept"]["authorship"], got["other"]["authorship"]) == ("paste_span_not_preserved", None, "unproven_ax_epoch_transition")
    ex, exclusions, _ = compiled.examples(events)
    assert {r["target"] for r in ex.collect()} == {"see <|paste|> here"}
    assert [r["reason"] for r in exclusions.collect()] == ["authorship_unresolved"] * 2
