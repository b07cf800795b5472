"""Typed and pasted text: a record for each rule and each reason, and the reasons of the write cascade."""

from tests.test_grounding import point, record
from tests.test_reduce import at, load
from tidewell.operators.reduce import reduce_journal, write_candidates

CLIP = {"schemaVersion": 3, "clipboard": {"snapshotID": "s1", "changeCount": 7, "textWasTruncated": False, "text": "PASTED"}}


def seen(i, t, value, **more):
    return {"observationID": i, "observedAt": at(t), "value": value, **more}


def paste(before, after, t=10, clip="PASTED", **more):
    base = {"checkpointID": f"c{t}", "eventTimestampNanoseconds": t, "axErrors": [], "prePasteAXErrors": [], "clipboardSnapshotID": "s1", "clipboardChangeCount": 7, "clipboardText": clip, "clipboardTextWasTruncated": False}
    return base | {"prePasteObservation": seen(f"pre{t}", 1 + t / 100, before), "observation": seen(f"post{t}", 1.01 + t / 100, after)} | more


def inputs(*hints, t=11):
    return [{"hint": h, "mutationCapable": True, "eventTimestampNanoseconds": t} for h in hints]


def case(before, after, pastes=None, hints=("paste", "typed"), state=CLIP, **more):
    return dict(before=before, after=after, hints=hints, state=state, pasteCheckpoints=pastes or [], **more)


A, P = lambda x: ("authored_text", x, None), lambda x, i="c10": ("paste", x, i)
KEPT = lambda x: [("unresolved_paste_transition", x, None)]
ONE = [paste("ab", "aPASTEDb")]
#: name: (record, (segments, completion, why unresolved, evidence))
CASES = {
    "typed": (case("a", "ab", hints=("typed",)), ([A("b")], "b", None, None)),
    "cut": (case("abcd", "ad", hints=("cut", "navigation")), ([], "", None, "cut_only_no_authored_content")),
    "missing": (case("a", "ab"), (KEPT("b"), "b", "paste_checkpoint_missing", "complete_before_selected_observation_minimal_diff")),
    "unconditioned": (case("ab", "aPASTEDb", ONE, state={"schemaVersion": 3}), (KEPT("PASTED"), "PASTED", "conditioning_clipboard_missing", "complete_before_selected_observation_minimal_diff")),
    "cut_clipboard": (case("ab", "aPASTEDb", ONE, state={"clipboard": CLIP["clipboard"] | {"textWasTruncated": True}}), (KEPT("PASTED"), "PASTED", "conditioning_clipboard_missing", "complete_before_selected_observation_minimal_diff")),
    "changed": (case("ab", "aPASTEDb", [paste("ab", "aPASTEDb", clipboardChangeCount=8)]), (KEPT("PASTED"), "PASTED", "clipboard_changed_after_conditioning", "complete_before_selected_observation_minimal_diff")),
    "incomplete": (case("ab", "aPASTEDb", [paste("ab", "aPASTEDb", axErrors=["e"])]), (KEPT("PASTED"), "PASTED", "paste_checkpoint_incomplete", "complete_before_selected_observation_minimal_diff")),
    "first_failure": (case("ab", "aPASTEDb", [paste("ab", "aPASTEDb", clipboardText=""), paste("ab", "aPASTEDb", 20, clipboardChangeCount=9)]), (KEPT("PASTED"), "PASTED", "paste_checkpoint_incomplete", "complete_before_selected_observation_minimal_diff")),
    "global": (case("ab", "axPASTEDyb", [paste("axb", "axPASTEDb")]), ([A("x"), P("PASTED"), A("y")], "xPASTEDy", None, "grounded_clipboard_transition")),
    "two": (case("", "PASTED PASTED", [paste("", "PASTED"), paste("PASTED ", "PASTED PASTED", 20)]), ([P("PASTED"), A(" "), P("PASTED", "c20")], "PASTED PASTED", None, "grounded_clipboard_transition")),
    "not_preserved": (case("ab", "aPASTb", [paste("ab", "aPASTEDb")]), (KEPT("PAST"), "PAST", "paste_span_not_preserved", "complete_before_selected_observation_minimal_diff")),
    "overlap": (case("", "PASTED", [paste("", "PASTED"), paste("", "PASTED", 20)]), (KEPT("PASTED"), "PASTED", "paste_spans_overlap", "complete_before_selected_observation_minimal_diff")),
    # the checkpoint still shows the field as before; a later observation has the paste
    "delayed": (case("ab", "aPASTED\nb", [paste("ab", "ab")], mutationCheckpoints=[point(5, "a?b"), point(30, "a PASTED b")]), ([P(" PASTED ")], " PASTED ", None, "grounded_delayed_paste_observation")),
    "delayed_end": (case("ab", "aPASTEDb", [paste("ab", "ab")], inputEvents=inputs("navigation", "return")), ([P("PASTED")], "PASTED", None, "grounded_delayed_paste_observation")),
    "typed_after": (case("ab", "aPASTEDxb", [paste("ab", "ab")], inputEvents=inputs("typed")), (KEPT("PASTEDx"), "PASTEDx", "unproven_ax_epoch_transition", "complete_before_selected_observation_minimal_diff")),
    "deleted_after": (case("ab", "aPASTEDxb", [paste("ab", "ab")], inputEvents=inputs("delete")), (KEPT("PASTEDx"), "PASTEDx", "post_paste_edit_may_modify_payload", "complete_before_selected_observation_minimal_diff")),
    "several": (case("ab", "aPASTEDb", [paste("ab", "ab"), paste("ab", "aPASTEDb", 20)]), (KEPT("PASTED"), "PASTED", "paste_transition_does_not_match_clipboard", "complete_before_selected_observation_minimal_diff")),
    # after the paste the field starts anew and empty
    "epoch": (case("q", "then", [paste("q so ", "", clip="PAYLOAD")], inputEvents=inputs("typed")), ([A(" so "), P("PAYLOAD"), A("then")], " so PAYLOADthen", None, "grounded_paste_ax_epoch_transition")),
    "epoch_shown": (case("q", "PAYLOAD then", [paste("q so ", "", clip="PAYLOAD")], inputEvents=inputs("typed")), (KEPT("PAYLOAD then"), "PAYLOAD then", "unproven_ax_epoch_transition", "complete_before_selected_observation_minimal_diff")),
    "marks": (case("x", "xone\n​\n-\n​ two", hints=("typed", "return"), bundleIdentifier="md.obsidian"), ([A("one\ntwo")], "one\ntwo", None, "obsidian_list_scaffold_normalized_v1")),
}


def journal(spark, tmp_path, cases):
    return load(spark, tmp_path, [record(k, **v) for k, v in cases.items()])


REJECTED = {
    "tap_timeout_during_burst": case("a", "ab", hints=("typed",), tapTimeoutCountDuringBurst=1),
    "sensitive_field": case("a", "ab", hints=("typed",), state={"destination": {"fieldLabel": "Security code"}}),
    "before_missing": case(None, "ab", hints=("typed",)),
    "before_error": case("a", "ab", hints=("typed",), beforeAXErrors=["e"]),
    "no_observation": case("a", None, hints=("typed",)),
    "cut_did_not_contract": case("a", "ab", hints=("cut", "navigation")),
    "empty_or_unreproduced_edit": case("a", "a", hints=("typed",)),
    "inserted_without_insertion": case("a", "ab", hints=("delete", "navigation")),
    "formatting_change": case("a sentence of some length", "**a sentence of some length**", hints=("typed",)),
    "application_generated_zero_width_scaffold": case("a", "a​b", hints=("typed",)),
    "paste_checkpoint_incomplete": case("ab", "aPASTEDb", [paste("ab", "aPASTEDb", axErrors=["e"])], hints=("typed",)),
    "began_at_missing": case("a", "ab", hints=("typed",), beganAt=None),
}


PASSED = {"kept_format": case("a sentence of some length", "**a sentence of some length**", hints=("paste",)), "removed": case("abc", "ac", hints=("delete", "navigation")), "cut_away": case("abc", "ac", hints=("cut", "navigation"))}


def test_each_rule_and_each_reason(spark, tmp_path):
    rows = write_candidates(journal(spark, tmp_path, {k: v for k, (v, _) in CASES.items()} | REJECTED | PASSED)).collect()
    got = {r["record_id"]: ([tuple(s) for s in r["segments"]], r["content"], r["authorship"], r["evidence"]) for r in rows if r["record_id"] in CASES}
    assert got == {k: want for k, (_, want) in CASES.items()}
    assert {r["record_id"]: r["reason"] for r in rows} == dict.fromkeys(CASES) | {k: k for k in REJECTED} | dict.fromkeys(PASSED)


def test_unresolved_pastes_stay_in_history(spark, tmp_path):
    events, rejected = reduce_journal(journal(spark, tmp_path, {k: CASES[k][0] for k in ("missing", "epoch", "cut")}))
    got = {r["record_id"]: (r["content"], r["authorship"], r["continuity"]) for r in events.collect()}
    assert got == {"missing": ("b", "paste_checkpoint_missing", "observed_document_transition_unresolved_authorship"), "epoch": (" so PAYLOADthen", None, "segmented_at_grounded_paste"), "cut": ("", None, "single_ax_epoch")}
    assert rejected.count() == 0
