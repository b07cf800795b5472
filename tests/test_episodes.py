"""Episodes: each reason for parting, each way of going on, and each reason against a loss."""

import pandas as pd

from tidewell.operators import episodes

SECOND = 1_000_000
LONG = "a composition of more than six words and forty characters"
WRITE = {"session_id": "s", "kind": "write", "content": None, "app": "A", "bundle": "app", "window_title": "w", "role": "AXTextArea", "field_description": None, "field_label": None, "element": 5, "hints": ["typed"], "boundary_reason": "write_delay_elapsed"}


def write(i, t, before, after, **more):
    return WRITE | {"event_id": i, "sequence": t, "before_value": before, "after_value": after, "began_at": t * SECOND, "available_at": t * SECOND + SECOND // 2} | more


def read(i, t, content, **more):
    return WRITE | {"event_id": i, "kind": "read", "sequence": t, "content": content, "before_value": None, "after_value": None, "began_at": None, "available_at": t * SECOND} | more


def folded(*rows):
    out = episodes.fold_session(pd.DataFrame(list(rows)))
    return {r.event_id: (r.episode, r.joined_by, r.opened_by, r.closed_by) for r in out.itertuples()}


def parted(*rows):
    got = folded(*rows)
    return got["b"][2] if got["b"][0] == 2 else got["b"][1]


A = write("a", 10, "", LONG)
B = write("b", 20, LONG, LONG + " more")
PROMPT = {"bundle": "com.openai.codex"}


def test_each_reason_for_parting_and_going_on():
    assert parted(A, B) == "same_region"
    assert parted(A | {"boundary_reason": "return_pressed"}, B) == "prior_submission"
    assert parted(A | {"boundary_reason": "submission_boundary"}, B) == "prior_submission"
    assert parted(A | {"hints": ["typed", "return"]}, B) == "same_region" and parted(A | PROMPT | {"hints": ["typed", "return"]}, B | PROMPT) == "prior_submission"
    assert parted(A, read("r", 15, "something new"), B) == "novel_read"
    assert parted(read("r0", 5, "something new"), A, read("r", 15, "something new"), B) == "same_region"  # to be read before the episode began
    assert parted(A, read("r", 15, f"x {LONG.upper().replace(' ', '  ')} y"), B) == "same_region"  # shows the composition itself
    assert parted(A, read("r", 15, f"x {LONG} y", app="other"), B) == "novel_read"
    assert parted(A, read("r", 9, "x"), read("q", 21, "y"), B) == "same_region"  # not in between
    assert parted(A, B | {"window_title": "v"}) == "destination_changed"
    assert parted(A | {"field_description": "List, ⠋ busy"}, B | {"field_description": "List, ⠙  busy"}) == "same_region"
    assert parted(A, B | {"before_value": "other"}) == "state_discontinuity"
    assert parted(A, B | {"before_value": None}) == "state_discontinuity"
    far = write("a", 10, "x" * 60, "x" * 60 + LONG), write("b", 20, "x" * 60 + LONG, "y" + "x" * 60 + LONG)
    assert parted(*far) == "affected_region_changed" and parted(*(w | PROMPT for w in far)) == "same_region"
    frontier = write("a", 10, "", LONG + " ", boundary_reason="selection_navigation"), write("b", 20, LONG + " ", LONG + " and then")
    assert parted(*frontier) == "same_region" and parted(*(w | PROMPT for w in frontier)) == "affected_region_changed"
    anew = write("a", 10, "", "text"), write("b", 20, "", "other")
    assert parted(*anew) == "state_discontinuity" and parted(*(w | PROMPT for w in anew)) == "prompt_began_anew"
    revised = A | {"boundary_reason": "pointer_selection_boundary"}, write("b", 12, "b" + LONG, "bc" + LONG)
    assert parted(*revised) == "caret_revision" and parted(revised[0], revised[1] | {"element": 6}) == "state_discontinuity" and parted(revised[0], revised[1] | {"hints": ["paste"]}) == "state_discontinuity"
    assert folded(A, B | {"window_title": "v"}) == {"a": (1, "first", "session_start", "destination_changed"), "b": (2, "first", "destination_changed", "session_end")}
    assert folded(read("r", 1, "x")) == {}


def test_each_reason_against_a_loss(spark):
    state = '{"schemaVersion":3,"cursorContext":{"leftContext":"l","selectedText":"","rightContext":""}}'
    empty = {"conditioning": state.replace('"l"', '""')}
    other = lambda i, t: write(f"{i}-end", t + 3, "", "next", window_title="v")
    cases = {
        "kept": ([{}], None, "closed_persistent_region"),
        "open": ([{"last": True}], "composition_not_structurally_closed", "open_or_abandoned"),
        "gone": ([{"after_value": ""}], "no_surviving_output", "closed_persistent_region"),
        "short": ([{"after_value": "few words"}], "authored_content_below_substantive_threshold", "closed_persistent_region"),
        "short_return": ([{"after_value": "few words", "boundary_reason": "return_pressed"}], "authored_content_below_substantive_threshold", "closed_submission"),
        "sent": ([PROMPT | empty | {"after_value": "send", "boundary_reason": "return_pressed"}], None, "closed_submission"),
        "sent_short": ([PROMPT | empty | {"after_value": "ok ", "boundary_reason": "return_pressed"}], "authored_content_below_substantive_threshold", "closed_submission"),
        "late_onset": ([PROMPT | {"before_value": "half", "after_value": "half of it", "boundary_reason": "return_pressed"}], "prediction_time_onset_unavailable", "closed_submission"),
        "unstated": ([{"conditioning": None}], "prediction_time_onset_unavailable", "closed_persistent_region"),
        "address": ([{"after_value": "https://example.com/a"}], "instrumental_navigation_or_url", "closed_persistent_region"),
        "location": ([{"role": "AXTextField", "field_label": "Address bar"}], "instrumental_navigation_or_url", "closed_persistent_region"),
        "pasted": ([{"after_value": "P" * 80, "segments": [("paste", "P" * 80, "c")]}], "pure_paste_history_only", "closed_persistent_region"),
        "part_pasted": ([{"after_value": f"{LONG} PASTED", "segments": [("authored_text", LONG + " ", None), ("paste", "PASTED", "c")]}], None, "closed_persistent_region"),
        "mostly_pasted": ([{"after_value": "see " + "P" * 80, "segments": [("authored_text", "see ", None), ("paste", "P" * 80, "c")]}], "authored_content_below_substantive_threshold", "closed_persistent_region"),
        "unproven": ([{"authorship": "paste_checkpoint_missing"}], "paste_authorship_unresolved", "closed_persistent_region"),
    }
    rows = []
    for i, (changes, _, _) in cases.items():
        base = {"session_id": i, "conditioning": state, "segments": None, "authorship": None, "submitted_at": None, "ineligible": None}
        last = changes[0].pop("last", False)
        rows.append(write(i, 10, "", LONG) | base | changes[0])
        if not last:
            rows.append(other(i, 20) | base)
    names = {**episodes.NEEDS, "conditioning": "string", "segments": "array<struct<type:string,content:string,paste_id:string>>", "authorship": "string", "submitted_at": "long", "ineligible": "string"}
    events = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {k}" for c, k in names.items()))
    got = {r["members"][0]: (r["reason"], r["closure"], r["has_loss"]) for r in episodes.closed(events, episodes.fold(events)).collect()}
    assert {i: got[i] for i in cases} == {i: (why, how, why is None) for i, (_, why, how) in cases.items()}
