"""Edits grounded by checkpoints: random edit sequences against a replay with a tag for each character, and the cascade on records."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_reduce import at, load, write
from tidewell.operators import grounding
from tidewell.operators.reduce import write_candidates


def tagged(before, after, states, caret):
    """The same rule with one tag a character: which characters of the first text are left, and which places are new."""
    lead, out, put = grounding.sizes(before, after)
    wanted = [o for o in range(len(before) - out + 1) if before[:o] + after[o : o + put] + before[o + out :] == after]
    if len(wanted) < 2 or wanted[-1] - wanted[0] > grounding.SLIDE:
        return None
    cells, now, used = [(c, k) for k, c in enumerate(before)], before, 0
    for state in [*states, after]:
        if state == now:
            continue
        _, r, i = grounding.sizes(now, state)
        options = [o for o in range(len(now) - r + 1) if now[:o] + state[o : o + i] + now[o + r :] == state]
        if len(options) > 1:
            if caret is None:
                return None
            best = min(min(abs(o - caret), abs(o + r - caret)) for o in options)
            options = [o for o in options if min(abs(o - caret), abs(o + r - caret)) == best]
            if len(options) > 1:
                return None
        o = options[0]
        cells[o : o + r] = [(c, None) for c in state[o : o + i]]
        now, caret, used = state, o + i, used + 1
    missing = set(range(len(before))) - {k for _, k in cells if k is not None}
    new = {k for k, (_, tag) in enumerate(cells) if tag is None}
    proven = [o for o in wanted if set(range(o, o + out)) == missing and set(range(o, o + put)) == new]
    if len(proven) != 1 or proven[0] == lead:
        return None
    lo, hi = sorted((lead, proven[0]))
    return None if any(c in grounding.STRUCTURAL for c in before[lo:hi] + after[lo:hi]) else (proven[0], used)


@settings(max_examples=400, deadline=None)
@given(st.text("ab\n", max_size=9), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 3), st.text("ab\n", max_size=3)), min_size=1, max_size=4), st.one_of(st.none(), st.integers(0, 9)))
def test_runs_agree_with_tags(before, edits, caret):
    states, now = [], before
    for place, n, put in edits:
        place = min(place, len(now))
        now = now[:place] + put + now[place + n :]
        states.append(now)
    got = grounding.grounded(before, now, states[:-1], caret)
    assert got == tagged(before, now, states[:-1], caret)


def test_many_random_sequences_and_some_are_grounded():
    r, found = random.Random(6), 0
    for _ in range(3000):
        before = "".join(r.choice("aab") for _ in range(r.randint(0, 8)))
        caret = r.randint(0, len(before))
        states, now, here = [], before, caret
        for _ in range(r.randint(1, 4)):
            put = "".join(r.choice("ab") for _ in range(r.randint(1, 2)))
            now, here = now[:here] + put + now[here:], here + len(put)
            states.append(now)
        got = grounding.grounded(before, now, states, caret)
        assert got == tagged(before, now, states, caret)
        if got:
            found += 1
            assert before[: got[0]] + now[got[0] : got[0] + len(now) - len(before)] + before[got[0] :] == now and got[0] == caret
    assert found > 300


def test_places_are_bounded_and_splices_keep_sizes():
    assert len(grounding.places("a" * 3000, "a" * 3001, 0, 1)) == 1 and len(grounding.places("a" * 1000, "a" * 1001, 0, 1)) == 1001
    runs = grounding.spliced([(0, 5)], 2, 2, 3)
    assert runs == [(0, 2), (None, 3), (4, 1)] and grounding.net_edit(runs, 5) == ((2, 4), (2, 5))
    assert grounding.net_edit([(1, 1), (3, 1)], 5) is None and grounding.net_edit([], 0) == (None, None)
    assert grounding.net_edit([(None, 1), (None, 2), (0, 2)], 2) == (None, (0, 3))


def point(t, value, **more):
    return {"checkpointID": f"p{t}", "eventTimestampNanoseconds": t, "axErrors": [], "observation": {"observationID": f"o{t}", "observedAt": at(1 + t / 100), "value": value, **more}}


def cursor(**more):
    return {"schemaVersion": 2, "cursorContext": {"source": "accessibility_string_for_range", "captureStatus": "complete", "leftContext": "l", "selectedText": "", "rightContext": "r", **more}}


def record(i, before, after, begin=None, n=0, state=None, probe=True, **more):
    r = write(i, 1, 2, before, after, **more)
    r["before"] |= {"selectedRangeLocation": begin, "selectedRangeLength": n} | ({"axRangeCursorProbe": {"errors": []}} if probe else {})
    r["after"]["observationID"], r["after"]["observedAt"] = "end", at(1.9)
    return r | ({"conditioningState": state} if state else {})


CANONICAL, EQUIVALENT, REPLACEMENT = grounding.CANONICAL, grounding.EQUIVALENT, grounding.REPLACEMENT
RECORDS = {
    # "aaa" gets an "a" at its caret; without proof it stands at the end
    "moved": (record("moved", "aaa", "aaaa", 1, state=cursor(), mutationCheckpoints=[point(10, "aaaa")]), (1, "", "a", EQUIVALENT, 1)),
    "no_probe": (record("no_probe", "aaa", "aaaa", 1, state=cursor(), probe=False, mutationCheckpoints=[point(10, "aaaa")]), (3, "", "a", CANONICAL, 0)),
    "no_source": (record("no_source", "aaa", "aaaa", 1, state=cursor(source="guess"), mutationCheckpoints=[point(10, "aaaa")]), (3, "", "a", CANONICAL, 0)),
    "no_points": (record("no_points", "aaa", "aaaa", 1, state=cursor()), (3, "", "a", CANONICAL, 0)),
    "across_lines": (record("across_lines", "\n\n", "\n\n\n", 0, state=cursor(), mutationCheckpoints=[point(10, "\n\n\n")]), (2, "", "\n", CANONICAL, 0)),
    "surrogates": (record("surrogates", "🙂aa", "🙂aaa", 2, state=cursor(), mutationCheckpoints=[point(10, "🙂aaa")]), (1, "", "a", EQUIVALENT, 1)),
    "late_points": (record("late_points", "aaa", "aaaa", 1, state=cursor(), mutationCheckpoints=[point(10, "aaaa"), point(99, "zzz")]), (1, "", "a", EQUIVALENT, 1)),
    # a selection that shares its ends with what replaced it
    "selected": (record("selected", "say hello now", "say help now", 4, 5, mutationCheckpoints=[point(10, "say hel now"), point(20, "say help now")]), (4, "hello", "help", REPLACEMENT, 2)),
    "not_reached": (record("not_reached", "say hello now", "say help now", 4, 5, mutationCheckpoints=[point(10, "say hel now")]), (7, "lo", "p", CANONICAL, 0)),
    "not_typed": (record("not_typed", "say hello now", "say help now", 4, 5, hints=("typed", "undo_redo"), mutationCheckpoints=[point(20, "say help now")]), (7, "lo", "p", CANONICAL, 0)),
    "elsewhere": (record("elsewhere", "say hello now", "say help now", 0, 3, mutationCheckpoints=[point(20, "say help now")]), (7, "lo", "p", CANONICAL, 0)),
    "prompt": (record("prompt", "Ask me", "Ask him", state=cursor(fieldState="unpopulated_prompt", leftContext="", rightContext=""), mutationCheckpoints=[point(20, "Ask him")]), (0, "Ask me", "Ask him", REPLACEMENT, 1)),
}


def test_writes_take_the_grounded_edit(spark, tmp_path):
    rows = write_candidates(load(spark, tmp_path, [r for r, _ in RECORDS.values()])).collect()
    assert {r["record_id"]: (r["offset"], r["removed"], r["inserted"], r["alignment"], r["alignment_states"]) for r in rows} == {k: want for k, (_, want) in RECORDS.items()}
    assert {r["reason"] for r in rows} == {None}
    assert {r["record_id"]: r["content"] for r in rows}["selected"] == "help"
