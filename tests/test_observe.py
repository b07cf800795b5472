"""The choice of observation: each reason reached, and a pure-Python reading of the rule on random records."""

import json
import random

from tests.test_reduce import at, load, write
from tidewell.operators.reduce import reduce_journal, write_candidates


def point(i, t, value, seen=None, errors=(), **more):
    return {"checkpointID": i, "eventTimestampNanoseconds": t, "axErrors": list(errors), "observation": {"observationID": i, "observedAt": at(seen if seen is not None else 1 + t / 100), "value": value, **more}}


def case(i, before, after, **more):
    return write(i, 1, 2, before, after, hints=more.pop("hints", ("character",)), **{"lastEventTimestampNanoseconds": 50, "lastInputAt": at(1.5), **more})


WALK = ["x" * 300 + "a" * k for k in (1, 5, 9)]
CASES = {
    "immediate_terminal_return": (case("c1", "", "gone", boundaryReason="return_pressed", returnCheckpoints=[point("p", 50, "sent")]), "sent"),
    "terminal_invalid": (case("c2", "", "x", afterAXErrors=["e"], mutationCheckpoints=[point("p", 10, "typed a"), point("q", 40, "typed ab"), point("r", 60, "too late")]), "typed ab"),
    "terminal_does_not_preserve_pre_return": (case("c3", "", "other text", returnCheckpoints=[point("p", 50, "what I wrote")]), "what I wrote"),
    "terminal_ax_epoch_discontinuity": (case("c4", "x" * 300, "z" * 700, mutationCheckpoints=[point(f"m{k}", 30 + 10 * k, v, seen=1.6 + k / 10) for k, v in enumerate(WALK)]), WALK[-1]),
    "cut_post_input_checkpoint": (case("c5", "long text here", "long text here", hints=("cut",), mutationCheckpoints=[point("p", 50, "long")]), "long"),
    "terminal_matches_before": (case("c6", "same", "same", hints=("paste",), pasteCheckpoints=[point("p", 50, "same pasted")]), "same pasted"),
    "terminal_unpopulated": (case("c7", "abc", " \n", mutationCheckpoints=[point("p", 50, "abcdef")]), "abcdef"),
    "terminal_observation": (case("c8", "abc", "abcd", mutationCheckpoints=[point("p", 50, "abcdef")]), "abcd"),
    None: (case("c9", "abc", "abc", mutationCheckpoints=[point("p", 50, "abcdef")]), None),
}


def test_each_reason_once(spark, tmp_path):
    rows = write_candidates(load(spark, tmp_path, [r for r, _ in CASES.values()])).collect()
    got = {r["record_id"]: (r["observed_because"], r["after_value"]) for r in rows}
    assert got == {r["recordID"]: (why, value) for why, (r, value) in CASES.items()}
    events, rejected = reduce_journal(load(spark, tmp_path, [r for r, _ in CASES.values()]))
    assert {r["record_id"]: r["content"] for r in events.collect()}["c6"] == " pasted"
    assert {r["record_id"]: r["reason"] for r in rejected.collect()}["c9"] == "no_observation"


def plainly(r):
    """The rule once more, on a record of small values (no jump is large enough)."""
    before, last = r["before"]["value"], r["lastEventTimestampNanoseconds"]

    def fit(p):
        return not p["axErrors"] and not p["observation"].get("valueWasTruncated") and p["observation"]["value"] not in (None, before)

    best = None
    for name, weight in (("returnCheckpoints", 3), ("pasteCheckpoints", 2), ("mutationCheckpoints", 1)):
        for p in r.get(name, []):
            key = (p["eventTimestampNanoseconds"], weight)
            if fit(p) and key[0] <= last and (best is None or key > best[0]):
                best = (key, p["observation"]["value"], name)
    ret = r.get("returnCheckpoints", [])[-1:]
    sent = ret[0]["observation"]["value"] if ret and fit(ret[0]) else None
    if r["boundaryReason"] == "return_pressed":
        return sent
    if r["after"] is None or r.get("afterAXErrors"):
        return best and best[1]
    seen = r["after"]["value"]
    if seen is None or r["after"].get("valueWasTruncated"):
        return None
    if sent is not None and ret[0]["eventTimestampNanoseconds"] == last and sent not in seen:
        return sent
    if set(r["inputHints"]) <= {"cut", "navigation"} and "cut" in r["inputHints"]:
        left = [p["observation"]["value"] for p in r.get("mutationCheckpoints", []) if fit(p) and p["eventTimestampNanoseconds"] == last and len(p["observation"]["value"]) < len(before)]
        if left:
            return left[-1]
    if seen == before and best:
        return best[1] if best[2] != "mutationCheckpoints" else None
    if not seen.strip() and best:
        return best[1]
    return seen


def test_random_records_against_a_plain_reading(spark, tmp_path):
    r = random.Random(7)
    value = lambda: r.choice(["", "a", "ab", "abc", "b", " ", None])
    some = lambda: [point(f"p{k}", r.choice([10, 40, 50, 60]), value(), errors=["e"] * (r.random() < 0.1), valueWasTruncated=r.random() < 0.1) for k in range(r.randint(0, 3))]
    rows = []
    for k in range(250):
        more = {name: some() for name in ("returnCheckpoints", "pasteCheckpoints", "mutationCheckpoints") if r.random() < 0.6}
        row = case(f"r{k}", r.choice(["", "a", "ab"]), value(), hints=r.choice([("cut",), ("cut", "navigation"), ("character",)]), boundaryReason=r.choice(["write_delay_elapsed", "return_pressed"]), afterAXErrors=["e"] * (r.random() < 0.15), **more)
        row["after"]["valueWasTruncated"] = r.random() < 0.1
        if r.random() < 0.1:
            row["after"] = None
        rows.append(row)
    got = {x["record_id"]: x["after_value"] for x in write_candidates(load(spark, tmp_path, json.loads(json.dumps(rows)))).collect()}
    assert got == {x["recordID"]: plainly(x) for x in rows}
