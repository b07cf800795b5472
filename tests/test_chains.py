"""Chains of write attempts against a plain loop over random journals of several sessions."""

import json
import random

from pyspark.sql import functions as F

from tests.test_reduce import at
from tidewell.operators import chains
from tidewell.operators.conditioning import CONDITIONING
from tidewell.operators.reduce import reduce_journal
from tidewell.sources import journal


def observation(value, location=None, length=0, **more):
    return {"observationID": "o", "observedAt": at(1), "value": value, "selectedRangeLocation": len(value.encode("utf-16-le")) // 2 if location is None else location, "selectedRangeLength": length, **more}


def attempt(session, i, began, before, after, **more):
    base = {"sessionID": session, "recordType": "active_tap_write_attempt", "recordID": i, "beganAt": at(began), "lastInputAt": at(began + 0.2), "terminalDecisionAt": at(began + 0.3), "inputEventCount": 1, "inputHints": ["typed"], "boundaryReason": "write_delay_elapsed"}
    return base | {"processIdentifier": 1, "before": observation(before), "after": observation(after), "targetIdentity": {"elementHash": 5, "processIdentifier": 1, "windowTitle": "w", "role": "AXTextArea"}} | more


def load(spark, folder, records):
    for session in {r["sessionID"] for r in records}:
        (folder / f"{session}.jsonl").write_text("\n".join(json.dumps(r) for r in records if r["sessionID"] == session))
    return journal.read_journal(spark, str(folder / "*.jsonl"))


def rows(spark, folder, records):
    return journal.records(load(spark, folder, records), "active_tap_write_attempt").withColumn("state", F.from_json("conditioningState", CONDITIONING))


def random_starts(seed, n=300):
    r, out = random.Random(seed), []
    for s in "ab":
        t = 0.0
        for k in range(n):
            t += r.choice([0.05, 0.1, 0.1, 0.2, 0.4])
            kind = {"boundaryReason": r.choice(["target_changed"] * 14 + ["write_delay_elapsed"]), "inputHints": r.choice([["typed"]] * 14 + [["typed", "delete"], []]), "inputEventCount": r.choice([1, 1, 1, 1, 1, 2, 3, 0]), "processIdentifier": r.choice([1] * 19 + [2]), "bundleIdentifier": r.choice(["app"] * 19 + ["other", None])}
            before = "x" * r.choice([0, 1, 2, 3, 4]) if r.random() < 0.9 else "🙂"
            more = {"mutationCheckpoints": [{"axErrors": [], "observation": observation(before + r.choice(["y", "", "yy"]))}]} if r.random() < 0.9 else {}
            a = attempt(s, f"{s}{k}", t, before, before + "z", **kind, **more)
            a["targetIdentity"]["windowTitle"] = r.choice(["w"] * 19 + ["v", None])
            if r.random() < 0.05:
                a["recordID"] = None
            out.append(a)
    return out


def loop_starts(records):
    """The walk back, attempt by attempt."""
    found = {}
    units = lambda v: len(v.encode("utf-16-le")) // 2
    for session in {x["sessionID"] for x in records}:
        own = [x for x in records if x["sessionID"] == session]
        for k in range(1, len(own)):
            now = own[k]
            was, points = now["before"]["value"], now.get("mutationCheckpoints")
            if not was or now["recordID"] is None or not points or now["before"]["selectedRangeLength"] or now["before"]["selectedRangeLocation"] != units(was):
                continue
            seen = points[0]["observation"]["value"]
            if not seen.startswith(was) or len(seen) <= len(was):
                continue
            ids, total, j = [], 0, k - 1
            while j >= 0:
                p = own[j]
                titles = {p["targetIdentity"]["windowTitle"], now["targetIdentity"]["windowTitle"]} - {None}
                begun = [float(x["beganAt"][17:-1]) + 60 * int(x["beganAt"][14:16]) for x in (p, now)]
                if p["boundaryReason"] != "target_changed" or not set(p["inputHints"]) <= {"typed"} or p["inputEventCount"] < 1 or p["bundleIdentifier"] != now["bundleIdentifier"] or p["processIdentifier"] != now["processIdentifier"] or not 0 <= round(begun[1] - begun[0], 6) <= 1 or p["recordID"] is None or len(titles) > 1:
                    break
                ids.insert(0, p["recordID"])
                total += p["inputEventCount"]
                if total >= len(was):
                    break
                j -= 1
            if total == len(was) and ids:
                found[session, now["recordID"]] = ids
    return found


def test_fast_starts_equal_a_loop(spark, tmp_path):
    records = [x for x in random_starts(2) if float(x["beganAt"][17:-1]) < 60]
    got = chains.fast_starts(rows(spark, tmp_path, records))
    ids = {(s, line): [x["recordID"] for x in records if x["sessionID"] == s][line - 1] for s in "ab" for line in range(1, 1 + sum(x["sessionID"] == s for x in records))}
    found = {(r["session_id"], ids[r["session_id"], r["line"]]): r["before_ids"] for r in got.collect()}
    wanted = loop_starts(records)
    assert found == wanted and len(wanted) > 3 and max(map(len, wanted.values())) > 1


def random_chains(seed, n=60):
    r, out = random.Random(seed), []
    for s in "ab":
        t, value = 0.0, "a"
        for k in range(n):
            t += r.choice([0.3, 0.5, 4.0])
            now = value + r.choice(["", "", "bc", "🙂"])
            more = {"boundaryReason": r.choice(["selection_navigation"] * 4 + ["write_delay_elapsed"]), "inputHints": r.choice([["typed"]] * 5 + [["typed", "cut"], ["navigation"], []]), "inputEvents": [{"hint": f"e{k}"}], "inputEventCount": k % 3}
            if r.random() < 0.3:
                more["conditioningState"] = {"clipboard": {"changeCount": r.choice([1, 1, 2]), "textSHA256": "h", "textWasTruncated": False}}
            if r.random() < 0.2:
                more["configuredWriteDelaySeconds"] = 0.1
            after = now + r.choice(["d", ""])
            out.append(attempt(s, f"{s}{k}" if r.random() > 0.04 else None, t, now, after, **more))
            out[-1]["before"]["selectedRangeLocation"] -= r.choice([0] * 8 + [1])
            value = after if r.random() < 0.9 else "zz"
    return out


def loop_chains(records):
    out = []
    clip = lambda x: (x.get("conditioningState") or {}).get("clipboard")
    for session in "ab":
        own, k = sorted((x for x in records if x["sessionID"] == session), key=lambda x: x["beganAt"]), 0
        while k < len(own):
            end = k
            while end + 1 < len(own):
                a, b = own[end], own[end + 1]
                was, now = a["after"], b["before"]
                pause = float(b["beganAt"][17:-1]) - float(a["lastInputAt"][17:-1])
                ok = a["boundaryReason"] == "selection_navigation" and a["inputHints"] and b["inputHints"] and clip(a) == clip(b) and -1e-9 <= pause <= a.get("configuredWriteDelaySeconds", 3) + 1e-9
                same = (was["value"], was["selectedRangeLocation"], was["selectedRangeLength"]) == (now["value"], now["selectedRangeLocation"], now["selectedRangeLength"])
                units = lambda v: len(v.encode("utf-16-le")) // 2
                grown = set(a["inputHints"]) <= {"typed"} and "typed" in b["inputHints"] and not {"cut", "delete", "paste", "undo_redo"} & set(b["inputHints"]) and was["value"] and len(now["value"]) > len(was["value"]) and now["value"].startswith(was["value"])
                grown = grown and was["selectedRangeLocation"] == units(was["value"]) and now["selectedRangeLocation"] == units(now["value"])
                if not (ok and (same or grown)):
                    break
                end += 1
            members = own[k : end + 1]
            if any(m["recordID"] is None for m in members):
                out += [(m["recordID"], [m["recordID"]] if m["recordID"] else [], m["after"]["value"], 1, m["inputEventCount"]) for m in members]
            else:
                out.append((members[0]["recordID"], [m["recordID"] for m in members], members[-1]["after"]["value"], len(members), sum(m["inputEventCount"] for m in members)))
            k = end + 1
    return sorted(out, key=str)


def test_navigation_chains_equal_a_loop(spark, tmp_path):
    records = [x for x in random_chains(4) if float(x["beganAt"][17:-1]) < 59]
    got = chains.merge_navigation(rows(spark, tmp_path, records)).collect()
    found = sorted(((r["recordID"], r["lineage"], r["after"]["value"], len(r["inputEvents"]), r["inputEventCount"]) for r in got), key=str)
    wanted = loop_chains(records)
    assert found == wanted and max(len(w[1]) for w in wanted) > 2


def test_chains_become_one_write_and_a_fast_start_is_history_only(spark, tmp_path):
    nav = {"boundaryReason": "selection_navigation"}
    records = [
        attempt("n", "n1", 1, "", "one", **nav), attempt("n", "n2", 1.5, "one", "one two", **nav), attempt("n", "n3", 2, "one two", "one two three"),
        attempt("f", "f1", 1, "", "", boundaryReason="target_changed"), attempt("f", "f2", 1.2, "", "", boundaryReason="target_changed", inputEventCount=2), attempt("f", "f3", 1.5, "abc", "abcdef ghi", mutationCheckpoints=[{"axErrors": [], "observation": observation("abcd")}]),
    ]
    events, rejected = reduce_journal(load(spark, tmp_path, records))
    got = {r["record_id"]: (r["lineage"], r["content"], r["ineligible"], r["continuity"]) for r in events.collect()}
    assert got == {"n1": (["n1", "n2", "n3"], "one two three", None, "single_ax_epoch"), "f3": (["f1", "f2", "f3"], "abcdef ghi", "pre_first_mutation_conditioning_unavailable", "incomplete_pre_mutation_conditioning")}
    assert {r["record_id"]: r["reason"] for r in rejected.collect()} == {"f1": "empty_or_unreproduced_edit", "f2": "empty_or_unreproduced_edit"}


def test_running_sums_of_a_hot_key(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 9 + ["b", None]), k, r.randint(-3, 9)) for k in range(500)]
    from tidewell.operators.sequence import running

    got = running(spark.createDataFrame(data, "k string, i int, x int").repartition(5), ["k"], ["i"], {"before": F.col("x"), "place": F.lit(1)}).collect()
    for key in ("hot", "b", None):
        total = place = 0
        for row in sorted((g for g in got if g["k"] == key), key=lambda g: g["i"]):
            assert (row["before"], row["place"]) == (total, place)
            total, place = total + row["x"], place + 1
    assert len(got) == 500


def test_attempts_are_parsed_once(spark):
    line = '{"type": "active_tap_write_attempt", "recordID": "r"}'
    rows = chains.write_attempts(spark.createDataFrame([("s", 1, "active_tap_write_attempt", line)], "session_id string, line long, record_type string, raw string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()
