import hashlib
import random

import pytest

from tidewell.operators import compile as compiled
from tidewell.operators import rebuild

PLAN = "key string, target_id string, first long, last long, cut long, query string"
BLOCK = "key string, place long, serialized string, extra int"


def brute(plans, blocks, instruction):
    held = {(k, p): x or "" for k, p, x, _ in blocks}
    out = {}
    for k, t, first, last, cut, q in plans:
        places = [] if first is None or last is None else [p for p in range(first, last + 1)]
        texts = [held[k, p] for p in places if (k, p) in held]
        if texts and cut is not None and (k, first) in held:
            texts[0] = texts[0][len(texts[0]) - min(cut, len(texts[0])) :]
        context = "\n".join(texts)
        body = context + "\n" + (q or "") if context else q or ""
        out[k, t] = (hashlib.sha256((instruction + "\n" + body).encode()).hexdigest(), len(texts), len(body), len(places) - len(texts))
    return out


@pytest.mark.parametrize("slice_", [3, 4096])
def test_digests_against_inputs_written_out(spark, monkeypatch, slice_):
    monkeypatch.setattr(rebuild, "SLICE", slice_)
    r = random.Random(7)
    blocks = [(k, p, r.choice([None, "", "é" * r.randrange(9), "a\nb", "x" * 400]), 1) for k, n in [("hot", 120), (None, 9), ("one", 1)] for p in range(n) if r.random() < 0.9]
    plans = []
    for k, n in [("hot", 120), (None, 9), ("one", 1), ("none", 3)]:
        for i in range(40):
            last = r.randrange(-1, n)
            first = r.choice([0, max(0, last - r.randrange(12)), last + 1])
            plans.append((k, f"t{i}", first, last, r.choice([None, None, 0, 3, 1000]), r.choice([None, "", "go on"])))
    plans += [("hot", "nothing", None, 3, None, "q"), ("hot", "half", 3, None, None, "q")]
    r.shuffle(blocks)
    got = rebuild.digests(spark.createDataFrame(plans, PLAN), spark.createDataFrame(blocks, BLOCK), "do")
    rows = got.collect()
    assert len(rows) == len(plans)
    assert {(x["key"], x["target_id"]): tuple(x)[2:] for x in rows} == brute(plans, blocks, "do")
    assert rebuild.digests(spark.createDataFrame([], PLAN), spark.createDataFrame(blocks, BLOCK)).count() == 0
    assert rebuild.disagreeing(got, got).where("reason <> 'block_missing'").count() == 0
    claimed = spark.createDataFrame([("one", "t0", "0" * 64), ("one", "lost", "0" * 64)], "key string, target_id string, model_input_sha256 string")
    why = {(x["key"], x["target_id"]): x["reason"] for x in rebuild.disagreeing(got.where("missing = 0"), claimed).collect()}
    assert why["one", "lost"] == "plan_missing" and why.get(("one", "t0"), "plan_missing") in ("digest_differs", "plan_missing") and "not_claimed" in why.values()


def test_a_key_stays_together_where_partitions_are_coalesced_at_run_time(spark):
    r = random.Random(1)
    blocks = [(f"k{k}", p, r.randbytes(400).hex(), 0) for k in range(200) for p in range(6)]
    plans = [(f"k{k}", f"{last}", 0, last, None, "q") for k in range(200) for last in range(-1, 6)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48KB"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = rebuild.digests(spark.createDataFrame(plans, PLAN), spark.createDataFrame(blocks, BLOCK), "do").collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert {(x["key"], x["target_id"]): tuple(x)[2:] for x in rows} == brute(plans, blocks, "do")


def test_leaks_count_the_plans_that_show_a_block(spark):
    r = random.Random(5)
    blocks = [(k, p, r.choice(["secret", "other", "open", None]), 0) for k in ("a", "b") for p in range(30)]
    plans = [(r.choice("ab"), f"{i}", f := r.randrange(30), f + r.randrange(-1, 8), r.choice([None, 2]), "") for i in range(60)]
    want = {}
    for k, p, x, _ in blocks:
        n = sum(1 for key, _, first, last, cut, _ in plans if key == k and first + (cut is not None) <= p <= last)
        if x in ("secret", "other") and n:
            want[k, p] = n
    private = spark.createDataFrame([("secret",), ("secret",), ("other",), (None,)], "serialized string")
    got = rebuild.leaks(spark.createDataFrame(plans, PLAN), spark.createDataFrame(blocks, BLOCK), private)
    assert {(x["key"], x["place"]): x["n_targets"] for x in got.collect()} == want


def test_planned_examples_have_the_inputs_of_written_ones(spark):
    r = random.Random(2)
    rows = [("s", f"e{i}", r.choice(["read", "write"]), i, 10 * i + r.choice([0, 3]), 10 * i - 25, r.choice(["hello there", "a \"quoted\" é", "ab"]), "w") for i in range(160)] + [("t", "x", "write", 1, 9, 5, "first one", None)]
    events = spark.createDataFrame(rows, "session_id string, event_id string, kind string, line int, available_at long, began_at long, content string, window_title string")
    examples, left, _ = compiled.examples(events)
    plans, blocks, left_too, _ = compiled.planned_examples(events)
    want = {(x["session_id"], x["event_id"]): (hashlib.sha256(x["model_input"].encode()).hexdigest(), x["n_context"]) for x in examples.collect()}
    found = {(x["key"], x["target_id"]): (x["model_input_sha256"], x["n_blocks"]) for x in rebuild.digests(plans, blocks).collect()}
    assert found == want and len(want) > 20
    assert sorted(left.collect()) == sorted(left_too.collect())
