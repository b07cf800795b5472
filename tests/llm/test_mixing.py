import re
from collections import defaultdict

import numpy as np

from tests.llm.fixtures import frame, rows
from tidewell.llm import mixing


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and w[s] * left / open_w > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * left / open_w for s in names}
        full |= over


def check(got, data):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data}
    per = defaultdict(int)
    for r in data:
        per[r[3]] += size[r[0]]
    want = brute_targets(per)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        ratio = want[r["source"]] / per[r["source"]] if per[r["source"]] else 0
        assert r["copies"] in (int(ratio), int(ratio) + (ratio > int(ratio)))
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in per:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_small_and_reruns(spark):
    got = mixing.mix(frame(spark)).collect()
    check(got, rows())
    again = mixing.mix(frame(spark).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tree_of_several_levels(spark):
    data = [r for k in range(5) for r in [(x[0] + 1000 * k, *x[1:]) for x in rows(seed=k)]]
    check(mixing.mix(frame(spark, data), fan_in=8).collect(), data)


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, part = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out = mixing.pivot(size, part, rng.random(40))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / 3000 - part).max() < 0.04


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    one = mixing.mix(frame(spark, [(1, None, *[None] * 8)])).collect()
    assert one[0]["size"] == 0 and one[0]["target"] == 0


def test_rows_with_repeated_or_no_ids_and_clashing_columns(spark):
    words = lambda n, w: " ".join([w] * n)
    rows = [(7, words(10, "a"), "s", 1, "x")] * 4 + [(None, words(20, "b"), "s", 2, "y"), (None, words(20, "c"), "t", 2, "y"), (8, None, "t", 3, "z"), (9, words(50, "d"), None, 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, own_id string")
    plan = mixing.mix(df).collect()
    assert len(plan) == len(rows)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    taken, want = defaultdict(int), defaultdict(int)
    for r in got.collect():
        taken[r["source"]] += len((r["text"] or "").split())
        assert tuple(r) in set(rows)
    for r in plan:
        want[r["source"]] += r["size"] * r["copies"]
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in want.items() if n}
    assert sum(r["doc_id"] is None for r in got.collect()) == sum(r["copies"] for r in plan if r["doc_id"] is None)
    again = sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert sorted(map(str, plan)) == again
