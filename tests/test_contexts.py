import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.operators import causal
from tidewell.plans import catalog


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    r = random.Random(3)
    rows = [(c, t * 2, ["user", "other"][r.randrange(2)], " ".join(r.choice(["é", "stone", "\n"]) for _ in range(r.choice([0, 3, 40, 90])))) for c, n in [(1, 900), (2, 1), (3, 30)] for t in range(n)]
    path = tmp_path_factory.mktemp("conversations")
    r.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path), sorted(rows)


def pairs_free(df):
    plan = df._jdf.queryExecution().toString()
    return "Join" not in plan and "collect_list" not in plan


def test_packing_against_brute_force_without_pairs(spark, conversations):
    path, rows = conversations
    want = {}
    for c, t, role, _ in rows:
        if role != "user":
            continue
        for budget in (100, 300, 400):
            used = whole = partial = tokens = 0
            for x in reversed([x for d, u, _, x in rows if d == c and u < t]):
                n = len(re.findall("[^ \t\n\r]+", x))
                used += n
                if used <= budget:
                    whole, tokens = whole + 1, tokens + n
                elif used - n < budget:
                    partial, tokens = partial + 1, tokens + budget - (used - n)
            want[c, t, budget] = (whole, tokens, partial)
    one, two = catalog.suffix_pack(spark, path), catalog.multi_budget_pack(spark, path)
    assert pairs_free(one) and pairs_free(two)
    got = {(r["conv_id"], r["turn"], 300): (r["n_whole"], r["n_tokens"], r["n_partial"]) for r in one.collect()}
    got |= {(r["conv_id"], r["turn"], r["budget"]): (r["n_whole"], r["n_tokens"], r["n_partial"]) for r in two.collect()}
    assert got == want


def test_context_digests_against_brute_force_without_collected_texts(spark, conversations):
    path, rows = conversations
    want = {}
    for c, t, role, _ in rows:
        before = [x for d, u, _, x in rows if d == c and u < t]
        if role == "user":
            want[c, t] = (len(before), hashlib.sha256("\n".join(before).encode()).hexdigest())
    got = catalog.causal_context(spark, path)
    assert pairs_free(got)
    assert {(r["conv_id"], r["turn"]): (r["n_context"], r["context_sha256"]) for r in got.collect()} == want


def test_long_spans_meet_short_ones_on_coarser_grids(spark):
    r = random.Random(3)

    def span():
        lo = r.randrange(10**6)
        return lo, lo + r.choice([0, 5, 90, 4000, 70_000, 10**9])

    a = [(k % 2, k, *span()) for k in range(60)] + [(0, 100, 5, 4), (0, 101, None, 4)]
    b = [(k % 2, k, *span()) for k in range(60)] + [(0, 100, 9, 2)]
    x = spark.createDataFrame(a, "k int, i int, a long, b long")
    y = spark.createDataFrame(b, "k int, j int, c long, d long")
    want = {(i, j) for k, i, lo, hi in a for m, j, at, to in b if k == m and lo is not None and lo <= hi and at <= to and lo <= to and at <= hi}
    got = [tuple(r) for r in causal.interval_join(x, y, ["k"], ("a", "b"), ("c", "d"), 10).select("i", "j").collect()]
    assert len(got) == len(want) and set(got) == want


def test_forward_asof_grows_with_one_key_alone(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 50 == 0).alias("w"))
    got = causal.asof_forward(rows, "k", "t", F.col("w"), F.col("t"), "next").where("next is not null")
    assert got.agg(F.count("*"), F.max(F.col("next") - F.col("t"))).first()[:] == (29_950, 50)
