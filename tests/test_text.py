import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import ids, money, text
from tidewell.operators import scorecard


def pairs(seed=1, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab🙂é\n ") for _ in range(r.randint(0, 9)))
    return [(word(), word()) for _ in range(n)] + [("kitten", "sitting"), ("", ""), ("update after the latest trace", "live update after the latest trace")]


def brute_edit(a, b):
    if a == b:
        return "none", len(a), "", ""
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    gone, new = a[p : len(a) - s], b[p : len(b) - s]
    return "insert" if not gone else "delete" if not new else "replace", p, gone, new


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_edits_scores_and_lengths(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs())], "i int, a string, b string")
    e = text.minimal_edit(F.col("a"), F.col("b"))
    df = df.withColumn("e", e).withColumn("again", text.apply_edit(F.col("a"), F.col("e.offset"), F.col("e.removed"), F.col("e.inserted")))
    df = scorecard.row_scores(df, "a", "b").withColumn("u", text.utf16_length(F.col("a")))
    for r in df.collect():
        op, at, gone, new = brute_edit(r["a"], r["b"])
        assert tuple(r["e"]) == (op, at, gone, new) and r["again"] == r["b"]
        d, m = brute_distance(r["a"], r["b"]), max(len(r["a"]), len(r["b"]))
        assert r["distance"] == d and abs(r["similarity"] - (1 - d / m if m else 1)) < 1e-9
        assert r["u"] == len(r["a"].encode("utf-16-le")) // 2


def test_novel_lines(spark):
    r = random.Random(3)
    view = lambda: "\n".join(r.choice(["alpha", " alpha ", "beta", "", "a  b", "a b", "gamma"]) for _ in range(r.randint(0, 6)))
    data = [(None, "x\nx"), ("", "x\nx"), ("alpha\nbeta", "beta\ngamma\ngamma")] + [(view(), view()) for _ in range(300)]
    got = spark.createDataFrame(data, "p string, c string").select("p", "c", text.novel_lines(F.col("p"), F.col("c")).alias("n")).collect()
    for row in got:
        if not row["p"]:
            assert row["n"] == row["c"]
            continue
        norm = lambda x: " ".join(x.split())
        old, out = {norm(x) for x in row["p"].split("\n")}, []
        for line in row["c"].split("\n"):
            if line and norm(line) and norm(line) not in old:
                old.add(norm(line))
                out.append(line)
        assert row["n"] == "\n".join(out)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab🙂é ", max_size=12), min_size=1, max_size=20))
def test_utf16_offsets(spark, texts):
    df = spark.createDataFrame([(t, u) for t in texts for u in range(len(t.encode("utf-16-le")) // 2 + 2)], "t string, u long")
    for r in df.select("t", "u", text.utf16_to_offset(F.col("t"), F.col("u")).alias("n")).collect():
        ends = [len(r["t"][:k].encode("utf-16-le")) // 2 for k in range(len(r["t"]) + 1)]
        assert r["n"] == (ends.index(r["u"]) if r["u"] in ends else None)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_small_functions(spark):
    L = F.lit
    assert one(spark, text.normalized_line(L(" a \t b "))) == "a b" and one(spark, text.trimmed(L("\n a b \t"))) == "a b"
    assert one(spark, text.without_spaces(L("a​ ﻿B\n"), True)) == "ab"
    assert one(spark, text.occurrences(L("aa"), L("aaaaa"))) == 2 and one(spark, text.occurs_once(L("aa"), L("aaa"))) is False
    assert one(spark, text.word_count(L("don’t stop, it's é 4"))) == 5
    assert one(spark, text.submit_term(L("Please Run, then send"))) == "send" and one(spark, text.submit_term(L("sender"))) is None
    assert one(spark, text.logical_value(L(" Type here "), L("Type here"))) == "" and one(spark, text.logical_value(L("x"), L(""))) == "x"
    assert one(spark, text.is_sensitive(L("AXSecureTextField"), L(None).cast("string"))) and one(spark, text.is_sensitive(L("x"), L("digit 2 of 6"))) and not one(spark, text.is_sensitive(L("x"), L("y")))
    assert one(spark, text.looks_like_address(L(" https://a.b/ "))) and not one(spark, text.looks_like_address(L("two words.x")))
    assert one(spark, text.writable(L("a\x01\tb"))) == "a\tb" and one(spark, text.stable_label(L("App, ⠙ busy"))) == "App,  busy"
    long = "x" * 700
    assert one(spark, text.longest_contained_prefix(L("a" * 30 + "b"), L("zz" + "a" * 30 + "c"))) == 30
    assert one(spark, text.longest_contained_prefix(L("a" * 23), L("a" * 30))) is None and one(spark, text.longest_contained_prefix(L(long), L(long))) == 512
    c = one(spark, text.cursor_window(L("abcdefghij"), L(5), L(2), radius=3))
    assert tuple(c) == ("cde", "fg", "hij", True, False, False)
    assert one(spark, ids.canonical_json(b=L(1), a=L(None).cast("string"), c=L("x/y"))) == '{"b":1,"c":"x/y"}'


def test_money(spark):
    half = [one(spark, money.priced(F.lit(n), F.lit(r))) for n, r in ((1, "2.5"), (1, "3.5"), (3, "0.5"))]
    assert half == [Decimal("0.000002"), Decimal("0.000004"), Decimal("0.000002")]
    got = one(spark, money.tiered_cost(F.lit(100_000), F.lit(10_000), F.lit(0), F.lit(10_000)))
    assert got == Decimal("0.755000")
    assert one(spark, money.tiered_cost(F.lit(300_000), F.lit(0), F.lit(0), F.lit(1_000))) == Decimal("3.045000")
    with pytest.raises(Exception, match="more cached"):
        one(spark, money.tiered_cost(F.lit(1), F.lit(2), F.lit(0), F.lit(0)))


def test_scorecard_with_nothing(spark):
    empty = scorecard.row_scores(spark.createDataFrame([], "target string, prediction string"))
    r = empty.agg(*scorecard.scorecard()).first()
    assert r["n"] == 0 and r["micro_similarity"] is None and r["paste_recall"] is None
    one_ = scorecard.row_scores(spark.createDataFrame([("a<|paste|>", "a<|paste|><|paste|>"), ("", "x")], "target string, prediction string")).agg(*scorecard.scorecard()).first()
    assert one_["paste_precision"] == 0.5 and one_["paste_recall"] == 1.0 and one_["macro_prefix_coverage"] == 1.0
