import re
from collections import Counter

import numpy as np

from tests.llm.fixtures import by_id, frame, rows
from tidewell.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark):
    data = rows() + [(900, "a b\n\na b\n a b\n#<> é$\ra\r\n\n", *[None] * 8), (901, ("w x y z a b c d e " * 4) + "tail", *[None] * 8)]
    got = by_id(rules.judge(frame(spark, data)))
    for r in data:
        g, want = got[r[0]], brute(r[1])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert g["kept"] <= (not g["base_failed"])


def test_sketch_quantiles_within_error(spark):
    x = np.random.default_rng(0).lognormal(0, 2, 5000)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    halves = [rules.quantile_sketches(part, ["k"]) for part in df.randomSplit([0.5, 0.5], 1)]
    merged = halves[0].union(halves[1]).groupBy("k", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    got = rules.sketch_quantiles(merged, ["k"], {"q1": 0.25, "q3": 0.75}).first()
    for name, q in (("q1", 0.25), ("q3", 0.75)):
        assert abs(np.exp(got[name]) / np.quantile(x, q) - 1) < 0.03
    assert got["rows"] == 5000


def test_outliers_of_a_group_go(spark):
    clean = " ".join(f"word{i % 17}x{i}" for i in range(80))
    junk = " ".join(f"w{i}***" for i in range(80))
    data = [(i, clean + f" n{i}", "en", "s", *[None] * 6) for i in range(150)] + [(999, junk, "en", "s", *[None] * 6), (998, junk, "en", "rare", *[None] * 6)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(frame(spark, data)).collect()}
    assert not kept[999] and not kept[998] and all(kept[i] for i in range(150))


def test_empty(spark):
    assert rules.judge(frame(spark, [])).collect() == []


def test_fences_adapt_to_groups(spark):
    """Groups that differ in every metric have fences of their own; a small group leans on its language."""
    r = np.random.default_rng(5)

    def text(rate, n):
        words = [f"w{r.integers(900)}" + ("#" if r.random() < rate else "") + ("." if r.random() < rate else "") for _ in range(n)]
        words = [w.upper() if r.random() < rate else w for w in words]
        for k in range(1, n):
            if r.random() < rate / 4:
                words[k] = words[k - 1]
        return " ".join(w + ("\n" if k % 6 == 5 else "") for k, w in enumerate(words)) + "\nsame line\n" * int(r.random() < rate) * 2

    data = [(i, text(0.02, int(r.integers(60, 200))), "en", "plain", *[None] * 6) for i in range(150)]
    data += [(1000 + i, text(0.3, int(r.integers(60, 200))), "en", "noisy", *[None] * 6) for i in range(150)]
    data += [(2000 + i, text(0.02, 100), "en", "small", *[None] * 6) for i in range(2)]
    rows = rules.shares(rules.measured(frame(spark, data))).withColumn("base_failed", rules.F.lit(False))
    got = {x["source"]: x for x in rules.fences(rows).collect()}
    for m, *_ in rules.METRICS:
        assert got["plain"][f"{m}_high"] != got["noisy"][f"{m}_high"]
    for m in ("symbol_share", "punct_share", "upper_share", "echo_share"):
        assert got["plain"][f"{m}_high"] < got["small"][f"{m}_high"]
    kept = {x["doc_id"]: x["kept"] for x in rules.judge(frame(spark, data)).collect()}
    assert np.mean([kept[i] for i in kept if i < 1000]) > 0.97 and np.mean([kept[i] for i in kept if 1000 <= i < 2000]) > 0.97


def test_long_and_repeated_rows(spark):
    long = "one two three four five six seven eight nine ten " * 30_000
    data = [(1, long, None, None, *[None] * 6), (1, long, None, None, *[None] * 6), (None, "a b", "en", None, *[None] * 6)]
    got = rules.judge(frame(spark, data)).collect()
    assert sorted(r["n_words"] for r in got) == [2, 300_000, 300_000] and not any(r["kept"] for r in got)
