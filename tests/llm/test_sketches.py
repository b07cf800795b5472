import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.fixtures import by_id, frame, rows
from tidewell.llm import sketches


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_edits_and_likeness(spark):
    got = by_id(sketches.edited_pairs(frame(spark), scale=1).select("*", sketches.likeness(F.col("sketch"), F.col("edited_sketch")).alias("e"), sketches.likeness(F.col("sketch"), F.col("next_sketch")).alias("x")))
    data = sorted((r[0], r[1] or "") for r in rows())
    assert len(got) == len(data)
    for (i, t), (_, nxt) in zip(data, data[1:] + data[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(t)

        def jac(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        assert abs(got[i]["e"] - jac(shingles(t), shingles(edited))) < 1e-9
        assert abs(got[i]["x"] - jac(shingles(t), shingles(nxt))) < 1e-9


def test_scaled_sketch_is_the_part_below_the_threshold(spark):
    df = frame(spark).select("doc_id", sketches.sketch(F.col("text"), scale=1).alias("a"), sketches.sketch(F.col("text"), scale=4).alias("s"))
    for r in df.collect():
        low = [h for h in r["a"] if (h & (2**64 - 1)) < 2**64 // 4]
        assert sorted(r["s"]) == sorted(low or sorted(r["a"])[:1])


def test_merge_and_containment(spark):
    df = frame(spark).select("source", sketches.sketch(F.col("text"), scale=2).alias("sketch"))
    merged = {r["source"]: set(r["sketch"]) for r in sketches.merged(df, "source", scale=2).collect()}
    want = {}
    for r in df.collect():
        want.setdefault(r["source"], set()).update(r["sketch"])
    low = {k: {h for h in v if (h & (2**64 - 1)) < 2**63} for k, v in want.items()}
    assert merged == {k: low[k] or {min(v)} for k, v in want.items() if v}
    one = spark.sql("select array(1L,2L) a, array(2L,3L,4L) b").select(sketches.containment(F.col("a"), F.col("b"))).first()[0]
    assert one == 0.5


def test_edges(spark):
    assert sketches.edited_pairs(frame(spark, [])).collect() == []
    r = sketches.edited_pairs(frame(spark, [(5, "abcd", *[None] * 8), (5, "abca", *[None] * 8), (None, "q", *[None] * 8)])).collect()
    assert [(x["doc_id"], x["edited"]) for x in r] == [(5, "abab")]
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_merged_sketches_are_those_of_all_shingles_together(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    texts = [(g, " ".join(word() for _ in range(r.choice([5, 5, 6, 30])))) for g in range(60) for _ in range(r.randint(1, 3))]
    # the shingles of a group together: each text's, whatever stands between them
    rows = spark.createDataFrame(texts, "g int, text string").select("g", "text", sketches.sketch(F.col("text")).alias("sketch"))
    got = {x["g"]: x["sketch"] for x in sketches.merged(rows, "g").collect()}
    full = {}
    for x in rows.select("g", sketches.sketch(F.col("text"), scale=1).alias("all")).collect():
        full.setdefault(x["g"], set()).update(x["all"])
    below = lambda h: (h % (1 << 64)) >> 1 <= (1 << 63) // sketches.SCALE - 1
    for g, hashes in full.items():
        low = sorted(h for h in hashes if below(h))
        assert got[g] == (low or [min(hashes)])
    pair = spark.createDataFrame([([5], [7, 5]), ([-5], [5]), ([], [5]), ([-5], [-5])], "a array<long>, b array<long>")
    assert [x["c"] for x in pair.select(sketches.containment(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, None, 1.0, 1.0]
