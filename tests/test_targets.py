from pyspark.sql import functions as F

from tidewell.functions import targets
from tidewell.operators import protocol


def test_segments(spark):
    seg = "array<struct<type:string,content:string>>"
    data = [([("authored_text", " a "), ("paste", "P"), ("authored_text", "b")],), ([("paste", "P")],), ([("authored_text", "x")],), ([],)]
    rows = spark.createDataFrame(data, f"s {seg}").select(targets.target_text(F.col("s")).alias("t"), targets.target_text(F.col("s"), True).alias("p"), targets.stratum(F.col("s")).alias("k"), targets.authored_length(F.col("s")).alias("n"), targets.without_payloads(F.col("s")).alias("w"), targets.content_of(F.lit(None).cast("string"), F.col("s")).alias("c")).collect()
    assert [(r["t"], r["p"], r["k"], r["n"]) for r in rows] == [(" a <|paste|>b", " a Pb", "mixed", 3), ("<|paste|>", "P", "paste_only", 0), ("x", "x", "authored_only", 1), ("", "", "empty", 0)]
    assert rows[1]["w"][0]["content"] is None and rows[0]["c"] == " a Pb"


def test_choices_and_trajectories(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    L, A = F.lit, lambda *x: F.array(*map(F.lit, x))
    assert one(targets.nearest_unique(A(1, 5, 9), L(6))) == 5 and one(targets.nearest_unique(A(1, 5), L(3))) is None
    obs = F.array(*[F.struct(L(t).alias("t"), L(p).alias("priority"), L(v).alias("value")) for t, p, v in ((1, 3, "a"), (2, 1, "b"), (2, 2, "c"), (2, 2, "d"), (9, 9, "z"))])
    assert one(targets.latest_observation(obs, L(5))) == "c"
    assert one(targets.is_coherent(A("a", "ab", "abc"))) and not one(targets.is_coherent(A("a", "a" * 30)))
    assert one(targets.is_terminal_jump(L("x" * 300), L("y" * 300))) and not one(targets.is_terminal_jump(L("x"), L("y" * 300)))
    assert one(targets.bridged_paste(L("ab"), L("aPPb"), L("aPPtb"))) == "PP" and one(targets.bridged_paste(L("ab"), L("b"), L("b"))) is None
    assert one(targets.excerpt(L("0123456789"), L(4), L(6), 2)) == "…23[[45]]67…"
    base = "abcdefghijklmnopqrstuvwxyz0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ-_=+~!"
    assert one(targets.anchored_offset(L(base), L(base + "more"), L(36))) == "anchored" and one(targets.anchored_offset(L("a"), L("a"), L(1))) == "left_too_short"
    assert one(targets.shared_start(L("a🙂b"), L("a🙂c"))) == "a🙂"


def test_protocol(spark, tmp_path):
    ex = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "example_id string, block long")
    keys = protocol.expected_keys(ex, ["x", "y"]).orderBy("block", "place").collect()
    assert [(r["arm"], r["example_id"]) for r in keys] == [("x", "b"), ("x", "c"), ("y", "b"), ("y", "c")]
    seen = {r["example_id"]: r["presentations"] for r in protocol.exposure(ex, spark.createDataFrame([(0,)], "block long"), ["y"]).collect()}
    assert seen == {"a": 1, "b": 0, "c": 0}
    gen = spark.createDataFrame([(1, "stop", "t"), (1, "length", "t"), (2, "stop", "t"), (2, "stop", None)], "block long, finish string, text string").withColumn("disposition", protocol.disposition(F.col("finish"), F.col("text")))
    assert {r["block"]: r["state"] for r in protocol.gate(gen, 0.5).collect()} == {1: "intact", 2: "intact"} and protocol.gate(gen).where("state = 'intact'").count() == 0
    assert {tuple(r) for r in protocol.outcomes(gen, ["block"]).collect()} == {(1, 1, 1, 0), (2, 1, 0, 1)}
    ops = spark.createDataFrame([("gen", k, 4) for k in range(4)], "kind string, place int, amount int")
    assert [r["place"] for r in protocol.over_budget(ops, spark.createDataFrame([("gen", 9)], "kind string, ceiling int")).orderBy("place").collect()] == [2, 3]
    use = spark.sql("select 'm' as m, named_struct('input', 3, 'cached', cast(null as int)) as usage union all select 'm', named_struct('input', 4, 'cached', 1)")
    assert tuple(protocol.usage(use, ["m"], ["input", "cached"]).first()) == ("m", 2, 7, 1)
    a = spark.createDataFrame([("e", 1.0, "p", "stop")], "example_id string, nll double, prediction string, finish string")
    assert protocol.parity(a, a.withColumn("nll", F.lit(1.01)), 0.02).first()["passes"] and not protocol.parity(a, a.limit(0), 0.02).first()["passes"]
    path = str(tmp_path / "journal")
    assert [protocol.append_results(spark, path, a, ["example_id"]) for _ in range(2)] == [1, 0] and spark.read.parquet(path).count() == 1
