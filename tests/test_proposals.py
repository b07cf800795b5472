import random

from pyspark.sql import functions as F

from tidewell.operators import proposals


def greedy(candidates):
    """The choice one by one: (key, better, members) in order."""
    taken, used = set(), set()
    for key, better, members in sorted(candidates, key=lambda c: c[1]):
        if not {(key, m) for m in members} & used:
            taken.add((key, better))
            used |= {(key, m) for m in members}
    return taken


def test_choice_equals_one_by_one(spark):
    r = random.Random(3)
    rows = []
    for key in ("a", "b", None):
        for i in range(60):
            first = r.randint(0, 60)
            members = list(range(first, first + r.randint(1, 7))) if r.random() < 0.8 else r.sample(range(60), 3)
            rows.append((key, i, members, -len(members)))
    rows += [("c", k, [k, k + 1], 0) for k in range(25)] + [("d", 1, [], 0), ("d", 2, [5, 5], 0)]  # a chain in which each hangs on the one before
    table = spark.createDataFrame(rows, "k string, i int, m array<int>, n int").repartition(4)
    got = {(x["k"], x["i"]) for x in proposals.best_apart(table, ["k"], [F.col("n"), F.col("i")], F.col("m")).collect()}
    want = {(k, b[1]) for k, b in set().union(*(greedy([(k, (n, i), m) for k, i, m, n in rows if k == key]) for key in ("a", "b", None, "c", "d")))}
    assert got == want and ("c", 0) in got and ("c", 1) not in got and ("c", 2) in got


def test_runs_and_their_parts(spark):
    r = random.Random(5)
    rows = [(k, i, t) for k in ("hot", None) for i, t in enumerate(sorted(r.sample(range(400), 70)))]
    placed = proposals.runs(spark.createDataFrame(rows, "k string, i int, t int").repartition(5), ["k"], ["t"], lambda a, b: b["t"] - a["t"] <= 4, ["t"])
    got = {(x["k"], x["first"], x["last"]) for x in proposals.subruns(placed, ["k"]).collect()}
    want = set()
    for key in ("hot", None):
        times = [t for k, _, t in rows if k == key]
        for a in range(len(times)):
            b = a
            while b + 1 < len(times) and times[b + 1] - times[b] <= 4:
                b += 1
                want.add((key, a, b))
    assert got == want and len(want) > 30


def test_chosen_runs_against_brute_force(spark):
    from tidewell.plans import attempts
    from tidewell.plans.catalog import HOUR

    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()
    candidates = []
    for user in {e["user_id"] for e in events}:
        own = sorted((e for e in events if e["user_id"] == user), key=lambda e: (e["t"], e["event_id"]))
        for a in range(len(own)):
            b = a
            while b + 1 < len(own) and own[b + 1]["t"] - own[b]["t"] <= 12 * HOUR:
                b += 1
                if own[a]["event_type"] != own[b]["event_type"]:
                    candidates.append((user, (a - b, a), range(a, b + 1)))
    want = {(user, first, first - size) for user, (size, first) in greedy(candidates)}
    assert {(r["user_id"], r["first"], r["last"]) for r in attempts.chosen_runs(spark, folder).collect()} == want


def test_longest_parts_equal_the_choice_among_all_parts(spark):
    r = random.Random(8)
    rows, want = [], set()
    for key in ["k%d" % k for k in range(60)] + [None]:
        place = 0
        for run in range(1, r.randint(2, 6)):
            kinds = [r.choice(["a", "a", "a", "b", "c", None][: r.choice([1, 4, 5, 6])]) for _ in range(r.randint(1, 9))]
            rows += [(key, run, place + i, x) for i, x in enumerate(kinds)]
            parts = [(run, (a - b, a), range(a, b + 1)) for a in range(len(kinds)) for b in range(a + 1, len(kinds)) if kinds[a] and kinds[b] and kinds[a] != kinds[b]]
            want |= {(key, run, place + a, place + a - size) for _, (size, a) in greedy(parts)}
            place += len(kinds)
    rows, want = rows + [(None, 9, 100 + i, x) for i, x in enumerate("aba")], want | {(None, 9, 100, 101)}
    placed = spark.createDataFrame(r.sample(rows, len(rows)), "k string, run long, place long, kind string").repartition(4)
    got = [tuple(x) for x in proposals.longest_unlike(placed, ["k"], "kind").collect()]
    assert set(got) == want and len(got) == len(want) > 60 and any(x[0] is None for x in got)


def test_chosen_runs_of_a_long_run_makes_no_pairs(spark, tmp_path):
    from tidewell.plans import attempts

    # one run of 5,000 events: 12 million parts, whose members no session could list
    events = spark.range(5000).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * 60) as ts", "7L as user_id", "if(id between 40 and 4989 and id % 3 = 0, 'view', 'click') as event_type", "1.0D as value", "'{}' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(x) for x in attempts.chosen_runs(spark, str(tmp_path)).collect()] == [(7, 1, 0, 4989 - 4989 % 3)]
