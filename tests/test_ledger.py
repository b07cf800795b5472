import random
from decimal import Decimal

from pyspark.sql import functions as F

from tidewell.operators import ledger as L

ALLOWED = {"score": 4, "train": 2}


def fold(runs, events):
    """The ledger as a loop over one event after the other."""
    out, state = [], {}
    for run, seq, event, kind, identity, cost in sorted(events, key=lambda e: (e[0], e[1])):
        s = state.setdefault(run, {"marker": None, "done": set(), "lost": [], "over": False})
        if event == L.BEGIN:
            s["marker"] = (kind, identity, cost or Decimal(0))
        elif event == L.COMMIT:
            s["done"].add((kind, identity))
        elif event == L.CLEAR:
            s["marker"] = None
        elif s["marker"]:
            k, i, c = s["marker"]
            planned, ceiling = runs.get(run, (Decimal(0), None))
            total = planned + c + sum(x[2] for x in s["lost"])
            if s["over"]:
                why = L.UNREACHED
            elif k not in ALLOWED:
                why = L.UNSUPPORTED
            elif (k, i) in s["done"]:
                why = L.STALE
            elif sum(x[0] == k for x in s["lost"]) >= ALLOWED[k]:
                why = L.EXHAUSTED
            elif any(x[:2] == (k, i) for x in s["lost"]):
                why = L.REPEATED
            elif ceiling is not None and total > ceiling:
                why = L.CEILING
            else:
                why = L.ABANDONED
                s["lost"].append((k, i, c))
            s["over"] |= why not in (L.STALE, L.ABANDONED)
            out.append((run, seq, k, i, why, total if why == L.ABANDONED else None))
            s["marker"] = None
    return sorted(out)


def journal(r, run, n):
    seq, out = 0, []
    for _ in range(n):
        kind, identity, cost = r.choice(["score", "score", "train"] + ["probe"] * (r.random() < 0.1)), f"i{r.randrange(8)}", r.choice([None, Decimal("1.5"), Decimal(r.randrange(9))])
        end = r.choice([L.CLEAR, L.CLEAR, L.RESUME])
        for event in [L.BEGIN] + [L.COMMIT] * (end == L.CLEAR or r.random() < 0.3) + [end] + [L.RESUME] * (r.random() < 0.2):
            seq += r.randrange(1, 5)
            out.append((run, seq, event, kind, identity, cost))
    return out


def test_ledger_is_the_fold_of_any_prefix_of_the_journal(spark):
    r = random.Random(11)
    events = [e for k in range(40) for e in journal(r, f"r{k}", r.choice([1, 5, 12]))]
    runs = {f"r{k}": (Decimal(r.randrange(5)), r.choice([None, Decimal(6), Decimal(30)])) for k in range(38)}
    # each run once whole and once cut off after any of its events, as a crash there would leave it
    cut = {f"r{k}": r.randrange(1, 30) for k in range(40)}
    events += [(f"{run}-cut", seq, *rest) for run, seq, *rest in events if seq <= cut[run]]
    runs |= {f"{k}-cut": v for k, v in runs.items()}
    r.shuffle(events)
    table = spark.createDataFrame([(k, *v) for k, v in runs.items()], "run string, planned decimal(10,2), ceiling decimal(10,2)")
    rows = spark.createDataFrame(events + [(None, 1, L.BEGIN, "score", "i", None)], "run string, seq long, event string, kind string, identity string, cost decimal(10,2)")
    found = L.recoveries(table, rows, ALLOWED)
    got = sorted(tuple(x) for x in found.collect())
    assert got == fold(runs, events)
    whole = {x[:2]: x[2:] for x in got if not x[0].endswith("-cut")}
    assert all(whole[x[0][:-4], x[1]] == x[2:] for x in got if x[0].endswith("-cut"))
    assert {x[4] for x in got} == {L.STALE, L.ABANDONED, L.UNSUPPORTED, L.EXHAUSTED, L.REPEATED, L.CEILING, L.UNREACHED}
    states = {x["run"]: x for x in L.states(table, found).collect()}
    assert len(states) == len(runs)
    for run, s in states.items():
        own = [x for x in got if x[0] == run]
        refused = [x[4] for x in own if x[4] not in (L.STALE, L.ABANDONED, L.UNREACHED)]
        assert s["status"] == (refused[0] if refused else "recovering" if own else "clean")
        assert s["worst_cost"] == max([x[5] for x in own if x[5] is not None], default=runs[run][0])
    assert L.recoveries(table, rows.limit(0), ALLOWED).count() == 0


def test_markers_are_met_inside_cells_without_a_place_for_each_event(spark, monkeypatch):
    r = random.Random(5)
    events = [e for k in range(6) for e in journal(r, f"r{k}", r.choice([3, 40]))]
    # numbers below zero, far apart, and a resumption that begins a cell right after, or many cells after, its begin
    events = [(run, seq - 40, *rest) for run, seq, *rest in events] + [("far", 7, L.BEGIN, "score", "i", Decimal(1)), ("far", 8, L.RESUME, None, None, None), ("far", 9, L.BEGIN, "score", "j", None), ("far", 10**12, L.RESUME, None, None, None), ("far", 10**12 + 64, L.RESUME, None, None, None), ("first", 16, L.RESUME, None, None, None)]
    runs = {f"r{k}": (Decimal(1), Decimal(30)) for k in range(6)}
    table = spark.createDataFrame([(k, *v) for k, v in runs.items()], "run string, planned decimal(10,2), ceiling decimal(10,2)")
    rows = spark.createDataFrame(r.sample(events, len(events)), "run string, seq long, event string, kind string, identity string, cost decimal(10,2)")
    placed, ordinal = [], L.ordinal_within

    def spy(df, *rest):
        placed.append(df.count())
        return ordinal(df, *rest)

    monkeypatch.setattr(L, "ordinal_within", spy)
    want = fold(runs, events)
    assert sorted(tuple(x) for x in L.recoveries(table, rows, ALLOWED).collect()) == want
    assert sum(placed) <= len({(run, seq // 4096) for run, seq, *_ in events}) < len(events) / 4
    monkeypatch.setattr(L, "_CELL_BITS", 2)
    assert sorted(tuple(x) for x in L.recoveries(table, rows, ALLOWED).collect()) == want
    # a sequence of another type
    named = rows.withColumn("seq", F.col("seq") + F.lit(Decimal("0.5")))
    assert sorted((run, int(seq - Decimal("0.5")), *rest) for run, seq, *rest in L.recoveries(table, named, ALLOWED).collect()) == want
