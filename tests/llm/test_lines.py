import random
from collections import defaultdict

import pytest

from tests.llm import fixtures
from tidewell.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def brute(docs, least_chars=20, least_docs=3):
    """(doc_id, n_lines, n_dropped, kept) of each row; a row is a document, null ids are the least."""
    at = lambda i: -(1 << 63) if i is None else i
    held = defaultdict(list)
    for i, t in docs:
        for key in {x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")}:
            if len(key) >= least_chars:
                held[key].append(at(i))
    keeper = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        stay = [x for x in own if keeper.get(x.strip(BLANK).translate(LOWER), at(i)) == at(i)]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return order(out)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def documents():
    r = random.Random(4)
    common = ["All rights reserved by nobody.", "  ALL RIGHTS RESERVED BY NOBODY.\t", "ÀÉÎ õü 🙂🙂🙂 zwölf Boxkämpfer", "short line", "exactly twenty chars", "nineteen characters", "\x0b\x0cAll rights reserved by nobody.\r", "", "   "]
    out = [(None, "All rights reserved by nobody.\nx"), (None, "exactly twenty chars"), (None, None), (5, ""), (6, "\n\n"), (7, "\n"), (5, "exactly twenty chars\nexactly twenty chars")]
    for i in range(10, 150):
        out.append((i * 7, "\n".join(r.choice(common) if r.random() < 0.4 else f"line number {r.randint(0, 90)} of some text" for _ in range(r.randint(1, 9)))))
    return out + [out[20], out[20], (2000, "\n".join(f"line number {k % 97} of some text" for k in range(50_000)))]


@pytest.mark.parametrize(("batches", "most_sent"), [(4, 1 << 20), (1, 1 << 20), (7, 0)])
def test_against_brute_force(spark, batches, most_sent):
    docs = documents()
    table = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in docs], "doc_id long, text string, kept string, h1 int, n_lines int").repartition(5)
    got = lines.dedup_lines(table, batches=batches, most_sent=most_sent).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert order(map(tuple, got)) == brute(docs)


def test_batches_in_any_order_and_size_give_the_same_frequent_lines(spark):
    docs = documents()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for parts in (1, 2, 5):
        runs = lines.LineRuns(spark, fanout=2)
        batches = table.randomSplit([1.0] * parts, seed=parts)
        for b in batches:
            runs.add(b)
        assert all(len(level) < 2 for level in runs.levels)
        assert len(runs.names()) == bin(parts).count("1")
        found.append({tuple(r) for r in runs.frequent().collect()})
        runs.clear()
        assert runs.names() == []
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_settled_lines_add_nothing(spark):
    one = spark.createDataFrame([(i, "a line that all documents have") for i in range(50, 60)], "doc_id long, text string")
    runs = lines.LineRuns(spark, fanout=9)
    runs.add(one)
    runs.add(spark.createDataFrame([(i, "a line that all documents have") for i in range(10)], "doc_id long, text string"))
    runs.add(spark.createDataFrame([(99, "a line that all documents have")], "doc_id long, text string"))
    sizes = [spark.table(n).count() for n in runs.names()]
    assert sizes == [1, 0, 1]  # a later document takes the line over
    assert [r["last"] for r in runs.frequent().collect()] == [99]
    runs.clear()


def test_merging_runs_needs_no_shuffle(spark):
    runs = lines.LineRuns(spark, fanout=9)
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    for b in lines.batches_by_id(docs, 2):
        runs.add(b)
    plan = runs._merged(runs.names())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.clear()


def test_empty_table_and_fixture(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = lines.dedup_lines(fixtures.frame(spark), least_chars=5, least_docs=2).collect()
    assert order((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == brute([(r[0], r[1]) for r in fixtures.rows()], 5, 2)
