import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import fixtures
from tidewell.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size, least, most, inside):
    """Each language's collocations, from all n-grams of all pieces."""
    found = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, size + 1):
                found["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        long = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in long.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def documents():
    r = random.Random(3)
    words = ["New", "York", "is", "Über", "🙂", "a", "the", "b c", "x"]
    out = [(None, "en"), ("", None), (" \t ", "de"), ("one", "fr"), ("the a the a the a the a", "en"), ("same words here.", "en"), ("same words here.", "en")]
    for i in range(120):
        out.append((r.choice(["", " "]) + "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(r.randint(1, 60))), [None, "en", "de", "und"][i % 4]))
    out.append((" ".join(r.choice(words[:4]) for _ in range(30_000)), "en"))
    return out


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("size", "least", "most", "inside"), [(3, 10, 2000, 50), (2, 3, 5, 50), (4, 6, 40, 80)])
def test_against_brute_force(spark, size, least, most, inside):
    docs = documents()
    table = spark.createDataFrame([(t, lang, 1, "p", 2) for t, lang in docs], "text string, lang string, n int, phrase string, rank int").repartition(5)
    wanted = brute(docs, size, least, most, inside)
    assert result(phrases.collocations(table, size, least, most, inside)) == wanted
    assert len(wanted) > 10


def test_without_sending_prefixes_results_are_the_same(spark, monkeypatch):
    docs = documents()
    table = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    monkeypatch.setattr(phrases, "MOST_SENT", 0)
    assert phrases.frequent_prefixes(table, 3, 10)[0] is None
    assert result(phrases.collocations(table)) == brute(docs, 3, 10, 2000, 50)


def test_too_many_prefixes_to_be_sent_are_marked_and_windows_still_cut(spark, monkeypatch):
    docs = documents()
    table = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    listed, _ = phrases.prefix_set(table, 3, 40)
    cells, _ = phrases.frequent_prefixes(table, 3, 40)
    every, _ = phrases.frequent_prefixes(table, 3, 1)
    windows = lambda: {tuple(r) for r in phrases.window_counts(table, 3, 40).collect()}
    cut = windows()
    monkeypatch.setattr(phrases, "MOST_SENT", 0)
    marks, _ = phrases.prefix_set(table, 3, 40)
    assert isinstance(listed, phrases.Listed) and isinstance(marks, phrases.Marks) and marks.table.nbytes == 1 << 26
    assert listed.has(cells).all() and marks.has(cells).all()
    rare = np.setdiff1d(every, cells)
    assert not listed.has(rare).any() and marks.has(rare).mean() < 0.01
    assert len(cut) <= len(windows()) < 1.01 * len(cut) + 5
    assert result(phrases.collocations(table)) == brute(docs, 3, 10, 2000, 50)


def test_pruned_windows_keep_all_frequent_phrases(spark):
    docs = documents()
    table = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    cells, _ = phrases.frequent_prefixes(table, 3, 40)
    every, _ = phrases.frequent_prefixes(table, 3, 1)
    assert 0 < len(cells) < len(every) and set(cells) < set(every)
    counts = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(table, 3, 40).collect()}
    whole = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(table, 3, 1).collect()}
    assert counts == {k: v for k, v in whole.items() if v >= 40 or k[1] == ""}


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert result(phrases.collocations(table)) == []


def test_fixture_and_counts_beyond_packed_keys(spark):
    rows = fixtures.rows()
    assert result(phrases.collocations(fixtures.frame(spark), least=4)) == brute([(r[1], r[2]) for r in rows], 3, 4, 2000, 50)
    w = phrases.Windows(pa.array(["x"] * ((1 << 21) + 5)), np.zeros((0, 3), np.int64), np.array([0, 0, 1, 1, 1]), ["a", "b"])
    ids = np.array([[5, 1 << 21, -1], [5, 1 << 21, -1], [5, 7, 9], [5, 7, 9], [5, 7, -1]])
    lang, found, n = w.counted(ids)
    assert sorted(zip(lang.tolist(), map(tuple, found.tolist()), n.tolist(), strict=True)) == [(0, (5, 1 << 21, -1), 2), (1, (5, 7, -1), 1), (1, (5, 7, 9), 2)]
