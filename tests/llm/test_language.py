import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.fixtures import by_id, frame
from tidewell.llm import language


def corpus(n=160):
    r = random.Random(3)
    parts = {"en": ["the", "ing", "and ", "tion", "ou", " of"], "de": ["sch", "en ", "ich", "ü", "ver", " der"], "fr": ["é", "eau", "le ", "ment", "ç", " de"]}
    return [(i, "".join(r.choice(parts[k]) for _ in range(r.randint(10, 300))), k, *[None] * 7) for i in range(n) for k in [r.choice(sorted(parts))]]


def test_held_out_accuracy(spark):
    data = corpus() + [(900, None, "en", *[None] * 7), (901, "123 ...", "en", *[None] * 7), (902, "", None, *[None] * 7), (None, "the and of the", None, *[None] * 7)]
    got = by_id(language.identify(frame(spark, data)))
    assert {i: got[i]["held_out"] for i in range(160)} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(160)}
    held = [r for r in data[:160] if got[r[0]]["held_out"]]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())


def test_windows_cover_every_stretch():
    texts = ["x" * n for n in (0, 1, 3, 127, 128, 129, 253, 1000)]
    for rows, text, room, _ in language.windows(pa.array(texts)):
        for i, t in enumerate(texts):
            n = (text == i).sum()
            assert (n == 0) == (t == "")
            covered = sum(room[text == i]) - (n - 1 if n else 0) * (max(language.WIDTHS) - 1)
            assert covered == len(t)
        assert ((rows != 0).sum(axis=1) == room).all()


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    net = language.ByteNet.fresh(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rows, y = r.integers(1, 256, (5, language.WINDOW)), np.array([0, 1, 2, 0, 1])

    def loss():
        z = net.logits(rows)
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(5), y]).mean()

    g = net.grads(rows, y)
    for k, w in net.weights.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old, h = w[i], 1e-6
        w[i] = old + h
        up = loss()
        w[i] = old - h
        down = loss()
        w[i] = old
        assert abs((up - down) / (2 * h) - g[k][i]) < 1e-5


def test_nothing_to_learn(spark):
    assert language.identify(frame(spark, [])).collect() == []
    got = language.identify(frame(spark, [(1, "abc", None, *[None] * 7)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_large_counts_many_languages_repeats_and_long_texts(spark, monkeypatch):
    rows = [(i, "the cat and the dog " * 9 if i % 2 else "der hund und die katze " * 9, "en" if i % 2 else "de") for i in range(120)]
    rows += [(1000 + i, f"odd words {i}", f"rare{i}") for i in range(40)] + [rows[4], rows[4], (5000, "the cat and the dog " * 40_000, "en"), (None, "der hund", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.identify(table, sample=8).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"en", "de", *(f"rare{i}" for i in range(40))}
    by = {r["doc_id"]: r["lang_pred"] for r in language.identify(table.where("lang in ('en', 'de') or lang is null"), sample=40).collect()}
    assert by[5000] == "en" and by[3] == "en" and by[4] == "de"
    # the hash of a row may be multiplied by any number of rows
    h, n = (1 << 40) - 1, 10**9
    assert spark.sql(f"select {h}L / {float(1 << 40)}D * {n}L <= 1650 as x").first()["x"] is False
