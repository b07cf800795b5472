import random
import zlib

import numpy as np

from tests.llm.fixtures import by_id, frame, rows
from tidewell.llm import quality
from tidewell.llm.bytestext import passes
from tidewell.llm.neural import temperature

import pyarrow as pa


def corpus(n=300):
    r = random.Random(2)
    good = [f"{a}{b}" for a in ("sto", "riv", "lan", "mer", "tol") for b in ("ne", "er", "d", "ry")]
    out, marks = [], []
    for i in range(n):
        bad = r.random() < 0.4
        words = [r.choice(good) for _ in range(r.randint(20, 60))]
        out.append(" ".join(w.upper() + "!!" if bad else w for w in words))
        marks.append(int(not bad))
    return out, marks


def test_held_out_accuracy_and_folds(spark):
    texts, marks = corpus()
    df = frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)] + [(1, 1 - marks[1], 0), (None, 1, 0)], "doc_id long, quality int, text int")
    got = by_id(quality.classify(df, labels))
    held = [i for i in got if got[i]["held_out"]]
    assert held == [] or set(held) == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.95
    # flipping held-out labels changes nothing
    flipped = spark.createDataFrame([(i, 1 - m if i in held else m, 0) for i, m in enumerate(marks)] + [(1, 1 - marks[1], 0)], "doc_id long, quality int, text int")
    again = by_id(quality.classify(df, flipped))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-9 for i in got)


def test_context_sums_against_brute_force(spark):
    df = frame(spark)
    sums = quality.context_sums(df.repartition(3))
    where, sign = quality.index_entries()
    index = np.zeros((quality.BUCKETS, quality.DIMS), int)
    np.put_along_axis(index, where, sign, axis=1)
    want = np.zeros((quality.BUCKETS, quality.DIMS + 1), int)
    for t in passes(pa.array([r[1] for r in rows()])):
        w, n = quality.word_buckets(t)
        for k in np.split(w, np.cumsum(n)[:-1]):
            for i, b in enumerate(k):
                want[b, -1] += 1
                for j in range(max(0, i - quality.REACH), min(len(k), i + quality.REACH + 1)):
                    if j != i:
                        want[b, :-1] += index[k[j]]
    assert (sums == want).all()


def test_edges(spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(frame(spark, []), no_labels).collect() == []
    got = quality.classify(frame(spark), no_labels).collect()
    assert len(got) == 60 and {r["score"] for r in got} == {0.5}
    assert temperature(np.array([[4.0, 0], [4.0, 0]]), np.array([0, 1])) == 8.0
