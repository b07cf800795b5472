import random

import pytest

import corpus_pipeline
from tests.llm.test_repeats import brute
from tidewell.llm import mixing, pieces, quality, simhash


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(9)
    stem = [a + b for a in ("sto", "riv", "lan", "mer", "tol", "gan", "hul") for b in ("ne", "er", "d", "ry", "ip")]
    prose = lambda n: " ".join(r.choice(stem) for _ in range(n))
    passage = prose(60)
    docs, labels = [], []
    for i in range(120):
        bad = i % 5 == 3
        t = prose(r.randint(30, 90))
        if i % 10 == 1:
            t = t + "\n" + passage + "\n" + prose(20)
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        docs.append((i, t, "en", f"s{i % 4}", len(t), 7))
        labels.append((i, int(not bad), 0))
    docs[110] = (110, docs[20][1], "en", "s1", 5, 7)
    docs[112] = (112, docs[22][1], "en", None, 5, 7)
    docs[114] = (114, None, None, "s0", None, 7)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        new = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert new.columns == docs.columns
        seen.append((docs, docs := new))
    # 1: junk goes and clean documents stay
    kept = {r["doc_id"] for r in seen[0][1].collect()}
    want = {r["doc_id"] for r in quality.classify(seen[0][0], spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert kept == want and not any(i % 5 == 3 for i in kept) and len(kept) >= 95
    # 2: the first of each component
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(seen[1][0]).collect()}
    kept = {r["doc_id"] for r in seen[1][1].collect()}
    assert kept == set(comp.values()) and {20, 22} <= kept and not {110, 112} & kept
    # 3: each text as by brute force
    data = [(r["doc_id"], r["text"]) for r in seen[2][0].collect()]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[2][1].collect()}
    for i, (text, _) in brute(data, 100).items():
        assert got[i] == (text.decode(), len(text.decode()))
    # 4: rows as often as the mix takes them
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3][0]).collect()}
    count = {r["doc_id"]: r["count"] for r in seen[3][1].groupBy("doc_id").count().collect()}
    assert count == {i: c for i, c in copies.items() if c}
    # 5: pieces decode to the texts
    texts = {r["doc_id"]: r["text"] or "" for r in seen[4][0].collect()}
    back = [(r["doc_id"], r["text"]) for r in pieces.decode(seen[4][1]).collect()]
    assert len(back) == seen[4][0].count() and all(texts[i] == t for i, t in back)
    # run() is the stages in a row
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids"]) for r in seen[4][1].collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
