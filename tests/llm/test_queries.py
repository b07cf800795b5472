"""Every registered corpus query on a small folder: its columns, and its results against brute force where the contract fixes them."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import fixtures, test_codes, test_lines, test_mixing, test_phrases, test_repeats, test_rules, test_simhash, test_urls
from tidewell.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_repeats": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op2_fingerprints": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
    "op3_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op4_language": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op5_lm": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double"), ("bits_per_byte", "double")],
    "op6_mix": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op7_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op8_pieces": [("doc_id", "bigint"), ("n_pieces", "bigint"), ("ids_digest", "string"), ("score", "double"), ("nbest_scores", "array<double>"), ("round_trip", "boolean")],
    "op9_rules": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op10_urls": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op11_phrases": [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")],
    "op12_codes": [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")],
    "op13_lines": [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")],
}


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = fixtures.rows()
    docs = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], int(len(d[1] or "") > 90), 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, u, "h") for i, u in enumerate(test_urls.URLS * 2)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vectors = [v for v in test_codes.vectors() if v[0] is not None]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    out = {}
    for name, query in queries.QUERIES.items():
        df = query(spark, folder)
        out[name] = (dict(df.dtypes), {r[:2] if name == "op11_phrases" else r[0]: r for r in df.collect()})
    return docs, out


def test_columns_rows_and_folds(results):
    docs, out = results
    assert list(out) == list(COLUMNS)
    for name, wanted in COLUMNS.items():
        types, rows = out[name]
        assert [(c, types.get(c)) for c, _ in wanted] == wanted
        if name not in ("op11_phrases", "op12_codes"):
            assert len(rows) == (2 * len(test_urls.URLS) if name == "op10_urls" else len(docs))
    for name, folds, fold in (("op3_quality", 5, 0), ("op4_language", 4, 2), ("op5_lm", 7, 2)):
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold) for i, r in out[name][1].items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out["op3_quality"][1].values())
    languages = out["op4_language"][1]
    assert {r["lang_pred"] for r in languages.values()} <= {"en", "de", "und"}
    assert all((languages[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= languages[i]["score"] <= 1 for i, t, *_ in docs)
    assert all(r["round_trip"] for r in out["op8_pieces"][1].values())


def test_op1_against_brute_force(results):
    docs, out = results
    for i, (kept, spans) in test_repeats.brute([(d[0], d[1]) for d in docs], 100).items():
        r, size = out["op1_repeats"][1][i], len((dict((d[0], d[1]) for d in docs)[i] or "").encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, size - len(kept), spans, sha(kept))


def test_op2_against_brute_force(results):
    docs, out = results
    ordered = sorted((d[0], d[1] or "") for d in docs)
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [WORD.findall(t)] for k in range(max(1, len(w) - 4))} if WORD.search(t) else set()
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    off = []
    for k, (i, t) in enumerate(ordered):
        r, following = out["op2_fingerprints"][1][i], ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        off += [abs(r["near_edited"] - jaccard(shingles(t), shingles(edited))), abs(r["near_next"] - jaccard(shingles(t), shingles(following)))]
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
    assert np.mean(off) < 0.1
    by_text = defaultdict(set)
    for i, t in ordered:
        by_text[t].add(out["op2_fingerprints"][1][i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_op6_against_brute_force(results):
    docs, out = results
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in docs}
    per, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        per[d[3]] += size[d[0]]
    want = test_mixing.brute_targets(per)
    for d in docs:
        r = out["op6_mix"][1][d[0]]
        assert (r["size"], r["source_size"]) == (size[d[0]], per[d[3]]) and abs(r["target"] - want[d[3]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[d[3]] += r["taken"]
        largest[d[3]] = max(largest[d[3]], size[d[0]])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in per)


def test_op7_against_brute_force(results):
    docs, out = results
    prints = {d[0]: test_simhash.brute_print(d[1]) for d in docs}
    components = test_simhash.brute_components(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out["op7_simhash"][1].items()} == {i: (f"{prints[i]:016x}", components[i]) for i in prints}


def test_op9_and_op10_against_brute_force(results):
    docs, out = results
    for d in docs:
        r = out["op9_rules"][1][d[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == test_rules.brute(d[1])
    for i, u in enumerate(test_urls.URLS * 2):
        r, (host, path) = out["op10_urls"][1][i], test_urls.split(u)
        rule, verdict = test_urls.rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ({verdict} if verdict else {"allow", "block"})


def test_model_scores_are_log_probabilities(results):
    docs, out = results
    for d in docs:
        r, n = out["op5_lm"][1][d[0]], len((d[1] or "").encode())
        assert r["score"] < 0 and abs(r["bits_per_byte"] * max(1, n) + r["score"] * np.log2(10)) < 1e-6


def test_phrases_codes_and_lines(results):
    docs, out = results
    got = out["op11_phrases"][1]
    assert sorted(tuple(r) for r in got.values()) == test_phrases.brute([(t, lang) for _, t, lang, *_ in docs], 3, 10, 2000, 50)
    rows, books = test_codes.brute([v for v in test_codes.vectors() if v[0] is not None])
    assert {tuple(r) for r in out["op12_codes"][1].values()} <= {(*r, books) for r in rows} and set(out["op12_codes"][1]) == {r[0] for r in rows}
    lines = test_lines.brute([(i, t) for i, t, *_ in docs])
    assert [tuple(r) for _, r in sorted(out["op13_lines"][1].items())] == [(i, n, gone, sha(kept)) for i, n, gone, kept in lines]
