import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.fixtures import frame, rows
from tidewell.llm import simhash
from tidewell.llm.sparktools import connected_components, whole_groups


def brute_print(text, n=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=4):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(frame(spark)).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows()}
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == brute_components(prints)
    assert prints[10] == 0 and got[13][1] == got[10][1] == 10  # null, empty and blank texts are linked


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_lose_no_component(spark, tile):
    r = random.Random(1)
    centers = [r.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(400):
        x = r.choice(centers)
        for _ in range(r.randint(0, 9)):
            x ^= 1 << r.randrange(64)
        prints.setdefault(x, i)
    prints = {v: k for k, v in prints.items()}
    data = [(int(np.uint64(x).astype(np.int64)), i) for i, x in prints.items()]
    e = simhash.links(spark.createDataFrame(data, "fp long, node long"), 4, tile=tile)
    found = {x["node"]: x["component"] for x in connected_components(e).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    data = [(None, "a b", *[None] * 8), (4, "a b", *[None] * 8), (4, "a b", *[None] * 8)]
    assert [tuple(x)[::2] for x in simhash.near_duplicates(frame(spark, data)).collect()] == [(4, 4), (4, 4)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_wide_links_against_brute_force(spark):
    r = random.Random(4)
    mask = (1 << 256) - 1
    centers = [r.getrandbits(256) for _ in range(5)]
    prints = {}
    for i in range(200):
        x = r.choice(centers)
        for _ in range(r.randint(0, 45)):
            x ^= 1 << r.randrange(256)
        prints[i] = x
    lanes = {i: [x >> (64 * k) & (2**64 - 1) for k in range(4)] for i, x in prints.items()}
    data = [(i, *[int(np.uint64(v).astype(np.int64)) for v in x]) for i, x in lanes.items()]
    df = spark.createDataFrame(data, "node long, fp long, fp1 long, fp2 long, fp3 long")
    band = lambda x, k: ((x >> 8 * k) | (x << (256 - 8 * k)) & mask) & 0xFFFF
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 44 and any(band(prints[a], k) == band(prints[b], k) for k in range(32)):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for tile in (8, 1024):
        found = {x["node"]: x["component"] for x in connected_components(simhash.links(df, 44, 4, simhash.sliding_bands(4), tile)).collect()}
        assert {i: found.get(i, i) for i in prints} == {i: find(i) for i in prints}


def test_similar_documents_are_found_and_others_left_alone(spark):
    r = random.Random(8)
    texts = [[f"w{r.randrange(4000)}" for _ in range(300)] for _ in range(40)]
    data = [(i, " ".join(t), *[None] * 8) for i, t in enumerate(texts)]
    for i in range(10):  # one word in a hundred changed: similarity about 0.9
        t = list(texts[i])
        for k in (50, 150, 250):
            t[k] = "changed"
        data.append((100 + i, " ".join(t), *[None] * 8))
    kept = {x["doc_id"] for x in simhash.keep_first_of_near_duplicates(frame(spark, data)).collect()}
    assert kept == set(range(40))


def jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_link_from_their_exact_similarity_on(spark):
    r = random.Random(11)
    pairs = []
    while len(pairs) < 120:  # a head and a tail change: any similarity
        words = [f"w{r.randrange(9000)}" for _ in range(r.choice([60, 120, 400]))]
        k = r.randint(1, len(words) // 4)
        other = words[:-k] + [f"x{r.randrange(9000)}" for _ in range(k)]
        a, b = " ".join(words), " ".join(other)
        if 0.6 <= jaccard(a, b) <= 0.79 or 0.8 <= jaccard(a, b) <= 0.85:
            pairs.append((a, b))
    ten = [f"s{i}" for i in range(10)]
    pairs += [(" ".join(ten), " ".join([*ten[:-1], "other"])), ("q1 q2 q3 q4 q5 q6 q7 q8", "q1 q2 q3 q4 q5 q6 q7 q8 q9")]
    data = [(2 * i + s, p[s], *[None] * 8) for i, p in enumerate(pairs) for s in (0, 1)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(frame(spark, data)).collect()}
    want = {2 * i + s: 2 * i if s == 0 or jaccard(*p) >= 0.8 else 2 * i + 1 for i, p in enumerate(pairs) for s in (0, 1)}
    assert 40 < sum(jaccard(*p) < 0.8 for p in pairs) < 110
    assert got == want


def test_similar_documents_against_brute_force_in_groups(spark):
    r = random.Random(12)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(30):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(80)] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(t))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for tile in (8, 1024):
        got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(frame(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)]), tile=tile).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def test_spanning_forest_is_lightest():
    r = np.random.default_rng(3)
    for n in (2, 9, 40):
        i, j = r.integers(0, n, (2, 3 * n))
        i, j = i[i != j], j[i != j]
        w = r.integers(0, 9, len(i))
        picked = simhash.spanning(n, i, j, w)
        assert (simhash.forest(n, i[picked], j[picked]) == simhash.forest(n, i, j)).all()
        label, total, links = list(range(n)), 0, 0
        for k in np.argsort(w, kind="stable"):  # one link after the other
            a, b = label[i[k]], label[j[k]]
            if a != b:
                total, links = total + w[k], links + 1
                label = [a if x == b else x for x in label]
        assert w[picked].sum() == total and len(picked) == links
    assert len(simhash.spanning(3, *[np.zeros(0, np.int64)] * 3)) == 0


def test_values_in_common():
    r = random.Random(6)
    lists = [r.sample(range(10**12, 10**12 + 40_000), r.choice([0, 3, 5000])) for _ in range(12)] + [[7], [7]]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(14) for b in range(a)], strict=True))
    got = simhash.in_common(pa.array(lists, pa.list_(pa.int64())), i, j)
    assert got.tolist() == [len(set(lists[a]) & set(lists[b])) for a, b in zip(i, j, strict=True)]


def test_whole_groups_over_batches():
    rows = [(k // 7, k // 3, k) for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 5]], pa.int64()) for c in range(3)], ["a", "b", "c"]) for a in range(0, 40, 5)]
    got = [t.to_pydict() for t in whole_groups(iter(batches), ("a", "b"))]
    assert [x for g in got for x in g["c"]] == list(range(40))
    keys = [set(zip(g["a"], g["b"], strict=True)) for g in got]
    assert all(len(k) == 1 for k in keys) and len(set().union(*keys)) == len(keys)


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "x", 1, 2), (1, "a b c d e f g", "x", 1, 2), (2, "a b c d e f g", "y", 1, 2), (3, None, "z", 1, 2), (4, "", "z", 1, 2), (None, "q", "z", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, row int, node int")
    assert sorted((x["doc_id"], x["kept_id"]) for x in simhash.keep_first_of_near_duplicates(df).collect()) == [(1, "x"), (3, "z")]
