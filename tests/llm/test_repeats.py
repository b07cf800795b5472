import random

import numpy as np
import pytest

from tests.llm.fixtures import frame
from tidewell.llm import repeats


def brute(data, least):
    texts = sorted((i, (t or "").encode()) for i, t in data)
    seen, out = set(), {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - least + 1):
            w = t[s : s + least]
            if w in seen:
                gone[s : s + least] = True
            seen.add(w)
        out[i] = gone
    return {i: (bytes(np.frombuffer(t, np.uint8)[~out[i]]), int(np.diff(out[i].astype(int), prepend=0).clip(0).sum())) for i, t in texts}


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 8)))
    shared = [" ".join(word() for _ in range(r.randint(3, 40))) for _ in range(6)]
    texts = [" ".join(r.choice(shared) if r.random() < 0.3 else word() for _ in range(r.randint(0, 25))) for _ in range(n)]
    texts[0], texts[1], texts[2] = None, "", "ab " * 90
    texts[5] = texts[6] = texts[20]
    texts[7] = texts[21][: len(texts[21]) // 2] + "X" + texts[21][len(texts[21]) // 2 :]
    texts[8] = "ab " * 50 + texts[22]
    return list(zip(r.sample(range(1000), n), texts, strict=True))


@pytest.mark.parametrize("least,gram,kinds", [(100, 24, 9999), (20, 6, 9999), (20, 6, 2)])
def test_against_brute_force(spark, least, gram, kinds):
    for seed in (1, 2):
        data = corpus(seed)
        df = frame(spark, [(i, t, *[None] * 8) for i, t in data]).repartition(3)
        got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeats.remove_repeats(df, least, gram, kinds=kinds).collect()}
        assert got == brute(data, least)


def test_one_hot_anchor(spark):
    """A passage in every text between parts of its own: its edges are split until their buckets are small."""
    r = random.Random(4)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = own(90)
    data = [(i, own(r.randint(0, 60)) + passage + own(r.randint(0, 60))) for i in range(150)]
    data += [(500 + i, data[i][1][:-3] + "xyz") for i in range(20)]
    df = frame(spark, [(i, t, *[None] * 8) for i, t in data]).repartition(4)
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in repeats.remove_repeats(df, 40, 8, kinds=5).collect()}
    assert got == brute(data, 40)
    strings = repeats._buckets(df.select("doc_id", "text"), 40, 8, 5)[1]
    assert strings.groupBy("key").count().agg({"count": "max"}).first()[0] <= 5


def naive_repeats(strings, least):
    """Maximal repeats as {bytes: set of (string, start)}."""
    out = {}
    for length in range(least, max(map(len, strings)) + 1):
        places = {}
        for i, s in enumerate(strings):
            for a in range(len(s) - length + 1):
                places.setdefault(s[a : a + length], []).append((i, a))
        for w, at in places.items():
            after = {strings[i][a + length : a + length + 1] or (i, a) for i, a in at}
            before = {strings[i][a - 1 : a] or (i, a) for i, a in at}
            if len(at) > 1 and len(after) > 1 and len(before) > 1:
                out[w] = set(at)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_maximal_repeats_of_strings(seed):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
    data = np.frombuffer(b"".join(strings), np.uint8)
    last = np.cumsum([len(s) for s in strings])
    first = last - [len(s) for s in strings]
    order = np.random.default_rng(seed).permutation(len(strings)) * 1000
    found = repeats.maximal_repeats(data, first, last, order, 4)
    place = list(zip(found.of.tolist(), (found.at - first[found.of]).tolist(), strict=True))
    rank = lambda p: order[p[0]] + p[1]
    got = {}
    for d, i, j, low in zip(found.length, found.first, found.last, found.low, strict=True):
        s, a = place[i]
        got[strings[s][a : a + d]] = set(place[i : j + 1])
        assert place[low] == min(place[i : j + 1], key=rank)
    assert got == naive_repeats(strings, 4)
    # the stretches of later suffixes cover the strings that start earlier as well
    covered, want = set(), set()
    for p, n in zip(place, found.later, strict=True):
        covered |= {(p[0], p[1] + k) for k in range(n)}
    seen = sorted(((rank((i, a)), i, a) for i, s in enumerate(strings) for a in range(len(s) - 3)))
    known = set()
    for _, i, a in seen:
        if strings[i][a : a + 4] in known:
            want |= {(i, a + k) for k in range(4)}
        known.add(strings[i][a : a + 4])
    assert covered == want and len(place) >= np.count_nonzero(found.later)


@pytest.mark.parametrize("kinds", [9999, 2])
def test_groups_cover_what_is_removed(spark, kinds):
    data = corpus(3)
    df = frame(spark, [(i, t or "", *[None] * 8) for i, t in data]).select("doc_id", "text").repartition(3)
    groups, gone = {}, {i: np.zeros(len((t or "").encode()), bool) for i, t in data}
    text = {i: (t or "").encode() for i, t in data}
    for r in repeats.occurrences(df, 20, 6, kinds).collect():
        groups.setdefault((r["group"], r["length"]), set()).add((r["doc_id"], r["start"], r["is_first"]))
        if not r["is_first"]:
            gone[r["doc_id"]][r["start"] : r["start"] + r["length"]] = True
    for (_, n), places in groups.items():
        assert len({text[d][s : s + n] for d, s, _ in places}) == 1 and len(places) > 1
        assert [p for p in places if p[2]] == [min(places)]
    want = brute(data, 20)
    assert all(bytes(np.frombuffer(text[i], np.uint8)[~gone[i]]) == want[i][0] for i in text)


def test_whole_characters_and_edges(spark):
    data = [(1, "é" * 80, *[None] * 8), (2, "x" + "é" * 80, *[None] * 8), (3, None, *[None] * 8), (None, "é" * 80, *[None] * 8), (3, "z", *[None] * 8)]
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in repeats.remove_repeats(frame(spark, data), whole_characters=True).collect()}
    assert got[2].startswith("x") and set(got) == {1, 2, 3} and got[3] == ""
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def test_clashing_columns_repeated_and_very_long_rows(spark):
    long = "".join(random.Random(2).choices("abcdefghij ", k=1_200_000))
    rows = [(1, long, 5, "a", "b", 1), (2, "x" + long[500_000:] + "y", 5, "a", "b", 1), (3, "k", 1, "q", "q", 2), (3, "k", 1, "q", "q", 2), (None, "k", 1, "q", "q", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, own_text string, own_id string, row int")
    got = {r["doc_id"]: r for r in repeats.without_repeats(df).collect()}
    assert set(got) == {1, 2, 3} and got[1]["text"] == long and got[2]["text"] == "xy" and got[2]["n_chars"] == 2
    assert (got[2]["own_text"], got[2]["own_id"], got[3]["row"]) == ("a", "b", 2)
