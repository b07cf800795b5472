import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import by_id, frame, rows
from tidewell.llm import mixlm
from tidewell.llm.bytestext import passes


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_against_brute_force(spark):
    got = by_id(mixlm.score(frame(spark), chunk_bytes=5000))
    tokens = {}
    for r in rows():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        tokens[r[0]] = [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
    train = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(train.values()), len(train)
    for i, t in tokens.items():
        g = got[i]
        assert g["held_out"] == held(i)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), n)
        assert abs(g["base_score"] - sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert g["score"] < 0
    long = [i for i in got if got[i]["n_tokens"] > 60]
    assert np.mean([got[i]["score"] > got[i]["base_score"] * 2 for i in long]) > 0.9


def followed(texts):
    """For each order's context what followed it, byte by byte: {(order's number, bytes before): Counter of symbols}."""
    out = defaultdict(Counter)
    for t in texts:
        for i, s in enumerate([*t, mixlm.END]):
            for k, order in enumerate(mixlm.ORDERS):
                out[k, t[max(0, i - order) : i]][s] += 1
    return out


def as_key(number, before):
    return sum(b << (8 * k) for k, b in enumerate(reversed(before))) | (len(before) << mixlm.BYTE_BITS) | (number << mixlm.ORDER_AT)


def tables(code, counts):
    entries = [(as_key(*c), s, n) for c, by in counts.items() for s, n in by.items()]
    return mixlm.Predictors(code, *(np.array(x, np.int64) for x in zip(*entries, strict=True)))


def path_of(code, symbol):
    at = slice(code.at[symbol], code.at[symbol] + code.size[symbol])
    return list(zip(code.node[at].tolist(), code.bit[at].tolist(), strict=True))


def brute(t, mixer, counts):
    """log10 of a text's probability, decision by decision."""
    at_node = defaultdict(lambda: [0, 0])
    for c, by in counts.items():
        for s, n in by.items():
            for node, bit in path_of(mixer.code, s):
                at_node[c, node][bit] += n
    w = mixer.weights.astype(float).copy()
    start = mixer.refined.astype(float)
    seen = np.zeros((*start.shape, 2))
    total, block, waiting = 0.0, 0, []
    for i, s in enumerate([*t, mixlm.END]):
        b = 0 if i < 32 else (i // 32).bit_length() if i < mixlm.BLOCK else (mixlm.BLOCK // 32).bit_length() - 1 + i // mixlm.BLOCK
        if b != block:
            block = b
            step = mixlm.RATE / np.sqrt(np.bincount([g for g, *_ in waiting], minlength=mixlm.GATES) + 1.0)
            for g, x, err, cell, bit in waiting:
                w[g] += step[g] * err * x
                seen[g, cell, bit] += 1
            waiting = []
        refined = (seen[:, :, 1] + mixlm.PRIOR * start) / (seen.sum(axis=2) + mixlm.PRIOR)
        for node, bit in path_of(mixer.code, s):
            n = [at_node[(k, t[max(0, i - order) : i]), node] for k, order in enumerate(mixlm.ORDERS)]
            x = np.array([math.log((one + mixlm.ADDED) / (zero + mixlm.ADDED)) for zero, one in n])
            g = max(k for k, least in enumerate(mixlm.GATE_FROM) if sum(n[-1]) >= least)
            z = float(w[g] @ x)
            p = 1 / (1 + math.exp(-z))
            cell = int(min(max(z / mixlm.CELL_WIDTH + mixlm.CELLS / 2, 0), mixlm.CELLS - 1))
            q = (p + refined[g, cell]) / 2
            total += math.log10(q if bit else 1 - q)
            waiting.append((g, x, bit - p, cell, bit))
    return total


def model(texts):
    counts = followed(texts)
    code = mixlm.Code.of(np.bincount([s for t in texts for s in [*t, mixlm.END]], minlength=257))
    r = np.random.default_rng(1)
    mixer = mixlm.Mixer(code, r.uniform(0.1, 0.6, (mixlm.GATES, len(mixlm.ORDERS))), np.clip(mixlm.fresh(code).refined + r.uniform(-0.1, 0.1, (mixlm.GATES, mixlm.CELLS)), 0.01, 0.99))
    return mixer, counts


def test_score_against_brute_force():
    texts = [(r[1] or "").encode() for r in rows()]
    mixer, counts = model(texts[:30])
    more = [b"", b"a", b"stone " * 10, ("stone river Über light " * 120).encode()]
    known = tables(mixer.code, counts)
    every = texts + more
    got = np.concatenate([mixlm.score_texts(t, mixer, known) for t in passes(pa.array(every), 4000)])
    alone = np.concatenate([mixlm.score_texts(t, mixer, known) for t in passes(pa.array(every), 1)])
    want = np.array([brute(t, mixer, counts) for t in every])
    # a cell's edge may fall on either side in single precision
    assert np.abs(got - want).max() < 0.05 and np.median(np.abs(got - want)) < 1e-4
    assert np.abs(got - alone).max() < 1e-4


def test_probabilities_of_all_first_symbols_sum_to_one():
    mixer, counts = model([(r[1] or "").encode() for r in rows()])
    known = tables(mixer.code, counts)
    top, p = as_key(len(mixlm.ORDERS) - 1, b""), 0.0
    begin = known.find((top << mixlm.SYMBOL_BITS) + np.arange(257))
    for s in range(257):
        log = 0.0
        for i in range(begin[s], begin[s] + mixer.code.size[s]):
            bit, gate = divmod(int(known.rows[i, -1]), mixlm.GATES)
            z = float(mixer.weights[gate] @ known.rows[i, :-1])
            q = (mixlm.squash(z) + mixer.refined[gate, mixlm.cell_of(np.array([z]))[0]]) / 2
            log += math.log(q if bit else 1 - q)
        p += math.exp(log)
    assert abs(p - 1) < 1e-9


def test_weights_fit_all_pairs():
    """The statistics are the gradient and curvature of the log likelihood, each decision predicted without its own count."""
    texts = [(r[1] or "").encode() for r in rows()[:20]]
    mixer, counts = model(texts)
    top = [c for c in counts if c[0] == len(mixlm.ORDERS) - 1]
    lists = []
    for k, order in enumerate(mixlm.ORDERS):
        entries = [(i, s, n) for i, (_, before) in enumerate(top) for s, n in counts[k, before[-order:] if len(before) > order else before].items()]
        lists.append(tuple(np.array(x, np.int64) for x in zip(*entries, strict=True)))
    sums = mixlm.statistics(mixer, lists, len(top), False).reshape(-1, mixlm.GATES) / 1024
    want = np.zeros((len(mixlm.ORDERS), mixlm.GATES))
    at_node = defaultdict(lambda: [0, 0])
    for c, by in counts.items():
        for s, n in by.items():
            for node, bit in path_of(mixer.code, s):
                at_node[c, node][bit] += n
    for t in texts:
        for i, s in enumerate([*t, mixlm.END]):
            for node, bit in path_of(mixer.code, s):
                n = [list(at_node[(k, t[max(0, i - order) : i]), node]) for k, order in enumerate(mixlm.ORDERS)]
                for x in n:
                    x[bit] -= 1
                x = np.array([math.log((one + mixlm.ADDED) / (zero + mixlm.ADDED)) for zero, one in n])
                g = max(k for k, least in enumerate(mixlm.GATE_FROM) if sum(n[-1]) >= least)
                want[:, g] += (bit - 1 / (1 + math.exp(-mixer.weights[g] @ x))) * x
    assert np.abs(sums[:3] - want).max() < 0.05 * max(1, np.abs(want).max() / 100)
    cells = mixlm.statistics(mixer, lists, len(top), True).reshape(2, mixlm.GATES, mixlm.CELLS)
    assert cells[1].sum() == sum(mixer.code.size[s] for t in texts for s in [*t, mixlm.END])
    better = mixlm.stepped(mixer, (sums * 1024).astype(np.int64).ravel())
    assert better.weights.shape == mixer.weights.shape and not np.allclose(better.weights, mixer.weights)


@pytest.mark.parametrize("chunk_bytes", [10**9, 3000])
def test_whole_query_against_its_parts(spark, chunk_bytes, monkeypatch):
    kept = {}
    fit = mixlm.fit_mixer
    monkeypatch.setattr(mixlm, "fit_mixer", lambda contexts, code: kept.setdefault("mixer", fit(contexts, code)))
    got = by_id(mixlm.score(frame(spark), chunk_bytes=chunk_bytes))
    texts = {r[0]: (r[1] or "").encode() for r in rows()}
    train = [t for i, t in texts.items() if not held(i)]
    mixer = kept["mixer"]
    assert (mixer.code.size == mixlm.Code.of(np.bincount([s for t in train for s in [*t, mixlm.END]], minlength=257)).size).all()
    near = tables(mixer.code, followed(train))
    want = {i: mixlm.score_texts(next(passes(pa.array([t]))), mixer, near)[0] for i, t in texts.items()}
    off = np.array([abs(got[i]["score"] - want[i]) / max(1, -want[i]) for i in texts])
    assert np.median(off) < 1e-5 and off.max() < 0.01
    for i, t in texts.items():
        assert abs(got[i]["bits_per_byte"] + got[i]["score"] * math.log2(10) / max(1, len(t))) < 1e-9
    again = by_id(mixlm.score(frame(spark).repartition(7), chunk_bytes=chunk_bytes))
    assert all(again[i]["score"] == pytest.approx(got[i]["score"], abs=1e-3) for i in got)


def test_texts_teach_themselves():
    texts = [(r[1] or "").encode() for r in rows()]
    mixer, counts = model(texts)
    known = tables(mixer.code, counts)
    bits = lambda n: -mixlm.score_texts(next(passes(pa.array(["stone zzq " * n]))), mixer, known)[0] / n
    assert bits(400) < 0.8 * bits(3)


def test_edges(spark):
    assert mixlm.score(frame(spark, [])).collect() == []
    got = mixlm.score(frame(spark, [(None, None, *[None] * 8), (2, "a", *[None] * 8)])).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2]
    long = "stone river " * 120_000
    got = mixlm.score(frame(spark, [(1, long, *[None] * 8), (1, long, *[None] * 8), (3, "z", *[None] * 8)])).collect()
    assert len(got) == 3 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
