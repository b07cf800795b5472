import itertools
import os

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import by_id, frame, rows
from tidewell.llm import pieces
from tidewell.llm.bytestext import passes


def small(apart=True):
    vocab = ["\xff", "\xffa", "\xffab", "a", "b", "ab", "ba", "abc", "c", "bc", "é", "aé", "\xff\xff"] + ([] if apart else ["a\xffb"])
    enc = lambda p: b"".join(bytes([0xFF]) if c == "\xff" else c.encode() for c in p)
    by_id = [enc(p) for p in vocab] + [bytes([b]) for b in range(256)]
    r = np.random.default_rng(4)
    return pieces.PieceModel({enc(p): (i, float(-r.uniform(1, 6))) for i, p in enumerate(vocab)}, np.arange(len(vocab), len(vocab) + 256, dtype=np.int32), by_id)


def every(model, part):
    """All segmentations by brute force."""
    edges = pieces.edges_of(model, part)

    def walk(e):
        if e == 0:
            yield 0.0, []
        for s, score, i in edges[e]:
            for t, ids in walk(s):
                yield t + score, ids + ([i] if i >= 0 else model.byte_ids[list(part[s:e])].tolist())

    return sorted(walk(len(part)), key=lambda x: -x[0])


@pytest.mark.parametrize("apart", [True, False])
def test_best_and_nbest_against_all_segmentations(apart):
    model = small(apart)
    assert model.apart == apart
    coder = pieces.Encoder(model, 6)
    alphabet = ["a", "b", "c", " ", "é", "\n"]
    texts = ["".join(x) for n in range(5) for x in itertools.product(alphabet, repeat=n)][::3]
    for t in passes(pa.array(texts)):
        got = coder(t)
        at = np.concatenate(([0], np.cumsum(got.n_ids)))
        for i, text in enumerate(texts[t.rows]):
            ids = got.ids[at[i] : at[i + 1]].tolist()
            if not text:
                assert ids == [] and got.score[i] == 0
                continue
            want = every(model, b"\xff" + text.encode().replace(b" ", b"\xff"))
            assert np.allclose([x["score"] for x in got.nbest[i]], [s for s, _ in want[:6]])
            made = []
            for x in got.nbest[i]:
                new = list(ids)
                for e in sorted(x["edits"], key=lambda e: -e["at"]):
                    new[e["at"] : e["at"] + e["n"]] = e["ids"]
                made.append(tuple(new))
                assert any(abs(s - x["score"]) < 1e-9 and w == new for s, w in want)
            assert len(made) == min(6, len(want))


def test_search_of_one_part():
    model = small()
    for part in (b"\xffabcab", "\xffabcaéx".encode("latin-1").replace(b"\xe9", "é".encode()), b"abababab"):
        want = every(model, part)
        got = pieces.n_best(model, part, 10)
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:10]])
        assert len({tuple(i) for _, i in got}) == len(got)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no piece file")
def test_round_trip_and_the_library(spark):
    import sentencepiece

    data = rows() + [(900, "▁ odd ▁mark  two  \ttab \x00 nul", *[None] * 8), (901, "a" * 3000, *[None] * 8), (902, "   lead", *[None] * 8), (None, "no id", *[None] * 8)]
    enc = pieces.encode(frame(spark, data))
    got = by_id(enc)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in data:
        assert back[r[0]] == (r[1] or "") and got[r[0]]["round_trip"]
        if r[1] and "▁" not in r[1]:
            assert sp.decode(list(got[r[0]]["ids"])) == r[1]
        scores = [x["score"] for x in got[r[0]]["nbest"]]
        assert all(a >= b - 1e-6 for a, b in zip(scores, scores[1:])) and abs(scores[0] - got[r[0]]["score"]) < 1e-6


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no piece file")
def test_empty(spark):
    assert pieces.encode(frame(spark, [])).collect() == []
