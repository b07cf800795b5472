import hashlib
import math
import random

import numpy as np
import pytest

from tidewell.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, error long"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in kept), default=0)
    width = -(-size // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[1] for c in cut]
            for e in set(at):
                own = [c[p] for c, k in zip(cut, at, strict=True) if k == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    rows = [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label]) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]
    return rows, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)


def vectors(n=90, dims=12, seed=1):
    r = random.Random(seed)
    centres = [[r.uniform(-0.4, 0.4) for _ in range(dims)] for _ in range(7)]
    rows = [(3 * i - 20, [x + r.choice([0, 0, r.gauss(0, 0.02)]) for x in r.choice(centres)], r.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(400, None, 1), (401, [None] * dims, 1), (402, [math.nan] + [0.0] * (dims - 1), 2), (403, [0.0] * (dims - 1) + [-math.inf], 2)]
    return rows + [rows[5], (None, rows[6][1], None), (rows[7][0], rows[8][1], 9), (500, [0.5] * (dims - 5), 1), (501, [], 1)]


@pytest.mark.parametrize("entries", [256, 16, 5])
def test_against_brute_force(spark, entries):
    rows = vectors()
    coded, books = codes.compress(made(spark, rows), 4, entries, 4)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.with_label_errors(coded).collect()]
    wanted, sha = brute(rows, 4, entries, 4)
    assert order(got) == order(wanted) and codes.digest(books) == sha


@pytest.mark.parametrize("side", [1, 7, 64, 4096])
def test_cells_leave_out_no_nearest_entry(side):
    r = np.random.default_rng(side)
    entries = r.integers(-300, 300, (60, 5))
    entries[7], entries[31] = entries[3], entries[3]  # ties go to the lower number
    points = np.concatenate((r.integers(-400, 400, (3000, 5)), entries, entries + 1))
    cells = codes.Cells(entries, side)
    number, distance = cells.nearest(points)
    d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    again, _ = cells.nearest(points)  # from remembered cells
    assert (again == number).all()


def test_remembered_cells_are_bounded_and_shared(monkeypatch):
    monkeypatch.setattr(codes, "REMEMBERED", 50)
    r = np.random.default_rng(2)
    entries, points = r.integers(0, 100, (20, 3)), r.integers(0, 100, (9000, 3))
    cells = codes.Cells(entries, 8)
    number, _ = cells.nearest(points)
    assert (number == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    copies = codes.Cells(entries, 8)
    copies.nearest(np.repeat(points[:10], 500, axis=0))
    assert len(copies.known) <= 10


def test_empty_and_unfit_tables(spark):
    for rows in ([], [(1, None, 2)], [(1, [math.inf], None)]):
        coded, books = codes.compress(made(spark, rows))
        assert codes.with_label_errors(coded).collect() == [] and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="exact distances"):
        codes.compress(made(spark, [(1, [1e9], 2)]))[0].collect()
