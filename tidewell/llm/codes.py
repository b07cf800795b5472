"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, in whole numbers throughout.

The nearest entry is looked for by grid cells. A part's coarse cell is hashed; the first part that falls into a cell finds, from
the least and the greatest distance of each entry to the cell's box, the entries that no other one beats everywhere in the box, and
these are remembered for the cell. Parts are then measured against their cell's entries alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import firsts
from tidewell.llm.sparktools import arrow_batches, released, written

#: Components are this many times their value, rounded down.
SCALE = 1024
#: Whole components must be smaller: squared distances of 2**9 of them are exact in 64 bits.
LIMIT = 1 << 26
#: Vectors in one step, and cells remembered at once by a task.
STEP, REMEMBERED = 2048, 200_000


def whole_vectors(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their whole components): null vectors and those with null or non-finite components are left out.

    Vectors shorter than ``dims`` (the longest one's length) end in zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.where(column.is_null(), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()  # without what stands under null lists
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lens)
    good = ~np.asarray(column.is_null())
    good[row[~np.isfinite(values)]] = False
    kept = np.flatnonzero(good)
    dims = int(lens.max(initial=0)) if dims is None else dims
    out = np.zeros((len(kept), dims), np.int64)
    use = good[row]
    scaled = np.floor(values[use] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is {np.abs(scaled).max() / SCALE} in size; exact distances need less than {LIMIT // SCALE}")
    place = np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[(np.cumsum(good) - 1)[row[use]], place[use]] = scaled.astype(np.int64)
    return kept, out


class Cells:
    """The nearest entries of one codebook, found by cells; ties go to the lower number."""

    def __init__(self, entries: np.ndarray, side: int | None = None):
        self.entries = entries
        self.side = self.fitting(entries) if side is None else side
        self.known: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []

    @staticmethod
    def fitting(entries: np.ndarray) -> int:
        """A cell's side: a quarter of the components' spread, as a power of two; it decides how much is measured, not what comes out."""
        spread = entries.std(axis=0).mean() / 4 if len(entries) else 1
        return 1 << max(0, int(np.log2(max(spread, 1))))

    def _learn(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries of each cell that may be nearest to one of its points."""
        near = np.zeros((len(cells), len(self.entries)), np.int64)
        far = np.zeros_like(near)
        for d in range(cells.shape[1]):
            # a box's distances are sums over its sides, and few sides differ in one direction
            sides, which = np.unique(cells[:, d], return_inverse=True)
            low = sides[:, None] * self.side
            to_low, to_high = low - self.entries[None, :, d], self.entries[None, :, d] - (low + self.side - 1)
            near += (np.maximum(np.maximum(to_low, to_high), 0) ** 2)[which]
            far += (np.maximum(np.abs(to_low), np.abs(to_high)) ** 2)[which]
        keep = near <= far.min(axis=1, keepdims=True)
        row, entry = np.nonzero(keep)
        return np.split(entry.astype(np.int32), np.cumsum(keep.sum(axis=1))[:-1])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, squared distance) of each point."""
        number, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for at in range(0, len(points), STEP):
            part = points[at : at + STEP]
            number[at : at + STEP], distance[at : at + STEP] = self._step(part)
        return number, distance

    def _step(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known, self.lists = {}, []
        cells = np.ascontiguousarray(np.floor_divide(points, self.side))
        keys = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel() if cells.shape[1] else np.zeros(len(points), "V1")
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        keys = [k.tobytes() for k in keys]
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if new:
            for k, found in zip(new, self._learn(cells[first[new]]), strict=True):
                self.known[keys[k]] = len(self.lists)
                self.lists.append(found)
        listed = [self.lists[self.known[key]] for key in keys]
        # pairs of points and their cells' entries, points of one cell after each other
        order = np.argsort(which, kind="stable")
        sizes = np.array([len(x) for x in listed], np.int64)
        per_point = sizes[which[order]]
        entry = np.concatenate(listed)[np.repeat(firsts(sizes)[which[order]] - firsts(per_point), per_point) + np.arange(per_point.sum())]
        d = points[np.repeat(order, per_point)] - self.entries[entry]
        d = np.einsum("ij,ij->i", d, d)
        least = np.minimum.reduceat(d, firsts(per_point))
        tied = np.where(d == np.repeat(least, per_point), entry, len(self.entries))
        number, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        number[order], distance[order] = np.minimum.reduceat(tied, firsts(per_point)), least
        return number, distance


def _coded(column: pa.Array, dims: int, books: list[Cells]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, vectors, numbers by part, distances by part) of some vectors."""
    kept, vectors = whole_vectors(column, dims)
    width = dims // len(books)
    found = [book.nearest(vectors[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return kept, vectors, np.column_stack([x[0] for x in found]), np.column_stack([x[1] for x in found])


def _sums(books: list[np.ndarray], dims: int, parts: int) -> Callable:
    """A task's number of parts at each entry and their sums by component."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, width, size = [Cells(b) for b in books], dims // parts, len(books[0])
        n, total = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64)
        out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

        def flushed() -> pa.RecordBatch:
            met = np.flatnonzero(n)
            columns = [pa.array((met // size).astype(np.int32)), pa.array((met % size).astype(np.int32)), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.int64()))]
            batch = pa.RecordBatch.from_arrays(columns, schema=out)
            n[:], total[:] = 0, 0
            return batch

        seen = 0
        for b in batches:
            _, vectors, numbers, _ = _coded(b.column("v"), dims, cells)
            seen += len(vectors)
            for p in range(parts):
                at = numbers[:, p] + p * size
                n += np.bincount(at, minlength=len(n))
                np.add.at(total, at, vectors[:, p * width : (p + 1) * width])
            if seen >= 1 << 30:  # sums of so many stay below 2**63
                yield flushed()
                seen = 0
        yield flushed()

    return run


def train(vectors: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks, one a part, of the table (vec_id, v), after some rounds of assigning and averaging (rounded down).

    The driver holds the codebooks alone: ``entries`` times ``dims`` whole numbers.
    """
    width = dims // parts
    # null ids last, equal ids by their vectors, so that reruns begin alike
    begin = vectors.select("vec_id", "v").mapInArrow(_kept, "vec_id long, v array<double>").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    _, start = whole_vectors(begin.column("v"), dims)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    if not len(start):
        return books
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books, dims, parts), "part int, entry int, n long, sums array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
        met = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
        for r in met:
            books[r["part"]][r["entry"], r["place"]] = int(r["x"]) // r["n"]
    return books


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors are kept."""
    for b in batches:
        at, _ = whole_vectors(b.column("v"))
        yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in b.columns], schema=b.schema)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimals between commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks): the codes of all vectors and the codebooks that they are numbers into.

    Components are floor(1024 x); the codebooks begin as the parts of the vectors of the smallest vec_ids. Distances are squared
    and exact, ties go to the lower number, and entries that no part is nearest to stay as they are. code has two hex digits a part.

    Rows whose vector is null or holds a null or non-finite component are left out. Shorter vectors count as ending in zeros, up
    to the longest one's length, and that to a multiple of ``parts``. A null vec_id or label is kept; null vec_ids begin a codebook last,
    and of a repeated vec_id every row counts. With fewer vectors than entries the codebooks are shorter. An empty table
    gives an empty one and empty codebooks. A finite component of 65,536 or more in size is refused by an error, as its distances would
    not be exact. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    arrow_batches(embeddings.sparkSession, 10_000)
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dims = max(parts, -(-max(dims, 0) // parts) * parts)
    books = train(rows, dims, parts, entries, rounds)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for b in batches:
            kept, _, numbers, distances = _coded(b.column("v"), dims, cells)
            code = pa.array([x.hex() for x in map(bytes, numbers.astype(np.uint8))], pa.string())
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), code, pa.array(distances.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over the rows of equal labels, nulls together.

    Labels are summed before they are shuffled, and the join leaves it to adaptive execution whether their sums are few enough to be sent
    to all tasks or a frequent label's rows are split.
    """
    coded = written(coded)
    sums = coded.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("label_"))).drop("label_")
