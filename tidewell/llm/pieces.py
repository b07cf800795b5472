"""SentencePiece encoding and decoding over the piece lattice, with exact n-best segmentations.

Forward Viterbi scores of a lattice are exact heuristics for a backward A-star search, so each pop of the search that
reaches the beginning is the next best segmentation. No piece holds a space mark after another
character, so a text's lattice falls apart before each run of spaces; a pass runs the Viterbi step for all its
distinct parts at once, and the search where a text's few cheapest deviations lie.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import Texts, _letters, firsts, passes, powers, substring_hash
from tidewell.llm.sparktools import arrow_batches, released

#: The space mark of piece files, and the byte that stands for it here (no UTF-8 text has it).
MARK, SPACE = "▁", 0xFF
#: What a character outside the vocabulary costs beyond the dearest piece.
UNKNOWN = 10.0
#: Cells of a lattice that one numpy step holds.
CELLS = 1 << 20
#: Bytes of text that a pass takes, and rows of an Arrow batch: the more, the oftener a part is met again.
PASS, ROWS = 1 << 21, 1000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def _hash_of(piece: bytes) -> int:
    data = np.frombuffer(piece, np.uint8)
    prefix = _prefix(data)
    return int(substring_hash(prefix, np.array([0]), np.array([len(data)]))[0])


@dataclass
class PieceModel:
    """Pieces as bytes with ids and log probabilities; ids of the 256 byte pieces."""

    pieces: dict[bytes, tuple[int, float]]
    byte_ids: np.ndarray
    by_id: list[bytes]
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN
        self.longest = max(map(len, self.pieces))
        self.apart = not any(SPACE in p.lstrip(bytes([SPACE])) for p in self.pieces)
        size = 1 << max(8, (len(self.pieces) * 16).bit_length())
        self.mask = np.uint64(size - 1)
        self.slot_hash, self.slot_id, self.slot_score = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.full(size, -np.inf)
        for piece, (i, score) in self.pieces.items():
            h = _hash_of(piece)
            at = h & (size - 1)
            while self.slot_id[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slot_hash[at], self.slot_id[at], self.slot_score[at] = h, i, score
        lens = np.array([len(p) for p in self.by_id])
        self.piece_at, self.piece_size, self.piece_bytes = firsts(lens), lens, np.frombuffer(b"".join(self.by_id), np.uint8)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the pieces with these hashes."""
        ids, scores = np.full(h.shape, -1, np.int32), np.full(h.shape, -np.inf)
        at, left = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(left):
            stored = self.slot_hash[at]  # 0: a free slot, where the search ends
            hit = stored == h
            ids[left[hit]], scores[left[hit]] = self.slot_id[at[hit]], self.slot_score[at[hit]]
            on = ~hit & (stored != 0)
            left, h, at = left[on], h[on], (at[on] + 1) & np.int64(self.mask)
        return ids, scores


def load(path: str = MODEL) -> PieceModel:
    """Read a SentencePiece model file. Pieces of a merge-rank model, whose scores are whole numbers,
    take log probabilities by Zipf's law of their rank; other models keep their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids, normal, by_id = np.full(256, -1, np.int32), [], [b""] * n
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            by_id[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            by_id[i] = piece.replace(MARK, "\0").encode().replace(b"\0", bytes([SPACE]))
            normal.append((i, sp.get_score(i)))
    ranks = all(float(s).is_integer() for _, s in normal)
    whole = np.log((1 / np.arange(2, len(normal) + 2)).sum())
    pieces = {by_id[i]: (i, float(-np.log(k + 2) - whole) if ranks else float(s)) for k, (i, s) in enumerate(normal)}
    return PieceModel(pieces, byte_ids, by_id)


def edges_of(model: PieceModel, part: bytes) -> list[list[tuple[int, float, int]]]:
    """The lattice of a part: for each end the (start, score, id) of edges; id -1 is a character outside the vocabulary."""
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(part) + 1)]
    for s in range(len(part)):
        if part[s] & 0xC0 == 0x80:
            continue
        size = 1 if part[s] < 0x80 or part[s] == SPACE else 2 if part[s] < 0xE0 else 3 if part[s] < 0xF0 else 4
        for e in range(s + 1, min(len(part), s + model.longest) + 1):
            hit = model.pieces.get(part[s:e])
            if hit:
                out[e].append((s, hit[1], hit[0]))
        if part[s : s + size] not in model.pieces:
            out[s + size].append((s, model.unknown, -1))
    return out


def n_best(model: PieceModel, part: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations (score, ids), best first: forward Viterbi, then backward A-star."""
    edges = edges_of(model, part)
    ahead = [0.0] + [-np.inf] * len(part)
    for e in range(1, len(part) + 1):
        for s, score, _ in edges[e]:
            ahead[e] = max(ahead[e], ahead[s] + score)
    # an entry: minus the score of the best segmentation that ends so, place, number, score so far, edges so far
    heap, count, found = [(-ahead[-1], len(part), 0, 0.0, ())], 0, []
    while heap and len(found) < n:
        _, place, _, done, path = heapq.heappop(heap)
        if place == 0:
            ids: list[int] = []
            while path:
                (s, e, i), path = path
                ids.extend([i] if i >= 0 else model.byte_ids[list(part[s:e])].tolist())
            found.append((done, ids))
            continue
        for s, score, i in edges[place]:
            if ahead[s] > -np.inf:
                count += 1
                heapq.heappush(heap, (-round(done + score + ahead[s], 9), s, count, done + score, ((s, place, i), path)))
    return found


def _parts(model: PieceModel, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a space mark in front and for each blank; first, last and text of each independent part."""
    data = np.concatenate((np.array([32], np.uint8), texts.data[:-1]))
    data[data == 32] = SPACE
    mark = data == SPACE
    begin = np.zeros(len(data) + 1, bool)
    begin[texts.starts] = True
    if model.apart:
        begin[1:-1] |= mark[1:] & ~mark[:-1]
    first = np.flatnonzero(begin[:-1])
    last = np.append(first[1:], len(data))
    text = np.searchsorted(texts.starts, first, "right") - 1
    some = (texts.ends > texts.starts)[text]
    return data, first[some], last[some], text[some]


def _viterbi(model: PieceModel, data: np.ndarray, prefix: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best and second best scores of parts of similar sizes, and the best one's edges (part, start, size, id)."""
    n, wide = len(first), int(size.max())
    longest = min(model.longest, wide)
    at = first[None, :] + np.arange(wide)[:, None]  # place by part, so that a step over all parts is contiguous
    chars = data[np.minimum(at, len(data) - 1)]
    char_size = np.digitize(chars, [0x80, 0xC0, 0xE0, 0xF0]) % 5
    char_size = np.array([1, 0, 2, 3, 4])[char_size]
    char_size[chars == SPACE] = 1
    top = min(max(longest, 4), wide)
    score, ids = np.full((top + 1, wide + 1, n), -np.inf), np.full((top + 1, wide + 1, n), -1, np.int32)
    room = np.where(char_size > 0, size[None, :] - np.arange(wide)[:, None], 0)  # pieces start where characters do
    for m in range(1, longest + 1):
        ok = np.flatnonzero(room.ravel() >= m)
        s = at.ravel()[ok]
        ids[m, :wide].reshape(-1)[ok], score[m, :wide].reshape(-1)[ok] = model.find(substring_hash(prefix, s, s + m))
    for m in range(1, min(4, top) + 1):
        lost = (char_size == m) & (room >= m) & (score[m, :wide] == -np.inf)
        score[m, :wide][lost] = model.unknown
    ahead, back = np.full((wide + 1, n), -np.inf), np.zeros((wide + 1, n), np.int32)
    ahead[0] = 0
    for e in range(1, wide + 1):
        for m in range(1, min(top, e) + 1):
            new = ahead[e - m] + score[m, e - m]
            better = new > ahead[e]
            ahead[e][better] = new[better]
            back[e][better] = m
    behind = np.full((wide + 1, n), -np.inf)
    behind[size, np.arange(n)] = 0
    for s in range(wide - 1, -1, -1):
        for m in range(1, min(top, wide - s) + 1):
            np.maximum(behind[s], score[m, s] + behind[s + m], out=behind[s])
    row, place, parts = np.arange(n), size.copy(), []
    while len(row):
        m = back[place, row]
        s = place - m
        parts.append(np.stack([row, s, m, ids[m, s, row]]))
        score[m, s, row] = -np.inf  # the best path's edges are taken out: what remains passes another edge
        row, place = row[s > 0], s[s > 0]
    second = np.full(n, -np.inf)
    for m in range(1, top + 1):
        np.maximum(second, (ahead[: wide + 1 - m] + score[m, : wide + 1 - m] + behind[m:]).max(axis=0), out=second)
    return ahead[size, np.arange(n)], second, np.concatenate(parts, axis=1)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - firsts(size), size) + np.arange(size.sum())


@dataclass
class Encoded:
    """For the texts of a pass: ids in a row, their number per text, best scores, and n-best lists of (score, edits)."""

    ids: np.ndarray
    n_ids: np.ndarray
    score: np.ndarray
    nbest: list[list[dict]]


class Encoder:
    def __init__(self, model: PieceModel, n: int):
        self.model, self.n, self.known = model, n, {}

    def _search(self, part: bytes) -> list[tuple[float, list[int]]]:
        if len(self.known) > 20_000:
            self.known.clear()  # a cache only: parts are searched again
        if part not in self.known:
            self.known[part] = n_best(self.model, part, self.n)
        return self.known[part]

    def __call__(self, texts: Texts) -> Encoded:
        model, count = self.model, len(texts)
        data, first, last, text = _parts(model, texts)
        if not len(first):
            return Encoded(np.zeros(0, np.int32), np.zeros(count, np.int64), np.zeros(count), [[{"score": 0.0, "edits": []}] for _ in range(count)])
        prefix = _prefix(data)
        _, one, of = np.unique(substring_hash(prefix, first, last), return_index=True, return_inverse=True)
        begin, size = first[one], (last - first)[one]
        best, second, edges = np.zeros(len(one)), np.zeros(len(one)), []
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            wide = int(size[order[at]])
            step = max(1, CELLS // ((wide + 4) * (min(wide + 4, model.longest) + 4)))
            near = int(np.searchsorted(size[order], wide + max(2, wide // 4), "right"))
            rows = order[at : min(at + step, near)]
            best[rows], second[rows], got = _viterbi(model, data, prefix, begin[rows], size[rows])
            edges.append(np.stack([rows[got[0]], got[1], got[2], got[3]]))
            at += len(rows)
        row, start, length, ids = np.concatenate(edges, axis=1)
        order = np.lexsort((start, row))
        row, start, length, ids = row[order], start[order], length[order], ids[order]
        # characters outside the vocabulary become their bytes
        wide = np.where(ids >= 0, 1, length)
        flat = np.repeat(ids, wide)
        lost = flat < 0
        flat[lost] = model.byte_ids[data[_ragged(begin[row] + start, wide)[lost]]]
        part_n = np.bincount(row, wide, len(one)).astype(np.int64)
        n_part = part_n[of]
        out = flat[_ragged(firsts(part_n)[of], n_part)].astype(np.int32)
        n_ids = np.bincount(text, n_part, count).astype(np.int64)
        score = np.bincount(text, best[of], count)
        return Encoded(out, n_ids, score, self._nbest(data, first, last, text, of, best - second, n_part, n_ids, score))

    def _nbest(self, data, first, last, text, of, gap, n_part, n_ids, score) -> list[list[dict]]:
        """Per text: only its n - 1 parts with the least gaps to their second best can deviate in its n best."""
        out = [[{"score": s, "edits": []}] for s in score.tolist()]
        if self.n < 2:
            return out
        gaps = gap[of]
        order = np.lexsort((gaps, text))
        rank = np.arange(len(order)) - firsts(np.bincount(text, minlength=len(score)))[text[order]]
        order = order[(rank < self.n - 1) & np.isfinite(gaps[order])]
        at_piece = np.cumsum(n_part) - n_part - (np.cumsum(n_ids) - n_ids)[text]
        for group in np.split(order, np.flatnonzero(np.diff(text[order])) + 1) if len(order) else []:
            doc = int(text[group[0]])
            lists = [self._search(data[first[p] : last[p]].tobytes()) for p in group]
            # combine the parts' own lists, cheapest sums first
            heap, seen, found = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
            while heap and len(found) < self.n:
                lost, pick = heapq.heappop(heap)
                found.append((lost, pick))
                for j, k in enumerate(pick):
                    if k + 1 < len(lists[j]):
                        nxt = (*pick[:j], k + 1, *pick[j + 1 :])
                        if nxt not in seen:
                            seen.add(nxt)
                            heapq.heappush(heap, (sum(lists[i][0][0] - lists[i][x][0] for i, x in enumerate(nxt)), nxt))
            out[doc] = [
                {"score": out[doc][0]["score"] - lost, "edits": [{"at": int(at_piece[p]), "n": int(n_part[p]), "ids": lists[j][k][1]} for j, (p, k) in enumerate(zip(group, pick, strict=True)) if k]}
                for lost, pick in found
            ]
        return out


def decode_bytes(model: PieceModel, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts from their ids in a row, and the number of bytes of each."""
    size = model.piece_size[ids]
    data = model.piece_bytes[_ragged(model.piece_at[ids], size)].copy()
    data[data == SPACE] = 32
    text = np.repeat(np.arange(len(n_ids)), n_ids)
    n = np.bincount(text, size, len(n_ids)).astype(np.int64)
    keep = np.ones(len(data), bool)
    keep[firsts(n)[n > 0]] = False  # the space mark put in front
    return data[keep], n - (n > 0)


EDITS = "array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>"
_EDIT = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


def encode(docs: DataFrame, path: str = MODEL, n: int = 3) -> DataFrame:
    """(doc_id, ids, score, nbest, round_trip) for each row's whole text.

    ids are the best segmentation's, score its log probability. nbest lists the n best, best first: the score and
    the edits that make it of ids (at: place in ids, n: ids replaced). A text has fewer if it has no more. round_trip:
    decoding gives the text's bytes again. The text is taken as it is, with a space mark in front; characters outside the
    vocabulary, the space mark itself included, are byte pieces. Null and empty texts have no ids and score 0.
    Repeated rows and null doc_ids are encoded like any other; extra columns are ignored. path is read on the driver.
    """
    spark = docs.sparkSession
    arrow_batches(spark, ROWS)
    shared = spark.sparkContext.broadcast(load(path))  # the vocabulary, whatever the corpus

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value, n)
        for b in batches:
            for t in passes(b.column(1), PASS):
                got = coder(t)
                data, sizes = decode_bytes(shared.value, got.ids, got.n_ids)
                want = t.data[_ragged(t.starts, t.ends - t.starts)]
                same = np.ones(len(t), bool)
                if len(data) == len(want) and (sizes == t.ends - t.starts).all():
                    same[np.repeat(np.arange(len(t)), sizes)[data != want]] = False
                else:
                    ends, cuts = np.cumsum(sizes), np.cumsum(t.ends - t.starts)
                    same = np.array([data[e - s : e].tobytes() == want[c - m : c].tobytes() for e, s, c, m in zip(ends, sizes, cuts, t.ends - t.starts, strict=True)])
                ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(got.n_ids))).astype(np.int32), pa.array(got.ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.rows.start, len(t)), ids, pa.array(got.score), pa.array(got.nbest, _NBEST), pa.array(same)], ["doc_id", "ids", "score", "nbest", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, ids array<int>, score double, nbest {EDITS}, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are an empty text, bytes that are no UTF-8 become U+FFFD."""
    arrow_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, size = decode_bytes(shared.value, b.column(1).flatten().to_numpy(zero_copy_only=False), n)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[e - s : e].tobytes().decode("utf-8", "replace") for e, s in zip(ends, size, strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
