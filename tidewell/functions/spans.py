"""Text functions that expressions can't say: Arrow-batched helpers over pairs of short strings."""

from __future__ import annotations

import difflib
import json
from functools import wraps
from itertools import groupby
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<type:string,content:string,paste_id:string>>"
#: Fixed value: the longest window in which equal-size edits are looked for.
SLIDE = 1024


def over_columns(kind: str):
    """A pandas function as a function of columns; the UDF is made when it is called, as only then a session is there."""

    def wrap(f):
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


@over_columns("double")
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by the longest matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def project_pastes(inserted: str, offset: int, spans: list[dict]) -> tuple[list[dict], str | None]:
    """The segments of an insertion at ``offset`` in which proven paste spans (start, text, paste_id, in the final text) lie whole.

    Returns (segments, None), or ([], reason): a span that is empty or does not stand at its place is named before any two that overlap.
    """
    owner = [None] * len(inserted)  # each character's span
    begins = {}
    for s in spans:
        lo = s["start"] - offset
        if lo < 0 or not s["text"] or not inserted.startswith(s["text"], lo):
            return [], "paste_span_not_preserved"
    for k, s in enumerate(spans):
        lo, size = s["start"] - offset, len(s["text"])
        if any(x is not None for x in owner[lo : lo + size]):
            return [], "paste_spans_overlap"
        owner[lo : lo + size] = [k] * size
        begins[k] = s
    out = []
    for k, run in groupby(range(len(inserted)), key=owner.__getitem__):
        places = list(run)
        piece = inserted[places[0] : places[-1] + 1]
        out.append({"type": "authored_text", "content": piece, "paste_id": None} if k is None else {"type": "paste", "content": piece, "paste_id": begins[k]["paste_id"]})
    return out, None


@over_columns(f"struct<segments:{SEGMENTS},reason:string>")
def paste_segments(inserted: pd.Series, offset: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """project_pastes over columns; spans is an array of struct(start, text, paste_id)."""
    rows = [project_pastes(i or "", int(o), [dict(s) for s in (x if x is not None else [])]) for i, o, x in zip(inserted, offset, spans, strict=True)]
    return pd.DataFrame({"segments": [r[0] for r in rows], "reason": [r[1] for r in rows]})


def merged_segments(segments: Column) -> Column:
    """Neighbouring authored segments as one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (last["type"] == "authored_text") & (s["type"] == "authored_text")
        both = F.struct(F.lit("authored_text").alias("type"), F.concat(last["content"], s["content"]).alias("content"), F.lit(None).cast("string").alias("paste_id"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(segments, F.array().cast(SEGMENTS), step)


def segmentations(text: str, parts: list[dict], most: int = 2) -> list[list[tuple[int, int]]]:
    """The first ``most`` ways to cut a text into typed parts that cover it from end to end, as (start, end) of each.

    parts: (type, content) in order. An authored part is its content; a paste is any stretch of a character or more where its
    content is null, else its content. The ways are counted from the end backwards, for each part and place once, so texts
    without a way cost no more than others. Two pastes of unknown content that touch can't be told apart: no way.
    """
    free = [p["type"] == "paste" and p.get("content") is None for p in parts]
    if any(x and y for x, y in zip(free, free[1:], strict=False)):
        return []
    size, last = len(text), len(parts)
    # ways[k][i]: in how many ways, up to most, parts k.. cover text[i:]
    ways = [[0] * (size + 1) for _ in range(last)] + [[0] * size + [1]]
    for k in range(last - 1, -1, -1):
        below = ways[k + 1]
        if free[k]:
            total = 0
            for i in range(size - 1, -1, -1):
                total = min(most, total + below[i + 1])
                ways[k][i] = total
        else:
            body = parts[k]["content"] or ""
            for i in range(size - len(body) + 1):
                if below[i + len(body)] and text.startswith(body, i):
                    ways[k][i] = below[i + len(body)]
    out: list[list[tuple[int, int]]] = []
    stack: list[tuple[int, int, list[tuple[int, int]]]] = [(0, 0, [])] if ways[0][0] else []
    while stack and len(out) < most:
        k, i, so_far = stack.pop()
        if k == last:
            out.append(so_far)
            continue
        ends = range(size, i, -1) if free[k] else [i + len(parts[k]["content"] or "")]
        stack.extend((k + 1, e, [*so_far, (i, e)]) for e in ends if ways[k + 1][e])
    return out


@over_columns("struct<places:array<int>,reason:string>")
def unique_segmentation(text: pd.Series, parts: pd.Series) -> pd.DataFrame:
    """Where the parts begin in the one way to cover the text with them; a reason if there is none or more than one.

    parts: an array of struct(type, content), as in segmentations.
    """
    found = [segmentations(t or "", [dict(p) for p in (x if x is not None else [])]) for t, x in zip(text, parts, strict=True)]
    return pd.DataFrame({"places": [[a for a, _ in f[0]] if len(f) == 1 else None for f in found], "reason": [None if len(f) == 1 else "no_segmentation" if not f else "ambiguous_segmentation" for f in found]})


def equivalent_edits(before: str, offset: int, removed: str, inserted: str) -> list[int] | None:
    """All offsets at which an edit of the same sizes gives the same text, the given one included; null beyond SLIDE places on a side.

    An edit may stand wherever the texts agree before it and after it, so the places are those from the texts' common suffix to
    their common prefix.
    """
    after = before[:offset] + inserted + before[offset + len(removed) :]
    prefix, suffix = len(commonprefix([before, after])), len(commonprefix([before[::-1], after[::-1]]))
    first, last = max(0, len(before) - len(removed) - suffix), min(prefix, len(before) - len(removed))
    if max(offset - first, last - offset) > SLIDE:
        return None
    return list(range(first, last + 1))


@over_columns("int")
def grounded_offset(before: pd.Series, offset: pd.Series, removed: pd.Series, inserted: pd.Series, caret: pd.Series) -> pd.Series:
    """Of the equivalent places of an edit, the one whose end is nearest to the caret; null if two are as near, or if there are too many."""

    def one(b: str, o: int, r: str, i: str, c: float) -> int | None:
        ends = sorted((abs(at + len(i) - c), at) for at in equivalent_edits(b, int(o), r, i) or [])
        return None if not ends or len(ends) > 1 and ends[0][0] == ends[1][0] else ends[0][1]

    return pd.Series([one(*row) for row in zip(before, offset, removed, inserted, caret, strict=True)], dtype="Int32")


def tail_of_event(event: str, budget: int, tokens) -> str | None:
    """A JSON event cut to its newest characters so that it has ``budget`` tokens at most; null if it can't.

    The content, or the segments from the last to the first, keep a suffix; types and ids stay. The number of
    kept characters is found by halving, since tokens do not fall as characters grow.
    """
    body = json.loads(event)
    segments = body.get("segments")
    whole = "".join(s.get("content", "") for s in segments) if segments else body.get("content", "")

    def kept(n: int) -> str:
        new = dict(body, truncated=True)
        if not segments:
            new["content"] = whole[len(whole) - n :]
        else:
            left, parts = n, []
            for s in reversed(segments):
                take = min(left, len(s.get("content", "")))
                if take:
                    parts.append(dict(s, content=s["content"][len(s["content"]) - take :]))
                left -= take
            new["segments"] = parts[::-1]
        return json.dumps(new, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    lo, hi = 0, len(whole)
    if len(tokens(kept(0))) > budget:
        return None
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if len(tokens(kept(mid))) <= budget else (lo, mid - 1)
    return kept(lo)


def truncated_tail(event: Column, budget: Column, tokens) -> Column:
    """tail_of_event over columns with any tokenizer."""

    @F.pandas_udf("string")
    def run(e: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tail_of_event(x, int(n), tokens) if x is not None else None for x, n in zip(e, b, strict=True)], dtype=object)

    return run(event, budget)
