"""Targets as segments, and choices among observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import common_prefix, chars, first_reason, let, minimal_edit, occurs_once, trimmed, without_spaces

#: What a paste shows as; characters of an anchor; the largest step of a coherent trajectory and a terminal jump.
PASTE, ANCHOR, STEP, JUMP, LOOK_BACK = "<|paste|>", 32, 16, 256, 16


def target_text(segments: Column, payloads: bool = False) -> Column:
    """Segments (type, content) as text; a paste is its marker, or its payload if asked for."""
    return F.array_join(F.transform(segments, lambda s: F.when((s["type"] == "paste") & F.lit(not payloads), PASTE).otherwise(s["content"])), "")


def without_payloads(segments: Column) -> Column:
    """Segments as a model may see them: a paste keeps its type and nothing else."""
    return F.transform(segments, lambda s: F.struct(s["type"].alias("type"), F.when(s["type"] != "paste", s["content"]).alias("content")))


def stratum(segments: Column) -> Column:
    """authored_only, paste_only, mixed, or empty."""
    paste = F.exists(segments, lambda s: s["type"] == "paste")
    authored = F.exists(segments, lambda s: (s["type"] == "authored_text") & (s["content"] != ""))
    return F.when(paste & authored, "mixed").when(paste, "paste_only").when(authored, "authored_only").otherwise("empty")


def authored_length(segments: Column) -> Column:
    """Trimmed characters of the authored segments."""
    return F.length(trimmed(F.array_join(F.transform(F.filter(segments, lambda s: s["type"] == "authored_text"), lambda s: s["content"]), "")))


def content_of(content: Column, segments: Column) -> Column:
    """An event's text: its content, or its joined segments."""
    return F.coalesce(content, F.array_join(F.transform(segments, lambda s: s["content"]), ""))


def excerpt(text: Column, start: Column, end: Column, around: int = 40, open_: str = "[[", close: str = "]]") -> Column:
    """The text around a span, the span in marks, cut ends shown by dots."""
    lo, hi = F.greatest(start - around, F.lit(0)).cast("int"), F.least(end + around, F.length(text)).cast("int")
    cut = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    return F.concat(F.when(lo > 0, "…").otherwise(""), cut(lo, start), F.lit(open_), cut(start, end), F.lit(close), cut(end, hi), F.when(hi < F.length(text), "…").otherwise(""))


def nearest_unique(candidates: Column, at: Column) -> Column:
    """The candidate number nearest to ``at``; null if two are as near or there is none."""
    least = F.array_min(F.transform(candidates, lambda x: F.abs(x - at)))
    near = F.filter(candidates, lambda x: F.abs(x - at) == least)
    return F.when(F.size(near) == 1, F.get(near, F.lit(0)))


def latest_observation(observations: Column, at: Column) -> Column:
    """Of structs (t, priority, value): the latest at or before ``at``, then the highest priority; the first of equals."""
    fit = F.transform(F.filter(observations, lambda o: o["t"] <= at), lambda o, i: F.struct(o["t"].alias("t"), o["priority"].alias("p"), (-i).alias("n"), o["value"].alias("value")))
    return F.array_max(fit)["value"]


def _span(a: Column, b: Column) -> Column:
    e = minimal_edit(a, b)
    return F.length(e["removed"]) + F.length(e["inserted"])


def is_coherent(values: Column) -> Column:
    """Whether each of the last sixteen values follows from the one before by an edit that removes and inserts
    sixteen characters at most together."""
    last = F.slice(values, F.greatest(F.size(values) - LOOK_BACK + 1, F.lit(1)), F.lit(LOOK_BACK))
    pairs = F.zip_with(F.slice(last, F.lit(1), F.greatest(F.size(last) - 1, F.lit(0))), F.slice(last, F.lit(2), F.greatest(F.size(last) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.forall(pairs, lambda p: _span(p["a"], p["b"]) <= STEP)


def is_terminal_jump(before: Column, last: Column) -> Column:
    """Whether the last value replaces a lot of the one before by a lot."""
    e = minimal_edit(before, last)
    return (F.length(e["removed"]) >= JUMP) & (F.length(e["inserted"]) >= JUMP)


def bridged_paste(before: Column, epoch: Column, after: Column) -> Column:
    """The text that an epoch without input put in between two known states; null unless both edits only insert at one place."""
    a, b = minimal_edit(before, epoch), minimal_edit(epoch, after)
    ok = (a["operation"] == "insert") & b["operation"].isin("insert", "none")
    return F.when(ok & ((b["operation"] == "none") | (b["offset"] == a["offset"] + F.length(a["inserted"]))), a["inserted"])


def anchored_offset(before: Column, text: Column, offset: Column) -> Column:
    """How an edit's place is proven by its surroundings: the state of the two anchors that meet there."""
    left, right = without_spaces(F.substring(before, F.lit(1), offset.cast("int"))), without_spaces(F.substring(before, offset.cast("int") + 1, F.length(before)))
    a, b = F.right(left, F.lit(ANCHOR)), F.left(right, F.lit(ANCHOR))
    whole = without_spaces(text)
    return first_reason((F.length(a) < ANCHOR, "left_too_short"), (F.length(b) < ANCHOR, "right_too_short"), (~occurs_once(a, whole), "left_not_unique"), (~occurs_once(b, whole), "right_not_unique"), (F.position(a, whole) + ANCHOR > F.position(b, whole), "out_of_order"), (F.lit(True), "anchored"))


def shared_start(a: Column, b: Column) -> Column:
    """The longest common beginning of two strings."""
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), lambda v: F.array_join(F.slice(v["a"], F.lit(1), common_prefix(v["a"], v["b"]).cast("int")), ""))
