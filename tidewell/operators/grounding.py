"""Where an edit stands: checkpoints tell which characters were kept, so that of several equal edits the one that happened is taken.

An edit that turns one text into another can often stand at several places ("aa" to "aaa"). The states that were seen between the two
are replayed with an owner for each character, its place in the first text or none if it was put in; what is left of the first
text and what is new are then read off the owners. The caret decides where a single step is ambiguous itself.
"""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.functions.columns import Steps, remembered, with_steps
from tidewell.functions.spans import SLIDE, over_columns
from tidewell.sources.journal import instant

#: The rules' names.
EQUIVALENT, REPLACEMENT, CANONICAL = "checkpoint_grounded_equivalent_diff_v1", "checkpoint_grounded_selected_replacement_v1", "canonical_minimal_diff"
#: Hints with which no replacement is completed, and where a cursor's strings must come from to be trusted.
NOT_TYPED_ALONE, RANGE_SOURCE = ("paste", "cut", "undo_redo"), "accessibility_string_for_range"
#: Characters that an edit is not moved across.
STRUCTURAL = "\n\r​"
#: Runs of characters that follow each other: (place of the first one in the first text, or None if they were put in, how many).
Runs = list[tuple[int | None, int]]


def sizes(before: str, after: str) -> tuple[int, int, int]:
    """(offset, characters removed, characters put in) of the smallest edit, the common prefix first."""
    lead = len(commonprefix([before, after]))
    tail = len(commonprefix([before[lead:][::-1], after[lead:][::-1]]))
    return lead, len(before) - lead - tail, len(after) - lead - tail


def places(before: str, after: str, removed: int, inserted: int) -> range:
    """All offsets at which an edit of these sizes turns before into after; the prefix's end alone beyond SLIDE of them."""
    lead = len(commonprefix([before, after]))
    tail = len(commonprefix([before[::-1], after[::-1]]))
    first, last = max(0, len(before) - removed - tail), min(lead, len(before) - removed, len(after) - inserted)
    return range(first, last + 1) if 0 <= last - first <= SLIDE else range(sizes(before, after)[0], sizes(before, after)[0] + 1)


def spliced(runs: Runs, at: int, removed: int, inserted: int) -> Runs:
    """The runs after an edit."""
    left: Runs = []
    right: Runs = []
    begin = 0
    for origin, n in runs:
        kept = min(max(at - begin, 0), n)
        gone = min(max(at + removed - begin, 0), n)
        if kept:
            left.append((origin, kept))
        if gone < n:
            right.append((None if origin is None else origin + gone, n - gone))
        begin += n
    return [*left, *([(None, inserted)] if inserted else []), *right]


def net_edit(runs: Runs, size: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None] | None:
    """(what is missing of the first ``size`` characters, what is new), as spans or None where nothing is; null if one is in pieces."""
    missing, new = [], []
    seen = begin = 0
    for origin, n in [*runs, (size, 0)]:
        if origin is None:
            new = [*new[:-1], (new[-1][0], begin + n)] if new and new[-1][1] == begin else [*new, (begin, begin + n)]
        else:
            if origin > seen:
                missing.append((seen, origin))
            seen = origin + n
        begin += n
    if len(missing) > 1 or len(new) > 1:
        return None
    return (missing or [None])[0], (new or [None])[0]


def grounded(before: str, after: str, states: list[str], caret: int | None) -> tuple[int, int] | None:
    """(offset, states used) of the smallest edit's place that the states prove, if it isn't the canonical one."""
    canonical, removed, inserted = sizes(before, after)
    possible = places(before, after, removed, inserted)
    if len(possible) < 2:
        return None
    runs: Runs = [(0, len(before))] if before else []
    now, used = before, 0
    for state in [*states, after]:
        if state == now:
            continue
        at, out, put = sizes(now, state)
        options = places(now, state, out, put)
        if len(options) > 1:
            if caret is None:
                return None
            near = sorted((min(abs(o - caret), abs(o + out - caret)), o) for o in options)
            if near[0][0] == near[1][0]:
                return None
            at = near[0][1]
        else:
            at = options[0]
        runs, now, caret, used = spliced(runs, at, out, put), state, at + put, used + 1
    found = net_edit(runs, len(before))
    if found is None:
        return None
    missing, new = found
    if (missing[1] - missing[0] if missing else 0) != removed or (new[1] - new[0] if new else 0) != inserted:
        return None
    begins = {span[0] for span in (missing, new) if span}
    if len(begins) != 1:
        return None
    at = begins.pop()
    lo, hi = min(at, canonical), max(at, canonical)
    if at == canonical or at not in possible or set(STRUCTURAL) & set(before[lo:hi] + after[lo:hi]):
        return None
    return at, used


@over_columns("struct<offset:int,states:int>")
def grounded_place(before: pd.Series, after: pd.Series, states: pd.Series, caret: pd.Series) -> pd.DataFrame:
    """grounded over columns; null where states is null."""
    rows = [grounded(b or "", a or "", list(s), None if pd.isna(c) else int(c)) if s is not None else None for b, a, s, c in zip(before, after, states, caret, strict=True)]
    return pd.DataFrame({"offset": pd.array([r and r[0] for r in rows], "Int32"), "states": pd.array([r and r[1] for r in rows], "Int32")})


def ordered_states(checkpoints: Column, until: Column) -> Column:
    """The whole values of the checkpoints that were seen up to a time (all where it is null), in order of time."""
    clean = lambda p: (F.size(F.coalesce(p["axErrors"], F.array().cast("array<string>"))) == 0) & ~F.coalesce(p["observation"]["valueWasTruncated"], F.lit(False)) & p["observation"]["value"].isNotNull()
    seen = lambda p: instant(p["observation"]["observedAt"])
    fit = F.filter(checkpoints, lambda p: clean(p) & seen(p).isNotNull() & (until.isNull() | (seen(p) <= until)))
    timed = F.transform(fit, lambda p, i: F.struct(seen(p).alias("at"), F.coalesce(p["eventTimestampNanoseconds"], F.lit(0)).alias("t"), i.alias("i"), text.logical_value(p["observation"]["value"], p["observation"]["placeholderValue"]).alias("value")))
    return F.transform(F.array_sort(timed), lambda p: p["value"])


def initial_caret() -> Column:
    """The caret before the write, where the field's own strings around it prove it."""
    cursor, before = F.col("state.cursorContext"), F.col("before")
    proven = (cursor["source"] == RANGE_SOURCE) & (cursor["captureStatus"] == "complete") & before["axRangeCursorProbe"].isNotNull() & (F.size(F.coalesce(before["axRangeCursorProbe"]["errors"], F.array().cast("array<string>"))) == 0)
    return F.when(proven, text.utf16_to_offset(F.col("before_value"), before["selectedRangeLocation"]))


def selected_replacement() -> Column:
    """struct(offset, removed, inserted) of the replaced selection, or of the whole field where it was an unpopulated prompt."""
    was, now, before = F.col("before_value"), F.col("after_value"), F.col("before")
    begin, length = before["selectedRangeLocation"], before["selectedRangeLength"]
    start, end = text.utf16_to_offset(was, begin).cast("int"), text.utf16_to_offset(was, begin + length).cast("int")
    head, tail = F.substring(was, F.lit(1), start), F.substring(was, end + 1, F.length(was))
    room = F.length(now) - F.length(head) - F.length(tail)
    fits = (room >= 0) & F.startswith(now, head) & F.endswith(now, tail)
    edit = lambda o, r, i: F.struct(o.cast("bigint").alias("offset"), r.alias("removed"), i.alias("inserted"))
    chosen = edit(start, F.substring(was, start + 1, end - start), F.substring(now, start + 1, room))
    cursor = F.col("state.cursorContext")
    prompt = (cursor["fieldState"] == "unpopulated_prompt") & (cursor["leftContext"] == "") & (cursor["selectedText"] == "") & (cursor["rightContext"] == "")
    selection = (length > 0) & start.isNotNull() & end.isNotNull()
    return F.when(F.coalesce(selection, F.lit(False)), F.when(fits, chosen)).when(F.coalesce(prompt, F.lit(False)), edit(F.lit(0), was, now))


def with_grounded_edit(writes: DataFrame) -> DataFrame:
    """Replaces edit by the one that the checkpoints ground and adds alignment (rule, states): needs the columns of a write with its observation.

    A replaced selection comes first: its edit shows all that was typed, even what stood there before. It must reproduce the observation, and the last
    checkpoint must have come to the same text. Else an edit that could stand at several places takes the one that the checkpoints
    prove, if no paste could have made them; it never changes its size. Else the smallest edit stands.
    """
    return with_steps(writes, _grounding()).drop("states_", "replaced_", "placed_")


@remembered
def _grounding() -> Steps:
    hints = F.coalesce("inputHints", F.array().cast("array<string>"))
    until = instant(F.coalesce("chosen.observed_at", "terminalSnapshotAt", "terminalDecisionAt"))
    some = F.size(F.coalesce("mutationCheckpoints", F.array())) > 0
    steps: Steps = [{"states_": F.when(some, ordered_states(F.col("mutationCheckpoints"), until))}]
    typed = F.array_contains(hints, "typed") & ~F.arrays_overlap(hints, F.array(*map(F.lit, NOT_TYPED_ALONE)))
    reached = F.try_element_at("states_", F.lit(-1)) == F.col("after_value")
    steps.append({"replaced_": F.when(F.coalesce(some & typed & reached, F.lit(False)), selected_replacement())})
    whole = text.apply_edit(F.col("before_value"), F.col("replaced_.offset"), F.col("replaced_.removed"), F.col("replaced_.inserted")).eqNullSafe(F.col("after_value"))
    other = ~(F.col("replaced_.offset").eqNullSafe(F.col("edit.offset")) & F.col("replaced_.removed").eqNullSafe(F.col("edit.removed")) & F.col("replaced_.inserted").eqNullSafe(F.col("edit.inserted")))
    use = F.col("replaced_").isNotNull() & (F.col("replaced_.inserted") != "") & whole & other
    steps.append({"replaced_": F.when(F.coalesce(use, F.lit(False)), F.col("replaced_"))})
    unpasted = F.size(F.coalesce("pasteCheckpoints", F.array())) == 0
    asked = some & unpasted & F.col("replaced_").isNull() & (F.col("edit.operation") != "none") & F.col("before_value").isNotNull() & F.col("after_value").isNotNull()
    steps.append({"placed_": grounded_place(F.col("before_value"), F.col("after_value"), F.when(asked, F.col("states_")), initial_caret())})
    at = F.col("placed_.offset")
    part = lambda t, n: F.substring(t, at + 1, F.length(n))
    moved = F.struct(F.col("edit.operation").alias("operation"), at.cast("bigint").alias("offset"), part(F.col("before_value"), F.col("edit.removed")).alias("removed"), part(F.col("after_value"), F.col("edit.inserted")).alias("inserted"))
    kind = F.when(F.col("replaced_.removed") == "", "insert").otherwise("replace")
    expanded = F.struct(kind.alias("operation"), F.col("replaced_.offset").alias("offset"), F.col("replaced_.removed").alias("removed"), F.col("replaced_.inserted").alias("inserted"))
    rule = F.when(F.col("replaced_").isNotNull(), REPLACEMENT).when(at.isNotNull(), EQUIVALENT).otherwise(CANONICAL)
    count = F.when(F.col("replaced_").isNotNull(), F.size("states_")).when(at.isNotNull(), F.col("placed_.states")).otherwise(0)
    edit = F.when(F.col("replaced_").isNotNull(), expanded).when(at.isNotNull(), moved).otherwise(F.col("edit"))
    return [*steps, {"alignment": F.struct(rule.alias("rule"), count.alias("states")), "observed_edit": F.col("edit"), "edit": edit}]
