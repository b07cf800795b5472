"""Episodes: writes of a session folded into closed targets, and what becomes of each.

Whether a write goes on with an episode depends on the episode's first state and its running last one, so the
fold is sequential inside a session and runs as a grouped map: sessions are spread over tasks, and one session is one group.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import ids, text
from tidewell.operators.conditioning import BROWSERS, CONDITIONING
from tidewell.operators.grounding import sizes

#: Seconds in which a caret revision of one element goes on; least characters and words of a text that persists, and characters of a submitted one.
REVISION_SECONDS, LEAST_CHARS, LEAST_WORDS, LEAST_SUBMITTED = 3.0, 40, 6, 4
#: Fixed value: least characters of a composition that makes a read that shows it no new one.
OWN_TEXT = 12
#: Boundaries that submit, and the markers of a browser's prompt and of an address field.
SUBMITTED, PROMPTS, ADDRESSES = ("return_pressed", "submission_boundary"), ("prompt", "message", "post text", "reply", "search", "address"), ("address", "location", "search combo box")
#: Applications that are prompts throughout, and in one role.
PROMPT_BUNDLE, PROMPT_FIELD = "com.openai.codex", ("com.microsoft.VSCode", "AXTextField")

MEMBER = "session_id string, event_id string, episode long, member long, joined_by string, opened_by string, closed_by string, went_on boolean"
#: What the fold reads of an event; where a table lacks one it is null.
NEEDS = {
    "session_id": "string", "event_id": "string", "kind": "string", "sequence": "long", "content": "string", "app": "string", "bundle": "string", "window_title": "string", "role": "string", "field_description": "string", "field_label": "string",
    "element": "long", "hints": "array<string>", "before_value": "string", "after_value": "string", "began_at": "long", "available_at": "long", "boundary_reason": "string",
}


def _bare(value: str | None) -> str:
    return "".join(c.lower() for c in value or "" if not c.isspace() and c not in "​﻿")


def _spot(before: str, after: str) -> tuple[int, int, int]:
    """Begin of an edit, end of what it put in, and end of the longer of what it removed and put in."""
    at, removed, inserted = sizes(before, after)
    return at, at + inserted, at + max(removed, inserted)


def touches(first_before: str, last_after: str, new_after: str) -> bool:
    """Whether the change from last_after to new_after meets, within a character, what the episode has changed since first_before."""
    begin, end, _ = _spot(first_before, last_after)
    local, _, local_end = _spot(last_after, new_after)
    return local <= end + 1 and local_end >= max(0, begin - 1)


def is_prompt(bundle: str | None, role: str | None, description: str | None, label: str | None) -> bool:
    """Whether a field takes messages that are sent, not text that stays."""
    if bundle == PROMPT_BUNDLE or (bundle, role) == PROMPT_FIELD:
        return True
    words = f"{description or ''} {label or ''}".lower()
    return bundle in BROWSERS and (role == "AXTextArea" or any(m in words for m in PROMPTS))


def _place(r) -> tuple:
    description = re.sub(r"\s+", " ", re.sub(r"(?<=, )[⠀-⣿]+(?= )", "", r.field_description or "")).strip()
    return r.bundle, r.window_title, r.role, description, r.field_label


def _revises(first, members: list, left, right) -> bool:
    """Whether a write goes on inside its composition although the field changed a little since: the same element, soon after a move of the caret."""
    values = (first.before_value, left.after_value, right.before_value, right.after_value)
    if any(v is None for v in values) or left.element is None or left.element != right.element or left.boundary_reason != "pointer_selection_boundary":
        return False
    hints = {h for m in [*members, right] for h in (m.hints if m.hints is not None else ())}
    at, removed, inserted = sizes(first.before_value, left.after_value)
    written = left.after_value[at : at + inserted].strip()
    bridge, _, bridge_end = _spot(left.after_value, right.before_value)
    inside = bridge <= at + max(removed, inserted) + 1 and bridge_end >= max(0, at - 1)
    known = is_prompt(left.bundle, left.role, left.field_description, left.field_label)
    return (
        _place(left) == _place(right) and 0 <= (right.began_at - left.available_at) / 1e6 <= REVISION_SECONDS and not hints & {"paste", "cut"} and len(written) >= LEAST_CHARS and len(re.findall(r"[\w’']+", written)) >= LEAST_WORDS
        and inside and (known or touches(first.before_value, left.after_value, right.after_value)) and left.after_value != right.before_value
    )


def fold_session(rows: pd.DataFrame) -> pd.DataFrame:
    """One session's events in order, into episodes of its writes, with why each was joined, opened and closed.

    A write goes on with the open episode if it has the same destination, starts from the text that the episode left (or from an empty
    prompt where the field began anew, or revises its own composition), touches what it changed, and neither a submission nor a novel
    read lies between. A read is novel unless its text was to be read before the episode began, or shows the composition itself.
    """
    rows = rows.astype(object).where(rows.notna(), None)
    ordered = list(rows.sort_values(["sequence"], kind="stable").itertuples(index=False))
    reads = sorted((r.available_at, k) for k, r in enumerate(ordered) if r.kind == "read" and r.available_at is not None)
    times = [t for t, _ in reads]
    first_seen: dict[str, int] = {}
    for t, k in reads:
        first_seen.setdefault(ordered[k].content, t)
    out, members, episode, opened = [], [], 0, "session_start"

    def close(reason: str, went_on: bool) -> None:
        out.extend((m.session_id, m.event_id, episode, n + 1, why, opened, reason, went_on) for n, (m, why) in enumerate(members))

    for right in (r for r in ordered if r.kind == "write"):
        if not members:
            members, episode = [(right, "first")], episode + 1
            continue
        first, left = members[0][0], members[-1][0]
        before, now, later = first.before_value, left.after_value, right.after_value
        known = is_prompt(left.bundle, left.role, left.field_description, left.field_label)
        composed = ""
        if before is not None and now is not None:
            at, _, n = sizes(before, now)
            composed = now[at : at + n]
        own = _bare(composed)
        novel = False
        for _, k in reads[bisect_right(times, left.available_at) : bisect_left(times, right.began_at)]:
            r = ordered[k]
            repeated = first_seen[r.content] < first.began_at
            shows = r.app == left.app and len(own) >= OWN_TEXT and own in _bare(r.content)
            novel = novel or not (repeated or shows)
        hints = set(left.hints) if left.hints is not None else set()
        same = _place(left) == _place(right)
        exact = now is not None and right.before_value is not None and now == right.before_value
        anew = known and is_prompt(right.bundle, right.role, right.field_description, right.field_label) and same and left.boundary_reason == "write_delay_elapsed" and "return" not in hints and bool(now) and right.before_value == ""
        revision = _revises(first, [m for m, _ in members], left, right)
        goes_on = exact or anew or revision
        region = False
        if before is not None and now is not None and later is not None:
            region = known or touches(before, now, later)
            if known and left.boundary_reason == "selection_navigation" and len(composed.strip()) >= LEAST_CHARS and _spot(now, later)[0] >= _spot(before, now)[1]:
                region = False  # a new composition behind the one that was left
        elif known and goes_on and now is not None and later is not None:
            region = True
        region = region or anew or revision
        submitted = left.boundary_reason in SUBMITTED or (known and "return" in hints)
        if same and goes_on and region and not novel and not submitted:
            members.append((right, "caret_revision" if revision else "prompt_began_anew" if anew and not exact else "same_region"))
            continue
        reason = "prior_submission" if submitted else "novel_read" if novel else "destination_changed" if not same else "state_discontinuity" if not goes_on else "affected_region_changed"
        close(reason, same and goes_on)
        members, episode, opened = [(right, "first")], episode + 1, reason
    if members:
        close("session_end", False)
    return pd.DataFrame(out, columns=[c.split()[0] for c in MEMBER.split(", ")])


def _known(events: DataFrame, **more: str) -> DataFrame:
    """events with all columns that are needed."""
    have = {c.lower() for c in events.columns}
    return events.withColumns({c: F.lit(None).cast(kind) for c, kind in (NEEDS | more).items() if c not in have})


def fold(events: DataFrame) -> DataFrame:
    """(session_id, event_id, episode, member, joined_by, opened_by, closed_by, went_on) for every write of the events."""
    return _known(events).select(*[F.col(c).cast(kind) for c, kind in NEEDS.items()]).groupBy("session_id").applyInPandas(fold_session, MEMBER)


def _prompt(e: Column) -> Column:
    words = F.lower(F.concat_ws(" ", e["field_description"], e["field_label"]))
    marked = F.exists(F.array(*map(F.lit, PROMPTS)), lambda m: F.contains(words, m))
    bundle = e["bundle"]
    return F.coalesce((bundle == PROMPT_BUNDLE) | ((bundle == PROMPT_FIELD[0]) & (e["role"] == PROMPT_FIELD[1])) | (bundle.isin(*BROWSERS) & ((e["role"] == "AXTextArea") | marked)), F.lit(False))


def closure_of(last: Column, prompt: Column, closed_by: Column, went_on: Column) -> Column:
    """How an episode closed: by submission, as a composition or a text that stays, or not at all."""
    hints = F.coalesce(last["hints"], F.array().cast("array<string>"))
    parted = closed_by.isin("novel_read", "destination_changed", "affected_region_changed", "prior_submission", "state_discontinuity")
    return text.first_reason(
        (last["boundary_reason"].isin(*SUBMITTED) | (prompt & F.array_contains(hints, "return")), "closed_submission"),
        ((closed_by == "novel_read") & went_on & prompt, "closed_composition_region"),
        (parted & ~prompt, "closed_persistent_region"),
        ((closed_by == "affected_region_changed") & prompt, "closed_composition_region"),
        (F.lit(True), "open_or_abandoned"),
    )


def closed(events: DataFrame, members: DataFrame) -> DataFrame:
    """One row an episode: members, net edit, closure, onset, availability, eligibility for loss and the reason against it.

    Available at its submission if it was submitted, else at the end of its last write. Only typed text counts towards the least lengths: pasted stretches
    are taken out of the net insertion where each stands in it once, and make the episode unresolved where one doesn't. A submission asks
    for four characters of a prompt alone, everything else for forty and six words. An onset in a prompt must be proven, by an
    empty prompt, a selected field, a recovered start or a novel read before it.
    """
    stated = "conditioning" in events.columns
    rows = _known(events, submitted_at="long", segments="array<struct<type:string,content:string,paste_id:string>>", authorship="string", conditioning="string", ineligible="string").where("kind = 'write'").join(members, ["session_id", "event_id"])
    span = F.struct("member", "event_id", "before_value", "after_value", "boundary_reason", "hints", "bundle", "role", "field_description", "field_label", "segments", "authorship", "conditioning", "ineligible")
    e = rows.groupBy("session_id", "episode").agg(F.array_sort(F.collect_list(F.struct("member", "event_id", span.alias("e")))).alias("m"), F.min("began_at").alias("began_at"), F.max("available_at").alias("ended_at"), F.max("submitted_at").alias("submitted_at"), F.first("opened_by").alias("opened_by"), F.first("closed_by").alias("closed_by"), F.first("went_on").alias("went_on"))
    e = e.withColumn("first_", F.element_at("m", 1)["e"]).withColumn("last_", F.element_at("m", -1)["e"])
    first, last = F.col("first_"), F.col("last_")
    e = e.withColumn("prompt", _prompt(first)).withColumn("state_", F.from_json(first["conditioning"], CONDITIONING))
    before = F.when(first["ineligible"].isNotNull(), "").otherwise(F.coalesce(first["before_value"], F.lit("")))
    e = e.withColumn("edit", text.minimal_edit(before, F.coalesce(last["after_value"], F.lit(""))))
    e = e.withColumn("closure", closure_of(last, F.col("prompt"), F.col("closed_by"), F.col("went_on"))).withColumn("available_at", F.greatest("ended_at", F.coalesce("submitted_at", "ended_at")))
    pastes = F.filter(F.flatten(F.transform("m", lambda x: F.coalesce(x["e"]["segments"], F.array()))), lambda s: s["type"] == "paste")
    e = e.withColumn("pastes_", F.transform(pastes, lambda s: s["content"]))
    whole = F.col("edit.inserted")
    lost = F.exists("m", lambda x: x["e"]["authorship"].isNotNull()) | F.exists("pastes_", lambda p: text.occurrences(p, whole) != 1)
    authored = F.aggregate("pastes_", whole, lambda acc, p: F.replace(acc, p, F.lit("")))
    e = e.withColumn("typed_", text.trimmed(authored))
    cursor, empty = F.col("state_.cursorContext"), F.lit("")
    seen = F.concat(*[F.coalesce(cursor[c], empty) for c in ("leftContext", "selectedText", "rightContext")])
    nothing = (text.without_spaces(first["before_value"]) == "") & (text.without_spaces(seen) == "")
    selected = (first["before_value"] != "") & (F.coalesce(cursor["leftContext"], empty) == "") & (F.coalesce(cursor["rightContext"], empty) == "") & (cursor["selectedText"] == first["before_value"])
    proven = ~F.col("prompt") | first["ineligible"].isNotNull() | (cursor["fieldState"] == "unpopulated_prompt") | nothing | selected | (F.col("opened_by") == "novel_read")
    onset = F.coalesce(proven, F.lit(False)) & (first["conditioning"].isNotNull() if stated else F.lit(True))
    address = (F.coalesce(first["role"], empty) != "AXTextArea") & F.exists(F.array(*map(F.lit, ADDRESSES)), lambda m: F.contains(F.lower(F.concat_ws(" ", first["field_description"], first["field_label"])), m))
    n, words = F.length("typed_"), text.word_count(F.col("typed_"))
    enough = F.when(F.col("prompt") & (F.col("closure") == "closed_submission"), n >= LEAST_SUBMITTED).otherwise((n >= LEAST_CHARS) & (words >= LEAST_WORDS))
    reason = text.first_reason(
        (last["after_value"].isNull() | (whole == ""), "no_surviving_output"),
        ((F.size("pastes_") > 0) & ~lost & (F.col("typed_") == ""), "pure_paste_history_only"),
        (F.coalesce(lost, F.lit(False)), "paste_authorship_unresolved"),
        (address | text.looks_like_address(whole), "instrumental_navigation_or_url"),
        (~onset, "prediction_time_onset_unavailable"),
        (F.col("closure") == "open_or_abandoned", "composition_not_structurally_closed"),
        (~enough, "authored_content_below_substantive_threshold"),
    )
    member_ids = F.transform("m", lambda x: x["event_id"])
    return e.select("session_id", "episode", ids.stable_id("epi_", F.col("session_id"), member_ids, F.lit(0)).alias("episode_id"), member_ids.alias("members"), F.size("m").alias("n_members"), "began_at", "available_at", "opened_by", "closed_by", "closure", F.col("edit.offset").alias("offset"), F.col("edit.removed").alias("removed"), whole.alias("target"), reason.alias("reason"), reason.isNull().alias("has_loss"))


def episode_context(episodes: DataFrame, members: DataFrame, order: DataFrame) -> DataFrame:
    """For each episode: the earlier events of its session with writes mapped to their episodes, each once.

    order: (session_id, event_id, place, available_at) of all events. An episode stands where its first write stood; the
    episode itself and those not yet available at its onset are left out. Returns (episode_id, context array).
    """
    mapped = order.join(members.select("session_id", "event_id", "episode"), ["session_id", "event_id"], "left").join(episodes.select("session_id", "episode", F.col("episode_id").alias("as_id"), F.col("available_at").alias("as_at")), ["session_id", "episode"], "left")
    items = mapped.select("session_id", F.coalesce("as_id", "event_id").alias("item"), F.coalesce("as_at", "available_at").alias("item_at"), "place").groupBy("session_id", "item").agg(F.min("place").alias("place"), F.max("item_at").alias("item_at"))
    met = episodes.select("session_id", "episode_id", "began_at").join(items, "session_id").where((F.col("item_at") < F.col("began_at")) & (F.col("item") != F.col("episode_id")))
    found = met.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("context"))
    return episodes.join(found, "episode_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
