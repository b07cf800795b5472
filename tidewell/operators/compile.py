"""From events to training examples: strictly causal contexts, target exclusions and the multi-session corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import ids, targets, text
from tidewell.operators import conditioning
from tidewell.operators.sequence import ordinal_within

#: Fixed value: least trimmed characters of an authored target.
LEAST_TARGET = 4
#: Fixed value: what stands for a private event.
REDACTED = '{"redacted":true}'


def convertible(events: DataFrame) -> DataFrame:
    """events with rejection: kinds other than read and write, events out of policy, and times that are none or turned around."""
    reason = text.first_reason(
        (~F.coalesce(F.col("kind").isin("read", "write"), F.lit(False)), "not_an_event"),
        (F.col("available_at").isNull(), "available_at_invalid"),
        ((F.col("kind") == "write") & F.col("began_at").isNull(), "began_at_invalid"),
        ((F.col("kind") == "write") & (F.col("available_at") < F.col("began_at")), "available_before_beginning"),
    )
    return events.withColumn("rejection", reason)


def serialized(events: DataFrame) -> Column:
    """A model-facing event: kind, place and text, compact, keys sorted, nulls left out."""
    return ids.canonical_json(kind=F.col("kind"), content=F.col("content"), window=F.col("window_title"))


def _has(events: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(events.columns)


def target_exclusion(events: DataFrame, minimum: int = LEAST_TARGET) -> Column:
    """The first case that keeps a write from being a target, or null. Cases whose columns the events don't have are passed over.

    The least length is that of trimmed typed text, and asked only where nothing was pasted. A state with the field's own strings needs
    all of them; any other needs a cursor whose place, the first change's and the net edit's agree.
    """
    body, cases = F.coalesce("content", F.lit("")), []
    if _has(events, "ineligible"):
        cases.append((F.col("ineligible").isNotNull(), F.col("ineligible")))
    cases.append((body == "", F.lit("empty_content")))
    length, pasted = F.length(text.trimmed(body)), F.lit(False)
    if _has(events, "segments", "authorship"):
        cases.append((F.col("authorship").isNotNull(), F.lit("authorship_unresolved")))
        length = F.coalesce(targets.authored_length(F.col("segments")), length)
        pasted = F.coalesce(F.exists("segments", lambda s: s["type"] == "paste"), F.lit(False))
    cases.append((~pasted & (length < minimum), F.lit("below_minimum_length")))
    cases.append((F.col("began_at").isNull(), F.lit("missing_onset")))
    if _has(events, "conditioning", "fidelity"):
        state = F.from_json("conditioning", conditioning.CONDITIONING)
        cursor, status = state["cursorContext"], F.col("fidelity.status")
        known = F.col("conditioning").isNotNull()  # events without any state are judged by the cases above
        ranged = F.coalesce(state["schemaVersion"] >= conditioning.RANGE, F.lit(False))
        complete = cursor["leftContext"].isNotNull() & cursor["selectedText"].isNotNull() & cursor["rightContext"].isNotNull()
        start = cursor["selectionStartCharacters"]
        old = known & ~ranged
        cases += [
            (known & ranged & ~F.coalesce(complete, F.lit(False)), F.lit("missing_semantic_cursor_context")),
            (old & start.isNull(), F.lit("missing_initial_cursor_context")),
            (old & (status == conditioning.NO_MUTATION), F.lit("missing_earliest_observed_mutation")),
            (old & (status == conditioning.DIFFERS), F.lit(conditioning.DIFFERS)),
            (old & ((status == conditioning.MOVED) | ~F.col("offset").eqNullSafe(start)), F.lit("net_edit_offset_differs_from_initial_cursor")),
            (old & ~status.eqNullSafe(conditioning.ALIGNED), F.lit("missing_cursor_fidelity")),
        ]
    return F.coalesce(*[F.when(condition, reason) for condition, reason in cases])


def _query(events: DataFrame) -> Column:
    plain = ids.canonical_json(query=F.lit("continue"), window=F.col("window_title"))
    return F.coalesce(conditioning.query_text(F.col("conditioning")), plain) if _has(events, "conditioning") else plain


def contexts(events: DataFrame) -> DataFrame:
    """Every accepted write with what came strictly before its onset in its session: number of events, and their ordered digest.

    A prefix is named by its length in the session's order (available_at, line), so contexts share one
    ordered table instead of being written out for each target. Returns (session_id, event_id, began_at, n_context).
    """
    rows = convertible(events).where("rejection is null").withColumn("t", F.col("available_at"))
    both = rows.select("session_id", "t", F.lit(0).alias("is_target"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("long").alias("began_at"))
    onsets = rows.where("kind = 'write'").select("session_id", F.col("began_at").alias("t"), F.lit(1).alias("is_target"), "event_id", "began_at")
    frame = W.partitionBy("session_id").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    counted = both.unionByName(onsets).withColumn("n_context", F.sum(1 - F.col("is_target")).over(frame))
    return counted.where("is_target = 1").select("session_id", "event_id", "began_at", F.coalesce("n_context", F.lit(0)).cast("long").alias("n_context"))


def _judged(events: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(good events with serialized, targets with n_context, query and content, exclusions, rejections)."""
    segmented = _has(events, "segments", "authorship")
    judged = convertible(events)
    rejections = judged.where("rejection is not null").select("session_id", "event_id", "kind", F.col("rejection").alias("reason"))
    good = judged.where("rejection is null").withColumn("serialized", serialized(events))
    writes = good.where("kind = 'write'").withColumn("exclusion", target_exclusion(good, minimum)).withColumn("target_", targets.target_text(F.col("segments")) if segmented else F.col("content"))
    exclusions = writes.where("exclusion is not null").select("session_id", "event_id", F.col("exclusion").alias("reason"), F.length("content").alias("n_chars"))
    wanted = writes.where("exclusion is null").join(contexts(events).drop("began_at"), ["session_id", "event_id"]).select("session_id", F.col("event_id").alias("target_id"), "began_at", F.col("target_").alias("content"), _query(writes).alias("query"), "n_context")
    return good, wanted, exclusions, rejections


def planned_examples(events: DataFrame, minimum: int = LEAST_TARGET) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(plans, blocks, exclusions, rejections): the examples without their histories written out, as rebuild.digests takes them.

    plans: (key, target_id, first, last, cut, query, target), blocks: (key, place, event_id, serialized); a session is a key. Nothing grows with the square of a
    session, and a session's events are placed by ranges.
    """
    good, wanted, exclusions, rejections = _judged(events, minimum)
    placed = ordinal_within(good.select("session_id", "available_at", "line", "event_id", "serialized"), ["session_id"], ["available_at", "line"], "place")
    blocks = placed.select(F.col("session_id").alias("key"), F.col("place").cast("long").alias("place"), "event_id", "serialized")
    plans = wanted.select(F.col("session_id").alias("key"), "target_id", F.lit(0).cast("long").alias("first"), (F.col("n_context") - 1).alias("last"), F.lit(None).cast("long").alias("cut"), "query", F.col("content").alias("target"))
    return plans, blocks, exclusions, rejections


def examples(events: DataFrame, minimum: int = LEAST_TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, exclusions, rejections): each write is in exactly one of them.

    An example holds the context text (events joined by line ends, in order), the query and the target. Where events have segments, a
    target shows a mark for each paste, and a write whose pastes can't be told from what was typed is excluded. The query is what the
    write was conditioned on, where its event has it. Contexts are written out here, for short sessions; planned_examples says the same by places.
    """
    good, wanted, exclusions, rejections = _judged(events, minimum)
    order = W.partitionBy("session_id").orderBy("available_at", "line")
    placed = good.select("session_id", (F.row_number().over(order)).alias("place"), "event_id", "serialized")
    history = wanted.join(placed, "session_id").where(F.col("place") <= F.col("n_context"))
    joined = F.array_sort(F.collect_list(F.struct("place", "event_id", "serialized")))
    history = history.groupBy("session_id", "target_id").agg(joined.alias("h"))
    out = wanted.join(history, ["session_id", "target_id"], "left")
    context = F.coalesce(F.array_join(F.transform("h", lambda x: x["serialized"]), "\n"), F.lit(""))
    out = out.withColumn("context", context)
    out = out.withColumn("model_input", F.when(F.col("context") == "", F.col("query")).otherwise(F.concat("context", F.lit("\n"), "query")))
    context_ids = F.coalesce(F.transform("h", lambda x: x["event_id"]), F.array().cast("array<string>"))
    return out.select("session_id", F.col("target_id").alias("event_id"), "began_at", "n_context", "context", "query", "model_input", context_ids.alias("context_ids"), F.col("content").alias("target")), exclusions, rejections


def corpus_blocks(events: DataFrame, sessions: DataFrame, policy: DataFrame) -> DataFrame:
    """The context blocks of several sessions in order: events, private ones redacted, and a gap between two sessions.

    sessions: (session_id, session_ordinal), not overlapping in time; policy: (event_id) of private events. Adds position, the
    global place of a block: all earlier sessions' blocks and gaps come before, so a context is a prefix length.
    """
    private = policy.select("event_id").distinct().withColumn("private", F.lit(True))
    rows = convertible(events).where("rejection is null").join(sessions, "session_id").join(private, "event_id", "left")
    body = serialized(events)
    shown = F.when(F.col("private"), F.lit(REDACTED)).otherwise(body)
    blocks = rows.select("session_id", "session_ordinal", F.lit("event").alias("block_type"), "event_id", "available_at", "line", shown.alias("serialized"), F.when(F.col("private"), F.sha2(body, 256)).alias("source_sha256"))
    ends = rows.groupBy("session_id", "session_ordinal").agg(F.max("available_at").alias("after_at"), F.min(F.least("available_at", F.coalesce("began_at", "available_at"))).alias("starts_at"))
    w = W.orderBy("session_ordinal")  # one row a session
    gaps = ends.withColumn("before_at", F.lead("starts_at").over(w)).where("before_at is not null")
    gap = ids.canonical_json(block=F.lit("gap"), after=F.col("after_at").cast("string"), before=F.col("before_at").cast("string"))
    gaps = gaps.select("session_id", "session_ordinal", F.lit("gap").alias("block_type"), F.col("after_at").alias("available_at"), F.lit((1 << 62)).alias("line"), gap.alias("serialized"))
    every = blocks.unionByName(gaps, allowMissingColumns=True)
    sizes = every.groupBy("session_ordinal").agg(F.count("*").alias("n_"))
    starts = sizes.select("session_ordinal", F.coalesce(F.sum("n_").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    inside = F.row_number().over(W.partitionBy("session_ordinal").orderBy(F.when(F.col("block_type") == "gap", 1).otherwise(0), "available_at", "line"))
    return every.withColumn("place_", inside).join(starts, "session_ordinal").withColumn("position", F.col("start_") + F.col("place_") - 1).drop("start_", "place_")


def cross_session_context(contexts_: DataFrame, blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds n_blocks: the length of the global prefix of blocks that a target sees, earlier sessions and gaps included."""
    base = blocks.groupBy("session_ordinal").agg(F.min("position").alias("base_"))
    return contexts_.join(sessions, "session_id").join(base, "session_ordinal").withColumn("n_blocks", F.col("base_") + F.col("n_context")).drop("base_")
