"""Queries of the reducer, the compiler, the packer and the ledgers over records that are made of the tables, with their SQL.

A document stands for a screen observation of its source's window, a turn for a write or a read of its conversation, an
order's lines for a protocol's operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import ids, money, targets, text
from tidewell.operators import audit, causal, packing, protocol, reduce, scorecard
from tidewell.operators import compile as compiled
from tidewell.plans.catalog import PAIRS, query, table

SECOND = 1_000_000


def _stamp(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _journal(rows: DataFrame, kind: str, session: Column, line: Column, **fields: Column) -> DataFrame:
    """Records of one type as a journal has them."""
    raw = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return rows.select(session.cast("string").alias("session_id"), line.cast("long").alias("line"), F.lit(kind).alias("record_type"), raw.alias("raw"))


def _surface(title: Column, shift: Column, high: Column) -> Column:
    bounds = F.struct(shift.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(200.0).alias("width"), high.cast("double").alias("height"))
    return F.struct(F.lit(1).alias("displayID"), F.lit(7).alias("windowID"), title.alias("windowTitle"), bounds.alias("windowBounds"), F.lit(3).alias("processIdentifier"))


@query("""
SELECT doc_id, CASE WHEN lang IS NULL THEN 'missing_record_id' WHEN source IN ('src1', 'src3') THEN 'surface_changed_during_capture' WHEN source = 'src4' THEN 'superseded_by_write'
  WHEN source = 'src5' AND n_chars % 600 < 300 THEN 'auxiliary_surface' WHEN coalesce(text, '') = '' THEN 'empty_content' WHEN n_chars > 5000 THEN 'truncated_content' END AS reason
FROM documents
""")
def read_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's cascade: what keeps each observation from being an event. Surfaces within a point are the same, and only browsers have auxiliary ones."""
    d, source = table(spark, sf_dir, "documents"), F.col("source")
    high = F.when(source == "src5", F.col("n_chars") % 600).otherwise(900)
    shift = F.when(source == "src2", 1).when(source == "src3", 2).otherwise(0)
    post = F.when(source.isin("src1", "src2", "src3"), _surface(F.when(source == "src1", "other").otherwise("w"), shift, high))
    journal = _journal(
        d, "screen_ocr_observation", F.col("source"), F.col("doc_id"), recordID=F.when(F.col("lang").isNotNull(), F.concat(F.lit("r"), "doc_id")), capturedAt=_stamp(F.col("doc_id")), content=F.col("text"), contentWasTruncated=F.col("n_chars") > 5000,
        supersedingWriteAttemptID=F.when(source == "src4", "w"), triggerSurface=_surface(F.lit("w"), F.lit(0), high), postCaptureSurface=post, windowBounds=_surface(F.lit("w"), F.lit(0), high)["windowBounds"], bundleIdentifier=F.when(source == "src5", F.element_at(F.array(F.lit("com.google.Chrome"), F.lit("company.thebrowser.Browser")), (F.col("doc_id") % 2 + 1).cast("int"))).otherwise("org.chromium.app"), processIdentifier=F.lit(3),
        displayID=F.lit(1), windowID=F.lit(7), windowTitle=F.lit("w"),
    )
    return reduce.read_candidates(journal).select(F.col("line").alias("doc_id"), "reason")


ROWS = "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)"
WRITES = f"(SELECT *, CASE WHEN turn % 5 = 1 AND length(before) > 30 THEN '' ELSE before END AS was FROM {ROWS} WHERE nth > 1)"


def _write_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a write over the one before it; where turn % 5 is 1, a long field shows its placeholder instead."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).withColumn("nth", F.row_number().over(w)).where("nth > 1")
    shown = (F.col("turn") % 5 == 1) & (F.length("before") > 30)
    state = lambda v, hint, cut, i: F.struct(v.alias("value"), hint.alias("placeholderValue"), cut.alias("valueWasTruncated"), i.alias("observationID"))
    none = F.lit(None).cast("string")
    hints = F.when(F.col("turn") % 4 == 0, F.array(F.lit("typed"))).when(F.col("turn") % 4 == 1, F.array(F.lit("delete"), F.lit("navigation"))).when(F.col("turn") % 4 == 2, F.array(F.lit("cut"), F.lit("navigation"))).otherwise(F.array(F.lit("paste"), F.lit("typed")))
    return _journal(
        rows, "active_tap_write_attempt", F.col("conv_id"), F.col("turn"), recordID=F.when(F.col("role") != "system", F.concat_ws("-", "conv_id", "turn")), beganAt=_stamp(F.col("turn") * 10), terminalDecisionAt=_stamp(F.col("turn") * 10 + 8), inputHints=hints, tapTimeoutCountDuringBurst=F.when(F.col("conv_id") % 11 == 3, 1),
        before=state(F.col("before"), F.when(shown, F.concat(F.lit(" "), "before")).otherwise(none), F.length("before") > 400, F.lit("b")), after=F.when(F.col("conv_id") % 13 != 5, state(F.col("text"), none, F.length("text") > 450, F.concat_ws("-", F.lit("o"), "turn"))),
        beforeAXErrors=F.when(F.col("conv_id") % 17 == 4, F.array(F.lit("e"))), targetIdentity=F.struct(F.when(F.col("conv_id") % 19 == 6, "AXSecureTextField").otherwise("AXTextArea").alias("role"), F.lit("note").alias("fieldLabel"), F.lit(3).alias("processIdentifier"), F.lit("w").alias("windowTitle")), boundaryReason=F.when(F.col("turn") % 10 == 9, "target_changed").otherwise("write_delay_elapsed"),
    )


#: The edit of each write in SQL, and the cascade over it. A cut writes nothing; a paste that no checkpoint shows stays in history.
CASCADE = f"""(SELECT *, CASE WHEN role = 'system' THEN 'missing_record_id' WHEN conv_id % 11 = 3 THEN 'tap_timeout_during_burst' WHEN conv_id % 19 = 6 THEN 'sensitive_field' WHEN conv_id % 17 = 4 THEN 'before_error' WHEN length(before) > 400 THEN 'before_truncated' WHEN before IS NULL THEN 'before_missing'
  WHEN conv_id % 13 <> 5 AND length(text) > 450 THEN 'observation_truncated' WHEN conv_id % 13 = 5 OR text IS NULL THEN 'no_observation' WHEN turn % 4 = 2 AND length(text) >= length(was) THEN 'cut_did_not_contract' WHEN removed = '' AND inserted = '' THEN 'empty_or_unreproduced_edit'
  WHEN turn % 4 = 1 AND inserted <> '' THEN 'inserted_without_insertion' WHEN turn % 4 <> 3 AND length(removed) >= 16 AND contains(inserted, removed) THEN 'formatting_change'
  WHEN turn % 4 = 0 AND contains(inserted, chr(8203)) THEN 'application_generated_zero_width_scaffold' END AS reason
  FROM (SELECT *, substr(was, p + 1, lb - p - s) AS removed, substr(text, p + 1, lt - p - s) AS inserted FROM (SELECT *, least(s0, least(lb, lt) - p) AS s FROM (SELECT *, length(was) AS lb, length(text) AS lt,
  (SELECT coalesce(max(i), 0) FROM range(1, least(length(was), length(text)) + 1) r(i) WHERE left(was, i) = left(text, i)) AS p,
  (SELECT coalesce(max(i), 0) FROM range(1, least(length(was), length(text)) + 1) r(i) WHERE right(was, i) = right(text, i)) AS s0 FROM {WRITES}))))"""


@query(f"""SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN p END AS edit_offset, CASE WHEN reason IS NULL THEN sha256(CASE WHEN turn % 4 = 2 THEN '' ELSE inserted END) END AS content_sha256,
CASE WHEN reason IS NULL AND turn % 4 = 3 THEN 'paste_checkpoint_missing' END AS authorship FROM {CASCADE}""")
def write_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writer's cascade in its order, the net edit of each write that passes, and why its pastes can't be told apart."""
    w = reduce.write_candidates(_write_journal(spark, sf_dir))
    good = F.col("reason").isNull()
    return w.select(F.col("session_id").cast("long").alias("conv_id"), F.col("line").alias("turn"), "reason", F.when(good, F.col("offset")).alias("edit_offset"), F.when(good, F.sha2("content", 256)).alias("content_sha256"), F.when(good, F.col("authorship")).alias("authorship"))


@query(f"""
WITH w AS (SELECT *, conv_id % 13 = 5 OR text IS NULL OR length(text) > 450 AS lost FROM {WRITES} WHERE role <> 'system'),
c AS (SELECT conv_id, turn AS closure_line, turn - 1 AS of_turn, 0 AS k, turn, before FROM {ROWS} WHERE nth > 1 UNION ALL SELECT conv_id, turn + 1000, turn - 1, 1, turn, before FROM {ROWS} WHERE nth > 1 AND turn % 3 = 0),
j AS (SELECT c.*, CASE WHEN w.conv_id IS NULL THEN 'closure_source_write_missing' WHEN w.lost OR of_turn % 10 = 9 OR c.turn % 7 = 3 AND k = 0 THEN 'closure_terminal_observation_mismatch'
    WHEN w.text = '' OR c.turn % 9 = 4 AND k = 0 THEN 'closure_pre_action_state_mismatch' WHEN c.turn % 8 = 5 AND k = 0 THEN 'closure_action_or_timing_invalid' WHEN c.turn % 11 = 6 AND k = 0 THEN 'closure_action_not_semantically_submissive'
    WHEN c.turn % 13 = 7 AND k = 0 THEN 'closure_post_action_transition_invalid' END AS why FROM c LEFT JOIN w ON w.conv_id = c.conv_id AND w.turn = c.of_turn WHERE c.turn % 7 <> 2 OR k = 1)
SELECT conv_id, closure_line, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY conv_id, of_turn, why IS NULL ORDER BY closure_line) > 1 THEN 'duplicate_confirmed_closure_for_write' END) AS reason FROM j
""")
def submission_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which confirmed submission closes which write: each check of the evidence in its order, the first valid one of several."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).withColumn("nth", F.row_number().over(w)).where("nth > 1")
    turn, none = F.col("turn"), F.lit(None).cast("string")
    state = lambda v: F.struct(v.alias("value"), F.lit("x").alias("observationID"))

    def record(r: DataFrame, line: Column, first: bool) -> DataFrame:
        at = lambda m, rest: (turn % m == rest) & F.lit(first)
        gone = turn % 2 == 0
        how = F.when(at(7, 2), "prompt_remained_populated").when(gone, "confirmed_field_disappeared").when(turn % 4 == 1, "confirmed_field_cleared").otherwise("confirmed_placeholder_restored")
        click = F.struct(F.lit("pointer_click").alias("kind"), _stamp(turn * 10 + 1).alias("observedAt"), F.when(at(11, 6), "cancel").otherwise("send").alias("matchedSubmissionTerm"))
        key = F.struct(F.when(at(11, 6), "modified_return").otherwise("unmodified_return").alias("kind"), _stamp(turn * 10 + 1).alias("observedAt"), none.alias("matchedSubmissionTerm"))
        return _journal(
            r, "prompt_submission_observation", F.col("conv_id"), line, recordID=F.concat_ws("-", F.lit("c"), "conv_id", line), sourceWriteRecordID=F.concat_ws("-", "conv_id", turn - 1), terminalObservationID=F.when(at(7, 3), "other").otherwise(F.concat_ws("-", F.lit("o"), turn - 1)), disposition=how,
            terminalValueSHA256=F.sha2("before", 256), terminalCharacterCount=F.length("before") + F.when(at(9, 4), 1).otherwise(0), preActionObservation=state(F.col("before")), referenceRetainedAt=_stamp(turn * 10), action=F.when(turn % 3 == 1, click).otherwise(key),
            observedAt=_stamp(turn * 10 + F.when(at(8, 5), -1).otherwise(2)), postActionObservation=F.when(~gone, state(F.when(at(13, 7), "left").otherwise(""))), postActionAXErrors=F.when(gone, F.array(F.when(at(13, 7), "timeout").otherwise("kAX_Invalid_UI_Element"))),
        )

    journal = _write_journal(spark, sf_dir).union(record(rows, turn, True)).union(record(rows.where("turn % 3 = 0"), turn + 1000, False))
    return reduce.closures(journal).select(F.col("session_id").cast("long").alias("conv_id"), "closure_line", "reason")


@query(f"""
SELECT r.conv_id, r.turn AS read_turn, max(p.i) AS shown FROM {PAIRS} w JOIN {PAIRS} r ON r.conv_id = w.conv_id AND r.turn BETWEEN w.turn AND w.turn + 2,
  LATERAL (SELECT max(i) AS i FROM range(24, least(512, length(lower(w.text))) + 1) x(i) WHERE contains(lower(trim(regexp_replace(r.text || ' ' || r.before, '[ \\t\\r\\n]+', ' ', 'g'))), left(lower(trim(regexp_replace(w.text, '[ \\t\\r\\n]+', ' ', 'g'))), i))
    AND i <= length(trim(regexp_replace(w.text, '[ \\t\\r\\n]+', ' ', 'g')))) p
WHERE p.i IS NOT NULL GROUP BY r.conv_id, r.turn
""")
def contaminated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads inside a write's span that show a prefix of what it wrote: a turn, shown with the one before it, against the writes two turns back."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    key = [F.col("conv_id").cast("string").alias("session_id"), F.lit(1).alias("pid"), F.col("turn").cast("long").alias("record_id")]
    reads = rows.select(*key, (F.col("turn") * 10).cast("long").alias("captured_at"), F.concat_ws(" ", "text", "before").alias("content"))
    writes = rows.select(*key, (F.col("turn") * 10).cast("long").alias("began_at"), (F.col("turn") * 10 + 20).cast("long").alias("terminal_at"), F.col("text").alias("content"))
    out = reduce.contaminated_reads(reads, writes, 30)
    return out.select(F.col("session_id").cast("long").alias("conv_id"), F.col("read_id").alias("read_turn"), F.col("shown").cast("long").alias("shown"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: a user's write from the turn's second on for half a second, others read; a few broken ones."""
    t = (F.col("turn") * SECOND).cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.col("turn").cast("long").alias("line"), F.when(F.col("turn") % 11 == 10, "note").when(F.col("role") == "user", "write").otherwise("read").alias("kind"),
        F.when(F.col("conv_id") % 23 != 9, t).alias("began_at"), F.when(F.col("conv_id") % 29 != 8, t + F.when(F.col("turn") % 6 == 4, -5).otherwise(500_000)).alias("available_at"), F.when(F.col("conv_id") % 7 == 6, F.left("text", F.lit(3))).otherwise(F.col("text")).alias("content"), F.lit("w").alias("window_title"),
    )


EVENTS = f"""(SELECT conv_id, turn, CASE WHEN turn % 11 = 10 THEN 'note' WHEN role = 'user' THEN 'write' ELSE 'read' END AS kind, CASE WHEN conv_id % 23 <> 9 THEN turn * {SECOND} END AS began_at,
  CASE WHEN conv_id % 29 <> 8 THEN turn * {SECOND} + CASE WHEN turn % 6 = 4 THEN -5 ELSE 500000 END END AS available_at, CASE WHEN conv_id % 7 = 6 THEN left(text, 3) ELSE text END AS content FROM conversations)"""
REJECTED = f"""(SELECT *, CASE WHEN kind = 'note' THEN 'not_an_event' WHEN available_at IS NULL THEN 'available_at_invalid' WHEN kind = 'write' AND began_at IS NULL THEN 'began_at_invalid'
  WHEN kind = 'write' AND available_at < began_at THEN 'available_before_beginning' END AS rejection FROM {EVENTS})"""


@query(f"""
SELECT conv_id, turn, rejection, CASE WHEN kind = 'write' AND rejection IS NULL THEN CASE WHEN coalesce(content, '') = '' THEN 'empty_content' WHEN length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) < 4 THEN 'below_minimum_length' END END AS exclusion FROM {REJECTED}
""")
def target_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps an event out of the data set, and a write from being a target."""
    rows = compiled.convertible(_events(spark, sf_dir))
    excluded = F.when((F.col("kind") == "write") & F.col("rejection").isNull(), compiled.target_exclusion(rows))
    key = F.split("event_id", "-")
    return rows.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "rejection", excluded.alias("exclusion"))


@query(f"""
WITH g AS (SELECT * FROM {REJECTED} WHERE rejection IS NULL)
SELECT t.conv_id, t.turn, count(e.turn) AS n_context FROM g t LEFT JOIN g e ON e.conv_id = t.conv_id AND e.available_at < t.began_at WHERE t.kind = 'write' GROUP BY t.conv_id, t.turn
""")
def context_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every accepted write how many accepted events were available strictly before its onset: its context is that prefix."""
    key = F.split("event_id", "-")
    return compiled.contexts(_events(spark, sf_dir)).select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "n_context")


@query(f"""
WITH g AS (SELECT * FROM {REJECTED} WHERE rejection IS NULL),
b AS (SELECT conv_id, 0 AS gap, available_at AS tm, turn, NULL AS nxt FROM g
  UNION ALL SELECT conv_id, 1, max(available_at), 4611686018427387904, lead(min(least(available_at, coalesce(began_at, available_at)))) OVER (ORDER BY conv_id) FROM g GROUP BY conv_id),
k AS (SELECT * FROM b WHERE gap = 0 OR nxt IS NOT NULL),
m AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT conv_id, CASE WHEN gap = 1 THEN 'gap' ELSE 'event' END AS block_type, CASE WHEN gap = 0 THEN turn END AS turn, row_number() OVER (ORDER BY conv_id, gap, tm, turn) - 1 AS position,
  CASE WHEN gap = 0 THEN conv_id * 10 + turn IN (SELECT doc_id FROM m) END AS redacted FROM k
""")
def corpus_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as one corpus in order: events, private ones redacted, and a gap between two sessions."""
    events = _events(spark, sf_dir)
    sessions = events.select("session_id", F.col("session_id").cast("long").alias("session_ordinal")).distinct()
    key = F.split("event_id", "-")
    policy = events.withColumn("doc_id", key[0].cast("long") * 10 + key[1].cast("long")).join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    rows = compiled.corpus_blocks(events, sessions, policy.select("event_id"))
    is_event = F.col("block_type") == "event"
    return rows.select(F.col("session_ordinal").alias("conv_id"), "block_type", F.when(is_event, key[1].cast("long")).alias("turn"), F.col("position").cast("long").alias("position"), F.when(is_event, F.col("serialized") == compiled.REDACTED).alias("redacted"))


SEGMENTS = "list_filter([{'type': 'authored_text', 'content': left(text, 40)}, {'type': 'paste', 'content': substr(text, 41, 40)}, {'type': 'authored_text', 'content': substr(text, 81)}], lambda s: s.content <> '')"


@query(f"""
WITH x AS (SELECT conv_id, turn, text, {SEGMENTS} AS s FROM conversations),
y AS (SELECT *, len(list_filter(s, lambda z: z.type = 'paste')) > 0 AS p, len(list_filter(s, lambda z: z.type = 'authored_text')) > 0 AS a, trim(array_to_string(list_transform(list_filter(s, lambda z: z.type = 'authored_text'), lambda z: z.content), ''), chr(32) || chr(9) || chr(10) || chr(13)) AS own FROM x)
SELECT conv_id, turn, sha256(array_to_string(list_transform(s, lambda z: CASE WHEN z.type = 'paste' THEN '<|paste|>' ELSE z.content END), '')) AS target_sha256, array_to_string(list_transform(s, lambda z: z.content), '') = text AS whole,
  CASE WHEN p AND a THEN 'mixed' WHEN p THEN 'paste_only' WHEN a THEN 'authored_only' ELSE 'empty' END AS stratum, length(own) AS authored, len(list_filter(s, lambda z: z.type <> 'paste')) AS n_shown FROM y
""")
def target_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as segments: their text with a mark for each paste, their stratum, and what a model may see of them."""
    t = F.col("text")
    one = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("content"))
    segments = F.filter(F.array(one("authored_text", F.left(t, F.lit(40))), one("paste", F.substring(t, 41, 40)), one("authored_text", F.substring(t, F.lit(81), F.length(t)))), lambda s: s["content"] != "")
    rows = table(spark, sf_dir, "conversations").withColumn("s", segments)
    shown = F.size(F.filter(targets.without_payloads(F.col("s")), lambda s: s["content"].isNotNull()))
    whole = targets.content_of(F.lit(None).cast("string"), F.col("s")) == t
    return rows.select("conv_id", "turn", F.sha2(targets.target_text(F.col("s")), 256).alias("target_sha256"), whole.alias("whole"), targets.stratum(F.col("s")).alias("stratum"), targets.authored_length(F.col("s")).cast("long").alias("authored"), shown.cast("long").alias("n_shown"))


BYTES = "list_transform(range(1, octet_length(encode({t})) + 1), lambda i: ('0x' || substr(hex(encode({t})), 2 * i - 1, 2))::INT + 3)"


@query(f"""
WITH x AS (SELECT conv_id, turn, {BYTES.format(t="before")} AS i, list_append({BYTES.format(t="text")}, 1) AS o FROM {PAIRS}),
y AS (SELECT *, list_concat(i, o) AS s, list_concat(list_transform(i, lambda v: -100), o) AS l, max(len(i) + len(o)) OVER (PARTITION BY conv_id) AS most FROM x)
SELECT conv_id, turn, len(s) AS n_tokens, sha256(array_to_string(s, ',')) AS tokens_sha256, sha256(array_to_string(l, ',')) AS labels_sha256, len(o) AS n_loss, most - len(s) AS n_padding,
  sha256(array_to_string(list_concat(s, list_transform(range(0, most - len(s)), lambda v: 0)), ',')) AS padded_sha256 FROM y
""")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed as inputs and targets by the byte tokenizer: labels on the target alone, shifted, filled up to the longest of a batch."""
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    rows = packing.tokenized(packing.tokenized(rows, "before", "input_ids"), "text", "own")
    rows = rows.withColumn("target_ids", packing.target_tokens(F.array(F.struct(F.lit("authored_text").alias("type"), F.col("own").alias("tokens")))))
    rows = packing.padded(packing.with_labels(rows), "conv_id")
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda v: v.cast("string")), ","), 256)
    loss = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).cast("long")
    filled = F.size(F.filter("mask", lambda m: m == 0)).cast("long")
    return rows.select("conv_id", "turn", F.size("sequence_ids").cast("long").alias("n_tokens"), digest("sequence_ids").alias("tokens_sha256"), digest("labels").alias("labels_sha256"), loss.alias("n_loss"), filled.alias("n_padding"), digest("padded").alias("padded_sha256"))


@query("""
SELECT o_orderpriority AS block, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') / count(*) AS accepted, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') / count(*) >= 0.98 THEN 'intact' ELSE 'material_deterioration' END AS state,
  count(*) FILTER (o_orderstatus = 'F') AS n_accepted, count(*) FILTER (o_orderstatus = 'P') AS n_truncated, count(*) FILTER (o_orderstatus = 'O') AS n_missing FROM
  (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS x, o_orderstatus FROM orders) GROUP BY o_orderpriority
""".replace("o_orderstatus <> 'P'", "o_orderstatus = 'F'"))
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of generations (finished orders were accepted, pending ones cut, open ones never came) and whether a stage may go on."""
    status = F.col("o_orderstatus")
    what = protocol.disposition(F.when(status == "P", "length").otherwise("stop"), F.when(status != "O", "text"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("block"), what.alias("disposition"))
    counts = protocol.outcomes(rows, ["block"]).select("block", *[F.col(c).alias(f"n_{c}") for c in ("accepted", "truncated", "missing")])
    return protocol.gate(rows).join(counts, "block")


@query("""
WITH o AS (SELECT l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS place, CAST(sum(l_quantity) AS BIGINT) AS amount FROM lineitem GROUP BY ALL),
c AS (SELECT kind, sum(amount) * 9 // 10 AS ceiling FROM o GROUP BY kind), r AS (SELECT *, sum(amount) OVER (PARTITION BY kind ORDER BY place) AS running FROM o)
SELECT kind, place, amount, CAST(running AS BIGINT) AS running FROM r JOIN c USING (kind) WHERE running > ceiling
""")
def budget_overruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations at which the running amount of their kind passes nine tenths of its total."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), "l_quantity").groupBy("kind", "place").agg(F.sum("l_quantity").cast("long").alias("amount"))
    ceilings = o.groupBy("kind").agg(F.floor(F.sum("amount") * 9 / 10).alias("ceiling"))
    return protocol.over_budget(o, ceilings).select("kind", "place", "amount", "running")


@query("""
SELECT max(abs(a.v - b.v)) AS largest, count(*) FILTER (a.p IS DISTINCT FROM b.p) AS texts, count(*) FILTER (a.s IS DISTINCT FROM b.s) AS stops, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS missing, false AS passes
FROM (SELECT o_orderkey AS k, o_totalprice AS v, o_orderpriority AS p, o_orderstatus AS s FROM orders) a
FULL JOIN (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS DOUBLE) AS v, max(l_returnflag) AS p, max(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey) b ON a.k = b.k
""")
def reload_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two runs scored alike: here orders against what their lines say, which they must not."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), F.col("o_totalprice").alias("nll"), F.col("o_orderpriority").alias("prediction"), F.col("o_orderstatus").alias("finish"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("example_id")).agg(F.sum("l_quantity").cast("double").alias("nll"), F.max("l_returnflag").alias("prediction"), F.max("l_linestatus").alias("finish"))
    return protocol.parity(a, b, 1e-6)


@query("""
SELECT l_returnflag AS arm, count(*) AS calls, CAST(sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS prefill, CAST(sum(l_linenumber) AS BIGINT) AS sampled,
  CAST(sum(round_even(CAST(CAST(l_partkey AS DECIMAL(18,0)) * 5 / 1000000 AS DECIMAL(38,12)), 6) + round_even(CAST(CAST(l_linenumber AS DECIMAL(18,0)) * 30 / 1000000 AS DECIMAL(38,12)), 6)) AS DOUBLE) AS flat_cost FROM lineitem GROUP BY l_returnflag
""")
def usage_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of nested usage fields, some of them missing, and the flat price of the same calls."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.struct(F.when(n % 3 != 0, F.col("l_quantity").cast("long")).alias("prefill"), n.cast("long").alias("sampled")).alias("usage"), money.flat_cost(F.col("l_partkey"), n).alias("cost"))
    return protocol.usage(rows, ["arm"], ["prefill", "sampled"]).join(rows.groupBy("arm").agg(F.sum("cost").cast("double").alias("flat_cost")), "arm")


@query("""
WITH j AS (SELECT *, '{"mode":"' || l_linestatus || '","part":' || l_partkey || CASE WHEN l_returnflag = 'R' THEN ',"returned":true' ELSE '' END || '}' AS line FROM lineitem)
SELECT l_orderkey, sha256(string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, line)) AS digest, round(sum(CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE CAST(l_discount AS DOUBLE) END), 9) AS nll FROM j GROUP BY l_orderkey
""")
def ordered_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over each order's lines as canonical JSON in order, nulls left out, and the loss of those that count."""
    line = ids.canonical_json(part=F.col("l_partkey"), mode=F.col("l_linestatus"), returned=F.when(F.col("l_returnflag") == "R", F.lit(True)))
    rows = table(spark, sf_dir, "lineitem").withColumn("json", line)
    order = F.struct("l_linenumber", "l_partkey")
    x = rows.groupBy("l_orderkey").agg(ids.ordered_digest(order, F.col("json")).alias("digest"), F.collect_list(F.struct(-F.col("l_discount").cast("double"), F.when(F.col("l_returnflag") == "A", -100).otherwise(1))).alias("p"))
    nll = scorecard.weighted_nll(F.transform("p", lambda v: v["col1"]), F.transform("p", lambda v: v["col2"]))
    return x.select("l_orderkey", "digest", F.round(nll, 9).alias("nll"))


@query("""
SELECT 'items in no group' AS rule, count(*) AS violations FROM partsupp_like WHERE n = 0
UNION ALL SELECT 'items in two groups', count(*) FROM partsupp_like WHERE n > 1 UNION ALL SELECT 'members that are no items', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
""".replace("partsupp_like", "(SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)"))
def partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part is in exactly one order, as an audit: the rules and how often each is broken."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"))
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("members"))
    return audit.counted(audit.exact_partition(parts, groups, "item", "members"))


@query(r"""
WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(low, '\bdigit\s+\d+\s+of\s+\d+\b') THEN 'segmented_verification_code' WHEN {sensitive} THEN 'credential_or_verification_field' END AS sensitive,
  {terms} AS submit_term, sha256(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS line_sha256, regexp_full_match(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '(https?://)?\S+\.\S+/?') AS is_address FROM d
""".format(sensitive=" OR ".join(f"contains(low, '{w}')" for w in text.SENSITIVE), terms="list_filter([" + ", ".join(f"'{t}'" for t in text.SUBMIT_TERMS) + r"], lambda t: list_contains(regexp_split_to_array(low, '[^\p{L}\p{N}]+'), t))[1]"))
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for fields, over whole texts: sensitive ones, a submission's term, the normalized line, an address."""
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", text.sensitive_category(F.lit(None).cast("string"), t).alias("sensitive"), text.submit_term(t).alias("submit_term"), F.sha2(text.normalized_line(t), 256).alias("line_sha256"), text.looks_like_address(t).alias("is_address"))


@query("""
SELECT doc_id, n_chars % 97 AS caret, list_filter([n_chars % 50, n_chars % 80, n_chars % 110], lambda x: abs(x - n_chars % 97) = least(abs(n_chars % 50 - n_chars % 97), abs(n_chars % 80 - n_chars % 97), abs(n_chars % 110 - n_chars % 97))) AS near FROM documents
""".replace("SELECT doc_id", "SELECT doc_id, caret, CASE WHEN len(near) = 1 THEN near[1] END AS nearest FROM (SELECT doc_id", 1).rstrip() + ")")
def nearest_carets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of some places the one nearest to a caret; none if two are as near."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", (n % 97).alias("caret"), targets.nearest_unique(F.array(n % 50, n % 80, n % 110), n % 97).alias("nearest"))


@query("""
SELECT e.user_id, e.event_id, max(w.event_id) AS closing FROM events e LEFT JOIN events w ON w.user_id = e.user_id AND w.event_type IN ('purchase', 'signup') AND epoch_us(w.ts) > epoch_us(e.ts) AND epoch_us(w.ts) <= epoch_us(e.ts) + 7200000000
  AND epoch_us(w.ts) = (SELECT max(epoch_us(x.ts)) FROM events x WHERE x.user_id = e.user_id AND x.event_type IN ('purchase', 'signup') AND epoch_us(x.ts) > epoch_us(e.ts) AND epoch_us(x.ts) <= epoch_us(e.ts) + 7200000000)
WHERE e.event_type NOT IN ('purchase', 'signup') GROUP BY e.user_id, e.event_id
""")
def latest_overtaking_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each read the latest write of the two hours after it, as a range frame over one sort of the key."""
    rows = table(spark, sf_dir, "events").withColumn("t", causal.micros(F.col("ts"))).withColumn("w", F.col("event_type").isin("purchase", "signup"))
    frame = W.partitionBy("user_id").orderBy("t").rangeBetween(1, 7_200_000_000)
    last = F.max_by(F.when(F.col("w"), F.col("event_id")), F.when(F.col("w"), F.struct("t", "event_id"))).over(frame)
    return rows.withColumn("closing", last).where("not w").select("user_id", "event_id", "closing")
