"""Queries of the engine over the tables, and the SQL that says the same.

Roles of the tables: ``events`` are an event stream (purchase and signup write, the others read; user_id is the session),
``conversations`` an ordered stream of texts, ``documents`` of a source are viewports that follow each other, and
``lineitem`` and ``orders`` stand for token counts, costs and lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import ids, money, text
from tidewell.operators import causal, scorecard, sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t (microseconds) and is_write."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("t", causal.micros(F.col("ts"))).withColumn("is_write", F.col("event_type").isin("purchase", "signup"))


#: The same in SQL.
STREAM = "(SELECT *, epoch_us(ts) AS t, event_type IN ('purchase', 'signup') AS is_write FROM events)"
HOUR = 3_600_000_000


@query("""
SELECT t.conv_id AS conv_id, t.turn AS turn, count(p.text) AS n_context,
  sha256(coalesce(string_agg(p.text, chr(10) ORDER BY p.turn), '')) AS context_sha256
FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') t
LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn < t.turn
GROUP BY t.conv_id, t.turn
""")
def causal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every user turn: how many turns come strictly before it, and the digest of their joined text."""
    return causal.prefix_digests(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").where("role = 'user'").select("conv_id", "turn", "n_context", "context_sha256")


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM {STREAM}")
def causal_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of the user come strictly before each."""
    return causal.causal_count(stream(spark, sf_dir), "user_id", "t").select("event_id", "n_before")


@query(f"""
SELECT e.event_id, max(w.event_id) AS last_write
FROM {STREAM} e LEFT JOIN {STREAM} w ON w.user_id = e.user_id AND w.is_write AND w.t = (
  SELECT max(x.t) FROM {STREAM} x WHERE x.user_id = e.user_id AND x.is_write AND x.t < e.t)
GROUP BY e.event_id
""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest write strictly before each event."""
    rows = causal.asof_backward(stream(spark, sf_dir), "user_id", "t", F.col("is_write"), F.col("event_id"), "last_write")
    return rows.select("event_id", "last_write")


@query(f"""
SELECT e.event_id, min(w.event_id) AS next_write
FROM {STREAM} e LEFT JOIN {STREAM} w ON w.user_id = e.user_id AND w.is_write AND w.t = (
  SELECT min(x.t) FROM {STREAM} x WHERE x.user_id = e.user_id AND x.is_write AND x.t > e.t)
GROUP BY e.event_id
""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest write strictly after each event."""
    rows = causal.asof_forward(stream(spark, sf_dir), "user_id", "t", F.col("is_write"), F.col("event_id"), "next_write")
    return rows.select("event_id", "next_write")


@query(f"""
SELECT event_id, array_to_string(list(CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), ',') AS next_ids
FROM {STREAM}
""")
def next_k_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five events after each."""
    rows = causal.neighbours(stream(spark, sf_dir), "user_id", ["t", "event_id"], 1, 5, F.col("event_id").cast("string"), "near")
    return rows.select("event_id", F.nullif(F.array_join("near", ","), F.lit("")).alias("next_ids"))


@query(f"""
SELECT event_id, array_to_string(list(CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS prior_ids
FROM {STREAM}
""")
def prior_k_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three events before each."""
    rows = causal.neighbours(stream(spark, sf_dir), "user_id", ["t", "event_id"], -3, -1, F.col("event_id").cast("string"), "near")
    return rows.select("event_id", F.nullif(F.array_join("near", ","), F.lit("")).alias("prior_ids"))


#: Reads were last active at t and captured two hours later; writes last an hour.
READS = f"(SELECT user_id, event_id AS read_id, t AS last_activity, t + {2 * HOUR} AS captured_at FROM {STREAM} WHERE NOT is_write)"
WRITES = f"(SELECT user_id, event_id AS write_id, t AS began_at, t + {HOUR} AS terminal_at FROM {STREAM} WHERE is_write)"


def reads_and_writes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stream(spark, sf_dir)
    reads = rows.where("not is_write").select("user_id", F.col("event_id").alias("read_id"), F.col("t").alias("last_activity"), (F.col("t") + 2 * HOUR).alias("captured_at"))
    writes = rows.where("is_write").select("user_id", F.col("event_id").alias("write_id"), F.col("t").alias("began_at"), (F.col("t") + HOUR).alias("terminal_at"))
    return reads, writes


@query(f"""
SELECT r.user_id, r.read_id, arg_min(w.write_id, row(w.began_at, w.write_id)) AS write_id, min(w.began_at) AS began_at
FROM {READS} r JOIN {WRITES} w ON r.user_id = w.user_id AND r.last_activity < w.began_at AND w.began_at <= r.captured_at AND r.captured_at <= w.terminal_at
GROUP BY r.user_id, r.read_id
""")
def stale_read_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that a write overtook between their activity and their capture, with that write."""
    return causal.superseded_reads(*reads_and_writes(spark, sf_dir), ["user_id"], 4 * HOUR)


@query(f"""
SELECT r.user_id, count(*) AS n_accepted FROM {READS} r WHERE NOT EXISTS (
  SELECT 1 FROM {WRITES} w WHERE r.user_id = w.user_id AND r.last_activity < w.began_at AND w.began_at <= r.captured_at AND r.captured_at <= w.terminal_at)
GROUP BY r.user_id
""")
def accepted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per user that no write overtook."""
    reads, writes = reads_and_writes(spark, sf_dir)
    stale = causal.superseded_reads(reads, writes, ["user_id"], 4 * HOUR)
    return reads.join(stale, ["user_id", "read_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n_accepted"))


@query(f"""
SELECT a.event_id AS a_id, b.event_id AS b_id
FROM {STREAM} a JOIN {STREAM} b ON a.user_id = b.user_id AND a.is_write AND NOT b.is_write
  AND a.t <= b.t + {3 * HOUR} AND b.t <= a.t + {6 * HOUR}
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of six hours and reads of three that overlap."""
    rows = stream(spark, sf_dir)
    a = rows.where("is_write").select("user_id", F.col("event_id").alias("a_id"), F.col("t").alias("a_from"), (F.col("t") + 6 * HOUR).alias("a_to"))
    b = rows.where("not is_write").select("user_id", F.col("event_id").alias("b_id"), F.col("t").alias("b_from"), (F.col("t") + 3 * HOUR).alias("b_to"))
    return causal.interval_join(a, b, ["user_id"], ("a_from", "a_to"), ("b_from", "b_to"), 12 * HOUR).select("a_id", "b_id")


@query(f"""
WITH e AS (SELECT *, sum(is_write::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS span,
  count(*) OVER (PARTITION BY user_id, props ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {STREAM})
SELECT user_id, span, count(*) AS n_reads, count(*) FILTER (seen > 0) AS n_repeats, count(*) FILTER (seen = 0) AS n_novel
FROM e WHERE NOT is_write GROUP BY user_id, span
""")
def between_reads_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads between two writes of a user, as exact repeats of an earlier payload or novel."""
    order = ["t", "event_id"]
    rows = stream(spark, sf_dir).withColumn("span", F.sum(F.col("is_write").cast("int")).over(W.partitionBy("user_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("seen", F.row_number().over(W.partitionBy("user_id", "props").orderBy(*order)) > 1).where("not is_write")
    return rows.groupBy("user_id", "span").agg(F.count("*").alias("n_reads"), F.count_if("seen").alias("n_repeats"), F.count_if(~F.col("seen")).alias("n_novel"))


@query(f"""
WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < {6 * HOUR} THEN 0 ELSE 1 END AS begins FROM {STREAM}),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS n_events, min(t) AS first_t, max(t) AS last_t, round(sum(value), 4) AS total
FROM s GROUP BY user_id, session
""")
def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events less than six hours apart."""
    rows = sequence.gap_sessions(stream(spark, sf_dir), ["user_id"], "t", ["t", "event_id"], 6 * HOUR)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND t - lag(t) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS begins FROM {STREAM} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS members
FROM s GROUP BY user_id, island
""")
def navigation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of like events no more than twelve hours apart, merged into one row with the ordered members."""
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    joined = (F.col("event_type") == F.lag("event_type").over(w)) & (F.col("t") - F.lag("t").over(w) <= 12 * HOUR)
    rows = sequence.islands(stream(spark, sf_dir), ["user_id"], ["t", "event_id"], joined)
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return rows.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), members.alias("members"))


@query(f"""
SELECT event_id, count(*) FILTER (p.t IS NOT NULL) AS n_linked, coalesce(sum(p.value), 0) > 100 AS reached FROM (
  SELECT e.event_id, p.t, p.value FROM {STREAM} e LEFT JOIN {STREAM} p ON e.is_write AND p.user_id = e.user_id AND p.t < e.t AND p.t >= e.t - {24 * HOUR}
  WHERE e.is_write) p GROUP BY event_id
""")
def day_before_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each write: the events of the day before it, and whether they carry enough, as a range frame."""
    return carried_before(stream(spark, sf_dir)).where("is_write").select("event_id", "n_linked", "reached")


def carried_before(rows: DataFrame) -> DataFrame:
    """Adds n_linked and reached: how many events lie in the day before, and whether their values sum to more than 100.

    Values are summed as the decimals they are written as: a sum of doubles near 100 depends on the order it is taken in. Values
    that such decimals can't hold are summed as doubles.
    """
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-24 * HOUR, -1)
    written = F.col("value").try_cast("decimal(38,18)")
    exact = F.when(F.count(written).over(w) == F.count("value").over(w), F.try_sum(written).over(w))
    return rows.withColumn("n_linked", F.count("*").over(w)).withColumn("reached", F.coalesce(exact > 100, F.sum("value").over(w) > 100, F.lit(False)))


LINES = r"list_transform(list_filter(str_split({c}, chr(10)), lambda x: x <> ''), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g')))"


@query(f"""
WITH d AS (SELECT doc_id, source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents),
l AS (SELECT *, list_filter(str_split(text, chr(10)), lambda x: x <> '') AS cl, {LINES.format(c="text")} AS cn, {LINES.format(c="prev")} AS pn FROM d)
SELECT doc_id, sha256(CASE WHEN prev IS NULL OR prev = '' THEN text ELSE array_to_string(list_filter(cl, lambda x, i:
  cn[i] <> '' AND NOT list_contains(pn, cn[i]) AND list_position(cn, cn[i]) = i), chr(10)) END) AS emitted_sha256 FROM l
""")
def viewport_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each viewport of a source shows beyond the one before it."""
    rows = sequence.viewport_novelty(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "text")
    return rows.select("doc_id", F.sha2("emitted", 256).alias("emitted_sha256"))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders)
SELECT o_orderkey, ordinal, ordinal // 50 AS block, printf('block-%04d', ordinal // 50) AS block_id FROM o
""")
def chronological_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in time, in blocks of fifty."""
    return sequence.blocks(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "ordinal", "block", "block_id")


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('mix:7:' || CAST(n_chars AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents
""")
def deterministic_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random order of each source's documents that is the same on every run."""
    rows = table(spark, sf_dir, "documents").withColumn("k", ids.shuffle_key("mix", 7, F.col("n_chars"), F.col("doc_id")))
    placed = sequence.ordinal_within(rows.select("doc_id", "source", "k"), ["source"], ["k", "doc_id"], "at")
    return placed.select("doc_id", "source", (F.col("at") + 1).cast("long").alias("place"))


@query("""
SELECT l_orderkey, 'evt_' || sha256(CAST(l_orderkey AS VARCHAR) || chr(31) || string_agg(CAST(l_partkey AS VARCHAR), chr(30) ORDER BY l_linenumber, l_partkey) || chr(31) || CAST(count(*) AS VARCHAR)) AS event_key
FROM lineitem GROUP BY l_orderkey
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity for each order from the ordered lineage of its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"), F.count("*").alias("n"))
    lineage = F.transform("x", lambda r: r["l_partkey"].cast("string"))
    return lines.select("l_orderkey", ids.stable_id("evt_", F.col("l_orderkey"), lineage, F.col("n")).alias("event_key"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one before it in its conversation."""
    rows = table(spark, sf_dir, "conversations")
    return rows.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")


PAIRS = "(SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)"
EDIT = f"""(SELECT *, length(before) AS lb, length(text) AS lt,
  (SELECT coalesce(max(i), 0) FROM range(1, least(length(before), length(text)) + 1) r(i) WHERE left(before, i) = left(text, i)) AS p,
  (SELECT coalesce(max(i), 0) FROM range(1, least(length(before), length(text)) + 1) r(i) WHERE right(before, i) = right(text, i)) AS s0 FROM {PAIRS})"""


@query(f"""
WITH e AS (SELECT *, least(s0, least(lb, lt) - p) AS s FROM {EDIT}),
x AS (SELECT conv_id, turn, p AS edit_offset, substr(before, p + 1, lb - p - s) AS removed, substr(text, p + 1, lt - p - s) AS inserted FROM e)
SELECT *, CASE WHEN removed = '' AND inserted = '' THEN 'none' WHEN removed = '' THEN 'insert' WHEN inserted = '' THEN 'delete' ELSE 'replace' END AS operation, true AS reproduced FROM x
""")
def minimal_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest edit that makes each turn of the one before, and that applying it gives the turn again."""
    rows = turn_pairs(spark, sf_dir).withColumn("e", text.minimal_edit(F.col("before"), F.col("text")))
    again = text.apply_edit(F.col("before"), F.col("e.offset"), F.col("e.removed"), F.col("e.inserted"))
    return rows.select("conv_id", "turn", F.col("e.offset").alias("edit_offset"), "e.removed", "e.inserted", "e.operation", (again == F.col("text")).alias("reproduced"))


@query("""
SELECT doc_id, sha256(substr(text, greatest(n // 2 - 512, 0) + 1, least(n // 2, 512))) AS left_sha256, substr(text, n // 2 + 1, 20) AS selected,
  sha256(substr(text, n // 2 + 21, 512)) AS right_sha256, n // 2 > 512 AS left_cut, n - n // 2 - 20 > 512 AS right_cut
FROM (SELECT *, length(text) AS n FROM documents)
""")
def cursor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around a selection in the middle of each document."""
    middle = F.floor(F.length("text") / 2)
    rows = table(spark, sf_dir, "documents").withColumn("c", text.cursor_window(F.col("text"), middle, F.lit(20)))
    return rows.select("doc_id", F.sha2("c.left", 256).alias("left_sha256"), "c.selected", F.sha2("c.right", 256).alias("right_sha256"), "c.left_cut", "c.right_cut")


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_’'']+')) AS n_words,
  len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_’'']+')) >= 6 AND length(text) >= 40 AS is_substantive FROM documents
""")
def word_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, and whether it is long enough to count."""
    n = text.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_words"), ((n >= 6) & (F.length("text") >= 40)).alias("is_substantive"))


#: SQL's levenshtein counts bytes. Texts of a pair are spelled anew, a byte from 1 on for each different character of the two, which
#: leaves distances in characters as they are; no pair has more than 127 different ones.
SPELLED = f"""(SELECT *, (SELECT string_agg(chr(list_position(a, c)::INT), '' ORDER BY i) FROM (SELECT unnest(str_split(text, '')) AS c, generate_subscripts(str_split(text, ''), 1) AS i)) AS t1,
  (SELECT string_agg(chr(list_position(a, c)::INT), '' ORDER BY i) FROM (SELECT unnest(str_split(before, '')) AS c, generate_subscripts(str_split(before, ''), 1) AS i)) AS b1
  FROM (SELECT *, list_distinct(str_split(text || before, '')) AS a FROM {PAIRS}))"""
SCORED = f"""(SELECT *, levenshtein(coalesce(b1, ''), coalesce(t1, '')) AS d, greatest(length(before), length(text)) AS m,
  (SELECT coalesce(max(i), 0) FROM range(1, least(length(before), length(text)) + 1) r(i) WHERE left(before, i) = left(text, i)) AS p FROM {SPELLED})"""


@query(f"""
SELECT conv_id, turn, d AS distance, round(CASE WHEN m = 0 THEN 1.0 ELSE 1 - d / m END, 9) AS similarity, before = text AS exact, p AS prefix FROM {SCORED}
""")
def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn scored as a prediction of the next; distances are in code points."""
    rows = scorecard.row_scores(turn_pairs(spark, sf_dir), "text", "before")
    return rows.select("conv_id", "turn", F.col("distance").cast("long").alias("distance"), F.round("similarity", 9).alias("similarity"), "exact", "prefix")


@query(f"""
WITH s AS (SELECT *, turn // 3 AS block FROM {SCORED})
SELECT role, block, count(*) AS n, count(*) FILTER (before = text) AS n_exact, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE 1 - d / m END), 9) AS macro_similarity, round(1 - sum(d) / sum(m), 9) AS micro_similarity,
  round(sum(p) / sum(length(text)), 9) AS micro_prefix_coverage FROM s GROUP BY GROUPING SETS ((role), (role, block))
""")
def scorecard_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard of each role, whole and by block of turns, in one pass."""
    rows = scorecard.row_scores(turn_pairs(spark, sf_dir), "text", "before").withColumn("block", F.floor(F.col("turn") / 3))
    out = scorecard.by_strata(rows, "role", "block")
    return out.select("role", "block", "n", "n_exact", *[F.round(c, 9).alias(c) for c in ("macro_similarity", "micro_similarity", "micro_prefix_coverage")])


@query("""
SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 9) AS mean, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 9) AS median,
  round(quantile_cont(CAST(value AS DOUBLE), 0.9), 9) AS p90, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 9) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type
""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each event type's values, however many an event type has."""
    out = scorecard.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), *[F.round(c, 9).alias(c) for c in ("mean", "median", "p90", "p95")], "least", "most")


PRICE = "round_even(CAST(CAST({n} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(12,6)) / 1000000 AS DECIMAL(38,12)), 6)"


@query(f"""
WITH u AS (SELECT l_orderkey, CAST(l_quantity * 8000 AS BIGINT) AS input, CAST(l_quantity * 100 AS BIGINT) AS cached, CAST(l_linenumber * 10 AS BIGINT) AS written, CAST(l_partkey AS BIGINT) AS output FROM lineitem),
r AS (SELECT *, input > 272000 AS over FROM u)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (over) AS n_over,
  CAST(sum({PRICE.format(n="cached", r="CASE WHEN over THEN 1.0 ELSE 0.5 END")} + {PRICE.format(n="(input - cached - written)", r="CASE WHEN over THEN 10 ELSE 5 END")}
    + {PRICE.format(n="written", r="CASE WHEN over THEN 12.5 ELSE 6.25 END")} + {PRICE.format(n="output", r="CASE WHEN over THEN 45 ELSE 30 END")}) AS DOUBLE) AS cost
FROM r GROUP BY l_orderkey
""")
def tiered_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each order's lines as token counts: each line exact and rounded half-even, then added."""
    n = lambda c: F.expr(c).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n("l_quantity * 8000").alias("i"), n("l_quantity * 100").alias("c"), n("l_linenumber * 10").alias("w"), n("l_partkey").alias("o"))
    cost = money.tiered_cost(F.col("i"), F.col("c"), F.col("w"), F.col("o"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("i") > money.TIER).alias("n_over"), F.sum(cost).cast("double").alias("cost"))


@query("""
WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
b AS (SELECT t.conv_id, t.turn, p.turn AS block, len(regexp_extract_all(p.text, '[^ \t\n\r]+')) AS n FROM t LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn < t.turn),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn ORDER BY block DESC ROWS UNBOUNDED PRECEDING) AS used FROM b)
SELECT conv_id, turn, count(*) FILTER (used <= 300) AS n_whole, coalesce(sum(CASE WHEN used <= 300 THEN n WHEN used - n < 300 THEN 300 - (used - n) ELSE 0 END), 0)::BIGINT AS n_tokens,
  count(*) FILTER (used > 300 AND used - n < 300) AS n_partial FROM u GROUP BY conv_id, turn
""")
def suffix_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest history of each user turn that fits 300 words."""
    return packed(spark, sf_dir, [300]).drop("budget")


def packed(spark: SparkSession, sf_dir: str, budgets: list[int]) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long"))
    out = sequence.suffix_edges(rows, "conv_id", "turn", "n", budgets).where("role = 'user'")
    return out.select("conv_id", "turn", "budget", "n_whole", "n_tokens", "n_partial")


@query("""
WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
b AS (SELECT t.conv_id, t.turn, g.budget, p.turn AS block, len(regexp_extract_all(p.text, '[^ \t\n\r]+')) AS n FROM t CROSS JOIN (VALUES (100), (400)) g(budget) LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn < t.turn),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn, budget ORDER BY block DESC ROWS UNBOUNDED PRECEDING) AS used FROM b)
SELECT conv_id, turn, budget, count(*) FILTER (used <= budget) AS n_whole, coalesce(sum(CASE WHEN used <= budget THEN n WHEN used - n < budget THEN budget - (used - n) ELSE 0 END), 0)::BIGINT AS n_tokens,
  count(*) FILTER (used > budget AND used - n < budget) AS n_partial FROM u GROUP BY conv_id, turn, budget
""")
def multi_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for two budgets at once."""
    return packed(spark, sf_dir, [100, 400])


@query("""
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS session FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT session, lead(session) OVER (ORDER BY session) AS following FROM m)
SELECT strftime(session, '%Y-%m-%d') AS session, 'event' AS block_type, CAST(NULL AS VARCHAR) AS before_at FROM b
UNION ALL SELECT strftime(session, '%Y-%m-%d'), 'gap', strftime(following, '%Y-%m-%d') FROM b WHERE following > session + INTERVAL 1 MONTH
""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with finished orders as sessions, and a gap row wherever months are missing between two."""
    months = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("session")).distinct()
    nxt = months.withColumn("before_at", F.lead("session").over(W.orderBy("session")))  # one row a month
    gaps = nxt.where(F.col("before_at") > F.add_months("session", 1)).select("session", F.lit("gap").alias("block_type"), "before_at")
    rows = months.select("session", F.lit("event").alias("block_type"), F.lit(None).cast("date").alias("before_at")).unionByName(gaps)
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("session", "before_at")})


@query("""
SELECT d.doc_id, coalesce(l.toxic, 0) = 1 AS redacted, CASE WHEN l.toxic = 1 THEN '{"redacted":true}' ELSE left(text, 40) END AS shown, sha256(text) AS source_sha256
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def privacy_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a policy: the text of private ones is replaced, its digest stays."""
    policy = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("private"))
    rows = table(spark, sf_dir, "documents").join(policy, "doc_id", "left")
    private = F.coalesce("private", F.lit(False))
    return rows.select("doc_id", private.alias("redacted"), F.when(private, '{"redacted":true}').otherwise(F.left("text", F.lit(40))).alias("shown"), F.sha2("text", 256).alias("source_sha256"))


@query("""
WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS v FROM documents JOIN labels USING (doc_id)), n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN md5('') ELSE md5(coalesce(text, '')) END AS v FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.v = n.v THEN 'unchanged' ELSE 'changed' END AS delta
FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def corpus_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a curation changed: from the documents that were labelled to all that are not bad, toxic ones emptied."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    digest = F.md5(F.coalesce("text", F.lit("")))
    old = d.join(labels, "doc_id").select("doc_id", digest.alias("was"))
    kept = d.join(labels, "doc_id", "left").where(~F.col("quality").eqNullSafe(0))
    new = kept.select("doc_id", F.when(F.col("toxic") == 1, F.md5(F.lit(""))).otherwise(digest).alias("is"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return old.join(new, "doc_id", "full_outer").select("doc_id", kind.alias("delta"))


@query("""
SELECT 'orders without lines' AS rule, count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'lines without an order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders held twice', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'lines out of quantity', count(*) FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 50
""")
def exact_cover_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit as rules with their violations: lines and orders cover each other."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rules = [
        ("orders without lines", o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti")),
        ("lines without an order", l.join(o, o["o_orderkey"] == l["l_orderkey"], "left_anti")),
        ("orders held twice", o.groupBy("o_orderkey").count().where("count > 1")),
        ("lines out of quantity", l.where("not l_quantity between 1 and 50")),
    ]
    out = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, rows in rules]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("""
WITH x AS (SELECT doc_id, n_chars % 13 AS n_in, n_chars % 5 + 1 AS n_out FROM documents),
y AS (SELECT doc_id, n_in, list_concat(list_transform(range(0, n_in), lambda i: -100), list_transform(range(0, n_out), lambda i: i + 7)) AS labels FROM x)
SELECT doc_id, array_to_string(labels, ',') AS labels, array_to_string(labels[2:], ',') AS shifted, len(list_filter(labels[2:], lambda v: v <> -100)) AS n_loss FROM y
""")
def causal_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that ignore the input, shifted by one; the loss begins at the boundary."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 13).cast("int").alias("a"), (F.col("n_chars") % 5 + 1).cast("int").alias("b"))
    labels = F.concat(F.array_repeat(F.lit(-100), F.col("a")), F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: i + 7))
    rows = rows.withColumn("l", labels).withColumn("s", F.slice("l", F.lit(2), F.size("l")))
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("doc_id", text_of("l").alias("labels"), text_of("s").alias("shifted"), F.size(F.filter("s", lambda v: v != -100)).cast("long").alias("n_loss"))


@query("""
SELECT d.doc_id, d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY l.quality DESC NULLS LAST, d.n_chars DESC, d.doc_id) AS place,
  left(d.text, 30) AS preview FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def inspector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as an inspector lists them: best label first, unlabelled last, then the longest."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select("doc_id", "source", "quality", "n_chars", F.left("text", F.lit(30)).alias("preview"))
    placed = sequence.ordinal_within(rows, ["source"], [F.col("quality").desc_nulls_last(), F.col("n_chars").desc(), "doc_id"], "at")
    return placed.select("doc_id", "source", "quality", (F.col("at") + 1).cast("long").alias("place"), "preview")


@query(f"""
WITH m AS (SELECT user_id, event_id, t, value, ntile FROM (SELECT *, event_id % 2 AS ntile FROM {STREAM}))
SELECT user_id, count(*) AS n, round(sum(CASE WHEN ntile = 0 THEN value ELSE -value END) / ln(2), 6) AS bits_saved, round(avg(value / (event_id % 9 + 1)), 9) AS macro_nll,
  round(sum(value) / sum(event_id % 9 + 1), 9) AS micro_nll FROM m GROUP BY user_id
""")
def likelihood_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood summaries with values in the place of losses."""
    rows = stream(spark, sf_dir).withColumn("n", F.col("event_id") % 9 + 1).withColumn("a", F.when(F.expr("event_id % 2 = 0"), F.col("value")).otherwise(0.0)).withColumn("b", F.when(F.expr("event_id % 2 = 1"), F.col("value")).otherwise(0.0))
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), scorecard.bits_saved("a", "b"), *scorecard.likelihood_summary("value", "n"))
    return out.select("user_id", "n", F.round("bits_saved", 6).alias("bits_saved"), F.round("macro_nll", 9).alias("macro_nll"), F.round("micro_nll", 9).alias("micro_nll"))


@query("""
SELECT c_mktsegment, count(*) AS n, round(sum(f), 2) AS urgent, round(sum(h), 2) AS high, round(sum(l), 2) AS low,
  round(sum(coalesce(f, 0) - coalesce(l, 0)), 2) AS difference
FROM (SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS f, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS h,
  sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS l FROM orders GROUP BY o_custkey) o JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment
""")
def arms_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arms (order priorities) of each customer in one row, by a pivot, and what they come to by segment."""
    arms = ["1-URGENT", "2-HIGH", "5-LOW"]
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", arms).agg(F.sum("o_totalprice"))
    rows = wide.join(table(spark, sf_dir, "customer"), wide["o_custkey"] == F.col("c_custkey"))
    total = lambda c: F.round(F.sum(F.col(f"`{c}`")), 2)
    difference = F.coalesce(F.col("`1-URGENT`"), F.lit(0)) - F.coalesce(F.col("`5-LOW`"), F.lit(0))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), total("1-URGENT").alias("urgent"), total("2-HIGH").alias("high"), total("5-LOW").alias("low"), F.round(F.sum(difference), 2).alias("difference"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(1.0 / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS FLOAT) AS DOUBLE) AS weight,
  CAST(sum(l_quantity) OVER w AS BIGINT) AS span_end, CAST(sum(l_quantity) OVER w - l_quantity AS BIGINT) AS span_start
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)
""")
def batch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as examples of a batch: weights that make all tokens of the batch count alike, and where each one's tokens lie."""
    rows = sequence.token_spans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "l_quantity")
    total = F.sum("l_quantity").over(W.partitionBy("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", (1 / total).cast("float").cast("double").alias("weight"), F.col("span_end").cast("long").alias("span_end"), F.col("span_start").cast("long").alias("span_start"))


@query(f"""
SELECT user_id, arg_min(event_id, row(value, event_id)) AS least_id, arg_max(event_id, row(value, -event_id)) AS most_id,
  array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, count(DISTINCT props) AS n_payloads FROM {STREAM} GROUP BY user_id
""")
def extremes_and_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most with tie-breaks, and a set union, for each user."""
    return stream(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("least_id"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("most_id"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.countDistinct("props").alias("n_payloads"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each part: a journal's recovery by earliest row."""
    return sequence.first_by(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def claimed_but_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on keys: customers with finished orders and none in progress."""
    orders = table(spark, sf_dir, "orders")
    keys = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(keys("F"), "c_custkey", "left_semi").join(keys("P"), "c_custkey", "left_anti")


@query(f"""
SELECT w.user_id, w.event_id, count(r.event_id) AS n_seen, max(r.t) AS last_seen FROM {STREAM} w
LEFT JOIN {STREAM} r ON r.user_id = w.user_id AND NOT r.is_write AND r.t < w.t AND r.t >= w.t - {12 * HOUR} WHERE w.is_write GROUP BY w.user_id, w.event_id
""")
def reads_before_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read in the twelve hours before each write, as a range frame."""
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-12 * HOUR, -1)
    rows = stream(spark, sf_dir).withColumn("n_seen", F.count(F.when(~F.col("is_write"), 1)).over(w)).withColumn("last_seen", F.max(F.when(~F.col("is_write"), F.col("t"))).over(w))
    return rows.where("is_write").select("user_id", "event_id", "n_seen", "last_seen")


@query("""
SELECT doc_id, utf16_len, length(stripped) AS n_stripped, n_the, once FROM (SELECT doc_id,
  CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS utf16_len, regexp_replace(text, '[\\s]+', '', 'g') AS stripped,
  CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the, instr(text, 'license') > 0 AND instr(substr(text, instr(text, 'license') + 1), 'license') = 0 AS once FROM documents)
""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 length, length without white space, occurrences and single occurrence."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.utf16_length(t).alias("utf16_len"), F.length(text.without_spaces(t)).alias("n_stripped"), text.occurrences(F.lit("the"), t).alias("n_the"), text.occurs_once(F.lit("license"), t).alias("once"))


@query("""
SELECT block_no, arm, count(*) AS n, min(example) AS first_example FROM (SELECT (turn // 2) AS block_no, conv_id AS example FROM conversations WHERE role = 'user') e
CROSS JOIN (VALUES ('frozen'), ('frontier'), ('own')) a(arm) WHERE block_no > 0 GROUP BY block_no, arm
""")
def expected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score keys that a prequential run must bring: each block but the first, each arm, each example."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.floor(F.col("turn") / 2).alias("block_no"), F.col("conv_id").alias("example"))
    arms = F.explode(F.array(*map(F.lit, ("frozen", "frontier", "own"))))
    return rows.where("block_no > 0").withColumn("arm", arms).groupBy("block_no", "arm").agg(F.count("*").alias("n"), F.min("example").alias("first_example"))


@query()
def prequential_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prequential run over user turns with the mock model: every block scored before it is learned from."""
    from tidewell.plans import prequential

    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("example_id"), F.floor(F.col("turn") / 2).alias("block"), F.col("text").alias("target"))
    scores, _ = prequential.run(rows, ["frozen", "own"], prequential.MockBackend(), "own")
    return scorecard.row_scores(scores).groupBy("block", "arm").agg(*scorecard.scorecard(), *scorecard.likelihood_summary("nll", "tokens"))


@query()
def episode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as field states: user turns write, others read; writes that go on with each other are one episode."""
    from tidewell.operators import episodes

    t = (F.col("turn") * 1_000_000).cast("long")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.when(F.col("role") == "user", "write").otherwise("read").alias("kind"), F.col("turn").alias("sequence"), F.lit(1).alias("pid"), F.lit("w").alias("window_title"), F.lit(1).alias("element"),
        F.lit("").alias("before_value"), F.col("text").alias("after_value"), t.alias("began_at"), (t + 500_000).alias("available_at"), F.lit("write_delay_elapsed").alias("boundary_reason"), F.lit(None).cast("long").alias("submitted_at"),
    )
    members = episodes.fold(rows)
    return episodes.closed(rows, members).select("session_id", "episode", "n_members", "closure", "reason", "has_loss", F.length("target").alias("n_chars"))
