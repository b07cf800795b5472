"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.bytestext import Texts, firsts, group_sums, mix, passes, substring_hash
from tidewell.llm.sparktools import arrow_batches, cut, released

#: The symbols, words in a repeated window, the limits of the base rules.
SYMBOLS, REPEAT_WORDS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: Metrics: (name, what is counted, out of what, which sides are judged, reach of a fence in interquartile ranges). Shares are
#: judged as odds, (count + 1/2) / (rest + 1/2), so that a count of 0 weighs by what it is out of, and quartiles don't fall together.
METRICS = (
    ("symbol_share", "n_symbols", "word_chars", "high", 3.0),
    ("punct_share", "n_punct", "word_chars", "high", 4.0),
    ("upper_share", "n_upper", "word_chars", "high", 4.0),
    ("dup_share", "n_dup_lines", "n_lines", "high", 3.0),
    ("repeat_share", "n_repeat_words", "n_words", "high", 5.0),
    ("echo_share", "n_echo", "n_words", "high", 3.0),
    ("word_len", "word_chars", "n_words", "both", 4.0),
)
#: Relative error of a sketch and the least value it tells apart; rows that the group above counts for in a group's quartiles.
ERROR, LEAST, PRIOR = 0.01, 1e-6, 50.0
#: Width of a bucket in natural logarithms.
WIDTH = 2 * float(np.log1p(ERROR))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_punct long, n_upper long, n_echo long"


def _seen_before(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (group, h) occur before in order, and which occur twice or more."""
    key = mix(h + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return before, twice


def text_counts(texts: Texts) -> list[np.ndarray]:
    """The columns of COUNTS for each text of a pass."""
    data, prefix = texts.data, texts.prefix()
    first, last, n_words = texts.words()
    lens = texts.ends - texts.starts
    space = (data == 32) | ((data >= 9) & (data <= 13))
    per_text = lambda mask: group_sums(mask.astype(np.int64), lens + 1)
    word_chars = per_text(~space & ((data & 0xC0) != 0x80))
    symbols = per_text(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)))
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    punct = per_text(~space & (data < 128) & ~letter & ~((data >= 48) & (data <= 57)))
    upper = per_text((data >= 65) & (data <= 90))
    # lines: each text's end counts as a line's end
    breaks = data == 10
    breaks[texts.ends] = True
    ends = np.flatnonzero(breaks)
    begin = np.concatenate(([0], ends[:-1] + 1))
    filled = np.concatenate(([0], np.cumsum(~space)))
    has_word = filled[ends] > filled[begin]
    begin, ends = begin[has_word], ends[has_word]
    doc = np.searchsorted(texts.starts, begin, "right") - 1
    again, _ = _seen_before(doc, substring_hash(prefix, begin, ends))
    n_lines = np.bincount(doc, minlength=len(texts))
    dup_lines = np.bincount(doc[again], minlength=len(texts))
    # windows of words
    doc = np.repeat(np.arange(len(texts)), n_words)
    h = substring_hash(prefix, first, last)
    windows = np.maximum(n_words - REPEAT_WORDS + 1, 0)
    at = np.repeat(firsts(n_words) - firsts(windows), windows) + np.arange(windows.sum())
    folded = np.zeros(len(at), np.uint64)
    for k in range(REPEAT_WORDS):
        folded = folded * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    _, twice = _seen_before(doc[at], folded)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT_WORDS, -1)
    repeated = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=len(texts))
    echo = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))  # words equal to the one before
    return [n_words.astype(np.int64), word_chars, symbols, dup_lines, repeated, n_lines, punct, upper, echo]


def measured(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source with the columns of COUNTS for each whole text (null: none)."""
    arrow_batches(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in passes(b.column(3)):
                keys = [b.column(k).slice(texts.rows.start, len(texts)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x.astype(np.int64)) for x in text_counts(texts)]], ["doc_id", "lang", "source", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, f"doc_id long, lang string, source string, {COUNTS}")


def quantile_sketches(values: DataFrame, keys: list[str], error: float = ERROR) -> DataFrame:
    """(keys, bucket, n): for values (keys, x), x >= 0, counts in buckets whose bounds grow by a fixed ratio.

    Adding up counts merges sketches. Bucket b > 0 holds LEAST * r**(b-1) < x <= LEAST * r**b, r = (1 + error)**2; bucket 0 the
    smaller ones. A key has a number of buckets that depends on the error alone, not on its rows.
    """
    bucket = F.when(F.col("x") <= LEAST, 0).otherwise(F.ceil(F.log(F.col("x") / LEAST) / (2 * np.log1p(error)))).cast("int")
    return values.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float], error: float = ERROR) -> DataFrame:
    """(keys, rows, one column per quantile) of sketches: the quantile's logarithm, within the relative error."""
    w = Window.partitionBy(*keys)
    value = F.log(F.lit(LEAST)) + F.greatest(F.col("bucket") - 0.5, F.lit(0.0)) * (2 * float(np.log1p(error)))
    run = sketches.withColumn("up_to", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w)).withColumn("value", value)
    return run.groupBy(*keys).agg(F.first("rows").alias("rows"), *[F.min(F.when(F.col("up_to") >= q * F.col("rows"), F.col("value"))).alias(name) for name, q in at.items()])


def shares(counts: DataFrame) -> DataFrame:
    """Adds the metrics, shares as odds; a text without words has the odds of 0 out of 0, and words of length 1/2."""
    odds = lambda a, b: (F.col(a) + 0.5) / (F.col(b) - F.col(a) + 0.5)
    cols = {m: odds(a, b) for m, a, b, *_ in METRICS if m != "word_len"}
    return counts.withColumns(cols | {"word_len": (F.col("word_chars") + 0.5) / (F.col("n_words") + 1)})


def fences(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(lang, source, one low and high column per metric): fences of each group of rows that have 20 words, as logarithms.

    Quartiles come from the group's own sketch, mixed with those of its language as ``prior`` more rows of it would, and these with
    those of all rows in the same way; so a group of any size has fences, and a small one leans on its language. A fence lies the
    metric's reach of interquartile ranges beyond the quartiles; the range is taken two buckets wider, as a quartile is known to a bucket.
    """
    names = [m[0] for m in METRICS]
    values = rows.where(F.col("n_words") >= LEAST_WORDS).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in names])).alias("v")).select("lang", "source", "v.metric", "v.x")
    own = cut(quantile_sketches(values, ["lang", "source", "metric"]))
    quartiles = {"q1": 0.25, "q3": 0.75}
    out = rows.select("lang", "source").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, names)))).alias("g")
    mixed = {q: F.lit(None).cast("double") for q in quartiles}
    for k, keys in enumerate((["metric"], ["lang", "metric"], ["lang", "source", "metric"])):
        merged = own if len(keys) == 3 else own.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        level = sketch_quantiles(merged, keys, quartiles).select(*[F.col(c).alias(f"{c}_{k}") for c in (*keys, "rows", "q1", "q3")])
        out = out.join(level, [F.col(f"g.{c}").eqNullSafe(F.col(f"{c}_{k}")) for c in keys], "left")
        n = F.coalesce(F.col(f"rows_{k}"), F.lit(0))
        mixed = {q: F.col(f"{q}_{k}") if not k else F.when(n > 0, (n * F.col(f"{q}_{k}") + prior * above) / (n + prior)).otherwise(above) for q, above in mixed.items()}
    out = out.select("g.lang", "g.source", "g.metric", *[x.alias(q) for q, x in mixed.items()])
    reach = F.element_at(F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[4])]), F.col("metric")) * (F.col("q3") - F.col("q1") + 2 * WIDTH)
    out = out.withColumn("low", F.col("q1") - reach).withColumn("high", F.col("q3") + reach)
    agg = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in names for side in ("low", "high")]
    return out.groupBy("lang", "source").agg(*agg)


def judge(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(doc_id, lang, source, counts, metrics, base_failed, reasons, kept) for each row of docs.

    base_failed: fewer than 20 words, or more than 30 % of the words in 8-word windows found twice. kept: not
    base_failed and every metric inside its group's fences; a value at a fence, or at one of equal values, is inside. reasons lists the
    broken fences. Null texts have no words; null lang and source are groups of their own; repeated rows are judged each; extra
    columns are ignored; an empty table gives an empty result. Texts are counted whole, a text longer than a pass in one of its own.
    """
    rows = cut(measured(docs))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = shares(rows).withColumn("base_failed", base)
    limits = fences(rows, prior).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    out = rows.join(limits, rows["lang"].eqNullSafe(F.col("lang_")) & rows["source"].eqNullSafe(F.col("source_")), "left")
    broken = []
    for m, _, _, sides, _ in METRICS:
        broken.append(F.when(F.log(m) > F.col(f"{m}_high"), F.lit(f"{m} high")))
        if sides == "both":
            broken.append(F.when(F.log(m) < F.col(f"{m}_low"), F.lit(f"{m} low")))
    out = out.withColumn("reasons", F.array_compact(F.array(*broken))).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[m[0] for m in METRICS], "base_failed", "reasons", "kept")
