"""URL filtering: host and path rules, and a character language-model ratio for the rest. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sparktools import cut

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest context of the Markov models, in characters.
ORDER = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end.

    Both are empty for null and where there is no ://.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url"))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (host and path of the longest that fits, or null) and rule_verdict."""
    fits = [
        F.when(
            ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    best = F.array_max(F.array(*fits))  # arrays' maximum passes over nulls
    return urls.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict")).drop("_best")


def ngrams(rows: DataFrame, text: str, keys: Sequence[str], order: int) -> DataFrame:
    """One row per character of the text and per end mark: keys and g, the last order + 1 characters.

    The text is padded with \\u0002 in front and \\u0003 at the end, so each g has order + 1 characters.
    """
    padded = F.concat(F.lit("\u0002" * order), F.coalesce(F.col(text), F.lit("")), F.lit("\u0003"))
    return rows.select(*keys, padded.alias("_p")).select(*keys, F.explode(F.expr(f"transform(sequence(1, length(_p) - {order}), i -> substring(_p, i, {order + 1}))")).alias("g"))


def markov_log_ratio(grams: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(g, llr) for distinct (order + 1)-grams g, from counts (g, yes, no) in accepted and rejected texts.

    Each class's model is of variable order with Witten-Bell smoothing: p_k(c | context) =
    (n(context, c) + t(context) * p_{k-1}(c | shorter)) / (n(context) + t(context)), t: distinct
    successors, and the base is uniform over 256 characters; a context never seen falls to the shorter.
    llr = ln p_yes - ln p_no. Each order is one join on distinct grams; texts are not touched.
    """
    out = grams.select("g").withColumn("p_yes", F.lit(1 / 256)).withColumn("p_no", F.lit(1 / 256))
    for k in range(order + 1):
        tail = counts.groupBy(F.expr(f"right(g, {k + 1})").alias("s")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        ctx = tail.groupBy(F.expr(f"left(s, {k})").alias("c")).agg(F.sum("yes").alias("cy"), F.sum("no").alias("cn"), F.count_if(F.col("yes") > 0).alias("ty"), F.count_if(F.col("no") > 0).alias("tn"))
        out = out.withColumn("s", F.expr(f"right(g, {k + 1})")).withColumn("c", F.expr(f"left(right(g, {k + 1}), {k})"))
        out = out.join(tail, "s", "left").join(ctx, "c", "left").na.fill(0, ["yes", "no", "cy", "cn", "ty", "tn"])
        step = lambda p, n, c, t: F.when(F.col(c) + F.col(t) > 0, (F.col(n) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t))).otherwise(F.col(p))
        out = out.withColumn("p_yes", step("p_yes", "yes", "cy", "ty")).withColumn("p_no", step("p_no", "no", "cn", "tn")).select("g", "p_yes", "p_no")
    return out.select("g", (F.log("p_yes") - F.log("p_no")).alias("llr"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, url, host, path, rule, llr, verdict): the longest rule's verdict, else the models'.

    The models learn from the hosts and paths of all URLs that a rule decides: allowed ones are accepted,
    blocked ones rejected. A URL's score is its sum of log ratios over its number of characters; the
    cut between the two classes is the middle of their mean scores, each rule-decided URL scored by the
    same models. A URL without a rule is allowed if its score is at or above the cut, so ties are
    allowed; with no learned rows in a class every such URL is allowed. A null or malformed URL has an
    empty host and path and is scored as an empty text. Repeated rows give repeated results, extra
    columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rows = apply_rules(rows, rules).withColumn("body", F.concat("host", "path"))
    # equal bodies score alike, so each distinct body is split into grams once, with its weights
    bodies = cut(rows.groupBy("body").agg(F.count_if(F.col("rule_verdict") == "allow").alias("yes"), F.count_if(F.col("rule_verdict") == "block").alias("no")))
    cells = ngrams(bodies, "body", ["body", "yes", "no"], order)
    counts = cut(cells.groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    ratios = cut(markov_log_ratio(counts, counts, order))
    scored = cut(cells.join(ratios, "g").groupBy("body").agg(F.first("yes").alias("yes"), F.first("no").alias("no"), (F.sum(F.col("llr").cast("decimal(30,12)")).cast("double") / F.count("*")).alias("llr")))
    sums = scored.agg(F.sum(F.col("llr") * F.col("yes")), F.sum("yes"), F.sum(F.col("llr") * F.col("no")), F.sum("no")).first()
    middle = (sums[0] / sums[1] + sums[2] / sums[3]) / 2 if sums[1] and sums[3] else float("-inf")
    by_model = F.when(F.col("llr") >= F.lit(middle), "allow").otherwise("block")
    return rows.join(scored.select("body", "llr"), "body").select("page_id", "url", "host", "path", "rule", "llr", F.coalesce("rule_verdict", by_model).alias("verdict"))
