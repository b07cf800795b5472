"""The corpus operators as queries over the tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import codes, language, lines, mixing, mixlm, phrases, pieces, quality, repeats, rules, simhash, sketches, urls

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + (x["end"] - x["start"]))
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.digest(F.col("sketch")).alias("fingerprint"),
        sketches.digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(table(spark, sf_dir, "documents"))
    scores = F.transform("nbest", lambda x: x["score"])
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.lpad(F.lower(F.hex(F.xxhash64("ids"))), 16, "0").alias("ids_digest"), "score", scores.alias("nbest_scores"), "round_trip")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ", ").alias("reasons"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("llr", 6).alias("llr"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    rows = codes.with_label_errors(coded)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_lm": op5_lm,
    "op6_mix": op6_mix,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_rules": op9_rules,
    "op10_urls": op10_urls,
    "op11_phrases": op11_phrases,
    "op12_codes": op12_codes,
    "op13_lines": op13_lines,
}


def _url_sql() -> str:
    """op10 in SQL: rules, then the smoothed character models of both classes, order by order."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    steps = ["p0 AS (SELECT g, CAST(1 / 256 AS DOUBLE) AS py, CAST(1 / 256 AS DOUBLE) AS pn FROM counts)"]
    for k in range(urls.ORDER + 1):
        steps.append(f"t{k} AS (SELECT right(g, {k + 1}) AS s, sum(yes) AS yes, sum(nay) AS nay FROM counts GROUP BY ALL)")
        steps.append(f"c{k} AS (SELECT left(s, {k}) AS c, sum(yes) AS cy, sum(nay) AS cn, count(*) FILTER (yes > 0) AS ty, count(*) FILTER (nay > 0) AS tn FROM t{k} GROUP BY ALL)")
        part = lambda p, n, c, t: f"CASE WHEN {c} + {t} > 0 THEN ({n} + {t} * {p}) / ({c} + {t}) ELSE {p} END"
        steps.append(f"p{k + 1} AS (SELECT g, {part('py', 'yes', 'cy', 'ty')} AS py, {part('pn', 'nay', 'cn', 'tn')} AS pn FROM p{k} JOIN t{k} ON s = right(g, {k + 1}) JOIN c{k} ON c = left(right(g, {k + 1}), {k}))")
    pad = "repeat(chr(2), {n}) || body || chr(3)".format(n=urls.ORDER)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT page_id, host, path, host || path AS body, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS by_rule
  FROM x LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
bodies AS (SELECT body, count(*) FILTER (by_rule = 'allow') AS yes, count(*) FILTER (by_rule = 'block') AS nay FROM d GROUP BY ALL),
cells AS (SELECT body, yes, nay, unnest(list_transform(range(1, length(body) + 2), lambda i: substr({pad}, i, {urls.ORDER + 1}))) AS g FROM bodies),
counts AS (SELECT g, sum(yes) AS yes, sum(nay) AS nay FROM cells GROUP BY ALL),
{", ".join(steps)},
l AS (SELECT body, yes, nay, CAST(sum(CAST(ln(py) - ln(pn) AS DECIMAL(30, 12))) AS DOUBLE) / count(*) AS llr FROM cells JOIN p{urls.ORDER + 1} USING (g) GROUP BY ALL),
m AS (SELECT (sum(llr * yes) / sum(yes) + sum(llr * nay) / sum(nay)) / 2 AS middle FROM l)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN llr >= middle THEN 'allow' ELSE 'block' END) AS verdict, round(llr, 6) AS llr FROM d JOIN l USING (body), m
"""


def _rules_sql() -> str:
    """op9 in SQL: counts from lists of words, quartiles from the same buckets, mixed by group, language and all."""
    names = [m[0] for m in rules.METRICS]
    word = "[^\\x20\\x09-\\x0D]+"
    bucket = f"CASE WHEN e.x <= {rules.LEAST!r} THEN 0 ELSE CAST(ceil(ln(e.x / {rules.LEAST!r}) / {rules.WIDTH!r}) AS INT) END"
    value = f"ln({rules.LEAST!r}) + greatest(bucket - 0.5, 0.0) * {rules.WIDTH!r}"
    reach = " ".join(f"WHEN '{m[0]}' THEN {m[4]}" for m in rules.METRICS)
    levels = []
    for k, keys in enumerate(("metric", "lang, metric", "lang, source, metric")):
        levels.append(f"b{k} AS (SELECT {keys}, bucket, count(*) AS n FROM v GROUP BY ALL)")
        levels.append(f"r{k} AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {keys}) AS total, {value} AS value FROM b{k})")
        levels.append(f"q{k} AS (SELECT {keys}, first(total) AS total, min(value) FILTER (up_to >= 0.25 * total) AS q1, min(value) FILTER (up_to >= 0.75 * total) AS q3 FROM r{k} GROUP BY {keys})")
    mixed = lambda k, q, above: f"CASE WHEN coalesce(q{k}.total, 0) > 0 THEN (q{k}.total * q{k}.{q} + {rules.PRIOR} * {above}) / (q{k}.total + {rules.PRIOR}) ELSE {above} END"
    pick = lambda q: mixed(2, q, "(" + mixed(1, q, f"q0.{q}") + ")")
    broken = []
    for m, _, _, sides, _ in rules.METRICS:
        broken.append(f"CASE WHEN ln({m}) > {m}_high THEN '{m} high' END")
        if sides == "both":
            broken.append(f"CASE WHEN ln({m}) < {m}_low THEN '{m} low' END")
    fence_cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN q1 - reach END) AS {m}_low, max(CASE WHEN metric = '{m}' THEN q3 + reach END) AS {m}_high" for m in names)
    shares = ", ".join(f"({a} + 0.5::DOUBLE) / ({b} - {a} + 0.5::DOUBLE) AS {m}" for m, a, b, *_ in rules.METRICS if m != "word_len")
    n = rules.REPEAT_WORDS
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
h AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {n})) AS j FROM t WHERE c > 1) GROUP BY doc_id),
k AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(str_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(regexp_extract_all(array_to_string(w, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]')) AS n_punct, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
  len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echo FROM w LEFT JOIN h USING (doc_id)),
c AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines FROM k),
m AS (SELECT *, {shares}, (word_chars + 0.5::DOUBLE) / (n_words + 1) AS word_len,
  n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM c),
e AS (SELECT lang, source, unnest([{", ".join(f"{{'metric': '{x}', 'x': CAST({x} AS DOUBLE)}}" for x in names)}]) AS e FROM m WHERE n_words >= {rules.LEAST_WORDS}),
v AS (SELECT lang, source, e.metric AS metric, {bucket} AS bucket FROM e),
{", ".join(levels)},
o AS (SELECT s.lang, s.source, s.metric, {pick('q1')} AS q1, {pick('q3')} AS q3 FROM (SELECT DISTINCT lang, source, unnest([{", ".join(f"'{x}'" for x in names)}]) AS metric FROM m) s
  LEFT JOIN q2 ON s.lang IS NOT DISTINCT FROM q2.lang AND s.source IS NOT DISTINCT FROM q2.source AND s.metric = q2.metric
  LEFT JOIN q1 ON s.lang IS NOT DISTINCT FROM q1.lang AND s.metric = q1.metric LEFT JOIN q0 ON s.metric = q0.metric),
f AS (SELECT lang, source, {fence_cols} FROM (SELECT *, CASE metric {reach} END * (q3 - q1 + {2 * rules.WIDTH!r}) AS reach FROM o) GROUP BY lang, source),
z AS (SELECT m.*, list_filter([{", ".join(broken)}], lambda r: r IS NOT NULL) AS reasons FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(reasons) = 0 AS kept, coalesce(array_to_string(reasons, ', '), '') AS reasons FROM z
"""


PHRASES_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, str_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
b AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
x AS (SELECT c.* FROM c LEFT JOIN b USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
u AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM x)),
s AS (SELECT u.*, fl.f AS l, fr.f AS r, CAST((1000000::HUGEINT * a * a) // (fl.f::HUGEINT * fr.f) AS BIGINT) AS score
  FROM u JOIN f fl ON fl.lang = u.lang AND fl.phrase = lp JOIN f fr ON fr.lang = u.lang AND fr.phrase = rp),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS first FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m WHERE first = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """op12 in SQL: the rounds one after another; distances from inner products, which are exact for whole numbers."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT i, v.p, min(CAST(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * {entries} + e) AS m FROM v JOIN c{k} c ON v.p = c.p GROUP BY i, v.p)")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, list(x ORDER BY place) AS v FROM (SELECT p, e, place, floor(sum(x) / count(*)) AS x
  FROM (SELECT v.p, m % {entries} AS e, unnest(v.v) AS x, unnest(range(len(v.v))) AS place FROM a{k} JOIN v USING (i, p)) GROUP BY p, e, place) GROUP BY p, e)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(s.v, c.v) AS v FROM c{k} c LEFT JOIN s{k} s USING (p, e))")
    return f"""
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, * FROM r),
v AS MATERIALIZED (SELECT i, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, i - 1 AS e, v FROM v WHERE i <= {entries}),
{", ".join(steps)},
d AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS t FROM c{rounds})),
z AS (SELECT i, string_agg(lower(lpad(to_hex(m % {entries}), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z JOIN k USING (i), d
"""


LINES_SQL = f"""
WITH s AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, i, s[i] AS line, translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{urls.UPPER}', '{urls.LOWER}') AS k FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT l.*, last IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""


#: The others can't be said in SQL: rounding and components are iterative, and the hashes, models and lattices are not in
#: the SQL engine. tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op9_rules": _rules_sql(), "op10_urls": _url_sql(), "op11_phrases": PHRASES_SQL, "op12_codes": _codes_sql(), "op13_lines": LINES_SQL}
