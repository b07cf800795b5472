"""Document fingerprints by threshold-scaled sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.sparktools import cut, partitions

#: One hash in SCALE is kept. Words in a shingle.
SCALE, WORDS = 8, 5


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes of a text that are below 1/scale of the 64-bit range.

    Shingles are of ``words`` words between blanks and 9 to 13; a text of fewer words is one shingle. The fraction is
    the same for all texts, so sketches merge by union and compare by containment whatever the lengths. A text
    whose hashes all lie above keeps its smallest one, so that only null and wordless texts are empty.
    """
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        # get() avoids a slice's copy: a shingle's hash folds the hashes of its words
        many = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(many)

    return _let(hashed, lambda h: _let(shingles(h), lambda s: _kept(s, scale)))


def _below(scale: int):
    return lambda x: F.shiftrightunsigned(x, 1) <= F.lit((1 << 63) // scale - 1)


def _kept(s: Column, scale: int) -> Column:
    """What a sketch keeps of some hashes: those below the threshold, or the smallest one if there are none."""
    low = F.filter(s, _below(scale))
    chosen = F.when(F.size(low) > 0, low).when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(s)
    return F.array_sort(F.array_distinct(chosen))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty.

    Null where it can't be told: a has no hash below the threshold, and b's sketch says nothing of those above it.
    """
    untold = ~F.exists(a, _below(scale)) & F.exists(b, _below(scale))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(untold, F.lit(None)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(rows: DataFrame, key: str, column: str = "sketch", scale: int = SCALE) -> DataFrame:
    """One sketch per key, that of all its rows' shingles together: the union of their sketches, combined before the shuffle by distinct.

    The smallest hashes of rows that have none below the threshold go as soon as another row has one; else the smallest of them stays.
    """
    union = rows.select(key, F.explode(column).alias("h")).distinct().groupBy(key).agg(F.collect_list("h").alias("h"))
    return union.select(key, _kept(F.col("h"), scale).alias(column))


def digest(s: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits for each hash, in order."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending doc_id, the last followed by the first; no task sees all rows.

    Rows are dealt by ranges; each range is ordered on its own and the few range ends are matched apart.
    """
    n = partitions(ids.sparkSession)
    own = cut(ids.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()))
    inside = own.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    heads = own.groupBy("part").agg(F.min("doc_id").alias("head"))  # a row per range: n in all
    heads = heads.withColumn("follow", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy())))
    return inside.join(F.broadcast(heads), "part").select("doc_id", F.coalesce("next_id", "follow").alias("next_id"))


def edited_pairs(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each document's sketch, its edited text's and the next document's.

    Edited text: the last floor(n/2) of n code points replaced by as many first ones (or all) of the
    next document's, in ascending doc_id, the last followed by the first. Null text: empty. Rows without a doc_id are left out;
    of rows that repeat a doc_id the one with the smallest text is taken; extra columns are ignored; an
    empty table gives an empty result and a single document follows itself.

    Returns (doc_id, n_chars, sketch, edited, edited_sketch, next_sketch).
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = cut(rows.select("doc_id", F.length("text").alias("n_chars")).groupBy("doc_id").agg(F.count("*").alias("copies"), F.min("n_chars").alias("n_chars")))
    if lengths.where("copies > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
        lengths = cut(rows.select("doc_id", F.length("text").alias("n_chars")))
    after = successors(lengths.select("doc_id"))
    follow = after.join(lengths.select("doc_id", (F.col("n_chars") / 2).cast("long").alias("half")), "doc_id")
    # what a document gives to the one before it: no more characters than that one replaces
    given = rows.join(follow.select(F.col("doc_id").alias("to_id"), F.col("next_id").alias("doc_id"), "half"), "doc_id")
    given = given.select(F.col("to_id").alias("doc_id"), F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("head"), sketch(F.col("text"), words, scale).alias("next_sketch"))
    n = F.length("text")
    out = rows.join(given, "doc_id").withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head")))
    return out.select("doc_id", "n_chars", sketch(F.col("text"), words, scale).alias("sketch"), "edited", sketch(F.col("edited"), words, scale).alias("edited_sketch"), "next_sketch")
