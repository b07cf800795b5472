"""Model inputs rebuilt from their plans: a plan names places in one ordered table of blocks, and no history is written out."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.sequence import passed, running

#: Places of one key that are met in one task together.
SLICE = 4096
_RESULT = {"key": pa.string(), "target_id": pa.string(), "model_input_sha256": pa.string(), "n_blocks": pa.int64(), "n_chars": pa.int64(), "missing": pa.int64()}


def suffix_plans(edges: DataFrame, key: str, target: str, place: str) -> DataFrame:
    """Plans (key, target_id, budget, first, last, cut) out of sequence.suffix_edges.

    The last block is the one before the row, whose place in its key (from 0) ``place`` is. Where the first block came in part, cut is how much of its end stays.
    """
    first = (F.col(place) - F.col("n_whole") - F.col("n_partial")).alias("first")
    return edges.select(F.col(key).cast("string").alias("key"), F.col(target).cast("string").alias("target_id"), "budget", first, (F.col(place) - 1).alias("last"), F.when(F.col("n_partial") > 0, F.col("n_cut")).alias("cut"))


def digests(plans: DataFrame, blocks: DataFrame, instruction: str = "") -> DataFrame:
    """(key, target_id, model_input_sha256, n_blocks, n_chars, missing) of each plan, n_chars without the instruction.

    plans: (key, target_id, first, last, cut, query): the blocks from place first to last, both included, none where last is the
    smaller or one is null; of the first one only its last ``cut`` characters, where cut is not null. blocks: (key, place, serialized), a
    place once. The input is the instruction, the blocks and the query, joined by line ends; a null text is empty, and an empty
    context leaves no line behind. missing counts the plan's places that no block has. A null key is a key of its own.

    Plans of a prefix share one running digest of their key. The others are dealt by slices of the places they end at,
    each slice with the blocks it reaches back to, so that a hot key spreads over tasks; blocks pass in order, and a task holds those
    alone that a plan to come still asks for.
    """
    keyed = lambda df: df.withColumn("key_", F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("n")))
    empty = F.col("first").isNull() | F.col("last").isNull()
    plans = keyed(plans).withColumns({"first": F.when(empty, 0).otherwise(F.col("first")).cast("long"), "last": F.when(empty, -1).otherwise(F.col("last")).cast("long")})
    blocks = keyed(blocks).where("place is not null").select("key_", F.col("place").cast("long").alias("at_"), F.coalesce("serialized", F.lit("")).alias("text_"))
    least = blocks.groupBy("key_").agg(F.min("at_").alias("least_"))
    prefix = (F.col("last") >= F.col("first")) & (F.col("first") <= F.col("least_")) & F.col("cut").isNull()
    asked = plans.join(least, "key_", "left").select("key_", F.coalesce(prefix, F.lit(False)).alias("prefix_"), F.floor(F.col("last") / SLICE).alias("slice_"), F.col("last").alias("at_"), F.lit(1).alias("asks_"), F.col("target_id").cast("string").alias("target_id"), "first", F.col("cut").cast("long").alias("cut"), F.coalesce("query", F.lit("")).alias("text_"))
    n = int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    last = asked.where("prefix_").groupBy("key_").agg(F.max("at_").alias("to_"))
    whole = blocks.join(last, "key_").where("at_ <= to_").select("key_", "at_", F.lit(0).alias("asks_"), "text_")
    whole = whole.unionByName(asked.where("prefix_").drop("prefix_", "slice_", "cut"), allowMissingColumns=True)
    schema = "key string, target_id string, model_input_sha256 string, n_blocks long, n_chars long, missing long"
    found = passed(whole, ["key_"], ["at_", "asks_"]).mapInArrow(_prefixes(instruction), schema)

    # one row for each slice and each slice of blocks that it reaches
    reach = asked.where("not prefix_ and at_ >= first").groupBy("key_", "slice_").agg(F.min("first").alias("from_"), F.max("at_").alias("to_"))
    reach = reach.withColumn("of_", F.explode(F.sequence(F.floor(F.greatest("from_", F.lit(0)) / SLICE), F.col("slice_"))))
    near = blocks.withColumn("of_", F.floor(F.col("at_") / SLICE)).join(reach, ["key_", "of_"]).where("at_ between from_ and to_").select("key_", "slice_", "at_", F.lit(0).alias("asks_"), "text_")
    near = near.unionByName(asked.where("not prefix_").drop("prefix_"), allowMissingColumns=True).repartition(n, "key_", "slice_")
    later = W.partitionBy("key_", "slice_").orderBy(F.desc("at_"), F.desc("asks_")).rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("keep_", F.min(F.when(F.col("at_") >= F.col("first"), F.col("first"))).over(later)).where("asks_ = 1 or at_ >= keep_")
    found = found.unionByName(near.sortWithinPartitions("key_", "slice_", "at_", "asks_").mapInArrow(_windows(instruction), schema))
    return found.withColumn("key", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)))


def _rows(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(_RESULT.values())], list(_RESULT))


def _prefixes(instruction: str):
    head = (instruction + "\n" if instruction else "").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, chars = None, hashlib.sha256(), 0, 0
        for b in batches:
            out = []
            for key, at, asks, text, target, first in _rows(b, "key_", "at_", "asks_", "text_", "target_id", "first"):
                if key != now:
                    now, digest, n, chars = key, hashlib.sha256(head), 0, 0
                if not asks:
                    line = "\n" + text if n else text
                    digest.update(line.encode())
                    n, chars = n + 1, chars + len(line)
                    continue
                line, d = "\n" + text if chars else text, digest.copy()
                d.update(line.encode())
                out.append((key, target, d.hexdigest(), n, chars + len(line), at - first + 1 - n))
            yield _batch(out)

    return run


def _windows(instruction: str):
    head = (instruction + "\n" if instruction else "").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, deque()
        for b in batches:
            out = []
            for key, part, at, asks, text, target, first, cut, keep in _rows(b, "key_", "slice_", "at_", "asks_", "text_", "target_id", "first", "cut", "keep_"):
                if (key, part) != now:
                    now, window = (key, part), deque()
                if not asks:  # a block's keep is over all plans that end at it or later
                    while window and window[0][0] < keep:
                        window.popleft()
                    window.append((at, text))
                    continue
                shown = [x[-cut:] if cut and p == first else "" if cut == 0 and p == first else x for p, x in window if first <= p <= at]
                body = "\n".join(shown)
                line = "\n" + text if body else text
                d = hashlib.sha256(head)
                d.update(body.encode())
                d.update(line.encode())
                out.append((key, target, d.hexdigest(), len(shown), len(body) + len(line), max(at - first + 1, 0) - len(shown)))
            yield _batch(out)

    return run


def disagreeing(found: DataFrame, claimed: DataFrame) -> DataFrame:
    """(key, target_id, reason) of inputs that are not what was claimed for them: rows (key, target_id, model_input_sha256) of either side alone, other digests, and missing blocks."""
    a = found.select(F.col("key").alias("ka"), F.col("target_id").alias("ta"), F.col("model_input_sha256").alias("a"), "missing")
    b = claimed.select(F.col("key").cast("string").alias("kb"), F.col("target_id").cast("string").alias("tb"), F.col("model_input_sha256").alias("b"))
    met = a.join(b, F.col("ka").eqNullSafe(F.col("kb")) & F.col("ta").eqNullSafe(F.col("tb")), "full_outer")
    reason = F.when(F.col("a").isNull(), "plan_missing").when(F.col("missing") > 0, "block_missing").when(F.col("b").isNull(), "not_claimed").when(F.col("a") != F.col("b"), "digest_differs")
    return met.select(F.coalesce("ka", "kb").alias("key"), F.coalesce("ta", "tb").alias("target_id"), reason.alias("reason")).where("reason is not null")


def leaks(plans: DataFrame, blocks: DataFrame, private: DataFrame) -> DataFrame:
    """(key, place, n_targets): blocks that show a private event's text, and the number of plans that show the block whole.

    private: (serialized). A serialized event is one JSON object in one line, whose quotes are escaped wherever it stands inside another
    one, so an input shows it only as a block of its own. Plans are counted by running sums over the places where they begin and end.
    """
    secret = private.where("serialized is not null").select(F.sha2("serialized", 256).alias("digest_")).distinct()
    shown = blocks.withColumn("digest_", F.sha2("serialized", 256)).join(secret, "digest_", "left_semi").select(F.col("key").cast("string").alias("key"), F.col("place").cast("long").alias("place"), F.lit(0).alias("step_"), F.lit(1).alias("last_"))
    begins = (F.col("first") + F.when(F.col("cut").isNotNull(), 1).otherwise(0)).cast("long")
    spans = plans.select(F.col("key").cast("string").alias("key"), begins.alias("from_"), (F.col("last") + 1).cast("long").alias("to_")).where("to_ > from_")
    steps = spans.select("key", F.col("from_").alias("place"), F.lit(1).alias("step_")).unionByName(spans.select("key", F.col("to_").alias("place"), F.lit(-1).alias("step_")))
    steps = steps.groupBy("key", "place").agg(F.sum("step_").cast("int").alias("step_")).withColumn("last_", F.lit(0))
    counted = running(shown.unionByName(steps), ["key"], ["place", "last_"], {"n_targets": F.col("step_")})
    return counted.where("last_ = 1 and n_targets > 0").select("key", "place", F.col("n_targets").cast("long").alias("n_targets"))
