"""Small Spark helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.shared import cut, written

__all__ = ["ARROW_ROWS", "arrow_batches", "connected_components", "cut", "partitions", "release", "released", "unused", "whole_groups", "written"]

#: Rows in one Arrow batch handed to Python; texts are long, so batches are kept short.
ARROW_ROWS = 500


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole texts small, so that a task's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Give freed memory back to the system; workers are kept for the next stages, which need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For the functions of mapInArrow: release memory when a task's batches are done."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each group of equal keys, from batches that are sorted by them."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        key = np.stack([t.column(c).to_numpy() for c in keys], axis=1).astype(np.int64)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(t)]
        for first, end in zip(edges, edges[1:], strict=False):
            if held and tuple(key[first]) != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(first, end - first))
            last = tuple(key[first])
    if held:
        yield pa.concat_tables(held)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge list (u, v) with the smallest node reachable.

    Alternates the large-star and small-star steps until the edges are stars. A node's neighbours
    are never gathered: each step is a map-side-combined minimum and a join, so a hub with any number
    of neighbours is summed before the shuffle. Returns (node, component) for nodes on an edge.
    Self-loops are ignored; an empty edge list gives an empty table.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges, last = cut(tidy(edges.select("u", "v"))), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            break
        last = now
        edges = cut(tidy(star(tidy(star(edges, True)), False)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
