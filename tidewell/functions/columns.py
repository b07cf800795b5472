"""Columns that are made once: large expressions over fixed column names take seconds to put together, whatever the data."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame

Steps = list[dict[str, Column]]


def remembered(build: Callable[[], object]) -> Callable[[], object]:
    """A function without arguments that makes columns from names alone, called once for each running Spark."""
    made: dict[int, object] = {}

    @wraps(build)
    def get() -> object:
        # the context is held with its columns, so that its number isn't given to another one
        context = SparkContext._active_spark_context
        if id(context) not in made:
            made.clear()
            made[id(context)] = (context, build())
        return made[id(context)][1]

    return get


def with_steps(rows: DataFrame, steps: Steps) -> DataFrame:
    """Adds columns step by step, those of a step at once."""
    for step in steps:
        rows = rows.withColumns(step)
    return rows
