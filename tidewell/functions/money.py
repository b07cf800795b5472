"""Exact money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars a million tokens, and what input beyond the tier costs more.
RATES = {"cached": "0.5", "input": "5", "cache_write": "6.25", "output": "30"}
TIER, INPUT_FACTOR, OUTPUT_FACTOR = 272_000, "2", "1.5"


def priced(tokens: Column, rate: Column) -> Column:
    """tokens * rate / 1,000,000, rounded half-even to 6 places."""
    exact = tokens.cast("decimal(18,0)") * rate.cast("decimal(12,6)")
    return F.bround((exact / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,12)"), 6).cast("decimal(38,6)")


def tiered_cost(input_tokens: Column, cached: Column, cache_write: Column, output: Column) -> Column:
    """Price of a query: cached, written and other input, and output; more beyond the tier. Negative other input is an error."""
    other = input_tokens - cached - cache_write
    over = input_tokens > TIER
    rate = lambda k, f: F.when(over, F.lit(RATES[k]).cast("decimal(12,6)") * F.lit(f).cast("decimal(4,1)")).otherwise(F.lit(RATES[k]).cast("decimal(12,6)"))
    total = priced(cached, rate("cached", INPUT_FACTOR)) + priced(other, rate("input", INPUT_FACTOR)) + priced(cache_write, rate("cache_write", INPUT_FACTOR)) + priced(output, rate("output", OUTPUT_FACTOR))
    return F.when(other < 0, F.raise_error(F.lit("more cached than input tokens")).cast("decimal(38,6)")).otherwise(total.cast("decimal(38,6)"))


def flat_cost(input_tokens: Column, output: Column) -> Column:
    """The price that ignores caching and tiers."""
    return (priced(input_tokens, F.lit(RATES["input"])) + priced(output, F.lit(RATES["output"]))).cast("decimal(38,6)")
