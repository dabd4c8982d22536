"""PRJ-11 call cost, PRJ-12 usage total, JN-2 price lookup with default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# USD per 1M tokens as (input, cached input, output), and the default rate
# used for any model not listed.
PRICE_TABLE = {
    "gemini-2.5-flash": (0.075, 0.01875, 0.30),
    "gemini-2.5-pro": (1.25, 0.3125, 10.00),
    "gemini-3-pro": (1.25, 0.3125, 10.00),
    "gemini-3-pro-large": (2.50, 0.625, 20.00),
}
DEFAULT_RATE = (1.25, 0.3125, 10.00)


def price_dim(spark: SparkSession) -> DataFrame:
    """The price table as a dimension DataFrame (constant size: safe to broadcast)."""
    rows = [(m, *r) for m, r in PRICE_TABLE.items()]
    return spark.createDataFrame(rows, "model string, rate_in double, rate_cached double, rate_out double")


def cost_expr(input_tokens: Column, cached_tokens: Column, output_tokens: Column,
              rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    # cached tokens are priced on top of input tokens, never subtracted from them
    return (input_tokens * rate_in / 1_000_000 + cached_tokens * rate_cached / 1_000_000
            + output_tokens * rate_out / 1_000_000)


def call_cost(df: DataFrame, spark: SparkSession | None = None, out: str = "cost_usd") -> DataFrame:
    """Add ``cost_usd`` priced from ``model``; unknown models use the default rate."""
    spark = spark or df.sparkSession
    prices = F.broadcast(price_dim(spark))
    j = df.join(prices, "model", "left")
    cost = cost_expr(
        F.coalesce(F.col("input_tokens"), F.lit(0)), F.coalesce(F.col("cached_tokens"), F.lit(0)),
        F.coalesce(F.col("output_tokens"), F.lit(0)),
        F.coalesce(F.col("rate_in"), F.lit(DEFAULT_RATE[0])),
        F.coalesce(F.col("rate_cached"), F.lit(DEFAULT_RATE[1])),
        F.coalesce(F.col("rate_out"), F.lit(DEFAULT_RATE[2])))
    return j.withColumn(out, cost).drop("rate_in", "rate_cached", "rate_out")


def usage_total(input_tokens: Column, output_tokens: Column) -> Column:
    """PRJ-12: total tokens of a call = input + output (cached tokens are not added)."""
    return F.coalesce(input_tokens, F.lit(0)) + F.coalesce(output_tokens, F.lit(0))
