"""Corpus totals, money and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import framed, token_count, token_counts, total

PRICE_IN, PRICE_OUT = 3.00, 15.00


def tool_tokens(tools: Column) -> Column:
    return total(token_counts(F.transform(tools, lambda t: t["schema_json"])))


def summary(requests: DataFrame) -> DataFrame:
    """(records, calls, message_tokens, tool_tokens, output_tokens, input_tokens, avg_input, n_sources)."""
    w = F.col("weight")
    r = requests.select(
        "weight",
        framed(F.col("messages")).alias("m"),
        tool_tokens(F.col("tools")).alias("t"),
        token_count("completion").alias("o"),
        F.substring_index("source", ":", 1).alias("s"),
    )
    whole = lambda c: F.coalesce(F.sum(F.col(c) * w), F.lit(0))
    out = r.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(w), F.lit(0)).alias("calls"), whole("m").alias("message_tokens"), whole("t").alias("tool_tokens"), whole("o").alias("output_tokens"), F.count_distinct("s").alias("n_sources"))
    out = out.withColumn("input_tokens", F.col("message_tokens") + F.col("tool_tokens"))
    avg = F.when(F.col("calls") > 0, F.floor(F.col("input_tokens") / F.col("calls"))).otherwise(0).cast("long")
    return out.select("records", "calls", "message_tokens", "tool_tokens", "output_tokens", "input_tokens", avg.alias("avg_input"), "n_sources")


def money(tokens: float, price: float) -> float:
    return tokens / 1e6 * price


def projection(totals: DataFrame, measured: DataFrame, high: DataFrame, calls: int, price_in: float = PRICE_IN) -> DataFrame:
    """Monthly and yearly money at `calls` a month; high has one row with `high_tokens`."""
    x = totals.crossJoin(measured.select("saved")).crossJoin(high)  # single rows
    safe = F.col("saved") + F.col("high_tokens")
    scale = F.lit(calls) / F.col("calls")
    usd = lambda t: t.cast("long") / 1e6 * price_in
    return x.where("calls > 0").select(
        safe.alias("safe_tokens"),
        F.when(F.col("input_tokens") > 0, safe / F.col("input_tokens") * 100).otherwise(0.0).alias("safe_pct"),
        scale.alias("scale"),
        usd(F.col("input_tokens") * scale).alias("monthly_spend"),
        usd(safe * scale).alias("monthly_saving"),
        usd(safe * scale * 12).alias("annual_saving"),
    )
