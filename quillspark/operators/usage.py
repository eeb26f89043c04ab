"""Token and cost ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# USD for a million input and output tokens; the first name that a model contains counts.
PRICES = [
    ("claude-opus", 15, 75), ("claude-sonnet", 3, 15), ("claude-haiku", 0.8, 4), ("claude", 3, 15), ("gpt-5", 10, 30), ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4o", 2.5, 10), ("o3", 10, 40), ("gemini-2.5-pro", 1.25, 10), ("gemini-2.5-flash", 0.15, 0.6), ("gemini", 0.5, 1.5), ("deepseek-reasoner", 0.55, 2.19),
    ("deepseek", 0.27, 1.1), ("qwen3-235b", 0.35, 1.4), ("qwen", 0.1, 0.4), ("glm", 0.1, 0.4), ("kimi", 0.6, 2.5), ("llama", 0.2, 0.6),
]
CONFIRM_USD = 0.5


def price(model: Column, local: Column | None = None, prices: list[tuple] = PRICES) -> Column:
    """struct<in, out> or null for an unknown model. A handful of patterns is an expression, not a join."""
    made = lambda i, o: F.struct(F.lit(float(i)).alias("in"), F.lit(float(o)).alias("out"))
    out = F.when(local if local is not None else F.lit(False), made(0, 0))
    for pattern, i, o in prices:
        out = out.when(F.contains(F.lower(model), F.lit(pattern)), made(i, o))
    return out


def cost(usage: DataFrame, local: Column | None = None, prices: list[tuple] = PRICES) -> DataFrame:
    """Usage with ``usd``: null where no price is known, 0 where ``local`` says that the model runs here. ``prices`` may have rows of the caller's before these."""
    p = price(F.col("model"), local, prices)
    return usage.withColumn("usd", (F.col("input_tokens") * p["in"] + F.col("output_tokens") * p["out"]) / 1_000_000)


def by_month(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), *keys).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.count(F.lit(1)).alias("calls"))


def overview(usage: DataFrame) -> DataFrame:
    """(month, usd, unpriced): spend, and the models without a price."""
    rows = cost(usage)
    unknown = F.array_join(F.array_sort(F.collect_set(F.when(F.col("usd").isNull(), F.col("model")))), ",")
    return rows.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.round(F.sum("usd"), 6).alias("usd"), unknown.alias("unpriced"))


def estimate(paras: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Tokens and cost of translating the paragraphs that need it: characters / 3.8, 160 tokens for six paragraphs, 1.3 out for 1 in."""
    sums = paras.groupBy(*keys).agg(F.count(F.lit(1)).alias("paras"), F.sum(F.char_length("text")).alias("chars"))
    text = F.ceil(F.col("chars") * 10 / 38)
    out = sums.withColumn("input_tokens", text + F.ceil(F.col("paras") / 6) * 160).withColumn("output_tokens", F.ceil(text * 13 / 10)).withColumn("model", F.lit(model))
    priced = cost(out)
    return priced.select(*keys, "paras", "input_tokens", "output_tokens", F.round("usd", 6).alias("usd"), (F.col("usd") > CONFIRM_USD).alias("confirm"))
