"""Tumbling windows. The same functions serve batch and stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.functions.clock import second_text
from tidemart.functions.numbers import MONEY

SIZE = "10 seconds"


def tumbling(rows: DataFrame, at: Column | str, keys: Sequence[str],
             measures: Mapping[str, Column], size: str = SIZE) -> DataFrame:
    """Measures per window and key. Partial sums are built where the rows are, so neither a
    window without keys nor a hot key ends up in one task."""
    return bounds(rows.groupBy(F.window(at, size).alias("window"), *keys)
                  .agg(*(value.alias(name) for name, value in measures.items())))


def bounds(rows: DataFrame) -> DataFrame:
    """Replace `window` by its start and end as text."""
    rest = [name for name in rows.columns if name != "window"]
    return rows.select(second_text(F.col("window.start")).alias("stt"),
                       second_text(F.col("window.end")).alias("edt"), *rest)


def per_window(rows: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Fold rows that already carry `window` into one row per window."""
    return bounds(rows.groupBy("window")
                  .agg(*(value.alias(name) for name, value in measures.items())))


def orders_and_amount(rows: DataFrame, at: Column | str, keys: Sequence[str], order: str,
                      amount: Column | None = None, size: str = SIZE,
                      count_name: str = "order_count", amount_name: str = "order_amount",
                      ) -> DataFrame:
    """Exact number of different orders, and the sum of an amount, per window and key.

    First one row per order, then the count of those rows: no set of order ids is ever held, and
    both steps have partial sums. As a pair of aggregations it also runs on a stream, where
    distinct aggregates do not. Keeps `window`.
    """
    per_order = rows.groupBy(F.window(at, size).alias("window"), *keys, order)
    if amount is None:
        once = per_order.agg(F.lit(1).alias("_one"))
        sums: list[Column] = []
    else:
        once = per_order.agg(F.sum(F.coalesce(amount, F.lit(0).cast(MONEY)))
                             .alias("_amount"))
        sums = [F.sum("_amount").cast("double").alias(amount_name)]
    again = F.window("window", size) if rows.isStreaming else F.col("window")
    return once.groupBy(again.alias("window"), *keys).agg(F.count("*").alias(count_name), *sums)


def live_count(rows: DataFrame, key: str) -> DataFrame:
    """Running count per key without a window; on a stream a changelog in update mode."""
    return rows.groupBy(key).agg(F.count("*").alias("row_count"))


__all__ = ["SIZE", "bounds", "live_count", "orders_and_amount", "per_window", "tumbling"]
