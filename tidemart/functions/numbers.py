"""Numbers that travel as text."""

from __future__ import annotations

from pyspark.sql import Column

MONEY = "decimal(16,2)"


def money(text: Column) -> Column:
    """Exact amount; null when the text is no number."""
    return text.try_cast(MONEY)


def product_text(count: Column, price: Column) -> Column:
    """Count times price as text, keeping the four decimals of the exact product."""
    return (money(count) * money(price)).cast("string")


def whole(text: Column) -> Column:
    return text.try_cast("int")
