"""Keyed reads of a dimension table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidemart.operators.versions import first_per_key


def one_per_key(dimension: DataFrame, *keys: str) -> DataFrame:
    """A dimension with at most one row per key, so that a lookup cannot multiply facts. Which
    row stays is fixed by the order of its columns."""
    rest = [F.col(name) for name in dimension.columns if name not in keys]
    return first_per_key(dimension, list(keys), rest or [F.col(keys[0])])


def by_key(dimension: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """Rows with the given key values; the conditions are pushed to the scan."""
    found = dimension
    for column, value in key.items():
        found = found.filter(F.col(column) == value)
    return found
