"""One row per key: first, latest, and upserts built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str | Column],
                  order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first in `order`.

    `row_number() = 1` lets Spark cut every key to one row inside each input partition before
    the shuffle, so a key that holds a large share of the rows costs one row per partition.
    """
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", ranked).filter("_rank = 1").drop("_rank")


def latest_per_key(rows: DataFrame, keys: Sequence[str | Column], version: Sequence[str],
                   ) -> DataFrame:
    """The row with the highest version; `version` lists columns, most significant first, and
    must be a total order where reruns have to agree."""
    return first_per_key(rows, keys, [F.col(name).desc_nulls_last() for name in version])


def merge_latest(current: DataFrame, changes: DataFrame, keys: Sequence[str],
                 version: Sequence[str]) -> DataFrame:
    """Upsert result: current rows and changes together, newest version of each key."""
    return latest_per_key(current.unionByName(changes), keys, version)
