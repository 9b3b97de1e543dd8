"""Dictionary and dimension joins.

Nothing is hinted: Spark broadcasts a side whose size it has checked and shuffles otherwise.
Files and local rows have a known size; a relational table has none before it is read, so Spark
joins it by shuffle and AQE turns that into a broadcast when what it has read is small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


#: A dictionary table, or what adds the name of a code to rows (rows, code, name) in its own way.
Dictionary = DataFrame | Callable[[DataFrame, str, str], DataFrame]


def name_of(rows: DataFrame, dictionary: Dictionary, code: str, name: str) -> DataFrame:
    """Add the dictionary name of a code; rows whose code has no entry are lost."""
    if not isinstance(dictionary, DataFrame):
        return dictionary(rows, code, name)
    entries = dictionary.select(F.col("dic_code").alias("_code"), F.col("dic_name").alias(name))
    return rows.join(entries, rows[code] == entries["_code"], "inner").drop("_code")


def unnamed(rows: DataFrame, dictionary: DataFrame, code: str) -> DataFrame:
    """The rows `name_of` loses, to be counted or set aside."""
    return rows.join(dictionary.select(F.col("dic_code").alias(code)), code, "left_anti")


def enrich(rows: DataFrame, dimension: DataFrame, on: Mapping[str, str],
           take: Mapping[str, str | Column]) -> DataFrame:
    """Left lookup by one or more keys: rows without a match stay, with nulls.

    `on` maps a column of `rows` to a key column of the dimension, `take` a new column to a
    dimension column. The dimension must hold one row per key.
    """
    picked = dimension.select(
        *(F.col(key).alias(f"_key_{place}") for place, key in enumerate(on.values())),
        *(value.alias(name) if isinstance(value, Column) else F.col(value).alias(name)
          for name, value in take.items()))
    match: Sequence[Column] = [rows[column] == picked[f"_key_{place}"]
                               for place, column in enumerate(on)]
    return rows.join(picked, list(match), "left").drop(*(f"_key_{p}" for p in range(len(on))))


def category_names(rows: DataFrame, category3: DataFrame, category2: DataFrame,
                   category1: DataFrame) -> DataFrame:
    """From `category3_id` up to the names and ids of all three levels.

    The three levels are flattened to one small dimension first, so the facts are joined once.
    """
    levels = enrich(category3, category2, {"category2_id": "id"},
                    {"category2_name": "name", "category1_id": "category1_id"})
    levels = enrich(levels, category1, {"category1_id": "id"}, {"category1_name": "name"})
    return enrich(rows, levels, {"category3_id": "id"},
                  {"category3_name": "name", "category2_id": "category2_id",
                   "category2_name": "category2_name", "category1_id": "category1_id",
                   "category1_name": "category1_name"})
