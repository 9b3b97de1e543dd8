"""Config-driven dimensions: route changes to target tables, keep the current image per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from tidemart.operators.changes import row_images
from tidemart.operators.versions import latest_per_key

DEFAULT_KEY = "id"


def source_tables(config: DataFrame) -> list[str]:
    """Names of the routed tables: control data, one row per source table of the database."""
    return sorted(row[0] for row in config.select("source_table").distinct().collect())


def routing_now(changes: DataFrame) -> DataFrame:
    """The config that changes add up to: the last per source table, by `batch` and then `version`,
    unless that takes the table out."""
    return (latest_per_key(changes, ["source_table"], ["batch", "version"])
            .filter(~F.col("gone")).drop("gone", "batch", "version"))


def route(log: DataFrame, config: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """Tag each row image with its target and keep the configured columns of it; tables without
    a config row are dropped.

    `tables`, from `source_tables`, turns that into a filter the scan of the log can use, so the
    facts in the log, usually most of it, are not read at all.
    """
    listed = F.split("sink_columns", ",")
    images = row_images(log if tables is None else log.filter(F.col("table").isin(*tables)))
    return (images
            .join(config.select("source_table", "sink_table", "sink_columns", "sink_pk"),
                  F.col("table") == F.col("source_table"), "inner")
            .withColumn("data", F.map_filter("data", lambda key, _: F.array_contains(listed, key)))
            .withColumn("pk", key_value(F.col("data"), F.col("sink_pk")))
            .drop("source_table", "sink_columns", "sink_pk"))


def unrouted(log: DataFrame, config: DataFrame) -> DataFrame:
    """Row images no config row claims."""
    return row_images(log).join(config.select(F.col("source_table").alias("table")), "table",
                                "left_anti")


def key_value(data: Column, sink_pk: Column) -> Column:
    """Value of the key column named in the config, `id` when none is."""
    return data[F.coalesce(F.nullif(sink_pk, F.lit("")), F.lit(DEFAULT_KEY))]


def current_images(routed: DataFrame, version: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest image per target and key, for all targets at once."""
    return latest_per_key(routed, ["sink_table", "pk"], version)


def target_schema(config_row: Row) -> T.StructType:
    """All-text schema of a target table. The key is the config's, or `id`, and not nullable."""
    key = config_row["sink_pk"] or DEFAULT_KEY
    return T.StructType([T.StructField(name, T.StringType(), name != key)
                         for name in config_row["sink_columns"].split(",")])


def as_table(images: DataFrame, config_row: Row) -> DataFrame:
    """Rows of one target as plain columns."""
    return (images.filter(F.col("sink_table") == config_row["sink_table"])
            .select(*(F.col("data")[name].alias(name)
                      for name in config_row["sink_columns"].split(","))))
