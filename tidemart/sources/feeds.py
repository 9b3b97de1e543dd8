"""Readers, each with a batch and a stream form that give the same columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemart.functions.clock import from_ms_by_second
from tidemart.operators.logs import parse_text, stream_of, stream_schema
from tidemart.schemas import DICTIONARY, ENVELOPE, PAGE_TABLE, ROUTING, WIDE_ORDER

PAGE_DELAY = "3 seconds"


def topic_text(spark: SparkSession, servers: str, topic: str, *, stream: bool = True,
               options: Mapping[str, str] | None = None) -> DataFrame:
    """Values of a message topic as text, from the earliest offset. Needs the Kafka connector on
    the classpath; `maxOffsetsPerTrigger` in `options` bounds the size of a micro-batch."""
    reader = spark.readStream if stream else spark.read
    return (reader.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest")
            .options(**(options or {})).load()
            .select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value")))


def folder_text(spark: SparkSession, path: str, *, stream: bool = False,
                files_per_trigger: int | None = None) -> DataFrame:
    """The same feed as lines of text files."""
    if not stream:
        return spark.read.text(path)
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def table_rows(spark: SparkSession, path: str, schema: T.StructType | None = None, *,
               stream: bool = False, fmt: str = "parquet",
               files_per_trigger: int | None = None) -> DataFrame:
    """A stored layer of the mart, whole or as it grows."""
    if not stream:
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema else reader).load(path)
    stream_reader = spark.readStream.format(fmt).schema(schema or spark.read.format(fmt).load(path).schema)
    if files_per_trigger:
        stream_reader = stream_reader.option("maxFilesPerTrigger", files_per_trigger)
    return stream_reader.load(path)


def _parsed_once(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of the JSON text; no filter is pushed below the explode to parse it again."""
    row = F.from_json(F.coalesce("value", F.lit("")), schema)
    return raw.select(F.explode(F.array(row)).alias("row")).select("row.*")


def change_log(raw: DataFrame) -> DataFrame:
    """Change-log text as rows with `data` and `old` maps and the time of processing. Rows that
    are no JSON give nulls and fall out at the table filter."""
    return _parsed_once(raw, ENVELOPE).withColumn("proc_time", F.current_timestamp())


def change_log_checked(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, with unreadable rows set aside for a quarantine table."""
    parsed = parse_text(raw.select("value"), ENVELOPE, required=None)
    return parsed.clean.withColumn("proc_time", F.current_timestamp()), parsed.dirty


def page_table(raw: DataFrame, delay: str = PAGE_DELAY) -> DataFrame:
    """Page log as a table of maps with an event time cut to the second and its watermark."""
    rows = _parsed_once(raw, PAGE_TABLE).withColumn("row_time", from_ms_by_second(F.col("ts")))
    return rows.withWatermark("row_time", delay) if rows.isStreaming else rows


def stored_changes(spark: SparkSession, path: str, *tables: str, stream: bool = True,
                   files_per_trigger: int | None = None) -> dict[str, DataFrame]:
    """Changes of some source tables out of the stored split of the feed, a partition each."""
    schema = T.StructType([*(f for f in ENVELOPE.fields if f.name != "table"), ENVELOPE["table"]])

    def one(name: str) -> DataFrame:
        rows = table_rows(spark, path, schema, stream=stream, files_per_trigger=files_per_trigger)
        return rows.filter(F.col("table") == name)

    return {name: one(name) for name in tables}


def stored_stream(spark: SparkSession, path: str, name: str, *, stream: bool = True,
                  more: T.StructType | None = None, files_per_trigger: int | None = None,
                  ) -> DataFrame:
    """One stream of the stored log."""
    rows = table_rows(spark, path, stream_schema(more), stream=stream,
                      files_per_trigger=files_per_trigger)
    return stream_of(rows, name)


def wide_orders(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """The stored wide order rows under their fixed schema."""
    return table_rows(spark, path, WIDE_ORDER, stream=stream)


def routing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Routing config as it is now; streaming jobs read it again in every micro-batch."""
    return spark.read.format(fmt).schema(ROUTING).load(path)


def routing_changes(raw: DataFrame) -> DataFrame:
    """Routing config as changes: the config's columns, `gone` for a source table that is not routed
    any more, `version`. A row image is under `after`; a delete has only `before`, and an update that
    moves a row to another source table takes the old one away."""
    schema = T.StructType([T.StructField("before", ROUTING), T.StructField("after", ROUTING),
                           T.StructField("ts_ms", T.LongType())])
    before, after = F.col("row.before"), F.col("row.after")
    left = before["source_table"].isNotNull() & ~before["source_table"].eqNullSafe(
        after["source_table"])
    steps = F.array(
        F.when(left, F.struct(before.alias("config"), F.lit(True).alias("gone"))),
        F.when(after["source_table"].isNotNull(),
               F.struct(after.alias("config"), F.lit(False).alias("gone"))))
    return (raw.select(F.from_json("value", schema).alias("row"))
            .select(F.explode(F.array_compact(steps)).alias("step"), "row.ts_ms")
            .select("step.config.*", "step.gone", F.col("ts_ms").alias("version")))


def routing_images(raw: DataFrame) -> DataFrame:
    """Routing config out of change rows, whose row image is under `after`; a delete has none."""
    return routing_changes(raw).filter(~F.col("gone")).select(*ROUTING.names)


def dictionary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(DICTIONARY).load(path)


def database_table(spark: SparkSession, table: str, options: Mapping[str, str]) -> DataFrame:
    """A relational table. Address and credentials come from the caller's options; give
    `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` to read it in parallel."""
    return spark.read.format("jdbc").options(**options).option("dbtable", table).load()


def comma_lines(raw: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Comma-separated text lines as columns; missing trailing parts are null."""
    parts = F.split("value", ",")
    return raw.select(*(F.get(parts, F.lit(place)).alias(name) for place, name in enumerate(names)))
