"""Where streams end. Every query has its own checkpoint below the folder given."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tidemart.operators import dimensions
from tidemart.operators.logs import tagged
from tidemart.operators.versions import latest_per_key
from tidemart.schemas import ROUTING

Batch = Callable[[DataFrame, int], None]


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON text in `value`."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a query; without a trigger interval it takes what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every
            else writer.trigger(availableNow=True)).start()


def to_topic(rows: DataFrame, servers: str, topic: str) -> DataStreamWriter:
    """JSON rows to a message topic (needs the Kafka connector)."""
    return (as_json(rows).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic))


def to_files(rows: DataFrame, path: str, fmt: str = "parquet") -> DataStreamWriter:
    """Append to a folder, each row exactly once."""
    return rows.writeStream.format(fmt).option("path", path).outputMode("append")


def to_console(rows: DataFrame, mode: str = "append") -> DataStreamWriter:
    return rows.writeStream.format("console").option("truncate", "false").outputMode(mode)


def to_upserts(rows: DataFrame, path: str, keys: Sequence[str], version: Sequence[str] = (),
               mode: str = "update",
               finish: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Keep the newest row per key by appending.

    `finish` is applied to each micro-batch: what it reads, such as dimensions for names, it reads
    as it is at that time, not as it was when the query started.

    Each micro-batch writes its own newest rows to a folder named after the batch, so the cost is
    that of the batch, whatever the size of the target, and a repeated batch replaces what its
    first attempt left. `current` reads the target.
    """
    def write(batch: DataFrame, number: int) -> None:
        order = list(version)
        newest = latest_per_key(batch, list(keys), order) if order else batch
        (finish(newest) if finish else newest).write.mode("overwrite").parquet(
            f"{path}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(write)


def current(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str] = (),
            gone: str | None = None, merge: bool = False) -> DataFrame:
    """Newest row per key of an upsert target; later batches win over earlier ones. A key whose newest
    row meets `gone` has been retracted and is left out. `merge` takes the columns of all batches
    together, where they may differ."""
    rows = spark.read.option("basePath", path).option("mergeSchema", merge).parquet(path)
    newest = latest_per_key(rows, list(keys), [*version, "batch"]).drop("batch")
    return newest.filter(~F.coalesce(F.expr(gone), F.lit(False))) if gone else newest


def rewrite(spark: SparkSession, path: str, target: str, keys: Sequence[str],
            version: Sequence[str] = ()) -> None:
    """Fold an upsert target into a new one that holds each key once."""
    current(spark, path, keys, version).write.parquet(f"{target}/batch=0")


def to_merged_table(rows: DataFrame, table: str, keys: Sequence[str], version: Sequence[str],
                    mode: str = "append") -> DataStreamWriter:
    """Upsert into a catalog table whose format supports MERGE."""
    def write(batch: DataFrame, _: int) -> None:
        newest = latest_per_key(batch, list(keys), list(version)).alias("fresh")
        match = [F.col(f"{table}.{key}") == F.col(f"fresh.{key}") for key in keys]
        condition = match[0]
        for part in match[1:]:
            condition = condition & part
        (newest.mergeInto(table, condition).whenMatched().updateAll()
         .whenNotMatched().insertAll().merge())

    return rows.writeStream.outputMode(mode).foreachBatch(write)


def to_database(rows: DataFrame, columns: Sequence[str], options: Mapping[str, str],
                mode: str = "append") -> DataStreamWriter:
    """Append summaries to a relational table: the columns named, in that order, and the time of
    writing as `ts`. Working columns not named are left out. Start it every 5 seconds."""
    def write(batch: DataFrame, _: int) -> None:
        stamped(batch, columns).write.format("jdbc").options(**options).mode("append").save()

    return rows.writeStream.outputMode(mode).foreachBatch(write)


def stamped(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sink rows of a summary: ordered columns and the processing time in epoch milliseconds."""
    return rows.select(*columns, F.unix_millis(F.current_timestamp()).alias("ts"))


def to_log_streams(log: DataFrame, path: str) -> DataStreamWriter:
    """Fan a repaired log out to its five streams: one folder, a partition a stream, written by one
    query. The sink lists the files of every finished micro-batch, and readers of the folder go by
    that list, so a repeated micro-batch or files of a lost task are never seen downstream.
    `logs.stream_of` picks a stream; a filter on it reads its partition only."""
    return to_files(tagged(log), path).partitionBy("stream")


def to_change_tables(log: DataFrame, path: str) -> DataStreamWriter:
    """The change feed parsed once and kept per source table, in the same way: each row exactly
    once, and a job reads the partitions of its tables only."""
    return to_files(log.select("database", "type", "data", "old", "ts", "table"), path
                    ).partitionBy("table")


def to_dimensions(log: DataFrame, path: str, config: Callable[[], DataFrame],
                  version: Sequence[str] = ("ts",)) -> DataStreamWriter:
    """Load dimensions: each micro-batch reads the routing config as it is now and writes the
    newest images of every target. Versions are numbers, though the log has them as text.
    `dimension` reads a target."""
    def write(batch: DataFrame, number: int) -> None:
        _load(batch, config(), path, version, number)

    return log.writeStream.outputMode("append").foreachBatch(write)


def _load(log: DataFrame, routing: DataFrame, path: str, version: Sequence[str],
          number: int) -> None:
    """The newest images of a micro-batch to its own folder of every target."""
    routed = dimensions.route(log, routing, dimensions.source_tables(routing)).withColumns(
        {name: F.col(name).cast("bigint") for name in version})
    routed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        images = dimensions.current_images(routed, tuple(version))
        for row in routing.collect():
            kept = images.filter(F.col("sink_table") == row["sink_table"])
            table = kept.select("pk", *version, *(
                F.col("data")[name].alias(f"c_{name}")
                for name in row["sink_columns"].split(",")))
            table.write.mode("overwrite").parquet(f"{path}/{row['sink_table']}/batch={number}")
    finally:
        routed.unpersist()


def to_routed_dimensions(log: DataFrame, routing: DataFrame, path: str, history: str,
                         stored: DataFrame, version: Sequence[str] = ("ts",)) -> DataStreamWriter:
    """Load dimensions while their routing config is a stream of changes itself
    (`feeds.routing_changes`).

    A micro-batch first appends its config changes to `history`, then routes its rows by what the
    changes up to it add up to: a table configured a moment ago gets its target and its rows, one taken
    out stops, other columns hold from there on. Rows that came before their config are not routed.
    `stored`, the config as the job first finds it, comes before all changes. A repeated micro-batch
    writes the same files again and sees no later change."""
    spark = log.sparkSession
    stored.select(*ROUTING.names, F.lit(False).alias("gone"), F.lit(None).cast("bigint").alias(
        "version")).write.mode("ignore").parquet(f"{history}/batch=-1")
    changes = routing.select(F.struct(*ROUTING.names, "gone", "version").alias("routing"))

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.filter(F.col("routing").isNotNull()).select("routing.*")
        fresh.write.mode("overwrite").parquet(f"{history}/batch={number}")
        known = (spark.read.option("basePath", history).schema(
                    fresh.schema.add("batch", "long")).parquet(history)
                 .filter(F.col("batch") <= number))
        config = dimensions.routing_now(known)
        create_targets(spark, path, config.join(fresh.select("source_table"), "source_table",
                                                "left_semi"), version)
        _load(batch.filter(F.col("routing").isNull()).drop("routing"), config, path, version, number)

    both = log.unionByName(changes, allowMissingColumns=True)
    return both.writeStream.outputMode("append").foreachBatch(write)


def dimension(spark: SparkSession, path: str, sink_table: str,
              version: Sequence[str] = ("ts",)) -> DataFrame:
    """A loaded dimension: one row per key, configured columns only. A column that the config took up
    later is null in rows loaded before."""
    rows = current(spark, f"{path}/{sink_table}", ["pk"], version, merge=True)
    return rows.select(*(F.col(name).alias(name[2:]) for name in rows.columns
                         if name.startswith("c_")))


def create_targets(spark: SparkSession, path: str, config: DataFrame,
                   version: Sequence[str] = ("ts",)) -> None:
    """An empty table for every configured target that is not there yet, so that readers find
    its columns before the first row has come."""
    for row in config.select(*ROUTING.names).collect():
        schema = dimensions.target_schema(row)
        empty = spark.createDataFrame([], schema).select(
            F.lit("").alias("pk"), *(F.lit(0).cast("bigint").alias(name) for name in version),
            *(F.col(name).alias(f"c_{name}") for name in schema.names))
        empty.write.mode("ignore").parquet(f"{path}/{row['sink_table']}/batch=-1")
