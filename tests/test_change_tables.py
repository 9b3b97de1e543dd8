"""The raw change feed split in turns: where its text is made, and which rows it has."""

import shutil

import pytest
from pyspark.sql import functions as F

from helpers import only_in
from tidemart.plans import catalog
from tidemart.session import work_dir
from tidemart.sources import standin
from tidemart.streaming import sinks


def test_text_of_one_row_group_is_made_by_many_tasks(spark, sf, monkeypatch):
    made, as_one_log = [], standin.as_one_log
    monkeypatch.setattr(standin, "as_one_log", lambda tables: made.append(as_one_log(tables)) or made[-1])
    assert catalog.stream_change_tables(spark, sf).count() > 0
    feed, = made
    assert len(spark.read.parquet(f"{sf}/orders.parquet").select(F.spark_partition_id()).distinct().collect()) == 1
    tasks = feed.groupBy("table", F.spark_partition_id().alias("task")).count().groupBy("table").agg(
        F.count("*").alias("tasks"), F.max("count").alias("most"), F.sum("count").alias("rows")).collect()
    assert len(tasks) == 2
    assert all(t.tasks == 8 and t.most < t.rows / 4 for t in tasks)


def test_orders_without_a_date_are_split_too(spark, sf, tmp_path):
    shutil.copy(f"{sf}/events.parquet", tmp_path)
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderdate", F.when(
        F.col("o_orderkey") % 7 != 1, F.col("o_orderdate")))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.stream_change_tables(spark, str(tmp_path))
    assert found.filter("ts IS NULL").count() > 0
    assert only_in(found, catalog.change_text(spark, str(tmp_path))) == (0, 0)


@pytest.mark.parametrize("count", [0, 1000])
def test_turns_hand_out_each_row_once_in_order_of_time(spark, count):
    """Also of a feed without rows; a row without a time comes in the first turn."""
    rows = spark.range(count).select("id", F.when(F.col("id") != 999, F.col("id") * 60).alias("at"))
    out, checkpoint, seen = work_dir(spark, "out"), work_dir(spark, "ck"), []
    for stream in catalog._turns(rows, "turns", at="at"):
        query = sinks.start(sinks.to_files(stream, out), checkpoint)
        assert query.awaitTermination(120)
        seen.append(sorted(r.id for r in spark.read.schema(rows.schema).parquet(out).collect()))
    assert len(seen) == 4 and seen[-1] == list(range(count))
    if count:
        added = [sorted({*now} - {*before} - {999}) for before, now in zip([[], *seen], seen)]
        assert 999 in seen[0] and sum(added, []) == list(range(999)) and all(len(a) > 200 for a in added)


def test_log_text_of_one_row_group_is_made_by_many_tasks(spark, sf, monkeypatch):
    made, replayed = [], catalog._replayed
    monkeypatch.setattr(catalog, "_replayed", lambda rows, *more, **named: made.append(rows) or replayed(
        rows, *more, **named))
    catalog.stream_log_split(spark, sf)
    text, = made
    tasks = text.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 8 and max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 4
    assert only_in(text, standin.behaviour_text(spark, sf, timed=True)) == (0, 0)
