"""The streaming mart end to end: text feeds in, summaries out, job after job."""

import os
import time

import pytest
from pyspark.sql import functions as F

from helpers import only_in
from tidemart import schemas as S
from tidemart.operators import logs, visits
from tidemart.plans import summaries
from tidemart.session import work_dir
from tidemart.sources import standin
from tidemart.streaming.mart import JOBS, Mart, run

HOUR = "1 hour"


@pytest.fixture(scope="module")
def mart(spark, sf):
    root = work_dir(spark, "mart")
    log = standin.behaviour(spark, sf).filter("event_id < 400")
    log.orderBy("ts").select(F.to_json(F.struct(*S.BEHAVIOUR.names)).alias("value")).unionByName(
        spark.createDataFrame([("broken",)], "value string")).coalesce(1).write.text(
            f"{root}/feed/log")
    tables = standin.table_changes(spark, sf, "user_info", "base_province", *standin.ORDERING)
    # orders and their details are written at the same moment
    together = {
        name: rows if name in ("user_info", "base_province") else rows.withColumn(
            "ts", (F.coalesce(*(rows[f"data.{key}"].cast("bigint") / scale for key, scale in keys))
                   .cast("bigint") * 60 + 1_700_000_000).cast("string"))
        for name, rows, keys in (
            (name, rows, {"order_info": [("id", 1)], "order_detail": [("order_id", 1)]}.get(
                name, [("order_detail_id", 10)])) for name, rows in tables.items())}
    feed = standin.as_one_log(together)
    feed.select(F.to_json(F.struct(*S.ENVELOPE.names)).alias("value")).coalesce(1).write.text(
        f"{root}/feed/db")
    standin.dictionary(spark).withColumns({
        "create_time": F.lit(None).cast("timestamp"), "operate_time": F.lit(None).cast("timestamp"),
    }).write.parquet(f"{root}/dim/dictionary")
    standin.routing(spark).write.parquet(f"{root}/dim/routing")
    return Mart(spark, root, size=HOUR, hold_ms=0)


def finish(mart, *names):
    for name in names:
        run(mart, name).awaitTermination()


def settle(mart, spark):
    """Let the job on the clock run until every detail has come through."""
    details = spark.read.parquet(f"{mart.root}/fact/order_detail")
    wanted = details.select("id").distinct().count()
    path = f"{mart.root}/fact/order_settled"
    query, deadline = run(mart, "order_settled", "500 milliseconds"), time.monotonic() + 60
    try:
        while time.monotonic() < deadline:
            query.awaitTermination(1)
            if os.path.exists(f"{path}/_spark_metadata") and \
                    spark.read.schema(details.schema).parquet(path).count() >= wanted:
                break
    finally:
        query.stop()


def test_jobs_on_the_clock_need_an_interval(mart):
    assert len(JOBS) == 33
    with pytest.raises(ValueError):
        run(mart, "order_settled")


def test_log_side(mart, spark, sf):
    finish(mart, "log_streams", "log_rejects", "unique_visitor", "bounce", "traffic_window")
    read = lambda name: spark.read.parquet(f"{mart.root}/fact/{name}")
    assert [r["value"] for r in read("log_rejects").collect()] == ["broken"]
    log = standin.behaviour(spark, sf).filter("event_id < 400").drop("event_id")
    pages = logs.split_log(logs.repair_new_visitors(log)).page
    assert mart.log_stream("page", stream=False).count() == pages.count()
    visitors = visits.daily_visitors(pages)
    assert read("unique_visitor").count() == visitors.count()
    found = mart.summary("traffic", ("version", "channel", "area", "is_new"))
    batch = summaries.tumbling(
        summaries.traffic_rows(pages, read("bounce"), visitors),
        F.timestamp_millis("ts"), ["version", "channel", "area", "is_new"],
        {name: F.sum(name) for name in summaries.MEASURES}, HOUR)
    assert only_in(found, batch) == (0, 0)


def test_trade_side(mart, spark):
    finish(mart, "change_tables", "dimensions", "order_wide", "order_detail")
    settle(mart, spark)
    finish(mart, "province_window")
    assert mart.dimension("base_province").filter("id <> ''").count() == 25
    stored = spark.read.parquet(f"{mart.root}/fact/order_detail")
    settled = spark.read.parquet(f"{mart.root}/fact/order_settled")
    assert stored.count() > 0 and settled.count() > 0
    assert settled.groupBy("id").count().filter("count > 1").count() == 0
    found = mart.summary("province", ["province_id"])
    batch = summaries.province_window(settled, mart.dimension("base_province"), HOUR)
    extra, missing = only_in(found, batch)
    last = batch.agg(F.max("stt")).first()[0]
    assert extra == 0 and missing <= batch.filter(F.col("stt") == last).count()


def test_registrations(mart, spark):
    finish(mart, "change_tables", "user_register", "register_window")
    rows = spark.read.parquet(f"{mart.root}/fact/user_register")
    assert only_in(mart.summary("register"), summaries.register_window(rows, HOUR)) == (0, 0)
    assert rows.columns == ["user_id", "date_id", "create_time", "ts"]
