"""Stream and batch give the same answers on time-ordered input in several micro-batches."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F, types as T

from helpers import only_in
from tidemart import schemas as S
from tidemart.operators import changes, dimensions, logs, versions, visits, windows
from tidemart.plans import catalog, facts, summaries
from tidemart.session import work_dir
from tidemart.sources import feeds, standin
from tidemart.streaming import jobs, live, rules, sinks

TIE, HOUR, DAY = catalog.TIE, catalog.HOUR, catalog.DAY


@pytest.fixture(scope="module")
def pages(spark, sf):
    return standin.pages(spark, sf).cache()


@pytest.fixture(scope="module")
def page_stream(replay, pages):
    source = replay.stream(pages, TIE)
    return lambda: source


@pytest.fixture(scope="module")
def details(spark, sf):
    """Order details, one version each, in a time range short enough for many lines per day."""
    rows = facts.order_detail(catalog._wide(spark, sf)).withColumn(
        "row_op_ts", F.timestamp_seconds(F.col("ts").cast("bigint")))
    return versions.latest_per_key(rows, ["id"], catalog.DETAIL_VERSION).cache()


def test_new_visitor_repair(replay, pages, page_stream):
    found = replay.appended(rules.repair_new_visitors(page_stream(), TIE))
    assert only_in(found, logs.repair_new_visitors(pages, TIE)) == (0, 0)


def test_daily_visitors(replay, pages, page_stream):
    found = replay.appended(rules.daily_visitors(page_stream(), TIE))
    assert only_in(found, visits.daily_visitors(pages, TIE)) == (0, 0)


def test_bounces_but_for_those_still_open(replay, pages, page_stream):
    gap, piece = catalog.GAP_MS, catalog.PIECE_MS
    found = replay.appended(rules.bounces(page_stream(), gap, piece, TIE))
    batch = visits.bounces(pages, gap, piece, TIE)
    extra, missing = only_in(found, batch)
    end = pages.agg(F.max("ts")).first()[0]
    still_open = batch.filter(F.col("ts") + gap > end - 2000).count()
    assert extra == 0 and missing <= still_open


def test_home_detail_window_closed_windows(replay, pages, page_stream):
    found = replay.appended(jobs.home_detail_window(page_stream(), HOUR))
    extra, missing = only_in(found, summaries.home_detail_window(pages, HOUR))
    assert extra == 0 and missing <= 1


def test_login_window_closed_windows(replay, pages, page_stream):
    found = replay.appended(jobs.login_window(page_stream(), HOUR, 4))
    extra, missing = only_in(found, summaries.login_window(pages, HOUR, 4))
    assert extra == 0 and missing <= 1


def test_keyword_window_by_upsert(replay, pages, page_stream):
    found = replay.upserted(jobs.keyword_window(page_stream(), HOUR), ["stt", "keyword"])
    assert only_in(found, summaries.keyword_window(pages, HOUR)) == (0, 0)


def test_traffic_window_by_upsert(replay, spark, pages):
    """Three streams, a day of lateness because they run apart, each window replaced as it grows."""
    gap, piece = catalog.GAP_MS, catalog.PIECE_MS
    bounced = visits.bounces(pages, gap, piece, TIE)
    visitors = visits.daily_visitors(pages, TIE)
    streams = [replay.stream(rows, TIE, 2) for rows in (pages, bounced, visitors)]
    found = replay.upserted(
        jobs.traffic_window(*streams, HOUR, gap, lateness="40 days"),
        ["stt", "version", "channel", "area", "is_new"])
    assert only_in(found, summaries.traffic_window(pages, HOUR, gap, piece, TIE)) == (0, 0)


def test_register_window_by_upsert(replay, spark, sf):
    rows = facts.user_register(standin.table_changes(spark, sf, "user_info"))
    found = replay.upserted(jobs.register_window(replay.stream(rows, ["ts"]), HOUR), ["stt"])
    assert only_in(found, summaries.register_window(rows, HOUR)) == (0, 0)


def test_cart_users_closed_windows(replay, spark, sf):
    rows = catalog.cart_delta(spark, sf)
    found = replay.appended(jobs.cart_user_window(replay.stream(rows, ["ts"]), HOUR))
    extra, missing = only_in(found, summaries.cart_user_window(rows, HOUR))
    assert extra == 0 and missing <= 1


def test_order_window_closed_windows(replay, details):
    found = replay.appended(jobs.order_window(replay.stream(details, [F.col("ts").cast("bigint"), "id"]), DAY))
    batch = summaries.order_window(details, DAY, catalog.DETAIL_VERSION)
    extra, missing = only_in(found, batch)
    assert extra == 0 and missing <= 1


def test_province_window_closed_windows(replay, spark, sf, details):
    provinces = standin.provinces(spark, sf)
    found = replay.appended(
        jobs.province_window(replay.stream(details, [F.col("ts").cast("bigint"), "id"]), provinces, DAY))
    batch = summaries.province_window(details, provinces, DAY, catalog.DETAIL_VERSION)
    extra, missing = only_in(found, batch)
    # windows are closed one micro-batch after the first of two aggregations has closed them
    last = batch.agg(F.max("stt")).first()[0]
    open_rows = batch.filter(F.col("stt") == last).count()
    assert extra == 0 and missing <= open_rows


def test_user_spu_window_closed_windows(replay, spark, sf, details):
    dims = standin.product_dimensions(spark, sf)
    found = replay.appended(
        jobs.user_spu_window(replay.stream(details, [F.col("ts").cast("bigint"), "id"]), dims, DAY))
    extra, missing = only_in(
        found, summaries.user_spu_window(details, dims, DAY, catalog.DETAIL_VERSION))
    assert extra == 0 and missing <= 5


def in_batches(spark, schema, *batches):
    """A stream of one file per micro-batch, rows of a file in the order given."""
    path = work_dir(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return (spark.readStream.schema(spark.createDataFrame([], schema).schema)
            .option("maxFilesPerTrigger", 1).parquet(path))


VISIT = "common struct<mid: string>, page struct<last_page_id: string>, ts bigint"


def test_bounces_of_rows_out_of_order_over_micro_batches(replay, spark):
    """An entry at 5.0 s, then in the next micro-batch the page before it at 4.5 s: as in batch the
    entry stands alone. An inner page within the gap, late but within the delay, undoes a bounce.
    Rows without a time are no bounce and harm nothing."""
    rows = [[(("a",), (None,), 5_000), (("b",), (None,), 5_000), (("c",), (None,), None)],
            [(("a",), ("x",), 4_500), (("b",), ("x",), 6_000), (("c",), ("x",), None)],
            [(("z",), ("x",), 500_000)], [(("z",), ("x",), 900_000)]]
    stream = in_batches(spark, VISIT, *rows)
    found = replay.appended(rules.bounces(stream, 10_000, 600_000))
    batch = visits.bounces(spark.createDataFrame(sum(rows, []), VISIT), 10_000, 600_000)
    assert [(r.common.mid, r.ts) for r in batch.collect()] == [("a", 5_000)]
    assert [(r.common.mid, r.ts) for r in found.collect()] == [("a", 5_000)]


def test_rows_without_a_time_do_not_stop_a_rule(replay, spark):
    schema = "common struct<mid: string, is_new: string>, ts bigint"
    stream = in_batches(spark, schema, [(("m", "1"), 1_000), (("m", "1"), None)],
                        [(("m", "1"), None)])
    assert replay.appended(rules.repair_new_visitors(stream)).count() == 3


def test_of_equal_versions_the_later_arrival_is_cut_out(spark):
    rows = spark.createDataFrame([("a", 1, "early"), ("a", 1, "late"), ("b", 2, "x"), ("b", 1, "y")],
                                 "id string, v int, note string").coalesce(1)
    kept = rules.first_of_batch(rows, ["id"], ["v"], descending=True)
    assert {(r.id, r.note) for r in kept.collect()} == {("a", "late"), ("b", "x")}


def test_names_added_while_a_query_runs_are_seen(spark):
    out, dim, source = (work_dir(spark, n) for n in ("out", "provinces", "counts"))
    kind = "stt string, edt string, province_id string, order_count bigint, order_amount double"
    name = lambda *rows: spark.createDataFrame(list(rows), "id string, name string").write.mode(
        "append").parquet(dim)
    put = lambda *row: spark.createDataFrame([row], kind).coalesce(1).write.mode(
        "append").parquet(source)
    name(("1", "North"))
    put("a", "b", "1", 1, 1.0)
    stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(source)
    writer = sinks.to_upserts(stream, out, ["stt", "province_id"], mode="append",
                              finish=lambda batch: summaries.province_names(
                                  batch, spark.read.parquet(dim)))
    query = sinks.start(writer, work_dir(spark, "ck"), every="200 milliseconds")
    try:
        query.processAllAvailable()
        name(("2", "South"))
        put("a", "b", "2", 1, 1.0)
        query.processAllAvailable()
    finally:
        query.stop()
    found = sinks.current(spark, out, ["stt", "province_id"]).collect()
    assert {(r.province_id, r.province_name) for r in found} == {("1", "North"), ("2", "South")}


def test_hold_latest_version(replay, spark):
    """Two versions and an equal one in a micro-batch: the newest wins, and
    of equal versions the later."""
    first = spark.createDataFrame([("a", 1, "old"), ("a", 3, "early"), ("a", 3, "new"), ("b", 1, "only")],
                                  "id string, row_op_ts int, note string")
    path = work_dir(spark, "versions")
    first.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(first.schema).parquet(path)
    out, checkpoint = work_dir(spark, "out"), work_dir(spark, "ck")
    query = sinks.start(sinks.to_files(rules.settled(stream, hold_ms=1500), out), checkpoint,
                        every="200 milliseconds")
    try:
        deadline = time.monotonic() + 40
        found = set()
        while len(found) < 2 and time.monotonic() < deadline:
            query.awaitTermination(1)
            if os.path.exists(f"{out}/_spark_metadata"):
                found = {tuple(row) for row in
                         spark.read.schema(first.schema).parquet(out).collect()}
    finally:
        query.stop()
    assert found == {("a", 3, "new"), ("b", 1, "only")}


def test_settled_on_event_time(spark):
    """Versions in any order within the delay; one beyond it is not seen; the query ends by itself."""
    schema = "id string, ts string, row_op_ts long, what string"
    batches = [[("a", "100", 1, "old"), ("b", "105", 1, "only"), ("c", "101", 2, "late version")],
               [("a", "103", 3, "new"), ("a", "102", 2, "between"), ("c", "100", 1, "early")],
               [("x", "200", 1, "later")], [("y", "300", 1, "again")],
               [("a", "104", 9, "beyond the delay")],
               [("a", "310", 1, "a again"), ("z", "500", 1, "closing")]]
    stream = in_batches(spark, schema, *batches)
    rows = jobs.settled_details(stream, "id", ("row_op_ts",), 5_000, "10 seconds")
    out = work_dir(spark, "out")
    query = sinks.start(sinks.to_files(rows, out), work_dir(spark, "ck"))
    assert query.awaitTermination(120)
    found = {tuple(row) for row in spark.read.schema(rows.schema).parquet(out).select(
        "id", "row_op_ts", "what").collect()}
    assert found == {("a", 3, "new"), ("b", 1, "only"), ("c", 2, "late version"), ("x", 1, "later"),
                     ("y", 1, "again"), ("a", 1, "a again")}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # z alone is held


def test_state_that_feeds_a_window_has_a_life(spark):
    """A user counts as unknown a life after the last row; others are forgotten without a word."""
    day = 86_400
    users = [[(f"u{k}", str(day + k)) for k in range(50)], [("u0", str(3 * day))],
             [("w", str(8 * day))], [("u1", str(9 * day))], [("u0", str(10 * day)), ("u1", str(10 * day))],
             [("end", str(30 * day))]]
    def run(life):
        rows = jobs.timed_by_seconds(in_batches(spark, "user_id string, ts string", *users))
        marks = rules.day_marks(rows, "user_id", F.to_date(jobs.AT), (jobs.AT,), jobs.AT, life)
        out = work_dir(spark, "out")
        query = sinks.start(sinks.to_files(marks.select("user_id", "ts", "_last"), out),
                            work_dir(spark, "ck"))
        assert query.awaitTermination(120)
        found = {(r.user_id, int(r.ts) // day): r._last is None for r in spark.read.parquet(
            out).collect()}
        return found, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    known, kept = run(None)
    assert not known["u0", 10] and not known["u1", 9] and kept[-1] >= 51
    found, state = run(5 * day * 1000)
    assert not found["u0", 3]                      # within its life
    assert found["u1", 9] and found["u0", 10]      # forgotten in between
    assert not found["u1", 10] and max(state) >= 50 and state[-1] < 20


def test_state_life_by_the_clock(spark):
    schema = "user_id string, ts long"
    path = work_dir(spark, "source")
    rows = [spark.createDataFrame([("u", 1000), ("v", 1000)], schema),
            spark.createDataFrame([("u", 2000)], schema)]
    rows[0].coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    firsts = rules.new_days(stream, {"_user": F.col("user_id")}, F.col("ts"), life_ms=3_000)
    out = work_dir(spark, "out")
    query = sinks.start(sinks.to_files(firsts.select("user_id", "ts"), out), work_dir(spark, "ck"),
                        "500 milliseconds")
    read = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(out).collect())) if (
        os.path.exists(f"{out}/_spark_metadata")) else []
    try:
        deadline = time.monotonic() + 60
        while len(read()) < 2 and time.monotonic() < deadline:
            query.awaitTermination(1)
        time.sleep(5)
        rows[1].coalesce(1).write.mode("append").parquet(path)  # the same day, a life later
        while len(read()) < 3 and time.monotonic() < deadline:
            query.awaitTermination(1)
    finally:
        query.stop()
    assert read() == [("u", 1000), ("u", 2000), ("v", 1000)]


def test_refund_join_keeps_hours_not_years(spark, sf):
    """Late rows find their order, and the state ends at what may still meet something."""
    tables = standin.written_together(
        standin.table_changes(spark, sf, "order_refund_info", "order_info"))
    dic = standin.dictionary(spark)
    streams = {name: catalog._file_by_file(work_dir(spark, name), catalog._parts(rows))
               for name, rows in tables.items()}
    rows = facts.refund_request(streams, dic, facts.Bounds("2 hours", "2 hours")).drop("row_op_ts")
    out = work_dir(spark, "out")
    query = sinks.start(sinks.to_files(rows, out), work_dir(spark, "ck"))
    assert query.awaitTermination(120)
    batch = facts.refund_request(tables, dic).drop("row_op_ts")
    assert only_in(spark.read.schema(rows.schema).parquet(out), batch) == (0, 0)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert states[-1] < max(states) / 2


def test_order_wide_on_streams(replay, spark, sf):
    """Inner and two outer stream joins in a row. Sides must meet within the wait, so the expected
    rows are the batch rows whose order came within it; unmatched sides come out late."""
    tables = standin.table_changes(spark, sf, *standin.ORDERING)
    dic = standin.dictionary(spark)
    # bring the sides of an order together in time
    tables = {name: rows.withColumn("ts", F.coalesce(rows["data"]["id"] if name == "order_info"
                                                     else F.lit(None), rows["ts"]))
              for name, rows in tables.items()}

    def at_order_time(name, rows):
        key = {"order_info": "id", "order_detail": "order_id"}.get(name)
        number = (F.col(f"data.{key}").cast("bigint") if key
                  else F.floor(F.col("data.order_detail_id").cast("bigint") / 10))
        return rows.withColumn("ts", (number * 60 + 1_700_000_000).cast("string"))

    tables = {name: at_order_time(name, rows) for name, rows in tables.items()}
    batch = facts.order_wide(tables, dic)
    streams = {name: replay.stream(rows, [F.col("ts").cast("bigint")], 2)
               for name, rows in tables.items()}
    found = replay.appended(facts.order_wide(streams, dic, facts.Bounds("5 seconds")).drop(
        "old", "row_op_ts"))
    extra, missing = only_in(found, batch.drop("old", "row_op_ts"))
    both = batch.filter("activity_id IS NOT NULL AND coupon_id IS NOT NULL").count()
    assert extra == 0
    assert found.filter("activity_id IS NOT NULL AND coupon_id IS NOT NULL").count() == both
    assert missing < 0.02 * batch.count() + 20


def stored_counts(spark, path, names=logs.STREAMS):
    event = T.StructType([T.StructField("event_id", T.LongType())])
    return {name: feeds.stored_stream(spark, path, name, stream=False, more=event).count()
            for name in names}


def test_log_streams_fan_out(replay, spark, sf):
    log = standin.behaviour(spark, sf)
    path = work_dir(spark, "fan")
    sinks.start(sinks.to_log_streams(replay.stream(log, TIE, 2), path),
                work_dir(spark, "ck")).awaitTermination()
    event = T.StructType([T.StructField("event_id", T.LongType())])
    for name, rows in logs.split_log(log)._asdict().items():
        found = feeds.stored_stream(spark, path, name, stream=False, more=event)
        text = lambda rows: rows.select(F.to_json(F.struct(*sorted(rows.columns))))
        assert only_in(text(found.drop("common_more", "page_more")), text(rows)) == (0, 0), name


def test_fan_out_after_a_kill_gives_each_row_once(replay, spark, sf):
    """The query dies after its write and before its commit; started again from its checkpoint it
    repeats the micro-batch. A downstream stream that has seen the first attempt reads on."""
    log = standin.behaviour(spark, sf).filter("event_id < 300")
    source = replay.stream(log, TIE, 3)
    path, checkpoint, below = (work_dir(spark, name) for name in ("fan", "ck", "below"))

    def downstream():
        event = T.StructType([T.StructField("event_id", T.LongType())])
        rows = feeds.stored_stream(spark, path, "display", more=event).select("event_id", "display")
        sinks.start(sinks.to_files(rows, below), f"{below}-ck").awaitTermination()
        return spark.read.schema(rows.schema).parquet(below).count()

    sinks.start(sinks.to_log_streams(source, path), checkpoint).awaitTermination()
    whole = {name: rows.count() for name, rows in logs.split_log(log)._asdict().items()}
    assert stored_counts(spark, path) == whole and downstream() == whole["display"]
    commits = f"{checkpoint}/commits"
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    # what a lost task leaves: a file that no finished micro-batch lists
    part = next(name for name in os.listdir(f"{path}/stream=display") if name.endswith(".parquet"))
    shutil.copy(f"{path}/stream=display/{part}", f"{path}/stream=display/part-lost.snappy.parquet")
    sinks.start(sinks.to_log_streams(source, path), checkpoint).awaitTermination()
    assert stored_counts(spark, path) == whole and downstream() == whole["display"]


def test_a_stream_of_the_stored_log_reads_its_partition(spark, sf):
    path = work_dir(spark, "fan")
    logs.tagged(standin.behaviour(spark, sf)).write.partitionBy("stream").parquet(path)
    plan = feeds.stored_stream(spark, path, "action", stream=False)._jdf.queryExecution(
        ).executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stream" in plan
    tables = work_dir(spark, "tables")
    standin.change_log(spark, sf).write.partitionBy("table").parquet(tables)
    found = feeds.stored_changes(spark, tables, "coupon_use", "cart_info", stream=False)
    for name, rows in found.items():
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(table" in plan and f"= {name})" in plan
        assert {row[0] for row in rows.select("table").distinct().collect()} == {name}


def test_the_change_feed_is_parsed_once(spark):
    raw = spark.createDataFrame([(None,)], "value string")
    rows = feeds.change_log(raw).filter("table IS NOT NULL").filter("type = 'insert'")
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_new_visitor_repair_of_rows_without_a_time(replay, spark):
    """A row without a time is nobody's first, in either form."""
    schema = "common struct<mid: string, is_new: string>, ts long, event_id long"
    day = 86_400_000
    first = [(("a", "1"), None, 1), (("a", "1"), day, 2), (("b", "1"), None, 3),
             (("c", "0"), None, 4), (("c", "1"), 2 * day, 5)]
    second = [(("a", "1"), 4 * day, 6), (("a", "1"), None, 7), (("b", "1"), 3 * day, 8),
              (("c", "1"), 3 * day, 9)]
    rows = spark.createDataFrame(first + second, schema)
    want = {1: "1", 2: "1", 3: "1", 4: "0", 5: "1", 6: "0", 7: "1", 8: "1", 9: "0"}
    for order in (("ts",), ("ts", "event_id")):
        found = replay.appended(rules.repair_new_visitors(in_batches(spark, schema, first, second),
                                                          order))
        batch = logs.repair_new_visitors(rows, order)
        for some in (found, batch):
            assert {r.event_id: r.common.is_new for r in some.collect()} == want


def test_dimension_loader(replay, spark, sf):
    """Changes of all tables in order; unrouted ones vanish, the newest image stays."""
    tables = standin.table_changes(spark, sf, "user_info", "sku_info", "base_province",
                                   "favor_info")
    log = standin.as_one_log(tables)
    path, config = work_dir(spark, "dims"), standin.routing(spark)
    sinks.create_targets(spark, path, config)
    sinks.start(sinks.to_dimensions(replay.stream(log, [F.col("ts").cast("bigint")]), path,
                                    lambda: standin.routing(spark)),
                work_dir(spark, "ck")).awaitTermination()
    users = sinks.dimension(spark, path, "dim_user_info").filter("id <> ''")
    assert users.columns == ["id", "last_event", "last_value"]
    newest = (changes.extract(log, "user_info", ["id", "last_event"], types=["insert", "update"])
              .groupBy("id").agg(F.max(F.col("last_event").cast("bigint")).cast("string")
                                 .alias("last_event")))
    assert only_in(users.select("id", "last_event"), newest) == (0, 0)
    provinces = sinks.dimension(spark, path, "dim_base_province").filter("id <> ''")
    assert provinces.count() == 25


def test_live_count_changelog(replay, spark, sf):
    events = standin.table(spark, sf, "events")
    found = replay.upserted(windows.live_count(replay.stream(events, ["ts"]), "user_id"),
                            ["user_id"])
    assert only_in(found, windows.live_count(events, "user_id")) == (0, 0)


def test_repeated_batch_leaves_upserts_unchanged(spark):
    """A micro-batch written twice, as after a failure, gives the same target."""
    path = work_dir(spark, "twice")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{path}/batch=0")
    spark.createDataFrame([(2, "c")], "k int, v string").write.parquet(f"{path}/batch=1")
    assert {tuple(r) for r in sinks.current(spark, path, ["k"]).collect()} == {(1, "a"), (2, "c")}
    target = work_dir(spark, "folded")
    sinks.rewrite(spark, path, target, ["k"])
    assert {tuple(r) for r in sinks.current(spark, target, ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_dictionary_that_changes_while_the_query_runs(spark):
    """Names are those of the micro-batch; rows of a code that comes later wait; one code is dealt
    over shares."""
    schema = "id long, code string, note string"
    facts_of = [[(1, "a", "x"), (2, "b", None), (3, None, "null code"), (4, "never", "y")],
                [(5, "a", None), (6, "b", "z")], [(7, "a", "w"), (8, "b", "v")]]
    entries = [[], [("b", "bee", 1)], [("a", "new a", 3), ("a", "middle a", 2)]]
    stored = spark.createDataFrame([("a", "old a"), ("c", "unused")], "dic_code string, dic_name string")
    rows = in_batches(spark, schema, *facts_of)
    found = live.named_live(rows, in_batches(spark, live.ENTRY, *entries), stored, "code", "name")
    out = work_dir(spark, "out")
    query = sinks.start(sinks.to_files(found, out), work_dir(spark, "ck"))
    assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(out).collect()))
    assert got == [(1, "a", "x", "old a"), (2, "b", None, "bee"), (5, "a", None, "old a"),
                   (6, "b", "z", "bee"), (7, "a", "w", "new a"), (8, "b", "v", "bee")]


def test_changelog_with_retractions(spark):
    schema = "user string, sign int"
    batches = [[("a", 1), ("a", 1), ("b", 1), (None, 1)], [("a", -1), ("b", -1), ("c", -1)],
               [("a", 0), ("b", 1), ("c", 1), ("c", 1)]]
    rows = live.changelog(in_batches(spark, schema, *batches), "user", "sign")
    out = work_dir(spark, "out")
    sinks.start(sinks.to_upserts(rows, out, ["user"], mode="append"),
                work_dir(spark, "ck")).awaitTermination()
    per = {}
    for r in spark.read.option("basePath", out).parquet(out).collect():
        per.setdefault((r.batch, r.user), []).append((r.kind, r.row_count))
    assert per == {(0, "a"): [("+I", 2)], (0, "b"): [("+I", 1)], (0, None): [("+I", 1)],
                   (1, "a"): [("-U", 2), ("+U", 1)], (1, "b"): [("-D", 1)],
                   (2, "b"): [("+I", 1)], (2, "c"): [("+I", 1)]}
    total = live.net(spark.read.parquet(out), "user")
    assert {(r.user, r.row_count) for r in total.collect()} == {
        ("a", 1), ("b", 1), (None, 1), ("c", 1)}


def test_retracted_keys_leave_an_upsert_target(spark):
    path = work_dir(spark, "out")
    schema = "user string, row_count long, kind string"
    for number, rows in enumerate([[("a", 2, "+I"), ("b", 1, "+I")], [("b", 1, "-D")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/batch={number}")
    found = sinks.current(spark, path, ["user"], gone="kind = '-D'")
    assert [tuple(r) for r in found.collect()] == [("a", 2, "+I")]


def _routing_change(spark, path, *rows):
    spark.createDataFrame([(json.dumps(row),) for row in rows], "value string").coalesce(1).write.mode(
        "append").parquet(path)


def test_routing_changes_fold(spark):
    """Inserts, an update that moves a table, a delete, and lines that say nothing."""
    one = {"source_table": "a", "sink_table": "dim_a", "sink_columns": "id", "sink_pk": "id"}
    two = one | {"source_table": "b"}
    lines = [{"after": one, "ts_ms": 1}, {"before": one, "after": two, "ts_ms": 2}, {"before": None},
             {"before": two, "ts_ms": 3}, {"after": one | {"sink_columns": "id,x"}, "ts_ms": 4}]
    raw = spark.createDataFrame([(json.dumps(line),) for line in lines] + [("no json",), (None,)],
                                "value string")
    changes = feeds.routing_changes(raw)
    assert [tuple(r) for r in changes.select("source_table", "gone").orderBy("version", "gone")
            .collect()] == [("a", False), ("b", False), ("a", True), ("b", True), ("a", False)]
    now = dimensions.routing_now(changes.withColumn("batch", F.lit(0))).collect()
    assert [(r.source_table, r.sink_columns) for r in now] == [("a", "id,x")]
    assert feeds.routing_images(raw).count() == 3


def test_routing_changes_while_a_job_runs(spark):
    """A table taken up gets its target at once, one taken out stops, a restart knows the config, and
    rows from before their config stay out."""
    log, text, out = (work_dir(spark, name) for name in ("changes", "routing-text", "dims"))
    schema = S.ENVELOPE

    def rows(*images):
        made = [("shop", table, "insert", {"id": key, "name": name}, None, ts)
                for table, key, name, ts in images]
        fields = "database string, table string, type string, data map<string,string>, " \
                 "old map<string,string>, ts string"
        frame = spark.createDataFrame(made, fields)
        return frame.select(*(F.col(f.name).cast(f.dataType) if f.name in frame.columns
                              else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    def run():
        source = spark.readStream.schema(schema).parquet(log)
        routing = feeds.routing_changes(spark.readStream.schema("value string").parquet(text))
        none = spark.createDataFrame([], S.ROUTING)
        sinks.start(sinks.to_routed_dimensions(source, routing, out, f"{out}-history", none),
                    f"{out}-checkpoint").awaitTermination()

    a = {"source_table": "a", "sink_table": "dim_a", "sink_columns": "id", "sink_pk": "id"}
    b = a | {"source_table": "b", "sink_table": "dim_b"}
    _routing_change(spark, text, {"after": a, "ts_ms": 1})
    rows(("a", "1", "x", "1"), ("b", "1", "early", "1")).write.parquet(log)
    run()
    assert [tuple(r) for r in sinks.dimension(spark, out, "dim_a").collect()] == [("1",)]
    # no change of the config: the one known holds
    rows(("a", "2", "y", "2")).write.mode("append").parquet(log)
    run()
    assert sinks.dimension(spark, out, "dim_a").count() == 2
    # a target without a row yet, and a column more
    _routing_change(spark, text, {"after": b, "ts_ms": 2},
                    {"before": a, "after": a | {"sink_columns": "id,name"}, "ts_ms": 3})
    run()
    assert sinks.dimension(spark, out, "dim_b").columns == ["id"]
    rows(("a", "3", "z", "3"), ("b", "2", "late", "3")).write.mode("append").parquet(log)
    run()
    found = sinks.dimension(spark, out, "dim_a").orderBy("id").collect()
    assert [(r.id, r.name) for r in found] == [("1", None), ("2", None), ("3", "z")]
    assert [r.id for r in sinks.dimension(spark, out, "dim_b").collect()] == ["2"]
    _routing_change(spark, text, {"before": a, "ts_ms": 4})
    rows(("a", "4", "gone", "4"), ("b", "3", "more", "4")).write.mode("append").parquet(log)
    run()
    assert sinks.dimension(spark, out, "dim_a").count() == 3
    assert sinks.dimension(spark, out, "dim_b").count() == 2
