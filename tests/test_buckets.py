"""State per bucket of keys, and feeds of several micro-batches written by many tasks."""

from pyspark.sql import functions as F

from helpers import only_in
from tidemart.operators import logs, visits
from tidemart.plans import catalog
from tidemart.session import work_dir
from tidemart.streaming import buckets, jobs, live, rules, sinks


def run(spark, rows):
    out = work_dir(spark, "out")
    query = sinks.start(sinks.to_files(rows, out), work_dir(spark, "ck"))
    assert query.awaitTermination(180)
    return spark.read.schema(rows.schema).parquet(out), query.recentProgress


def most_state(progress):
    return max(p["stateOperators"][0]["numRowsTotal"] for p in progress)


def test_a_part_is_a_micro_batch_of_several_files(spark):
    """Also an empty one and one of a single row; nothing is lost, doubled or mixed."""
    rows = spark.range(1000).select("id", F.struct(F.col("id").alias("k")).alias("data"))
    parts = [rows.filter("id < 600"), rows.filter("id < 0"), rows.filter("id BETWEEN 600 AND 998"),
             rows.filter("id = 999")]
    path = work_dir(spark, "parts")
    stream = catalog._file_by_file(path, parts)
    assert stream.schema.names == rows.schema.names
    out = work_dir(spark, "out")
    query = sinks.start(stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")),
        work_dir(spark, "ck"))
    assert query.awaitTermination(120)
    found = [sorted(r.id for r in spark.read.schema(rows.schema).parquet(f"{out}/batch={k}").collect())
             for k in range(4)]
    assert found == [list(range(600)), [], list(range(600, 999)), [999]]
    assert len(spark.read.parquet(path).inputFiles()) == 4 * spark.sparkContext.defaultParallelism


def test_settled_versions_of_many_keys(spark):
    """What is kept does not count by keys, and nulls, ties and rows of any type come out whole."""
    rows = spark.range(3000).select(
        F.when(F.col("id") != 7, F.col("id").cast("string")).alias("id"),
        F.lit("100").alias("ts"), F.timestamp_micros(F.col("id") + 1).alias("row_op_ts"),
        F.when(F.col("id") % 2 == 0, F.struct(F.lit("a\"\x00b").alias("x"))).alias("more"),
        (F.col("id") / 7).alias("share"))
    newer = rows.filter("id < 500").withColumns({"row_op_ts": F.expr("row_op_ts + interval 1 microsecond"),
                                                 "share": F.lit(0.5)})
    closing = rows.limit(1).withColumns({"id": F.lit("closing"), "ts": F.lit("9000")})
    stream = catalog._file_by_file(work_dir(spark, "versions"), [rows, newer, closing])
    found, progress = run(spark, jobs.settled_details(stream, "id", ("row_op_ts",), 5_000, "10 seconds"))
    assert only_in(found, rows.filter("id IS NULL OR id >= 500").union(newer)) == (0, 0)
    assert most_state(progress) <= 3 * buckets.BUCKETS


def test_an_older_version_that_comes_later_is_not_the_newest(spark):
    """Versions that differ only in their second column, in two micro-batches and in one."""
    rows = spark.createDataFrame([("a", "100", "637"), ("b", "100", "431"), ("c", "100", "9")],
                                 "id string, ts string, sku_id string")
    later = spark.createDataFrame([("a", "100", "431"), ("b", "100", "637"), ("c", "100", "8"),
                                   ("c", "100", None)], rows.schema)
    closing = spark.createDataFrame([("closing", "9000", "1")], rows.schema)
    stream = catalog._file_by_file(work_dir(spark, "versions"), [rows, later, closing])
    found, _ = run(spark, jobs.settled_details(stream, "id", ("ts", "sku_id"), 5_000, "10 seconds"))
    assert sorted((r.id, r.sku_id) for r in found.collect()) == [("a", "637"), ("b", "637"), ("c", "9")]


def test_turns_take_each_row_once_and_the_parts_as_written(spark):
    """Rows go to their part where they are made; a turn reads what the turns before it left out."""
    rows = spark.range(6000).select(F.col("id").cast("string").alias("id"),
                                    (F.col("id") * 60).cast("string").alias("ts"))
    taken = []
    catalog._in_turn(rows, "turns", rows, {"id": "closing"}, lambda part: taken.append(part) or part,
                     lambda held: held.select("id", "ts"), ["id"])
    source, = {file.rsplit("/", 2)[0] for file in spark.read.parquet(
        *(f"{spark.conf.get('spark.checkpoint.dir')}/turns-in-*",)).inputFiles()}
    sizes = {r._part: r["count"] for r in spark.read.parquet(source).groupBy("_part").count().collect()}
    assert len(taken) == 5 and sizes.keys() == {0, 1, 2, 3, 4} and sum(sizes.values()) == 6002
    assert sizes[3] == sizes[4] == 1 and all(1500 < sizes[k] < 2500 for k in range(3))


def test_order_text_sorts_as_its_columns(spark):
    schema = "a long, b string, c timestamp"
    texts = [None, "", "a", "a\x00", "a\x00b", "a\x01", "a\x02", "ab", "é", "\U0001f600", "￮"]
    numbers = [None, -2 ** 63, -5, 0, 7, 70, 2 ** 63 - 1]
    rows = spark.createDataFrame([(n, t, None) for n in numbers for t in texts], schema)
    shown = rows.withColumn("text", buckets.order_text(rows.schema, ("a", "b", "c"))).collect()
    by_text = sorted(shown, key=lambda r: r.text)
    by_columns = sorted(shown, key=lambda r: ((r.a is not None, r.a or 0), (r.b is not None, r.b or "")))
    assert [(r.a, r.b) for r in by_text] == [(r.a, r.b) for r in by_columns]
    assert len({r.text for r in shown}) == len(shown)


LOG = ("common struct<mid: string, is_new: string>, page struct<last_page_id: string>, "
       "tags map<string, string>, ts bigint, event_id bigint")


def visits_of_many(spark):
    day = 86_400_000
    return spark.createDataFrame([
        ((f"m{k}", str((k + n) % 2)), (None if (k + n) % 3 else "x",), {"k": None, "n": str(n)},
         day + n * day // 2 + k % 50, k * 10 + n) for k in range(1000) for n in range(4)], LOG)


def test_repair_of_many_visitors(spark):
    rows = visits_of_many(spark)
    order = ("ts", "event_id")
    stream = catalog._file_by_file(work_dir(spark, "log"), [
        rows.filter("event_id % 10 < 2"), rows.filter("event_id % 10 >= 2")])
    found, progress = run(spark, rules.repair_new_visitors(stream, order))
    as_text = lambda frame: frame.withColumn("tags", F.to_json("tags", {"ignoreNullFields": "false"}))
    assert only_in(as_text(found), as_text(logs.repair_new_visitors(rows, order))) == (0, 0)
    assert most_state(progress) <= buckets.BUCKETS


def test_bounces_of_many_visitors(spark):
    rows, gap = visits_of_many(spark).drop("tags"), 50_000_000
    closing = rows.limit(1).withColumns({"ts": F.lit(10 ** 10), "page": F.struct(F.lit("x").alias(
        "last_page_id")), "common": F.struct(F.lit("end").alias("mid"), F.lit("0").alias("is_new"))})
    stream = catalog._file_by_file(work_dir(spark, "pages"), [
        *(rows.filter(f"event_id % 10 = {n}") for n in range(4)), closing])
    found, progress = run(spark, rules.bounces(stream, gap, 4 * gap, ("ts", "event_id")))
    batch = visits.bounces(rows, gap, 4 * gap, ("ts", "event_id"))
    assert batch.count() > 1000 and only_in(found, batch) == (0, 0)
    assert most_state(progress) <= 4 * buckets.BUCKETS


def test_days_of_many_users(spark):
    """Days in one micro-batch and over two, a user and days that are null; state does not count by users."""
    day = 86_400
    rows = spark.range(3000).select(F.when(F.col("id") != 7, F.col("id")).alias("user_id"), F.explode(
        F.array(*(F.lit(n) for n in (0, 5, 40, 50, 90)))).alias("hours")).select(
        "user_id", F.timestamp_seconds(day * 10 + F.col("hours") * 3600 + F.lit(0.25)).alias("_at"), "hours")
    source = rows.withColumn("_of", F.when(F.col("hours") != 50, F.to_date("_at")))
    stream = catalog._file_by_file(work_dir(spark, "days"), [
        source.filter("hours < 20"), source.filter("hours >= 20")]).withWatermark("_at", "0 seconds")
    marks = rules.day_marks(stream, "user_id", F.col("_of"), ("_at",), event_time="_at")
    found, progress = run(spark, marks.select("user_id", "_at", "hours", F.date_diff("_last", F.lit(
        "1970-01-01")).alias("last")))
    want = rows.filter("hours <> 5").withColumn("last", F.when(F.col("hours") == 40, 10).when(
        F.col("hours") == 50, 11)).select(found.columns)
    assert only_in(found, want) == (0, 0)
    assert most_state(progress) <= buckets.BUCKETS


def test_changelog_of_many_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 2500).alias("user"), F.lit(1).alias("sign"))
    stream = catalog._file_by_file(work_dir(spark, "signed"), [rows.filter("id < 2500"),
                                                             rows.filter("id >= 2500")])
    found, progress = run(spark, live.changelog(stream, "user", "sign"))
    want = rows.groupBy("user").agg(F.count("*").alias("row_count"))
    assert only_in(live.net(found, "user"), want) == (0, 0) and found.count() == 2500 * 3
    assert most_state(progress) <= buckets.BUCKETS
