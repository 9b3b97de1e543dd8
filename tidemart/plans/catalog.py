"""Named queries over the test tables: one per rule and job, each over whole tables."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tidemart import schemas as S
from tidemart.functions.clock import from_ms
from tidemart.functions.words import words
from tidemart.operators import changes, dimensions, logs, lookups, versions, visits, windows
from tidemart.plans import facts, summaries
from tidemart.session import STATE_STORE, work_dir
from tidemart.sources import feeds, standin
from tidemart.streaming import jobs, live, rules, sinks

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the test data is sparser than a live feed.
TIE = ("ts", "event_id")
HOUR, DAY = "1 hour", "1 day"
GAP_MS = 6 * 3600 * 1000
PIECE_MS = 4 * GAP_MS
RETURN_DAYS = 4
# the test data holds real duplicates of a detail id, so versions need a total order
PAYMENT_VERSION = ("ts", "sku_id", "source_id", "sku_num", "split_original_amount")
DETAIL_VERSION = ("ts", "sku_id", "source_id", "sku_num", "split_original_amount",
                  "split_total_amount", "activity_id", "coupon_id")
LINE_VERSION = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _feeds(spark: SparkSession, sf: str, *tables: str,
           ) -> tuple[dict[str, DataFrame], DataFrame]:
    return standin.table_changes(spark, sf, *tables), standin.dictionary(spark)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return facts.order_wide(*_feeds(spark, sf, *standin.ORDERING))


# --- behaviour log -----------------------------------------------------------------------------

def dirty_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.tag_text(standin.behaviour_text(spark, sf))
    clean = ~F.col("dirty")
    return rows.select("event_id", F.when(clean, "clean").otherwise("dirty").alias("side"),
                       F.when(clean, F.col("common.mid")).alias("mid"),
                       F.when(clean, F.col("ts")).alias("ts"))


def log_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Text log to rows per stream: parse, repair, count."""
    clean = logs.parse_text(standin.behaviour_text(spark, sf)).clean
    return logs.stream_counts(logs.repair_new_visitors(clean, TIE))


def new_visitor_repair(spark: SparkSession, sf: str) -> DataFrame:
    fixed = logs.repair_new_visitors(standin.behaviour(spark, sf), TIE)
    return fixed.select("event_id", F.col("common.mid").alias("mid"),
                        F.col("common.is_new").alias("is_new"), "ts")


def _streams(spark: SparkSession, sf: str) -> logs.LogStreams:
    return logs.split_log(standin.behaviour(spark, sf))


def log_page(spark: SparkSession, sf: str) -> DataFrame:
    return _streams(spark, sf).page.select("event_id", "common.*", "page.*", "ts")


def log_start(spark: SparkSession, sf: str) -> DataFrame:
    return _streams(spark, sf).start.select(
        "event_id", F.col("common.mid").alias("mid"), F.col("start.entry").alias("entry"),
        F.col("start.loading_time").alias("loading_time"),
        F.size("displays").alias("display_count"), "ts")


def log_display(spark: SparkSession, sf: str) -> DataFrame:
    return _streams(spark, sf).display.select(
        "event_id", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"),
        F.col("display.item").alias("item"), F.col("display.pos_id").alias("pos_id"), "ts")


def log_action(spark: SparkSession, sf: str) -> DataFrame:
    return _streams(spark, sf).action.select(
        "event_id", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"),
        F.col("action.action_id").alias("action_id"), F.col("action.item").alias("item"))


def log_error(spark: SparkSession, sf: str) -> DataFrame:
    return _streams(spark, sf).error.select(
        "event_id", F.col("common.mid").alias("mid"), F.col("err.error_code").alias("error_code"),
        F.col("page.page_id").alias("page_id"), "ts")


def unique_visitor_daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = visits.daily_visitors(standin.pages(spark, sf), TIE)
    return rows.select("event_id", "common.*", "page.*", "ts")


def bounce_detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = visits.bounces(standin.pages(spark, sf), GAP_MS, PIECE_MS, TIE)
    return rows.select("event_id", "common.*", "page.*", "ts")


# --- traffic and user summaries ----------------------------------------------------------------

def keyword_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.keyword_window(standin.pages(spark, sf), HOUR)


def keyword_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword rule over long texts in several languages."""
    found = standin.table(spark, sf, "documents").select(
        "lang", F.explode(words(F.col("text"))).alias("keyword"))
    return found.groupBy("lang", "keyword").agg(F.count("*").alias("keyword_count"))


def traffic_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.traffic_window(standin.pages(spark, sf), HOUR, GAP_MS, PIECE_MS, TIE)


def home_detail_uv_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.home_detail_window(standin.pages(spark, sf), HOUR)


def login_back_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.login_window(standin.pages(spark, sf), HOUR, RETURN_DAYS)


def login_back_window_default(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.login_window(standin.pages(spark, sf))


def register_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.register_window(facts.user_register(standin.table_changes(spark, sf, "user_info")), HOUR)


def cart_unique_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.cart_user_window(facts.cart_add(*_feeds(spark, sf, "cart_info")), HOUR)


# --- change log --------------------------------------------------------------------------------

def cdc_extract(spark: SparkSession, sf: str) -> DataFrame:
    return changes.extract(
        standin.table_changes(spark, sf, "order_info"), "order_info",
        ["id", "user_id", "province_id", "operate_time", "order_status"],
        types=["insert", "update"],
        extra={"type": F.col("type"), "old_status": F.col("old")["order_status"],
               "ts": F.col("ts")})


def status_change(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that have just turned cancelled, refunding or refunded."""
    turned = (changes.became("order_status", S.ORDER_CANCELLED)
              | changes.became("order_status", S.ORDER_REFUNDING)
              | changes.became("order_status", S.ORDER_REFUNDED))
    return changes.extract(standin.table_changes(spark, sf, "order_info"), "order_info",
                           ["id", "order_status"], types=["update"], where=turned, extra={"ts": F.col("ts")})


def cart_delta(spark: SparkSession, sf: str) -> DataFrame:
    return facts.cart_add(*_feeds(spark, sf, "cart_info"))


def order_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = _wide(spark, sf)
    return (wide.withColumn("old_status", F.col("old")["order_status"])
            .drop("old", "row_op_ts"))


def order_detail(spark: SparkSession, sf: str) -> DataFrame:
    return facts.order_detail(_wide(spark, sf)).drop("row_op_ts")


def order_cancel(spark: SparkSession, sf: str) -> DataFrame:
    return facts.order_cancel(_wide(spark, sf)).drop("row_op_ts")


def _payments(spark: SparkSession, sf: str) -> DataFrame:
    log, dic = _feeds(spark, sf, "payment_info", *standin.ORDERING)
    return facts.payment_success(log, facts.order_detail(facts.order_wide(log, dic)), dic)


def payment_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _payments(spark, sf).drop("row_op_ts")


def refund_detail(spark: SparkSession, sf: str) -> DataFrame:
    return facts.refund_request(*_feeds(spark, sf, "order_refund_info", "order_info")).drop("row_op_ts")


def refund_paid(spark: SparkSession, sf: str) -> DataFrame:
    return facts.refund_paid(*_feeds(spark, sf, "refund_payment", "order_refund_info", "order_info")).drop("row_op_ts")


def coupon_get(spark: SparkSession, sf: str) -> DataFrame:
    return facts.coupon_get(standin.table_changes(spark, sf, "coupon_use"))


def coupon_order(spark: SparkSession, sf: str) -> DataFrame:
    return facts.coupon_order(standin.table_changes(spark, sf, "coupon_use"))


def change_text(spark: SparkSession, sf: str) -> DataFrame:
    """Coupons used, from a change feed of two tables that arrives as JSON text."""
    feed = standin.as_one_log(standin.table_changes(spark, sf, "coupon_use", "cart_info"))
    fields = [name for name in S.ENVELOPE.names if name in feed.columns]
    text = feed.select(F.to_json(F.struct(*fields)).alias("value"))
    return facts.coupon_order(feeds.change_log(text))


def coupon_pay(spark: SparkSession, sf: str) -> DataFrame:
    return facts.coupon_pay(standin.table_changes(spark, sf, "coupon_use"))


def favor_add(spark: SparkSession, sf: str) -> DataFrame:
    return facts.favor_add(standin.table_changes(spark, sf, "favor_info"))


def comment_dic(spark: SparkSession, sf: str) -> DataFrame:
    return facts.comment_add(*_feeds(spark, sf, "comment_info"))


def comment_unnamed(spark: SparkSession, sf: str) -> DataFrame:
    """Comments the dictionary join loses, per code."""
    log, dic = _feeds(spark, sf, "comment_info")
    rows = changes.extract(log, "comment_info", ["id", "appraise"], types=["insert"])
    return (lookups.unnamed(rows, dic, "appraise").groupBy("appraise")
            .agg(F.count("*").alias("row_count")))


def user_register(spark: SparkSession, sf: str) -> DataFrame:
    return facts.user_register(standin.table_changes(spark, sf, "user_info"))


# --- trade summaries ---------------------------------------------------------------------------

def _details(spark: SparkSession, sf: str) -> DataFrame:
    return facts.order_detail(_wide(spark, sf))


def order_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.order_window(_details(spark, sf), DAY, DETAIL_VERSION)


def payment_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.payment_window(_payments(spark, sf), DAY, PAYMENT_VERSION)


def province_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.province_window(_details(spark, sf), standin.provinces(spark, sf), DAY,
                                     DETAIL_VERSION)


def user_spu_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.user_spu_window(_details(spark, sf), standin.product_dimensions(spark, sf),
                                     DAY, DETAIL_VERSION)


def brand_refund_window(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.brand_refund_window(facts.refund_request(*_feeds(spark, sf, "order_refund_info", "order_info")),
                                         standin.product_dimensions(spark, sf), DAY)


# --- dimensions and versions -------------------------------------------------------------------

def _routed(spark: SparkSession, sf: str) -> DataFrame:
    config = standin.routing(spark)
    return dimensions.route(standin.change_log(spark, sf), config,
                            dimensions.source_tables(config))


def dim_route(spark: SparkSession, sf: str) -> DataFrame:
    routed = _routed(spark, sf)
    return routed.groupBy("sink_table", "type", F.concat_ws(",", F.array_sort(F.map_keys("data")))
                          .alias("kept")).agg(F.count("*").alias("row_count"),
                                              F.count_distinct("pk").alias("key_count"))


def dim_latest(spark: SparkSession, sf: str) -> DataFrame:
    routed = _routed(spark, sf)
    routed = routed.withColumn("last_event", F.col("data")["last_event"].cast("bigint"))
    images = dimensions.current_images(routed, ("ts", "last_event"))
    data = F.col("data")
    return images.select("sink_table", "pk", data["sku_name"].alias("sku_name"),
                         data["tm_id"].alias("tm_id"), data["name"].alias("name"),
                         "last_event", data["last_value"].alias("last_value"), "ts")


def dim_unrouted(spark: SparkSession, sf: str) -> DataFrame:
    rows = dimensions.unrouted(standin.change_log(spark, sf), standin.routing(spark))
    return rows.groupBy("table").agg(F.count("*").alias("row_count"))


def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest_per_key(standin.table(spark, sf, "lineitem"),
                                   ["l_orderkey", "l_linenumber"], LINE_VERSION)


def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Open lines as the stored target, fulfilled lines as the changes merged into it."""
    lines = standin.table(spark, sf, "lineitem")
    return versions.merge_latest(lines.filter("l_linestatus = 'O'"),
                                 lines.filter("l_linestatus = 'F'"),
                                 ["l_orderkey", "l_linenumber"], LINE_VERSION)


def changelog_count(spark: SparkSession, sf: str) -> DataFrame:
    return windows.live_count(standin.table(spark, sf, "events"), "user_id")


def left_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Comments with the dictionary name where there is one."""
    log, dic = _feeds(spark, sf, "comment_info")
    rows = changes.extract(log, "comment_info", ["id", "appraise"], types=["insert"])
    return lookups.enrich(rows, dic, {"appraise": "dic_code"}, {"appraise_name": "dic_name"})


def two_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension keyed by two columns: latest line per (order, part) looked up by refunds."""
    lines = standin.table(spark, sf, "lineitem")
    items = versions.latest_per_key(
        lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"),
        ["l_orderkey", "l_partkey"], ("l_linenumber", "l_quantity"))
    refunds = changes.extract(standin.table_changes(spark, sf, "refund_payment"), "refund_payment",
                              ["id", "order_id", "sku_id", "refund_status"])
    refunds = (refunds.withColumn("order_id", F.col("order_id").cast("bigint"))
               .withColumn("sku_id", F.col("sku_id").cast("bigint")))
    return lookups.enrich(refunds, items, {"order_id": "l_orderkey", "sku_id": "l_partkey"},
                          {"line": "l_linenumber", "quantity": "l_quantity"})


def click_filter_count(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered rows per user and hour, with the event time as text."""
    rows = standin.behaviour(spark, sf).filter(F.col("common.ch") == "click")
    return windows.tumbling(rows.select(F.col("common.uid").alias("user"), "ts"),
                            from_ms(F.col("ts")), ["user"], {"row_count": F.count("*")}, HOUR)


# --- the same rules on streams -----------------------------------------------------------------

def _taken(rows: DataFrame, name: str, keys: Sequence[str] = (), mode: str = "update",
           ) -> DataFrame:
    """Run a stream over what its source holds now, and read back what it wrote."""
    spark, schema = rows.sparkSession, rows.schema
    path = work_dir(spark, name)
    _run(sinks.to_upserts(rows, path, keys, mode=mode) if keys else sinks.to_files(rows, path),
         spark, name)
    return sinks.current(spark, path, keys) if keys else spark.read.schema(schema).parquet(path)


def _run(writer: DataStreamWriter, spark: SparkSession, name: str,
         checkpoint: str | None = None) -> None:
    """Run a query until its source has nothing new."""
    # one state store per core; a stream keeps the number it starts with
    with _set(spark, {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}):
        query = sinks.start(writer, checkpoint or work_dir(spark, f"{name}-checkpoint"))
    query.awaitTermination()


@contextmanager
def _set(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Session settings for a while; a stream keeps those it starts with."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _by_time(rows: DataFrame, at: str, parts: int, cuts: Sequence[float] | None = None) -> Column:
    """The number of the part a row falls in by its time. Cuts that aren't given are quantiles; a row
    without a time is in the first part."""
    time = F.col(at).cast("double")
    if cuts is None:
        cuts = rows.select(time.alias("at")).approxQuantile(
            "at", [k / parts for k in range(1, parts)], 0.01)
    part = F.lit(0)
    for cut in cuts:
        part = part + F.coalesce((time > cut).cast("int"), F.lit(0))
    return part


def _turns(rows: DataFrame, name: str, at: str, parts: int = 4) -> Iterator[DataFrame]:
    """The same rows as a stream that grows by a part a turn, for a job that is started in turn and goes
    on from its checkpoint. The rows are made once and leave their tasks as files of the part they fall
    in."""
    spark, path = rows.sparkSession, work_dir(rows.sparkSession, name)
    _write_parts(rows, _by_time(rows, at, parts), parts, path)
    for number in range(parts):
        yield (spark.readStream.schema(_marked(rows)).parquet(f"{path}/_part=[0-{number}]")
               .filter("NOT _mark").drop("_mark"))


def _write_parts(rows: DataFrame, part: Column, parts: int, path: str) -> None:
    """The rows as files of the part they fall in, a folder a part. A part starts with a row that only
    keeps it from being left out as empty."""
    marks = rows.sparkSession.range(parts, numPartitions=1).select(
        *(F.lit(None).cast(field.dataType).alias(field.name) for field in rows.schema.fields),
        F.lit(True).alias("_mark"), F.col("id").cast("int").alias("_part"))
    (marks.union(rows.select(*rows.columns, F.lit(False).alias("_mark"), part.alias("_part")))
     .write.partitionBy("_part").parquet(path))


def _marked(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("_mark", T.BooleanType())])


def _replayed(rows: DataFrame, name: str, closing: DataFrame | None = None, parts: int = 4,
              at: str = "ts", late: Column | None = None,
              cuts: Sequence[float] | None = None) -> DataFrame:
    """The rows as a stream of several micro-batches in order of time, and last the
    closing rows, which only move the watermark on. Rows for which `late` holds come one micro-batch
    after their time."""
    part = _by_time(rows, at, parts, cuts)
    if late is not None:
        part = F.least(part + F.coalesce(late, F.lit(False)).cast("int"), F.lit(parts - 1))
    cut = [rows.filter(part == number) for number in range(parts)]
    if closing is not None:
        cut.append(closing.select(*rows.columns))
    return _file_by_file(work_dir(rows.sparkSession, name), cut)


def stream_bounce_detail(spark: SparkSession, sf: str) -> DataFrame:
    pages = standin.pages(spark, sf)
    # a page of nobody that is no entry, long after all others
    last = pages.agg(F.max("ts")).first()[0]
    closing = pages.limit(1).select(
        F.col("common").withField("mid", F.lit("closing")).alias("common"),
        F.col("page").withField("last_page_id", F.lit("closing")).alias("page"),
        F.lit((last or 0) + 4 * GAP_MS).alias("ts"), "event_id")
    rows = rules.bounces(_replayed(pages, "pages", closing), GAP_MS, PIECE_MS, TIE)
    return _taken(rows.select("event_id", "common.*", "page.*", "ts"), "bounces")


def stream_new_visitor_repair(spark: SparkSession, sf: str) -> DataFrame:
    fixed = rules.repair_new_visitors(standin.behaviour(spark, sf, stream=True), TIE)
    return _taken(fixed.select("event_id", F.col("common.mid").alias("mid"),
                               F.col("common.is_new").alias("is_new"), "ts"), "repair")


def stream_log_split(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text in several micro-batches through the fan-out, and its five streams read back with
    the keys nobody knows."""
    text = _replayed(standin.behaviour_text(spark, sf, timed=True, dealt=True), "log-text", at="at").drop("at")
    log = rules.repair_new_visitors(logs.parse_text(text).clean, TIE)
    path = work_dir(spark, "log-streams")
    _run(sinks.to_log_streams(log, path), spark, "log-streams")
    event = T.StructType([T.StructField("event_id", T.LongType())])
    detail = {"page": F.col("page.last_page_id"), "start": F.col("start")["loading_time"],
              "display": F.col("display")["item"], "action": F.col("action")["item"],
              "error": F.col("err")["error_code"]}
    parts = [feeds.stored_stream(spark, path, name, stream=False, more=event).select(
        "event_id", F.lit(name).alias("stream"), F.col("common.mid").alias("mid"),
        F.col("common.is_new").alias("is_new"), F.col("common_more")["os"].alias("os"),
        F.col("page_more")["refer_id"].alias("refer_id"), detail[name].alias("detail"))
        for name in logs.STREAMS]
    return reduce(DataFrame.unionByName, parts)


def stream_change_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The raw change feed of coupons and carts, split once in several micro-batches; the coupon
    orders out of their partition."""
    feed = standin.as_one_log(standin.table_changes(spark, sf, "coupon_use", "cart_info", dealt=True))
    text = feed.select(F.to_json(F.struct(*S.ENVELOPE.names)).alias("value"),
                       F.col("ts").cast("bigint").alias("at"))
    path = work_dir(spark, "change-tables")
    for grown in _turns(text, "change-text", at="at"):
        _run(sinks.to_change_tables(feeds.change_log(grown), path), spark, "change-tables",
             f"{path}-checkpoint")
    return facts.coupon_order(feeds.stored_changes(spark, path, "coupon_use", stream=False))


# A shop's orders a minute apart; rows may come an hour late, and what belongs together waits so long.
LATE_SECONDS, DELAY, WAIT, HOLD_MS = 3600, "2 hours", "1 hour", 3600 * 1000


def _part(rows: DataFrame, of: DataFrame | None = None, parts: int = 3,
          ends: Sequence[float] | None = None) -> Column:
    """The number of the part that a change or fact row falls in, cut by time; a third of those in the
    last hour before a cut come after it. Cuts that aren't given are quantiles of the rows, or of `of`
    where the rows are dear to make."""
    at, late = F.col("ts").cast("bigint"), F.xxhash64(*rows.columns) % 3 == 0
    if ends is None:
        ends = (rows if of is None else of).select(at.cast("double").alias("at")).approxQuantile(
            "at", [k / parts for k in range(1, parts)], 0.01)
    return _below(sorted(ends), at + F.when(late, LATE_SECONDS).otherwise(0))


def _below(ends: Sequence[float], value: Column, passed: int = 0) -> Column:
    """How many of the sorted ends lie below the value, found by halves; none below a null."""
    if not ends:
        return F.lit(passed)
    half = len(ends) // 2
    return F.when(value > ends[half], _below(ends[half + 1:], value, passed + half + 1)).otherwise(
        _below(ends[:half], value, passed))


def _parts(rows: DataFrame, parts: int = 3) -> list[DataFrame]:
    number = _part(rows, parts=parts)
    return [rows.filter(number == k) for k in range(parts)]


def _closing(rows: DataFrame, days: int, **changed: str) -> DataFrame:
    """A row long after all others with other values in some columns; it moves the watermark on."""
    end = rows.agg(F.max(F.col("ts").cast("bigint")).alias("end"))
    return rows.limit(1).crossJoin(end).withColumns({
        "ts": (F.col("end") + days * 86_400).cast("string"),
        **{name: F.lit(value) for name, value in changed.items()}}).select(*rows.columns)


def _file_by_file(path: str, parts: list[DataFrame]) -> DataFrame:
    """A stream that takes the parts in turn, one in a micro-batch. Every part is the same number of
    files, one a core at least and more as the input is split in more, so no task writes or reads a
    whole part. A file starts with a row that only keeps it from being left out as empty."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    files = max(spark.sparkContext.defaultParallelism, *(part.rdd.getNumPartitions() for part in parts))
    for part in parts:
        marks = spark.range(files).select(
            *(F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields),
            F.lit(True).alias("_mark"), F.col("id").cast("int").alias("_file"))
        dealt = part.select(*schema.names, F.lit(False).alias("_mark"), F.pmod(
            F.monotonically_increasing_id(), F.lit(files)).cast("int").alias("_file"))
        (marks.union(dealt).repartitionById(files, "_file").drop("_file")
         .write.mode("append").parquet(path))
    return (spark.readStream.schema(T.StructType([*schema.fields, T.StructField("_mark", T.BooleanType())]))
            .option("maxFilesPerTrigger", files).parquet(path).filter("NOT _mark").drop("_mark"))


# Changes of all tables in a micro-batch of the wide orders: the joins hold a micro-batch's rows, however
# many come after it.
PART_CHANGES = 1_000_000

# What a micro-batch of the wide orders leaves behind is let go soon: state older than the last two, looked
# for more often (by the first such query of an application), and what was shuffled.
WIDE_STATE = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
              "spark.sql.streaming.join.stateFormatVersion": "3",  # one store for a join's task, not four
              "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
              "spark.sql.streaming.minBatchesToRetain": "2",
              "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
              "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.parquet.compression.codec": "zstd"}


def _cuts(tables: Sequence[DataFrame], least: int = 3) -> list[float]:
    """Times that cut the changes of all tables together into parts of a size."""
    at = reduce(DataFrame.unionAll, [rows.select(F.col("ts").cast("double").alias("at")) for rows in tables])
    parts = max(least, math.ceil(at.count() / PART_CHANGES))
    return at.approxQuantile("at", [k / parts for k in range(1, parts)], 0.1 / parts)


def stream_order_wide(spark: SparkSession, sf: str) -> DataFrame:
    """An inner and two outer stream joins in a row, over four tables in several micro-batches with
    late rows; what finds no partner comes out once the watermark has passed its wait. The job is started
    in turn as its input grows and goes on from its checkpoint."""
    cuts = _cuts([*_written(spark, sf).values()])
    with _set(spark, WIDE_STATE):
        return _order_wide_in_turn(spark, sf, cuts)


def _order_wide_in_turn(spark: SparkSession, sf: str, cuts: Sequence[float]) -> DataFrame:
    parts, closings = len(cuts) + 1, (10, 20)
    sources = {}
    for name, rows in _written(spark, sf, parts * spark.sparkContext.defaultParallelism).items():
        path = work_dir(spark, name)
        sources[name] = path, _marked(rows)
        _write_parts(rows, _part(rows, ends=cuts), parts, path)
        key = "order_detail_id" if name.startswith("order_detail_") else "id"
        closing = spark.read.schema(_marked(rows)).parquet(path).filter("NOT _mark").withColumn(
            "data", F.col("data").withField(key, F.lit(f"closing {name}")))
        if name == "order_detail":  # a row that the filters ahead of the joins let through
            closing = closing.withColumn("data", F.col("data").withField("order_id", F.lit("none"))
                                         .withField("source_type", F.lit("2401")))
        # what the second join passes on at the first closing is the third one's at the second
        last = [_closing(closing, days, type="insert") for days in closings]
        for number, rows in enumerate(last, parts):
            rows.write.parquet(f"{path}/_part={number}")
    out = work_dir(spark, "wide")
    for number in range(parts + len(closings)):
        streams = {name: spark.readStream.schema(schema).option("cleanSource", "delete")
                   .parquet(f"{path}/[_]part={number}").filter("NOT _mark").drop("_mark")
                   for name, (path, schema) in sources.items()}
        wide = facts.order_wide(streams, standin.dictionary(spark), facts.Bounds(WAIT, DELAY))
        wide = wide.withColumn("old_status", F.col("old")["order_status"]).drop("old", "row_op_ts")
        _run(sinks.to_files(wide, out), spark, "wide", f"{out}-checkpoint")
    return spark.read.schema(wide.schema).parquet(out)


def _written(spark: SparkSession, sf: str, ranges: int = 0) -> dict[str, DataFrame]:
    return standin.written_together(standin.table_changes(spark, sf, *standin.ORDERING, ranges=ranges))


def _in_turn(rows: DataFrame, name: str, of: DataFrame, closing: dict[str, str],
             settle: Callable[[DataFrame], DataFrame], window: Callable[[DataFrame], DataFrame],
             keys: Sequence[str]) -> DataFrame:
    """Two jobs started in turn as their input grows: settled versions, then windows over them.
    Each goes on from its checkpoint. The rows are made once and leave their tasks as files of the
    part they fall in; a turn's input is the parts up to its own. `of` has the times the cuts go by,
    `closing` a column and the start of its value in the two closing rows."""
    spark = rows.sparkSession
    source, held, out = (work_dir(spark, f"{name}-{part}") for part in ("in", "settled", "out"))
    parts = 3
    rows.withColumn("_part", _part(rows, of, parts)).write.partitionBy("_part").parquet(source)
    stored = spark.read.schema(T.StructType([
        *rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(source).drop("_part")
    (column, start), = closing.items()
    last = [_closing(stored, days, **{column: f"{start} {days}"}) for days in (10, 20)]
    for number in range(parts + len(last)):
        if number >= parts:
            last[number - parts].write.parquet(f"{source}/_part={number}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/_part=[0-{number}]")
        settled = settle(stream)
        _run(sinks.to_files(settled, held), spark, f"{name}-settled", f"{held}-checkpoint")
        stored_versions = feeds.table_rows(spark, held, settled.schema, stream=True)
        _run(sinks.to_upserts(window(stored_versions), out, keys, mode="append"), spark, name,
             f"{out}-checkpoint")
    return sinks.current(spark, out, keys)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = work_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _together(spark: SparkSession, sf: str, *more: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Changes as a shop writes them, the dictionary, and new details out of them."""
    tables = standin.written_together(standin.table_changes(spark, sf, *more, *standin.ORDERING))
    dic = standin.dictionary(spark)
    return tables, dic, facts.order_detail(facts.order_wide(tables, dic))


def _settled_windows(spark: SparkSession, sf: str, name: str, uses: Sequence[str],
                     window: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """Versions of details, settled, then the window. Spark prunes no columns ahead of a stateful rule,
    so `uses` names those of the window; key and version stay beside them."""
    tables, _, details = _together(spark, sf)
    rows = details.select(*dict.fromkeys(["id", *DETAIL_VERSION, *uses]))
    return _in_turn(rows, name, tables["order_detail"], {"id": "closing"}, lambda part: jobs.settled_details(
        part, "id", DETAIL_VERSION, HOLD_MS, DELAY), window, keys)


def stream_order_window(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of details, some late and out of order, settled on event time; then users and
    amounts per day."""
    uses = ["user_id", "source_type_name", "date_id", *summaries.ORDER_AMOUNTS.values()]
    return _settled_windows(spark, sf, "order-window", uses,
                            lambda rows: jobs.order_window(rows, DAY), ["stt"])


def stream_payment_window(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of paid details settled on event time; then paying users per day."""
    tables, dic, details = _together(spark, sf, "payment_info")
    payments = facts.payment_success(tables, details, dic).select("order_detail_id", *PAYMENT_VERSION, "user_id")
    return _in_turn(payments, "payment-window", tables["payment_info"], {"order_detail_id": "closing"},
                    lambda rows: jobs.settled_details(rows, "order_detail_id", PAYMENT_VERSION, HOLD_MS, DELAY),
                    lambda rows: jobs.payment_window(rows, DAY), ["stt"])


def stream_province_window(spark: SparkSession, sf: str) -> DataFrame:
    uses = ["user_id", "source_type_name", "province_id", "order_id", "split_total_amount"]
    counts = _settled_windows(spark, sf, "province-window", uses,
                              lambda rows: jobs.province_counts(rows, DAY), ["stt", "province_id"])
    return summaries.province_names(counts, standin.provinces(spark, sf))


def stream_comment_dic(spark: SparkSession, sf: str) -> DataFrame:
    """Comments in several micro-batches against a dictionary that grows meanwhile."""
    rows = facts.comments(standin.table_changes(spark, sf, "comment_info"))
    entries = standin.dictionary(spark).select("dic_code", "dic_name")
    late = {"1202": 1, "1203": 2, "1204": 3}
    path = work_dir(spark, "dictionary")
    for number in range(4):
        named = [code for code, at in late.items() if at == number]
        entries.filter(F.col("dic_code").isin(*named) if named else F.lit(False)).withColumn(
            "version", F.lit(number).cast("bigint")).coalesce(1).write.mode("append").parquet(path)
    growing = (spark.readStream.schema(live.ENTRY)
               .option("maxFilesPerTrigger", 1).parquet(path))
    found = live.named_live(_replayed(rows, "comments"), growing,
                            entries.filter(~F.col("dic_code").isin(*late)), "appraise_code",
                            "appraise_name")
    return _taken(found, "comments-named")


def _routing_text(spark: SparkSession, path: str) -> DataFrame:
    """Config changes as JSON text, a file per micro-batch: the products get a column more and the
    provinces are taken up in the second, the users are taken out in the third."""
    users, products, provinces = (dict(zip(S.ROUTING.names, row)) for row in standin.ROUTING_ROWS)
    narrow = products | {"sink_columns": "id,sku_name"}
    steps = [[{"after": users}, {"after": narrow}],
             [{"before": narrow, "after": products}, {"after": provinces}],
             [{"before": users}]]
    for number, rows in enumerate(steps):
        text = [(json.dumps(row | {"ts_ms": number}),) for row in rows]
        spark.createDataFrame(text, "value string").coalesce(1).write.mode("append").parquet(path)
    return (spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(path))


def stream_dim_route(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions loaded in three micro-batches while their routing config changes."""
    feed = standin.as_one_log(standin.table_changes(
        spark, sf, *(row[0] for row in standin.ROUTING_ROWS)))
    data = F.col("data")
    number = F.coalesce(data["last_event"], data["id"]).cast("bigint")
    log = _replayed(feed.withColumn("seq", number).withColumn("part", number % 3), "routed-feed",
                    parts=3, at="part", cuts=(0, 1))
    path = work_dir(spark, "routed")
    routing = feeds.routing_changes(_routing_text(spark, work_dir(spark, "routing-text")))
    none = spark.createDataFrame([], S.ROUTING)
    _run(sinks.to_routed_dimensions(log, routing, path, f"{path}-history", none, ("ts", "seq")),
         spark, "routed")
    shown = ("id", "sku_name", "tm_id", "category3_id", "name", "last_event")
    tables = [sinks.dimension(spark, path, row[1], ("ts", "seq")) for row in standin.ROUTING_ROWS]
    return reduce(DataFrame.unionByName, [
        table.select(F.lit(row[1]).alias("sink_table"),
                     *(F.col(name) if name in table.columns else F.lit(None).cast("string").alias(name)
                       for name in shown))
        for row, table in zip(standin.ROUTING_ROWS, tables)])


def stream_changelog_retract(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user, errors taking one away, as a changelog; what it adds up to in the end."""
    events = standin.table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return live.net(_taken(live.changelog(_replayed(events, "signed"), "user_id", "sign"),
                           "changelog"), "user_id")


def stream_unique_visitor_daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = rules.daily_visitors(standin.pages(spark, sf, stream=True), TIE)
    return _taken(rows.select("event_id", "common.*", "page.*", "ts"), "visitors")


def stream_login_days(spark: SparkSession, sf: str) -> DataFrame:
    return _taken(rules.daily_logins(standin.pages(spark, sf, stream=True), RETURN_DAYS), "logins")


def stream_page_visitors(spark: SparkSession, sf: str) -> DataFrame:
    return _taken(rules.daily_page_visitors(standin.pages(spark, sf, stream=True)), "page-visitors")


def stream_keyword_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = jobs.keyword_window(standin.pages(spark, sf, stream=True), HOUR)
    return _taken(rows, "keywords", ["stt", "keyword"])


def stream_register_window(spark: SparkSession, sf: str) -> DataFrame:
    log = standin.table_changes(spark, sf, "user_info", stream=True)
    return _taken(jobs.register_window(facts.user_register(log), HOUR), "registrations", ["stt"])


def stream_traffic_window(spark: SparkSession, sf: str) -> DataFrame:
    """Bounces and daily visitors as tables of their own, then the three streams together."""
    pages, parts = standin.pages(spark, sf), []
    for name, rows in (("bounces", visits.bounces(pages, GAP_MS, PIECE_MS, TIE)),
                       ("visitors", visits.daily_visitors(pages, TIE))):
        path = work_dir(spark, name)
        rows.write.parquet(path)
        parts.append(spark.readStream.schema(rows.schema).parquet(path))
    rows = jobs.traffic_window(standin.pages(spark, sf, stream=True), *parts, HOUR, GAP_MS)
    return _taken(rows, "traffic", ["stt", "version", "channel", "area", "is_new"])


def stream_cart_delta(spark: SparkSession, sf: str) -> DataFrame:
    log = standin.table_changes(spark, sf, "cart_info", stream=True)
    return _taken(facts.cart_add(log, standin.dictionary(spark)), "cart")


def stream_refund_detail(spark: SparkSession, sf: str) -> DataFrame:
    """A stream-stream join; the test lines are shipped years after their order, so the sides wait
    long."""
    log = standin.table_changes(spark, sf, "order_refund_info", "order_info", stream=True)
    rows = facts.refund_request(log, standin.dictionary(spark), facts.Bounds("4000 days"))
    return _taken(rows.drop("row_op_ts"), "refunds")


def stream_refund_near(spark: SparkSession, sf: str) -> DataFrame:
    """The same join over requests that follow their order by an hour, both sides in several
    micro-batches with late rows: two hours of wait and of delay are all that state holds."""
    tables = standin.written_together(
        standin.table_changes(spark, sf, "order_refund_info", "order_info"))
    streams = {name: _file_by_file(work_dir(spark, name), _parts(_stored(rows, f"{name}-rows")))
               for name, rows in tables.items()}
    rows = facts.refund_request(streams, standin.dictionary(spark), facts.Bounds("2 hours", DELAY))
    return _taken(rows.drop("row_op_ts"), "refunds-near")


def stream_changelog_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.live_count(standin.table(spark, sf, "events", stream=True), "user_id")
    return _taken(rows, "counts", ["user_id"])


QUERIES: dict[str, Query] = {query.__name__: query for query in (
    dirty_split, log_split_counts, new_visitor_repair, log_page, log_start, log_display,
    log_action, log_error, unique_visitor_daily, bounce_detail, keyword_window, keyword_docs,
    traffic_window, home_detail_uv_window, login_back_window, login_back_window_default,
    register_window, cart_unique_window, cdc_extract, status_change, cart_delta, order_wide,
    order_detail, order_cancel, payment_detail, refund_detail, refund_paid, coupon_get,
    coupon_order, change_text, coupon_pay, favor_add, comment_dic, comment_unnamed, user_register,
    order_window, payment_window, province_window, user_spu_window, brand_refund_window,
    dim_route, dim_latest, dim_unrouted, latest_by_key, upsert_by_key, changelog_count,
    left_lookup, two_key_lookup, click_filter_count, stream_new_visitor_repair,
    stream_bounce_detail, stream_unique_visitor_daily, stream_login_days, stream_page_visitors, stream_keyword_window,
    stream_register_window, stream_traffic_window, stream_cart_delta, stream_refund_detail,
    stream_changelog_count, stream_log_split, stream_change_tables, stream_order_wide,
    stream_order_window, stream_province_window, stream_comment_dic, stream_changelog_retract,
    stream_dim_route, stream_payment_window, stream_refund_near)}
