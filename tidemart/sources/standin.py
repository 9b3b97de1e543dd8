"""The mart's two feeds and its dimensions, derived from the star-schema test tables.

Everything here is a column expression over the tables, so Catalyst sees through it and scans only
the columns a job comes to use.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemart.functions.clock import SECOND_FORMAT
from tidemart.schemas import DICTIONARY_NAMES, ROUTING
from tidemart.session import configure

# Targets of the dimension loader.
ROUTING_ROWS = [
    ("user_info", "dim_user_info", "id,last_event,last_value", "id", None),
    ("sku_info", "dim_sku_info", "id,sku_name,tm_id,category3_id", None, None),
    ("base_province", "dim_base_province", "id,name", "id", " salt_buckets=3"),
]


# Columns that tell a table's rows apart, and that its changes use anyway.
DEALT_BY = {"orders": ("o_orderkey", "o_custkey", "o_orderdate"),
            "lineitem": ("l_orderkey", "l_linenumber", "l_partkey"),
            "events": ("event_id", "user_id", "ts")}

# per application and path: the schema
_KNOWN: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A test table, whole or as a stream of its files. The session is configured once, when its
    first table is read; settings changed later stay."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    application = spark.sparkContext.applicationId
    if not any(known == application for known, _ in _KNOWN):
        configure(spark)
    if (application, path) not in _KNOWN:
        _KNOWN[application, path] = spark.read.parquet(path).schema
    schema = _KNOWN[application, path]
    # a stream source takes a single file only as the match of a pattern
    return (spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]") if stream
            else spark.read.schema(schema).parquet(path))


def _text(value: Column) -> Column:
    return value.cast("string")


def _money(value: Column) -> Column:
    return value.cast("decimal(16,2)")


# --- behaviour log -----------------------------------------------------------------------------

def behaviour(spark: SparkSession, sf_dir: str, stream: bool = False, dealt: bool = False) -> DataFrame:
    """Events as parsed behaviour-log rows, with `event_id` kept to break ties. `dealt` events are spread
    over the cores before their rows are made."""
    events = table(spark, sf_dir, "events", stream)
    return behaviour_of(_dealt(events, "events") if dealt else events)


def behaviour_of(events: DataFrame) -> DataFrame:
    rows = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind, user = F.col("k"), F.col("event_type"), F.col("user_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    page_id = (F.when(kind == "view", "home").when(kind == "click", "good_detail")
               .otherwise(kind))
    last_page = (F.when(k % 4 == 1, "search").when(k % 4 == 2, "login")
                 .when(k % 4 == 3, "home"))
    phrase = F.concat_ws(" ", kind, F.lit("Deal"), _text(k % 7), F.concat(F.lit("sku"), _text(k)))
    display = F.transform(F.sequence(F.lit(1), F.greatest(k % 3, F.lit(1))), lambda place: F.create_map(
        F.lit("item"), _text(k + place), F.lit("pos_id"), _text(place)))
    action = F.array(F.create_map(F.lit("action_id"), F.lit("favor_add"), F.lit("item"), _text(k),
                                  F.lit("ts"), _text(ms)))
    return rows.select(
        F.struct(
            F.concat(F.lit("m"), user).alias("mid"),
            F.when(k % 10 != 9, _text(user)).alias("uid"),
            _text(k % 2).alias("is_new"),
            F.concat(F.lit("v"), _text(k % 3)).alias("vc"),
            kind.alias("ch"),
            F.concat(F.lit("a"), _text(user % 5)).alias("ar")).alias("common"),
        F.struct(
            page_id.alias("page_id"), last_page.alias("last_page_id"),
            F.when(k % 4 == 1, phrase).alias("item"),
            F.when(k % 8 == 1, "keyword").when(k % 4 == 1, "sku_id").alias("item_type"),
            (k * 100).cast("bigint").alias("during_time")).alias("page"),
        F.when(k % 3 > 0, display).alias("displays"),
        F.when(k % 2 == 1, action).alias("actions"),
        F.when(kind == "signup", F.create_map(F.lit("entry"), F.lit("icon"), F.lit("loading_time"),
                                              _text(k))).alias("start"),
        F.when(kind == "error", F.create_map(F.lit("error_code"), _text(k + 1000),
                                             F.lit("msg"), F.lit("failed"))).alias("err"),
        ms.alias("ts"),
        "event_id")


def behaviour_text(spark: SparkSession, sf_dir: str, timed: bool = False, dealt: bool = False) -> DataFrame:
    """The same log as raw text in which every tenth kind of row is damaged: cut short, emptied,
    or without its `common` part. With `timed`, the time stands beside it as `at`, and the objects
    hold keys that the mart doesn't know."""
    rows = behaviour(spark, sf_dir, dealt=dealt)
    if timed:
        rows = rows.withColumns({
            "common": F.col("common").withField("os", F.concat(F.lit("os"), F.col("common.vc"))),
            "page": F.col("page").withField("refer_id", F.col("event_id") % 11)})
    k = (F.col("page.during_time") / 100).cast("int")
    whole = F.to_json(F.struct("common", "page", "displays", "actions", "start", "err", "ts"))
    bare = F.to_json(F.struct("page", "ts"))
    value = (F.when(k % 30 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1))
             .when(k % 30 == 10, F.lit("")).when(k % 30 == 20, bare).otherwise(whole))
    return rows.select("event_id", value.alias("value"), *([rows["ts"].alias("at")] if timed else []))


def pages(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Page stream of the log, before new-visitor repair."""
    return page_rows(behaviour(spark, sf_dir, stream))


def page_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("start").isNull()).select("common", "page", "ts", "event_id")


# --- change log --------------------------------------------------------------------------------

def _image(**fields: Column) -> dict[str, Column]:
    return {name: _text(value) for name, value in fields.items()}


def _changes(rows: DataFrame, name: str, kind: Column | str, data: dict[str, Column],
             seconds: Column, old: dict[str, Column] | None = None) -> DataFrame:
    """Change rows of one table with their images as structs. A null in `old` stands for a column
    the change left alone."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    before = old or {"_none": F.lit(None).cast("string")}
    return rows.select(
        F.lit("mall").alias("database"), F.lit(name).alias("table"), kind.alias("type"),
        F.struct(*(value.alias(key) for key, value in data.items())).alias("data"),
        F.struct(*(value.alias(key) for key, value in before.items())).alias("old"),
        _text(seconds).alias("ts"))


def _seconds(day: str, spread: str) -> Column:
    """Epoch seconds of a date column, moved to a time of day that depends on a key."""
    return F.unix_seconds(F.col(day).cast("timestamp")) + F.col(spread) * 7919 % 86400


def _clock(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), SECOND_FORMAT)


def table_changes(spark: SparkSession, sf_dir: str, *tables: str, stream: bool = False,
                  dealt: bool = False, ranges: int = 0) -> dict[str, DataFrame]:
    """The change log kept per source table, with typed images: a job reads only the tables, and
    of their images only the columns, that it uses. `dealt` rows are spread over the cores before their
    images are made, with `ranges` over so many tasks, each a range of keys."""
    names = tables or tuple(MAKERS)
    sources = {source: _source(spark, sf_dir, source, stream, dealt, ranges)
               for source in {MAKERS[name][0] for name in names}}
    return {name: MAKERS[name][1](name, sources[MAKERS[name][0]]) for name in names}


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as one feed of all tables, images as maps."""
    return as_one_log(table_changes(spark, sf_dir))


def as_one_log(tables: dict[str, DataFrame]) -> DataFrame:
    """Per-table changes as one feed; `old` keeps changed columns only, and is null for none."""
    def with_maps(rows: DataFrame) -> DataFrame:
        data, old = (F.create_map(*(part for key in rows.schema[name].dataType.names
                                    for part in (F.lit(key), F.col(f"{name}.{key}"))))
                     for name in ("data", "old"))
        changed = F.map_filter(old, lambda _, value: value.isNotNull())
        return rows.withColumn("data", data).withColumn(
            "old", F.when(F.size(changed) > 0, changed))

    return reduce(DataFrame.unionByName, [with_maps(rows) for rows in tables.values()])


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a table over as many tasks as there are cores, and more as its files are split in
    more, however few row groups the files have. Rows that a filter above leaves out stay where they are."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(tasks, *DEALT_BY[name])


def _source(spark: SparkSession, sf_dir: str, name: str, stream: bool, dealt: bool = False,
            ranges: int = 0) -> DataFrame:
    rows = table(spark, sf_dir, name, stream)
    if ranges:
        rows = rows.repartitionByRange(ranges, *DEALT_BY[name])
    elif dealt:
        rows = _dealt(rows, name)
    if name != "events":
        return rows
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _detail_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _line_seconds() -> Column:
    return _seconds("l_shipdate", "l_orderkey")


def _line_price() -> Column:
    return _money(F.col("l_extendedprice"))


def _share_of_price(rate: str) -> Column:
    return _money(_line_price() * F.col(rate).cast("decimal(4,2)"))


def _with_activity() -> Column:
    return F.col("l_discount") >= 0.05


def _with_coupon() -> Column:
    return F.col("l_tax") >= 0.06


def _order_detail(name: str, lines: DataFrame) -> DataFrame:
    at, cut, tax = _line_seconds(), _share_of_price("l_discount"), _share_of_price("l_tax")
    kind = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), "update")
    return _changes(
        lines, name, kind.otherwise("insert"),
        _image(id=_detail_id(), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"),
               sku_name=F.concat(F.lit("sku-"), F.col("l_partkey")), create_time=_clock(at),
               source_id=F.col("l_suppkey"), source_type=2401 + F.col("l_suppkey") % 5,
               sku_num=F.col("l_quantity").cast("int"), order_price=_line_price(),
               split_total_amount=_line_price() - cut - tax,
               split_activity_amount=F.when(_with_activity(), cut),
               split_coupon_amount=F.when(_with_coupon(), tax)), at)


def _order_detail_activity(name: str, lines: DataFrame) -> DataFrame:
    return _changes(lines.filter(_with_activity()), name, "insert",
                    _image(order_detail_id=_detail_id(), activity_id=F.col("l_partkey") % 10,
                           activity_rule_id=F.col("l_partkey") % 30), _line_seconds())


def _order_detail_coupon(name: str, lines: DataFrame) -> DataFrame:
    return _changes(lines.filter(_with_coupon()), name, "insert",
                    _image(order_detail_id=_detail_id(), coupon_id=F.col("l_suppkey") % 20),
                    _line_seconds())


def _order_refund_info(name: str, lines: DataFrame) -> DataFrame:
    at = _line_seconds() + 3600
    return _changes(
        lines.filter("l_returnflag = 'R'"), name, "insert",
        _image(id=_detail_id(), user_id=F.col("l_orderkey") % 997, order_id=F.col("l_orderkey"),
               sku_id=F.col("l_partkey"), refund_type=1501 + F.col("l_linenumber") % 3,
               refund_num=F.col("l_quantity").cast("int"), refund_amount=_line_price(),
               refund_reason_type=1301 + F.col("l_partkey") % 8,
               refund_reason_txt=F.concat(F.lit("reason "), F.col("l_partkey") % 8),
               create_time=_clock(at)), at)


def _refund_payment(name: str, lines: DataFrame) -> DataFrame:
    at = _line_seconds() + 7200
    return _changes(
        lines.filter("l_returnflag = 'R'"), name, "update",
        _image(id=_detail_id(), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"),
               payment_type=1101 + F.col("l_suppkey") % 4, callback_time=_clock(at),
               total_amount=_line_price(),
               refund_status=F.when(F.col("l_linestatus") == "F", "0702").otherwise("0701")), at)


def _order_info(name: str, orders: DataFrame) -> DataFrame:
    key, flag = F.col("o_orderkey"), F.col("o_orderstatus")
    at, updated = _seconds("o_orderdate", "o_orderkey"), key % 3 != 0
    status = (F.when(flag == "O", "1001").when(flag == "F", "1003")
              .when(key % 4 < 2, "1005").otherwise("1006"))
    old = _image(order_status=F.when(updated & (key % 5 != 0), "1001"),
                 operate_time=F.when(updated & (key % 5 == 0), _clock(at)))
    return _changes(
        orders, name, F.when(updated, "update").otherwise("insert"),
        _image(id=key, user_id=F.col("o_custkey"), province_id=F.col("o_custkey") % 27,
               order_status=status, operate_time=F.when(updated, _clock(at + 600))),
        at, old)


def _payment_info(name: str, orders: DataFrame) -> DataFrame:
    key, user = F.col("o_orderkey"), F.col("o_custkey")
    at = _seconds("o_orderdate", "o_orderkey") + 900
    return _changes(
        orders, name, "update",
        _image(id=key, user_id=user, order_id=key, payment_type=1101 + user % 4,
               callback_time=_clock(at),
               payment_status=F.when(F.col("o_orderstatus") == "P", "1602").otherwise("1601")), at)


def _coupon_use(name: str, orders: DataFrame) -> DataFrame:
    key, at = F.col("o_orderkey"), _seconds("o_orderdate", "o_orderkey")
    step = key % 4
    status = F.when(step == 0, "1401").when(step == 2, "1403").otherwise("1402")
    old = _image(coupon_status=F.when(step == 1, "1401").when(step >= 2, "1402"))
    return _changes(
        orders, name, F.when(step == 0, "insert").otherwise("update"),
        _image(id=key, coupon_id=F.col("o_custkey") % 50, user_id=F.col("o_custkey"),
               order_id=key, get_time=_clock(at - 86400), using_time=F.when(step > 0, _clock(at)),
               used_time=F.when(step == 2, _clock(at + 900)), coupon_status=status), at, old)


def _event_seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def _cart_info(name: str, events: DataFrame) -> DataFrame:
    k, at, added = F.col("k"), _event_seconds(), F.col("event_id") % 3 == 0
    number = F.when(k % 25 == 24, "n/a").otherwise(_text(k))
    counted = F.col("event_id") % 4 != 0
    old = _image(sku_num=F.when(~added & counted, k * 7 % 100),
                 source_id=F.when(~added & ~counted, k))
    return _changes(
        events.filter("event_type = 'purchase'"), name,
        F.when(added, "insert").otherwise("update"),
        _image(id=F.col("event_id"), user_id=F.col("user_id"), sku_id=k * 3, source_id=k % 11,
               source_type=2401 + k % 5, sku_num=number), at, old)


def _favor_info(name: str, events: DataFrame) -> DataFrame:
    return _changes(events.filter("event_type = 'click'"), name, "insert",
                    _image(id=F.col("event_id"), user_id=F.col("user_id"), sku_id=F.col("k"),
                           create_time=_clock(_event_seconds())), _event_seconds())


def _comment_info(name: str, events: DataFrame) -> DataFrame:
    return _changes(events.filter("event_type = 'view'"), name, "insert",
                    _image(id=F.col("event_id"), user_id=F.col("user_id"), sku_id=F.col("k"),
                           order_id=F.col("event_id") * 2, create_time=_clock(_event_seconds()),
                           appraise=1201 + F.col("k") % 5), _event_seconds())


def _user_info(name: str, events: DataFrame) -> DataFrame:
    """A sign-up is a new user row, a purchase updates it."""
    signup = F.col("event_type") == "signup"
    return _changes(
        events.filter(F.col("event_type").isin("signup", "purchase")), name,
        F.when(signup, "insert").otherwise("update"),
        _image(id=F.col("user_id"), create_time=F.when(signup, _clock(_event_seconds())),
               last_event=F.col("event_id"), last_value=_money(F.col("value"))), _event_seconds())


def _sku_info(name: str, part: DataFrame) -> DataFrame:
    step = F.col("p_partkey") % 4
    kind = (F.when(step == 0, "insert").when(step == 1, "update")
            .when(step == 2, "bootstrap-insert").otherwise("delete"))
    return _changes(part, name, kind,
                    _image(id=F.col("p_partkey"), sku_name=F.col("p_name"), tm_id=F.col("p_brand"),
                           category3_id=F.col("p_type"), price=_money(F.col("p_retailprice"))),
                    FEED_START + F.col("p_partkey"))


def _base_province(name: str, nation: DataFrame) -> DataFrame:
    return _changes(nation, name, "bootstrap-insert",
                    _image(id=F.col("n_nationkey"), name=F.col("n_name"),
                           region_id=F.col("n_regionkey")), FEED_START + F.col("n_nationkey"))


# time stamp at which the bulk load of the dimension tables begins
FEED_START = 1_700_000_000

# change-log table: (test table it comes from, how)
LINE_TABLES = {"order_detail": ("lineitem", _order_detail),
               "order_detail_activity": ("lineitem", _order_detail_activity),
               "order_detail_coupon": ("lineitem", _order_detail_coupon),
               "order_refund_info": ("lineitem", _order_refund_info),
               "refund_payment": ("lineitem", _refund_payment)}
ORDER_TABLES = {"order_info": ("orders", _order_info), "payment_info": ("orders", _payment_info),
                "coupon_use": ("orders", _coupon_use)}
EVENT_TABLES = {"cart_info": ("events", _cart_info), "favor_info": ("events", _favor_info),
                "comment_info": ("events", _comment_info), "user_info": ("events", _user_info)}
DIMENSION_TABLES = {"sku_info": ("part", _sku_info), "base_province": ("nation", _base_province)}
MAKERS = {**LINE_TABLES, **ORDER_TABLES, **EVENT_TABLES, **DIMENSION_TABLES}

# tables a wide order row is put together from
ORDERING = ("order_detail", "order_info", "order_detail_activity", "order_detail_coupon")


def written_together(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ordering tables, payments and refund requests, as a shop writes them: an order and all that
    belongs to it at one moment, a minute after the order before it, its payment a quarter of an hour
    later, refund requests after an hour."""
    later = {"payment_info": 900, "order_refund_info": 3600}

    def key(name: str) -> Column:
        if name in ("order_info", "payment_info"):
            return F.col("data.id").cast("bigint")
        if name in ("order_detail", "order_refund_info"):
            return F.col("data.order_id").cast("bigint")
        return F.floor(F.col("data.order_detail_id").cast("bigint") / 10)

    def moved(name: str, rows: DataFrame) -> DataFrame:
        at = F.lit(FEED_START) + key(name) * 60 + later.get(name, 0)
        clocks = {"order_info": [("data", "operate_time", 600), ("old", "operate_time", 0)],
                  "order_detail": [("data", "create_time", 0)],
                  "payment_info": [("data", "callback_time", 0)],
                  "order_refund_info": [("data", "create_time", 0)]}
        out = rows.withColumn("_secs", at)
        for image, field, shift in clocks.get(name, []):
            now = F.when(F.col(f"{image}.{field}").isNotNull(), _clock(F.col("_secs") + shift))
            out = out.withColumn(image, F.col(image).withField(field, now))
        return out.withColumn("ts", _text(F.col("_secs"))).drop("_secs")

    return {name: moved(name, rows) for name, rows in tables.items()}


# --- dimensions --------------------------------------------------------------------------------

def dictionary(spark: SparkSession) -> DataFrame:
    rows = [{"dic_code": code, "dic_name": name, "parent_code": code[:2]}
            for code, name in DICTIONARY_NAMES.items()]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def routing(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(ROUTING.names, row)) for row in ROUTING_ROWS]
    fields = pa.schema([(name, pa.string()) for name in ROUTING.names])
    return spark.createDataFrame(pa.Table.from_pylist(rows, fields))


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(_text(F.col("n_nationkey")).alias("id"),
                                                 F.col("n_name").alias("name"))


def product_dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as skus, sizes as product lines, brands as trademarks, types as third category."""
    part = table(spark, sf_dir, "part")
    category3 = part.select(F.col("p_type").alias("id")).distinct()
    level2 = F.length("id")
    category2 = category3.select(level2.alias("n")).distinct()
    return {
        "sku": part.select(_text(F.col("p_partkey")).alias("id"), F.col("p_brand").alias("tm_id"),
                           F.col("p_type").alias("category3_id"),
                           _text(F.col("p_size")).alias("spu_id")),
        "spu": part.groupBy(_text(F.col("p_size")).alias("id")).agg(
            F.min("p_name").alias("spu_name")),
        "trademark": part.select(F.col("p_brand").alias("id")).distinct().select(
            "id", F.upper("id").alias("tm_name")),
        "category3": category3.select("id", F.lower("id").alias("name"),
                                      _text(level2).alias("category2_id")),
        "category2": category2.select(_text(F.col("n")).alias("id"),
                                      F.concat(F.lit("group "), F.col("n")).alias("name"),
                                      _text(F.col("n") % 2).alias("category1_id")),
        "category1": category2.select((F.col("n") % 2).alias("n")).distinct().select(
            _text(F.col("n")).alias("id"), F.concat(F.lit("class "), F.col("n")).alias("name")),
    }
