"""Input schemas and code values."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())

# One row of the database change log.
ENVELOPE = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", TEXT_MAP),
    T.StructField("old", TEXT_MAP),
    T.StructField("ts", T.StringType()),
])

COMMON = T.StructType([
    T.StructField(name, T.StringType()) for name in ("mid", "uid", "is_new", "vc", "ch", "ar")
])

PAGE = T.StructType([
    T.StructField("page_id", T.StringType()),
    T.StructField("last_page_id", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("during_time", T.LongType()),
])

# One row of the user-behaviour log. Displays, actions, start and err are opaque to the mart,
# so they stay maps and no key is lost on the way through.
BEHAVIOUR = T.StructType([
    T.StructField("common", COMMON),
    T.StructField("page", PAGE),
    T.StructField("displays", T.ArrayType(TEXT_MAP)),
    T.StructField("actions", T.ArrayType(TEXT_MAP)),
    T.StructField("start", TEXT_MAP),
    T.StructField("err", TEXT_MAP),
    T.StructField("ts", T.LongType()),
])

# The page log seen as a table of maps.
PAGE_TABLE = T.StructType([
    T.StructField("common", TEXT_MAP),
    T.StructField("page", TEXT_MAP),
    T.StructField("ts", T.LongType()),
])

ROUTING = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend")
])

DICTIONARY = T.StructType([
    T.StructField("dic_code", T.StringType()),
    T.StructField("dic_name", T.StringType()),
    T.StructField("parent_code", T.StringType()),
    T.StructField("create_time", T.TimestampType()),
    T.StructField("operate_time", T.TimestampType()),
])

WIDE_ORDER = T.StructType([
    *(T.StructField(name, T.StringType()) for name in (
        "id", "order_id", "user_id", "order_status", "sku_id", "sku_name", "province_id",
        "activity_id", "activity_rule_id", "coupon_id", "date_id", "create_time",
        "operate_date_id", "operate_time", "source_id", "source_type", "source_type_name",
        "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount",
        "split_total_amount", "type")),
    T.StructField("old", TEXT_MAP),
    T.StructField("od_ts", T.StringType()),
    T.StructField("oi_ts", T.StringType()),
    T.StructField("row_op_ts", T.TimestampType()),
])

# Codes the feeds carry.
ORDER_UNPAID, ORDER_PAID, ORDER_CANCELLED = "1001", "1002", "1003"
ORDER_FINISHED, ORDER_REFUNDING, ORDER_REFUNDED = "1004", "1005", "1006"
COUPON_UNUSED, COUPON_USING, COUPON_USED = "1401", "1402", "1403"
PAYMENT_OK = "1602"
REFUND_OK = "0702"
SOURCE_SEARCH, SOURCE_CLICK, SOURCE_CART, SOURCE_ORDER = "SEARCH", "CLICK", "CART", "ORDER"

# Dictionary entries, code to name.
DICTIONARY_NAMES = {
    "1001": "unpaid", "1002": "paid", "1003": "cancelled",
    "1004": "finished", "1005": "refunding", "1006": "refunded",
    "1101": "alipay", "1102": "wechat", "1103": "unionpay",
    "1201": "good", "1202": "medium", "1203": "bad", "1204": "automatic",
    "1301": "quality problem", "1302": "not as described", "1303": "out of stock",
    "1304": "wrong size", "1305": "ordered by mistake", "1306": "not wanted any more",
    "1307": "other",
    "1401": "unused", "1402": "in use", "1403": "used",
    "1501": "money only", "1502": "goods and money",
    "2401": "user query", "2402": "promotion", "2403": "recommendation", "2404": "activity",
}
