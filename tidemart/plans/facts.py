"""Detail facts out of the change log. Every function takes and returns DataFrames, batch or
stream; on a stream `Bounds` says how long the sides of a join wait for each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.functions.clock import day_text, from_seconds_text
from tidemart.functions.numbers import product_text
from tidemart.operators.changes import (Log, became, changed, extract, grew, increase,
                                        moved)
from tidemart.operators.lookups import Dictionary, name_of
from tidemart import schemas as S


@dataclass(frozen=True)
class Bounds:
    """How long a stream join keeps rows, and how late they may come."""

    wait: str = "5 seconds"
    delay: str = "0 seconds"


PAYMENT_BOUNDS = Bounds(wait="905 seconds")


def _timed(rows: DataFrame, seconds: str, name: str, bounds: Bounds | None) -> DataFrame:
    """On a stream, event time and watermark for a join side."""
    if bounds is None or not rows.isStreaming:
        return rows
    return rows.withColumn(name, from_seconds_text(F.col(seconds))).withWatermark(name, bounds.delay)


def _near(left: DataFrame, right: DataFrame, left_at: str, right_at: str,
          bounds: Bounds | None) -> list[Column]:
    if bounds is None or not left.isStreaming:
        return []
    wait = F.expr(f"interval {bounds.wait}")
    return [right[right_at] >= left[left_at] - wait, right[right_at] <= left[left_at] + wait]


def cart_add(log: Log, dic: Dictionary) -> DataFrame:
    rows = extract(log, "cart_info", ["id", "user_id", "sku_id", "source_id", "source_type"],
                   where=grew("sku_num"), rename={"source_type": "source_type_code"},
                   extra={"sku_num": increase("sku_num"), "ts": F.col("ts")})
    return name_of(rows, dic, "source_type_code", "source_type_name").select(
        "id", "user_id", "sku_id", "source_id", "source_type_code", "source_type_name",
        "sku_num", "ts")


def order_wide(log: Log, dic: Dictionary, bounds: Bounds | None = None) -> DataFrame:
    """Order detail with its order, its optional activity and coupon, and the source name."""
    detail = extract(
        log, "order_detail",
        ["id", "order_id", "sku_id", "sku_name", "create_time", "source_id", "source_type",
         "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount"],
        types=["insert"],
        extra={"split_original_amount": product_text(F.col("data")["sku_num"],
                                                     F.col("data")["order_price"]),
               "od_ts": F.col("ts")})
    order = extract(log, "order_info",
                    ["id", "user_id", "province_id", "operate_time", "order_status"],
                    types=["insert", "update"], rename={"id": "oi_id"},
                    extra={"type": F.col("type"), "old": F.col("old"), "oi_ts": F.col("ts")})
    activity = extract(log, "order_detail_activity",
                       ["order_detail_id", "activity_id", "activity_rule_id"],
                       types=["insert"], rename={"order_detail_id": "act_id"},
                       extra={"act_ts": F.col("ts")})
    coupon = extract(log, "order_detail_coupon", ["order_detail_id", "coupon_id"],
                     types=["insert"], rename={"order_detail_id": "cou_id"},
                     extra={"cou_ts": F.col("ts")})

    # The dictionary is joined first: it drops details before they are shuffled for the joins.
    detail = name_of(detail, dic, "source_type", "source_type_name")
    detail = _timed(detail, "od_ts", "_od_at", bounds)
    order = _timed(order, "oi_ts", "_oi_at", bounds)
    activity = _timed(activity, "act_ts", "_act_at", bounds)
    coupon = _timed(coupon, "cou_ts", "_cou_at", bounds)

    rows = detail.join(order, [detail["order_id"] == order["oi_id"],
                               *_near(detail, order, "_od_at", "_oi_at", bounds)], "inner")
    if rows.isStreaming:
        rows = rows.join(activity, [rows["id"] == activity["act_id"],
                                    *_near(rows, activity, "_od_at", "_act_at", bounds)], "left")
        rows = rows.join(coupon, [rows["id"] == coupon["cou_id"],
                                  *_near(rows, coupon, "_od_at", "_cou_at", bounds)], "left")
    else:
        rows = _with_extras(rows, detail, activity, coupon)
    return rows.select(
        "id", "order_id", "user_id", "order_status", "sku_id", "sku_name", "province_id",
        "activity_id", "activity_rule_id", "coupon_id",
        day_text(F.col("create_time")).alias("date_id"), "create_time",
        day_text(F.col("operate_time")).alias("operate_date_id"), "operate_time",
        "source_id", "source_type", "source_type_name", "sku_num", "split_original_amount",
        "split_activity_amount", "split_coupon_amount", "split_total_amount",
        "type", "old", "od_ts", "oi_ts", F.current_timestamp().alias("row_op_ts"))


def _with_extras(rows: DataFrame, detail: DataFrame, activity: DataFrame, coupon: DataFrame) -> DataFrame:
    """The activity and coupon of details, joined by the order the wide rows already lie by. Pairs of a
    detail's and its order's key go to the extras, so the wide rows are not shuffled again."""
    keys = detail.select(F.col("id").alias("_id"), F.col("order_id").alias("_order")).repartition(
        "_id").distinct()
    act = activity.join(keys, activity["act_id"] == keys["_id"], "inner").select(
        *activity.columns, F.col("_order").alias("_act_order"))
    cou = coupon.join(keys, coupon["cou_id"] == keys["_id"], "inner").select(
        *coupon.columns, F.col("_order").alias("_cou_order"))
    rows = rows.join(act, [rows["order_id"] == act["_act_order"], rows["id"] == act["act_id"]], "left")
    return rows.join(cou, [rows["order_id"] == cou["_cou_order"], rows["id"] == cou["cou_id"]], "left")


#: Source tables of a wide order row.
ORDER_TABLES = ("order_detail", "order_info", "order_detail_activity", "order_detail_coupon")

_DETAIL_HEAD = ["id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id",
                "activity_rule_id", "coupon_id"]
_DETAIL_AMOUNTS = ["split_original_amount", "split_activity_amount", "split_coupon_amount",
                   "split_total_amount"]


def order_detail(wide: DataFrame) -> DataFrame:
    """Details of newly placed orders."""
    return wide.filter(F.col("type") == "insert").select(
        *_DETAIL_HEAD, "date_id", "create_time", "source_id",
        F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num",
        *_DETAIL_AMOUNTS, F.col("od_ts").alias("ts"), "row_op_ts")


def order_cancel(wide: DataFrame) -> DataFrame:
    """Details of orders that have just turned cancelled."""
    turned = (F.col("type") == "update") & changed("order_status")
    return wide.filter(turned & (F.col("order_status") == S.ORDER_CANCELLED)).select(
        *_DETAIL_HEAD, F.col("operate_date_id").alias("date_id"),
        F.col("operate_time").alias("cancel_time"), "source_id",
        F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num",
        *_DETAIL_AMOUNTS, F.col("oi_ts").alias("ts"), "row_op_ts")


def payment_success(log: Log, details: DataFrame, dic: Dictionary,
                    bounds: Bounds | None = None) -> DataFrame:
    """Successful payments spread over the details of their order."""
    paid = extract(log, "payment_info", ["order_id", "payment_type", "callback_time"],
                   types=["update"], where=F.col("data")["payment_status"] == S.PAYMENT_OK,
                   rename={"order_id": "pay_order_id", "payment_type": "payment_type_code"},
                   extra={"ts": F.col("ts")})
    paid = _timed(name_of(paid, dic, "payment_type_code", "payment_type_name"),
                  "ts", "_pay_at", bounds)
    details = _timed(details.withColumnRenamed("ts", "_detail_ts"), "_detail_ts", "_od_at", bounds)
    rows = paid.join(details, [paid["pay_order_id"] == details["order_id"],
                               *_near(paid, details, "_pay_at", "_od_at", bounds)], "inner")
    return rows.select(
        F.col("id").alias("order_detail_id"), *_DETAIL_HEAD[1:], "payment_type_code",
        "payment_type_name", "callback_time", "source_id", "source_type_code",
        "source_type_name", "sku_num", "split_original_amount", "split_activity_amount",
        "split_coupon_amount", F.col("split_total_amount").alias("split_payment_amount"),
        "ts", "row_op_ts")


def refund_request(log: Log, dic: Dictionary, bounds: Bounds | None = None) -> DataFrame:
    """Refund requests of orders that have just turned to refunding."""
    refund = extract(
        log, "order_refund_info",
        ["id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount",
         "refund_reason_type", "refund_reason_txt", "create_time"], types=["insert"],
        rename={"refund_type": "refund_type_code",
                "refund_reason_type": "refund_reason_type_code"},
        extra={"ts": F.col("ts")})
    order = extract(log, "order_info", ["id", "province_id"], types=["update"],
                    where=became("order_status", S.ORDER_REFUNDING), rename={"id": "oi_id"},
                    extra={"oi_ts": F.col("ts")})
    refund = name_of(refund, dic, "refund_type_code", "refund_type_name")
    refund = name_of(refund, dic, "refund_reason_type_code", "refund_reason_type_name")
    refund, order = _timed(refund, "ts", "_at", bounds), _timed(order, "oi_ts", "_oi_at", bounds)
    rows = refund.join(order, [refund["order_id"] == order["oi_id"],
                               *_near(refund, order, "_at", "_oi_at", bounds)], "inner")
    return rows.select(
        "id", "user_id", "order_id", "sku_id", "province_id",
        day_text(F.col("create_time")).alias("date_id"), "create_time", "refund_type_code",
        "refund_type_name", "refund_reason_type_code", "refund_reason_type_name",
        "refund_reason_txt", "refund_num", "refund_amount", "ts",
        F.current_timestamp().alias("row_op_ts"))


def refund_paid(log: Log, dic: Dictionary, bounds: Bounds | None = None) -> DataFrame:
    """Completed refund payments, with their order and the refunded item."""
    paid = extract(log, "refund_payment",
                   ["id", "order_id", "sku_id", "payment_type", "callback_time", "total_amount"],
                   where=F.col("data")["refund_status"] == S.REFUND_OK,
                   rename={"payment_type": "payment_type_code", "total_amount": "refund_amount"},
                   extra={"ts": F.col("ts")})
    order = extract(log, "order_info", ["id", "user_id", "province_id"], types=["update"],
                    where=became("order_status", S.ORDER_REFUNDED), rename={"id": "oi_id"},
                    extra={"oi_ts": F.col("ts")})
    item = extract(log, "order_refund_info", ["order_id", "sku_id", "refund_num"],
                   rename={"order_id": "ri_order_id", "sku_id": "ri_sku_id"},
                   extra={"ri_ts": F.col("ts")})
    paid = name_of(paid, dic, "payment_type_code", "payment_type_name")
    paid, order = _timed(paid, "ts", "_at", bounds), _timed(order, "oi_ts", "_oi_at", bounds)
    item = _timed(item, "ri_ts", "_ri_at", bounds)
    rows = paid.join(order, [paid["order_id"] == order["oi_id"],
                             *_near(paid, order, "_at", "_oi_at", bounds)], "inner")
    rows = rows.join(item, [rows["order_id"] == item["ri_order_id"],
                            rows["sku_id"] == item["ri_sku_id"],
                            *_near(rows, item, "_at", "_ri_at", bounds)], "inner")
    return rows.select(
        "id", "user_id", "order_id", "sku_id", "province_id", "payment_type_code",
        "payment_type_name", day_text(F.col("callback_time")).alias("date_id"), "callback_time",
        "refund_num", "refund_amount", "ts", F.current_timestamp().alias("row_op_ts"))


def _coupon(log: Log, time: str, types: list[str], where: Column | None,
            name: str | None = None, order: bool = True) -> DataFrame:
    when = F.col("data")[time]
    return extract(log, "coupon_use",
                   ["id", "coupon_id", "user_id", *(["order_id"] if order else [])],
                   types=types, where=where,
                   extra={"date_id": day_text(when), name or time: when, "ts": F.col("ts")})


def coupon_get(log: Log) -> DataFrame:
    return _coupon(log, "get_time", ["insert"], None, order=False)


def coupon_order(log: Log) -> DataFrame:
    """Coupons that went from unused to in use."""
    return _coupon(log, "using_time", ["update"],
                   moved("coupon_status", S.COUPON_UNUSED, S.COUPON_USING), "order_time")


def coupon_pay(log: Log) -> DataFrame:
    """Coupons with a time of use."""
    return _coupon(log, "used_time", ["update"], F.col("data")["used_time"].isNotNull(),
                   "payment_time")


def favor_add(log: Log) -> DataFrame:
    made = F.col("data")["create_time"]
    return extract(log, "favor_info", ["id", "user_id", "sku_id"], types=["insert"],
                   extra={"date_id": day_text(made), "create_time": made, "ts": F.col("ts")})


def comments(log: Log) -> DataFrame:
    made = F.col("data")["create_time"]
    return extract(log, "comment_info", ["id", "user_id", "sku_id", "order_id", "appraise"],
                   types=["insert"], rename={"appraise": "appraise_code"},
                   extra={"date_id": day_text(made), "create_time": made, "ts": F.col("ts")})


def comment_add(log: Log, dic: Dictionary) -> DataFrame:
    return name_of(comments(log), dic, "appraise_code", "appraise_name").select(
        "id", "user_id", "sku_id", "order_id", "date_id", "create_time", "appraise_code",
        "appraise_name", "ts")


def user_register(log: Log) -> DataFrame:
    made = F.col("data")["create_time"]
    return extract(log, "user_info", ["id"], types=["insert"], rename={"id": "user_id"},
                   extra={"date_id": day_text(made), "create_time": made, "ts": F.col("ts")})
