"""Summaries on streams. Each takes streams and gives a stream; sinks are the caller's choice.

A job with one stateful step is meant for update mode, where a late row refreshes its window and
the upsert sink replaces it. A job that chains a rule and a window runs in append mode: the window
comes out once, when the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart import schemas as S
from tidemart.functions.clock import day_of_ms, from_ms, from_ms_by_second, from_seconds_text
from tidemart.functions.numbers import MONEY, money
from tidemart.operators.lookups import enrich
from tidemart.operators.visits import BOUNCE_GAP_MS, RETURN_DAYS
from tidemart.operators.windows import SIZE, bounds, orders_and_amount, tumbling
from tidemart.plans import summaries
from tidemart.streaming import rules

AT = "_at"


def timed_by_ms(rows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return rows.withColumn(AT, from_ms(F.col("ts"))).withWatermark(AT, delay)


def timed_by_seconds(rows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return rows.withColumn(AT, from_seconds_text(F.col("ts"))).withWatermark(AT, delay)


def keyword_window(pages: DataFrame, size: str = SIZE, delay: str = "3 seconds",
                   source: str = S.SOURCE_SEARCH) -> DataFrame:
    found = summaries.keyword_rows(summaries.search_phrases(pages))
    rows = found.withColumn(AT, from_ms_by_second(F.col("ts"))).withWatermark(AT, delay)
    return (tumbling(rows, F.col(AT), ["keyword"], {"keyword_count": F.count("*")}, size)
            .withColumn("source", F.lit(source)))


def traffic_window(pages: DataFrame, bounced: DataFrame, visitors: DataFrame, size: str = SIZE,
                   gap_ms: int = BOUNCE_GAP_MS, lateness: str = "10 seconds") -> DataFrame:
    """Pages, bounces and daily visitors are three streams, as their own jobs wrote them."""
    rows = timed_by_ms(summaries.traffic_rows(pages, bounced, visitors, gap_ms), lateness)
    return tumbling(rows, F.col(AT), ["version", "channel", "area", "is_new"],
                    {name: F.sum(name) for name in summaries.MEASURES}, size)


def home_detail_window(pages: DataFrame, size: str = SIZE,
                       life_ms: int | None = None) -> DataFrame:
    firsts = rules.daily_page_visitors(timed_by_ms(pages), event_time=AT, life_ms=life_ms)
    return tumbling(firsts, F.col(AT), [], {
        "home_uv": F.count_if(F.col("page_id") == "home"),
        "detail_uv": F.count_if(F.col("page_id") == "good_detail")}, size)


def login_window(pages: DataFrame, size: str = SIZE, return_days: int = RETURN_DAYS,
                 life_ms: int | None = None) -> DataFrame:
    logins = rules.daily_logins(timed_by_ms(pages), return_days, event_time=AT, life_ms=life_ms)
    return tumbling(logins, F.col(AT), [],
                    {"back_ct": F.sum("back_ct"), "uu_ct": F.sum("uu_ct")}, size)


def register_window(registrations: DataFrame, size: str = SIZE) -> DataFrame:
    return tumbling(timed_by_seconds(registrations), F.col(AT), [],
                    {"register_ct": F.count("*")}, size)


def _ms(rows: DataFrame) -> Column:
    return rows["ts"].try_cast("bigint") * 1000


def cart_user_window(adds: DataFrame, size: str = SIZE, life_ms: int | None = None) -> DataFrame:
    rows = timed_by_seconds(adds.select("user_id", "ts"))
    firsts = rules.new_days(rows, {"_user": F.col("user_id")}, _ms(rows), (AT,), event_time=AT,
                            life_ms=life_ms)
    return tumbling(firsts, F.col(AT), [], {"cart_uu_ct": F.count("*")}, size)


def settled_details(details: DataFrame, key: str = "id", version: tuple[str, ...] = ("row_op_ts",),
                    hold_ms: int = 5_000, delay: str = "5 seconds") -> DataFrame:
    """One settled version of each detail on event time."""
    return rules.settled(timed_by_seconds(details, delay), key, version, hold_ms, AT).drop(AT)


def _marked(rows: DataFrame, day: Column) -> DataFrame:
    marks = rules.day_marks(rows.select("user_id", AT, day.alias("_of")), "user_id",
                            F.col("_of"), (AT,), event_time=AT)
    return marks.select(AT, F.lit(1).cast("bigint").alias("unique"),
                        F.when(F.col("_last").isNull(), 1).otherwise(0).cast("bigint").alias("new"))


def order_window(settled: DataFrame, size: str = SIZE) -> DataFrame:
    """Takes details already settled by `rules.settled`. Only first-of-day rows pass the state;
    amounts go straight to the window."""
    rows = timed_by_seconds(summaries.complete(settled))
    zero, none = F.lit(0).cast(MONEY), F.lit(0).cast("bigint")
    amounts = rows.select(AT, none.alias("unique"), none.alias("new"), *(
        F.coalesce(money(F.col(column)), zero).alias(name)
        for name, column in summaries.ORDER_AMOUNTS.items()))
    marks = _marked(rows, F.col("date_id").try_cast("date")).select(
        AT, "unique", "new", *(zero.alias(name) for name in summaries.ORDER_AMOUNTS))
    return tumbling(amounts.unionByName(marks), F.col(AT), [], {
        "unique_users": F.sum("unique"), "new_users": F.sum("new"),
        **{name: F.sum(name).cast("double") for name in summaries.ORDER_AMOUNTS}}, size)


def payment_window(settled: DataFrame, size: str = SIZE) -> DataFrame:
    rows = timed_by_seconds(settled)
    return tumbling(_marked(rows, day_of_ms(_ms(rows))), F.col(AT), [],
                    {"unique_users": F.sum("unique"), "new_users": F.sum("new")}, size)


def province_counts(settled: DataFrame, size: str = SIZE) -> DataFrame:
    rows = timed_by_seconds(summaries.complete(settled))
    return bounds(orders_and_amount(rows, F.col(AT), ["province_id"], "order_id",
                                    money(F.col("split_total_amount")), size))


def province_window(settled: DataFrame, provinces: DataFrame, size: str = SIZE) -> DataFrame:
    return summaries.province_names(province_counts(settled, size), provinces)


def user_spu_counts(settled: DataFrame, sku: DataFrame, size: str = SIZE) -> DataFrame:
    rows = enrich(timed_by_seconds(summaries.complete(settled)), sku, {"sku_id": "id"},
                  {"trademark_id": "tm_id", "category3_id": "category3_id", "spu_id": "spu_id"})
    return bounds(orders_and_amount(
        rows, F.col(AT), ["trademark_id", "category3_id", "user_id", "spu_id"], "order_id",
        money(F.col("split_total_amount")), size))


def user_spu_window(settled: DataFrame, dims: dict[str, DataFrame], size: str = SIZE) -> DataFrame:
    return summaries.user_spu_names(user_spu_counts(settled, dims["sku"], size), dims)


def brand_refund_counts(refunds: DataFrame, sku: DataFrame, size: str = SIZE) -> DataFrame:
    rows = enrich(timed_by_seconds(refunds), sku, {"sku_id": "id"},
                  {"trademark_id": "tm_id", "category3_id": "category3_id"})
    return bounds(orders_and_amount(rows, F.col(AT), ["trademark_id", "category3_id", "user_id"],
                                    "order_id", size=size, count_name="refund_count"))


def brand_refund_window(refunds: DataFrame, dims: dict[str, DataFrame], size: str = SIZE,
                        ) -> DataFrame:
    return summaries.brand_names(brand_refund_counts(refunds, dims["sku"], size), dims)
