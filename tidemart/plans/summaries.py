"""Windowed summaries in their batch form. Amounts are added as decimals and leave as doubles;
the processing time stamp of the sink row is added by the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart import schemas as S
from tidemart.functions.clock import day_of_ms, from_ms, from_ms_by_second, from_seconds_text
from tidemart.functions.numbers import MONEY, money
from tidemart.functions.words import words
from tidemart.operators.lookups import category_names, enrich
from tidemart.operators.versions import latest_per_key
from tidemart.operators.visits import (BOUNCE_GAP_MS, RETURN_DAYS, bounces, daily_logins,
                                       daily_page_visitors, daily_users, daily_visitors,
                                       user_period_measures)
from tidemart.operators.windows import (SIZE, bounds, orders_and_amount, per_window, tumbling)

VERSION = ("row_op_ts",)


def complete(details: DataFrame) -> DataFrame:
    """Details with a user and a source name."""
    return details.dropna(subset=["user_id", "source_type_name"])


def settled(details: DataFrame, key: str = "id", version: tuple[str, ...] = VERSION) -> DataFrame:
    """Latest version of each detail."""
    return latest_per_key(details, [key], version)


# --- traffic -----------------------------------------------------------------------------------

def search_phrases(pages: DataFrame) -> DataFrame:
    page = F.col("page")
    return pages.filter(page["item"].isNotNull() & (page["last_page_id"] == "search")
                        & (page["item_type"] == "keyword")).select(page["item"].alias("phrase"), "ts")


def keyword_rows(phrases: DataFrame) -> DataFrame:
    """One row per word; a phrase without words gives none."""
    return phrases.select(F.explode(words(F.col("phrase"))).alias("keyword"), "ts")


def keyword_window(pages: DataFrame, size: str = SIZE, source: str = S.SOURCE_SEARCH) -> DataFrame:
    rows = keyword_rows(search_phrases(pages))
    counted = tumbling(rows, from_ms_by_second(F.col("ts")), ["keyword"],
                       {"keyword_count": F.count("*")}, size)
    return counted.select("stt", "edt", F.lit(source).alias("source"), "keyword", "keyword_count")


MEASURES = ("uv", "sv", "pv", "duration_sum", "bounce")


def measured(rows: DataFrame, shift_ms: int = 0, **values) -> DataFrame:
    """Log rows as records of measures, zero where not given."""
    common = F.col("common")
    return rows.select(
        common["vc"].alias("version"), common["ch"].alias("channel"), common["ar"].alias("area"),
        common["is_new"].alias("is_new"),
        *(F.coalesce(values.get(name, F.lit(0)), F.lit(0)).cast("bigint").alias(name)
          for name in MEASURES),
        (F.col("ts") + shift_ms).alias("ts"))


def page_measures(pages: DataFrame) -> DataFrame:
    entry = F.when(F.col("page.last_page_id").isNull(), 1).otherwise(0)
    return measured(pages, sv=entry, pv=F.lit(1), duration_sum=F.col("page.during_time"))


def bounce_measures(bounced: DataFrame, gap_ms: int = BOUNCE_GAP_MS) -> DataFrame:
    """A bounce is known one gap after the page, and counted there."""
    return measured(bounced, shift_ms=gap_ms, bounce=F.lit(1))


def visitor_measures(visitors: DataFrame) -> DataFrame:
    return measured(visitors, uv=F.lit(1))


def traffic_rows(pages: DataFrame, bounced: DataFrame, visitors: DataFrame,
                 gap_ms: int = BOUNCE_GAP_MS) -> DataFrame:
    return (page_measures(pages).unionByName(bounce_measures(bounced, gap_ms))
            .unionByName(visitor_measures(visitors)))


def traffic_window(pages: DataFrame, size: str = SIZE, gap_ms: int = BOUNCE_GAP_MS,
                   piece_ms: int | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    rows = traffic_rows(pages, bounces(pages, gap_ms, piece_ms, order),
                        daily_visitors(pages, order), gap_ms)
    return tumbling(rows, from_ms(F.col("ts")), ["version", "channel", "area", "is_new"],
                    {name: F.sum(name) for name in MEASURES}, size)


def page_visitor_counts(firsts: DataFrame, size: str = SIZE) -> DataFrame:
    """Rows of `daily_page_visitors` per window."""
    return tumbling(firsts, from_ms(F.col("ts")), [], {
        "home_uv": F.count_if(F.col("page_id") == "home"),
        "detail_uv": F.count_if(F.col("page_id") == "good_detail")}, size)


def home_detail_window(pages: DataFrame, size: str = SIZE) -> DataFrame:
    return page_visitor_counts(daily_page_visitors(pages), size)


# --- users -------------------------------------------------------------------------------------

def login_counts(logins: DataFrame, size: str = SIZE) -> DataFrame:
    return tumbling(logins, from_ms(F.col("ts")), [],
                    {"back_ct": F.sum("back_ct"), "uu_ct": F.sum("uu_ct")}, size)


def login_window(pages: DataFrame, size: str = SIZE, return_days: int = RETURN_DAYS) -> DataFrame:
    return login_counts(daily_logins(pages, return_days), size)


def register_window(registrations: DataFrame, size: str = SIZE) -> DataFrame:
    return tumbling(registrations, from_seconds_text(F.col("ts")), [],
                    {"register_ct": F.count("*")}, size)


def _ms(rows: DataFrame) -> Column:
    return rows["ts"].try_cast("bigint") * 1000


def cart_user_window(adds: DataFrame, size: str = SIZE) -> DataFrame:
    firsts = daily_users(adds, "user_id", _ms(adds))
    return tumbling(firsts, from_ms(F.col("ts")), [], {"cart_uu_ct": F.count("*")}, size)


# --- trade -------------------------------------------------------------------------------------

ORDER_AMOUNTS = {"activity_reduce": "split_activity_amount", "coupon_reduce": "split_coupon_amount",
                 "original_total": "split_original_amount"}


def order_window(details: DataFrame, size: str = SIZE,
                 version: tuple[str, ...] = VERSION) -> DataFrame:
    """Users ordering today, users ordering for the first time, and order amounts."""
    rows = settled(complete(details), "id", version)
    zero = F.lit(0).cast(MONEY)
    sums = {name: F.sum(F.coalesce(money(F.col(column)), zero))
            for name, column in ORDER_AMOUNTS.items()}
    users = user_period_measures(rows, "user_id", F.col("date_id"),
                                 from_seconds_text(F.col("ts")), size, sums)
    return per_window(users, {
        "unique_users": F.sum("unique").cast("bigint"), "new_users": F.sum("new").cast("bigint"),
        **{name: F.sum(name).cast("double") for name in ORDER_AMOUNTS}})


def payment_window(payments: DataFrame, size: str = SIZE,
                   version: tuple[str, ...] = VERSION) -> DataFrame:
    rows = settled(payments, "order_detail_id", version)
    users = user_period_measures(rows, "user_id", day_of_ms(_ms(rows)),
                                 from_seconds_text(F.col("ts")), size, {})
    return per_window(users, {"unique_users": F.sum("unique").cast("bigint"),
                              "new_users": F.sum("new").cast("bigint")})


def province_window(details: DataFrame, provinces: DataFrame, size: str = SIZE,
                    version: tuple[str, ...] = VERSION) -> DataFrame:
    """Orders and amount per province; the name is looked up once per result row."""
    rows = settled(complete(details), "id", version)
    counted = bounds(orders_and_amount(rows, from_seconds_text(F.col("ts")), ["province_id"],
                                       "order_id", money(F.col("split_total_amount")), size))
    return province_names(counted, provinces)


def province_names(counted: DataFrame, provinces: DataFrame) -> DataFrame:
    named = enrich(counted, provinces, {"province_id": "id"}, {"province_name": "name"})
    return named.select("stt", "edt", "province_id",
                        F.coalesce("province_name", F.lit("")).alias("province_name"),
                        "order_count", "order_amount")


def user_spu_window(details: DataFrame, dims: dict[str, DataFrame], size: str = SIZE,
                    version: tuple[str, ...] = VERSION) -> DataFrame:
    """Orders and amount per user and product line, with brand and category names.

    `dims` holds sku, spu, trademark, category3, category2 and category1. The sku gives the
    grouping keys and is joined before, everything else after the aggregation.
    """
    rows = settled(complete(details), "id", version).select(
        "order_id", "user_id", "sku_id", "split_total_amount", "ts")
    rows = enrich(rows, dims["sku"], {"sku_id": "id"},
                  {"trademark_id": "tm_id", "category3_id": "category3_id", "spu_id": "spu_id"})
    counted = bounds(orders_and_amount(
        rows, from_seconds_text(F.col("ts")), ["trademark_id", "category3_id", "user_id", "spu_id"],
        "order_id", money(F.col("split_total_amount")), size))
    return user_spu_names(counted, dims)


def user_spu_names(counted: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    named = enrich(counted, dims["spu"], {"spu_id": "id"}, {"spu_name": "spu_name"})
    named = enrich(named, dims["trademark"], {"trademark_id": "id"}, {"trademark_name": "tm_name"})
    named = category_names(named, dims["category3"], dims["category2"], dims["category1"])
    return named.select(
        "stt", "edt", "trademark_id", "trademark_name", "category1_id", "category1_name",
        "category2_id", "category2_name", "category3_id", "category3_name", "user_id", "spu_id",
        "spu_name", "order_count", "order_amount")


def brand_refund_window(refunds: DataFrame, dims: dict[str, DataFrame], size: str = SIZE,
                        ) -> DataFrame:
    """Refunded orders per brand, category and user."""
    rows = enrich(refunds.select("order_id", "user_id", "sku_id", "ts"), dims["sku"],
                  {"sku_id": "id"}, {"trademark_id": "tm_id", "category3_id": "category3_id"})
    counted = bounds(orders_and_amount(
        rows, from_seconds_text(F.col("ts")), ["trademark_id", "category3_id", "user_id"],
        "order_id", size=size, count_name="refund_count"))
    return brand_names(counted, dims)


def brand_names(counted: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    named = enrich(counted, dims["trademark"], {"trademark_id": "id"},
                   {"trademark_name": "tm_name"})
    named = category_names(named, dims["category3"], dims["category2"], dims["category1"])
    return named.select(
        "stt", "edt", "trademark_id", "trademark_name", "category1_id", "category1_name",
        "category2_id", "category2_name", "category3_id", "category3_name", "user_id",
        "refund_count")
