"""Visitor and user rules over ordered rows, in their batch form.

None of them sorts all rows of one visitor in one task: rules about the first row of a day are
aggregations, and the neighbour rule works on pieces of bounded time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemart.functions.clock import day_of_ms
from tidemart.operators.versions import first_per_key

BOUNCE_GAP_MS = 10_000
RETURN_DAYS = 8


def inner_pages(pages: DataFrame) -> DataFrame:
    """Pages reached from another page; the daily visitor rule looks at these only."""
    return pages.filter(F.col("page.last_page_id").isNotNull())


def daily_visitors(pages: DataFrame, order: Sequence[str] = ("ts",),
                   where: Column | None = None) -> DataFrame:
    """First inner page of every visitor and day; `where` replaces the choice of pages."""
    rows = inner_pages(pages) if where is None else pages.filter(where)
    return first_per_key(rows, ["common.mid", day_of_ms(F.col("ts"))], list(order))


def daily_page_visitors(pages: DataFrame, page_ids: Sequence[str] = ("home", "good_detail"),
                        ) -> DataFrame:
    """Time of the first visit per visitor, page and day, for the pages named."""
    return (pages.filter(F.col("page.page_id").isin(*page_ids))
            .groupBy(F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"),
                     day_of_ms(F.col("ts")).alias("day"))
            .agg(F.min("ts").alias("ts")))


def daily_users(rows: DataFrame, user: str, ms: Column) -> DataFrame:
    """Time (epoch ms) of the first row per user and day."""
    return (rows.groupBy(F.col(user).alias("user_id"), day_of_ms(ms).alias("day"))
            .agg(F.min(ms).alias("ts")))


def login_pages(pages: DataFrame) -> DataFrame:
    """Logged-in pages that open a session or come from the login page."""
    last = F.col("page.last_page_id")
    return pages.filter(F.col("common.uid").isNotNull() & (last.isNull() | (last == "login")))


def daily_logins(pages: DataFrame, return_days: int = RETURN_DAYS) -> DataFrame:
    """One row per user and login day with `uu_ct = 1`, and `back_ct = 1` when at least
    `return_days` days have passed since the login day before it.

    Rows meet per user only after they have been reduced to one per day.
    """
    days = daily_users(login_pages(pages).withColumn("_uid", F.col("common.uid")), "_uid",
                       F.col("ts"))
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))
    gap = F.datediff("day", before)
    return days.select(
        "user_id", "ts", F.lit(1).cast("bigint").alias("uu_ct"),
        F.when(gap >= return_days, 1).otherwise(0).cast("bigint").alias("back_ct"))


def user_period_measures(rows: DataFrame, user: str, day: Column, at: Column, size: str,
                         measures: Mapping[str, Column]) -> DataFrame:
    """Sums per user and window, with marks for the user's first window of a day (`unique`) and
    first window at all (`new`).

    A window lies within one day, so the first row of a day is in the first window of that day.
    Rows are summed to (user, window) first; what meets per user is one row per window.
    """
    periods = (rows.groupBy(F.col(user).alias("_user"), day.alias("_day"),
                            F.window(at, size).alias("window"))
               .agg(F.lit(1).alias("_seen"),
                    *(value.alias(name) for name, value in measures.items())))
    before = F.lag("_day").over(Window.partitionBy("_user").orderBy("window.start", "_day"))
    return periods.select(
        "window", *measures,
        F.when(before.isNull() | (before != F.col("_day")), 1).otherwise(0).alias("unique"),
        F.when(before.isNull(), 1).otherwise(0).alias("new"))


def with_overlap(pages: DataFrame, gap_ms: int, piece_ms: int) -> DataFrame:
    """Cut time into pieces and copy rows from the first `gap_ms` of a piece into the piece
    before, so that each piece sees everything that can follow its own rows within the gap.
    Adds `_piece` and `_copied`. Rows without a time follow nothing and are left out."""
    if piece_ms < gap_ms:
        raise ValueError("a piece must be at least as long as the gap")
    piece = F.floor(F.col("ts") / F.lit(piece_ms))
    early = F.col("ts") - piece * F.lit(piece_ms) < gap_ms
    places = F.when(early, F.array(piece, piece - 1)).otherwise(F.array(piece))
    return (pages.filter(F.col("ts").isNotNull()).withColumn("_piece", F.explode(places))
            .withColumn("_copied", F.col("_piece") != piece))


def bounces(pages: DataFrame, gap_ms: int = BOUNCE_GAP_MS, piece_ms: int | None = None,
            order: Sequence[str] = ("ts",)) -> DataFrame:
    """Entry pages whose visitor opened nothing within the gap, or opened another entry page.

    A visitor's rows are sorted per piece of time (60 gaps by default), not as a whole.
    """
    rows = with_overlap(pages, gap_ms, piece_ms or 60 * gap_ms)
    span = Window.partitionBy("common.mid", "_piece").orderBy(*order)
    entry = F.col("page.last_page_id").isNull()
    return (rows.withColumn("_next_ts", F.lead("ts").over(span))
            .withColumn("_next_entry", F.lead(entry).over(span))
            .filter(~F.col("_copied") & entry
                    & (F.col("_next_ts").isNull() | F.col("_next_entry")
                       | (F.col("_next_ts") - F.col("ts") >= gap_ms)))
            .drop("_piece", "_copied", "_next_ts", "_next_entry"))


__all__ = ["BOUNCE_GAP_MS", "RETURN_DAYS", "bounces", "daily_logins",
           "daily_page_visitors", "daily_users", "daily_visitors", "inner_pages", "login_pages",
           "user_period_measures", "with_overlap"]
