"""Visitor and user rules on streams: small state per key or, where every row passes a rule, per
bucket of keys (`buckets`); one processor per rule.

What a rule keeps is one day, one row or one flag per key. Where only the first or last row of a
key can matter, `first_of_batch` cuts every Arrow batch down before the shuffle, so that a key
with very many rows does not send them all to one task. Rows of one micro-batch arrive in no
order; each processor sorts the few rows it gets by `order`. How many rows a micro-batch holds is
bounded by the source (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`).

State can have a life. A rule that feeds a window forgets a key once the watermark is a life past the
key's last row, by a timer; other rules leave it to the state store, in processing time. A key that
comes back later starts anew. Without a life, state is kept for ever.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemart.functions.clock import day_of_ms, from_ms
from tidemart.operators.logs import first_day_of, repaired
from tidemart.operators.visits import (BOUNCE_GAP_MS, RETURN_DAYS, inner_pages, login_pages,
                                       with_overlap)
from tidemart.streaming import buckets

# The rules travel to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DAY = T.StructType([T.StructField("day", T.DateType())])
#: The column of a row's time in milliseconds that timers go by.
LIFE = "_life_ms"


def first_of_batch(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                   descending: bool = False) -> DataFrame:
    """Keep the first row per key of every Arrow batch: a combine step ahead of the shuffle, not a
    full deduplication. `keys` and `order` are top-level columns. Descending, the last row of equal
    ones is kept, and `_arrival` tells the places of rows within their micro-batch."""
    direction = "descending" if descending else "ascending"
    by = [(name, "ascending") for name in keys] + [(name, direction) for name in order]
    schema = _plus(rows.schema, "_arrival", T.LongType()) if descending else rows.schema
    if descending:
        by.append(("_arrival", direction))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            if descending:
                places = pa.array(range(seen, seen + batch.num_rows), pa.int64())
                seen += batch.num_rows
                batch = batch.append_column("_arrival", places)
            if batch.num_rows < 2:
                yield batch
                continue
            place = pc.sort_indices(batch.select([name for name, _ in by]), sort_keys=by)
            ordered = batch.take(place)
            fresh = None
            for name in keys:
                column = ordered.column(name)
                now, before = column.slice(1), column.slice(0, len(column) - 1)
                other = pc.fill_null(pc.not_equal(now, before),
                                     True) if column.null_count else pc.not_equal(now, before)
                fresh = other if fresh is None else pc.or_(fresh, other)
            yield ordered.filter(pa.concat_arrays([pa.array([True]), fresh]))

    return rows.mapInArrow(cut, schema)


@dataclass(frozen=True)
class Life:
    """How long a key's state is kept: for ever, or so many milliseconds."""

    ms: int | None = None
    event_time: bool = False

    @property
    def by_watermark(self) -> bool:
        return self.event_time and self.ms is not None

    def modes(self, event_time: str | None) -> dict[str, str]:
        """A rule that feeds a window keeps the event time of its rows as the window's watermark."""
        if event_time:
            return {"time_mode": "EventTime", "event_time": event_time}
        return {"time_mode": "ProcessingTime"} if self.ms is not None else {}


class _Rule(StatefulProcessor):
    """A rule with one value of state; `order` names the columns that order a key's rows and
    `schema` the rows passed on."""

    state_schema = _DAY

    def __init__(self, order: Sequence[str], schema: T.StructType, life: Life | None = None):
        self.order = list(order)
        self.make = Row(*schema.names)
        self.life = life or Life()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema,
                                          None if self.life.by_watermark else self.life.ms)

    def known(self, timerValues):
        """The key's state, unless its life is over: rows come to a rule ahead of expired timers."""
        known = self.state.get()
        if known is not None and self.life.by_watermark:
            passed = timerValues.getCurrentWatermarkInMs()
            if any(timer <= passed for timer in self.handle.listTimers()):
                self.state.clear()
                return None
        return known

    def renew(self, rows: list[Row]) -> None:
        """The key lives on from its last row. A key has one timer."""
        times = [row[LIFE] for row in rows if row[LIFE] is not None] if (
            self.life.by_watermark) else []
        if times:
            end = max(times) + self.life.ms
            for timer in list(self.handle.listTimers()):
                end = max(end, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def sorted(self, rows: Iterator[Row]) -> list[Row]:
        """Nulls first, as a batch sort has them."""
        return sorted(rows, key=lambda row: tuple((row[name] is not None, row[name])
                                                  for name in self.order))

    def close(self) -> None:
        pass


class NewDay(_Rule):
    """Passes a row when its day differs from the day of the last row passed."""

    def handleInputRows(self, key, rows, timerValues):
        known = self.known(timerValues)
        last = known[0] if known else None
        rows = self.sorted(rows)
        for row in rows:
            if row["_day"] != last:
                last = row["_day"]
                yield row
        self.state.update((last,))
        self.renew(rows)


class DayMarks(_Rule):
    """Passes rows of a new day with the day of the row before them, null for the very first."""

    def handleInputRows(self, key, rows, timerValues):
        known = self.known(timerValues)
        last = known[0] if known else None
        rows = self.sorted(rows)
        for row in rows:
            if row["_day"] != last:
                yield self.make(*row, last)
                last = row["_day"]
        self.state.update((last,))
        self.renew(rows)


class HoldLatest(_Rule):
    """Holds a key's newest row for a while after its first one, then passes it and forgets the
    key. Of equal versions the later arrival wins: a later micro-batch, and within one the row
    with the larger `_arrival`. The hold is a time of processing, or runs from the first row's own
    time to the watermark."""

    def __init__(self, order: Sequence[str], schema: T.StructType, hold_ms: int,
                 by_watermark: bool = False):
        super().__init__(order, schema)
        self.state_schema, self.hold_ms, self.by_watermark = schema, hold_ms, by_watermark

    def handleInputRows(self, key, rows, timerValues):
        rows = list(rows)
        newest = max(rows, key=lambda row: (self._version(row), row["_arrival"]))
        held = self.state.get()
        if held is None:
            start = (min(row[LIFE] for row in rows) if self.by_watermark
                     else timerValues.getCurrentProcessingTimeInMs())
            self.handle.registerTimer(start + self.hold_ms)
            self.state.update(tuple(newest))
        else:
            held = self.make(*held)
            if self._version(newest) >= self._version(held):
                self.state.update(tuple(newest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get()
        self.state.clear()
        if held is not None:
            yield self.make(*held)

    def _version(self, row: Row) -> tuple:
        return tuple((row[name] is not None, row[name]) for name in self.order)


def _apply(rows: DataFrame, keys: Sequence[str], rule: _Rule, schema: T.StructType, *,
           time_mode: str = "None", event_time: str = "") -> DataFrame:
    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=rule, outputStructType=schema, outputMode="Append", timeMode=time_mode,
        eventTimeColumnName=event_time)


def _plus(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def repair_new_visitors(log: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    rows = buckets.packed(log, ["common.mid"], log.columns, **{
        buckets.ORDER: buckets.order_text(log.schema, order),
        "own_first": F.unix_date(first_day_of(F.col("common.is_new"), F.col("ts")))})
    known = buckets.applied(rows, buckets.FirstDay(), f"{buckets.ROW} string, first_day int")
    fixed = repaired(F.col("common.is_new"), F.col("ts"), F.date_from_unix_date("first_day"))
    return (buckets.unpacked(known, log.schema, "first_day")
            .withColumn("common", F.col("common").withField("is_new", fixed)).drop("first_day"))


def new_days(rows: DataFrame, keys: dict[str, Column], ms: Column, order: Sequence[str] = ("ts",),
             event_time: str | None = None, life_ms: int | None = None) -> DataFrame:
    """First row of each key and day, in arrival order of days. A life without event time runs on the
    clock, so such a query needs a trigger interval."""
    keyed = rows.withColumns({**keys, "_day": day_of_ms(ms), LIFE: ms})
    keyed = first_of_batch(keyed, [*keys, "_day"], order)
    life = Life(life_ms, event_time is not None)
    return _apply(keyed, list(keys), NewDay(order, keyed.schema, life), keyed.schema,
                  **life.modes(event_time)).drop(LIFE)


def daily_visitors(pages: DataFrame, order: Sequence[str] = ("ts",),
                   life_ms: int | None = None) -> DataFrame:
    return new_days(inner_pages(pages), {"_mid": F.col("common.mid")}, F.col("ts"),
                    order, life_ms=life_ms).drop("_mid", "_day")


def daily_page_visitors(pages: DataFrame, page_ids: Sequence[str] = ("home", "good_detail"),
                        event_time: str | None = None, life_ms: int | None = None) -> DataFrame:
    """As for daily visitors, per page; needs the event-time column when a window follows."""
    keep = [event_time] if event_time else []
    rows = pages.filter(F.col("page.page_id").isin(*page_ids)).select(
        F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"), "ts", *keep)
    return new_days(rows, {"_mid": F.col("mid"), "_page": F.col("page_id")}, F.col("ts"),
                    event_time=event_time, life_ms=life_ms).drop("_mid", "_page", "_day")


def day_marks(rows: DataFrame, user: str, day: Column, order: Sequence[str] = ("ts",),
              event_time: str | None = None, life_ms: int | None = None) -> DataFrame:
    """First row of each user and day with `_last`, the user's day before it. A life bounds how long
    a user is known: after it a day counts as the user's first."""
    life = Life(life_ms, event_time is not None)
    at = F.unix_millis(F.col(event_time)) if event_time else F.lit(None).cast("bigint")
    keyed = rows.withColumns({"_user": F.col(user), "_day": day, LIFE: at})
    keyed = first_of_batch(keyed, ["_user", "_day"], order)
    if event_time and life_ms is None and list(order) == [event_time]:
        fields = [name for name in keyed.columns if name not in (LIFE, event_time)]
        packed = buckets.packed(keyed, ["_user"], fields, **{
            event_time: F.col(event_time), buckets.MICROS: F.unix_micros(event_time),
            "day": F.coalesce(F.unix_date("_day").cast("bigint"), F.lit(buckets.NO_DAY))})
        marked = buckets.applied(packed, buckets.DayMarks(), f"{buckets.ROW} string, last_day bigint, at timestamp",
                                 "EventTime", "at")
        last = F.when(F.col("last_day") != buckets.NO_DAY, F.date_from_unix_date(F.col("last_day").cast("int")))
        return buckets.unpacked(marked.withColumnRenamed("at", event_time), keyed.select(*fields).schema,
                                event_time, "last_day").withColumn("_last", last).select(
            *(name for name in keyed.columns if name != LIFE), "_last")
    schema = _plus(keyed.schema, "_last", T.DateType())
    return _apply(keyed, ["_user"], DayMarks(order, schema, life), schema,
                  **life.modes(event_time)).drop(LIFE)


def daily_logins(pages: DataFrame, return_days: int = RETURN_DAYS,
                 event_time: str | None = None, life_ms: int | None = None) -> DataFrame:
    keep = [event_time] if event_time else []
    rows = login_pages(pages).select(F.col("common.uid").alias("user_id"), "ts", *keep)
    marked = day_marks(rows, "user_id", day_of_ms(F.col("ts")), event_time=event_time,
                       life_ms=life_ms)
    back = F.datediff("_day", "_last") >= return_days
    return marked.select("user_id", "ts", *keep, F.lit(1).cast("bigint").alias("uu_ct"),
                         F.when(back, 1).otherwise(0).cast("bigint").alias("back_ct"))


def settled(details: DataFrame, key: str = "id", version: Sequence[str] = ("row_op_ts",),
            hold_ms: int = 5_000, event_time: str | None = None) -> DataFrame:
    """Newest version of each detail, passed `hold_ms` of processing time after its first one. With
    an event time (a column with a watermark) the hold runs from the first version's time until the
    watermark has passed its end: results then don't depend on when the query runs, it ends with its
    input, and versions within the watermark's delay may come in any order.
    The result has no watermark: write it to a table and start the next job from there. What one
    micro-batch passes is never older than what the micro-batches before it passed."""
    if event_time:
        details = details.withColumn(LIFE, F.unix_millis(F.col(event_time))).filter(
            F.col(LIFE).isNotNull())
    cut = first_of_batch(details, [key], version, descending=True)
    if event_time and buckets.sortable(cut.schema, version):
        fields = [name for name in details.columns if name != LIFE]
        rows = buckets.packed(
            cut, [key], fields, **{event_time: F.col(event_time), buckets.MS: F.col(LIFE),
                                   buckets.ORDER: buckets.order_text(cut.schema, version),
                                   "arrival": F.col("_arrival")})
        held = buckets.applied(rows, buckets.HoldLatest(hold_ms), f"{buckets.ROW} string", "EventTime")
        return buckets.unpacked(held, details.select(*fields).schema)
    held = HoldLatest(version, cut.schema, hold_ms, event_time is not None)
    return _apply(cut, [key], held, cut.schema, time_mode=(
        "EventTime" if event_time else "ProcessingTime")).drop("_arrival", LIFE)


def bounces(pages: DataFrame, gap_ms: int = BOUNCE_GAP_MS, piece_ms: int | None = None,
            order: Sequence[str] = ("ts",), delay: str = "2 seconds") -> DataFrame:
    """Entry pages nothing followed, per visitor and piece of time as in the batch form."""
    rows = with_overlap(pages, gap_ms, piece_ms or 60 * gap_ms).withColumn(
        "_at", from_ms(F.col("ts"))).withWatermark("_at", delay)
    waiting = buckets.packed(rows, ["common.mid", "_piece"], pages.columns, **{
        "_at": F.col("_at"), buckets.MS: F.col("ts"),
        buckets.ORDER: buckets.order_text(rows.schema, order),
        "entry": F.col("page.last_page_id").isNull(), "copied": F.col("_copied")})
    alone = buckets.applied(waiting, buckets.EntryAlone(gap_ms), f"{buckets.ROW} string", "EventTime")
    return buckets.unpacked(alone, pages.schema)


__all__ = ["bounces", "daily_logins", "daily_page_visitors", "daily_visitors", "day_marks",
           "first_of_batch", "new_days", "repair_new_visitors", "settled"]
