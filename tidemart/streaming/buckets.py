"""State kept per bucket of keys instead of per key.

A call into the state store costs the same for one key as for a thousand, and so does a Python frame.
These rules take the rows of a bucket as frames, and read and write its state in chunks, so what a
micro-batch pays per row is a sort, not a visit to the store. Rows travel as JSON text beside the few
columns that a rule looks at. Keys are dealt over BUCKETS buckets by hash; a task holds the rows of one
bucket and micro-batch at a time. The number stays with a checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The rules travel to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 256
# plain names: those with an underscore in front do not reach a stateful processor
BUCKET, KEY, ORDER, ROW, MS, MICROS = "bucket", "key_text", "order_text", "row_text", "ms", "micros"
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# a day before all others
NO_DAY = -2 ** 40
_CHUNK = T.StructType([T.StructField("chunk", T.BinaryType())])
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


# --- rows as text and back ---------------------------------------------------------------------

def as_text(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), JSON)


def packed(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], **columns: Column) -> DataFrame:
    """Bucket, key and fields of each row as text, with the columns named. Null is a key."""
    key = as_text(*keys)
    return rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias(BUCKET),
                       key.alias(KEY), as_text(*fields).alias(ROW),
                       *(value.alias(name) for name, value in columns.items()))


def unpacked(rows: DataFrame, schema: T.StructType, *more: str, text: str = ROW) -> DataFrame:
    plain = T.StructType([T.StructField(field.name, field.dataType) for field in schema.fields])
    return rows.select(F.from_json(text, plain, JSON | {"mode": "FAILFAST"}).alias("_row"),
                       *more).select("_row.*", *more)


def sortable(schema: T.StructType, names: Sequence[str]) -> bool:
    return all(isinstance(schema[name].dataType, (*_WHOLE, T.StringType, T.TimestampType, T.DateType,
                                                  T.BooleanType)) for name in names)


def order_text(schema: T.StructType, names: Sequence[str]) -> Column:
    """The columns as one text that sorts as they do, nulls first. It holds no NUL: frames compare texts
    only up to the first one."""
    if not sortable(schema, names):
        raise TypeError(f"whole numbers, text, times and flags give an order, not all of {list(names)}")

    def part(name: str) -> Column:
        value, kind = F.col(name), schema[name].dataType
        if isinstance(kind, T.StringType):
            text = value
            for plain, escaped in (("\x02", "\x02\x03"), ("\x01", "\x02\x02"), ("\x00", "\x02\x01")):
                text = F.replace(text, F.lit(plain), F.lit(escaped))
        else:
            number = (F.unix_micros(value) if isinstance(kind, T.TimestampType) else
                      F.unix_date(value) if isinstance(kind, T.DateType) else value.cast("bigint"))
            text = F.lpad((number.cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)"))
                          .cast("string"), 20, "0")
        return F.when(value.isNull(), "0").otherwise(F.concat(F.lit("1"), text))

    return F.concat_ws("\x01", *map(part, names))


# --- rules -------------------------------------------------------------------------------------

def _chunk(frame: pd.DataFrame) -> tuple[bytes]:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def _frame(chunk) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(chunk[0]))).read_all().to_pandas()


def _joined(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = list(frames)
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


class _Waiting(StatefulProcessor):
    """Rows of a bucket wait in chunks, one a micro-batch, until the bucket's timer. It has one timer
    at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", _CHUNK)

    def wait(self, rows: pd.DataFrame, until: int) -> None:
        self.chunks.appendValue(_chunk(rows))
        timers = list(self.handle.listTimers())
        if not any(timer <= until for timer in timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)

    def all(self) -> pd.DataFrame:
        return _joined(_frame(chunk) for chunk in self.chunks.get())

    def keep(self, rows: pd.DataFrame, until: int | None) -> None:
        """What goes on waiting, from a timer's end."""
        if until is None:
            self.chunks.clear()
        else:
            self.chunks.put([_chunk(rows)])
            self.handle.registerTimer(until)

    def close(self) -> None:
        pass


class HoldLatest(_Waiting):
    """A key's newest row, once the watermark has reached the end of the hold from its first
    micro-batch's earliest row. Of equal versions the later arrival wins."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def newest(self, rows: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
        several = rows[KEY].duplicated(keep=False)
        if not several.any():
            return rows
        last = rows[several].sort_values([KEY, *by], kind="stable").drop_duplicates(KEY, keep="last")
        return pd.concat([rows[~several], last], ignore_index=True)

    def handleInputRows(self, key, rows, timerValues):
        rows = _joined(rows)[[KEY, ORDER, ROW, MS, "arrival"]]
        start = rows.groupby(KEY)[MS].min()
        rows = self.newest(rows, [ORDER, "arrival"])
        rows[MS] = rows[KEY].map(start)
        self.wait(rows[[KEY, ORDER, ROW, MS]], int(rows[MS].min()) + self.hold_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = self.all()
        start = rows.drop_duplicates(KEY).set_index(KEY)[MS]
        rows = self.newest(rows, [ORDER])
        rows[MS] = rows[KEY].map(start)
        over = rows[MS] + self.hold_ms <= passed
        kept = rows[~over]
        self.keep(kept, int(kept[MS].min()) + self.hold_ms if len(kept) else None)
        if over.any():
            yield rows.loc[over, [ROW]]


class EntryAlone(_Waiting):
    """Passes an entry page when the visitor's next page is another entry page or comes only after
    the gap. Rows wait until the watermark has passed them and are then judged in order of time, so
    rows that come out of order within the delay change nothing; an entry page passes once nothing
    can come any more within its gap."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def handleInputRows(self, key, rows, timerValues):
        rows = _joined(rows)[[KEY, ORDER, ROW, MS, "entry", "copied"]]
        self.wait(rows, int(rows[MS].min()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = self.all()
        early = rows[MS] >= passed
        ready = rows[~early].sort_values([KEY, ORDER], kind="stable")
        last = ready[KEY] != ready[KEY].shift(-1)
        gap = ready[MS].shift(-1, fill_value=0) - ready[MS]
        held = ready["entry"] & ~ready["copied"]
        alone = held & ~last & (ready["entry"].shift(-1, fill_value=False) | (gap >= self.gap_ms))
        over = ready[MS] + self.gap_ms <= passed
        kept = held & last & ~over
        until = [int(times.min()) + wait for times, wait in (
            (rows.loc[early, MS], 1), (ready.loc[kept, MS], self.gap_ms)) if len(times)]
        self.keep(pd.concat([ready[kept], rows[early]], ignore_index=True), min(until, default=None))
        found = ready.loc[alone | (held & last & over), [ROW]]
        if len(found):
            yield found


class _Known(StatefulProcessor):
    """One value a key, a bucket's values in one chunk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunk = handle.getValueState("chunk", _CHUNK)

    def known(self) -> pd.Series:
        chunk = self.chunk.get()
        return (pd.Series([], index=pd.Index([], dtype=object), dtype="int64") if chunk is None
                else _frame(chunk).set_index(KEY)["value"])

    def update(self, known: pd.Series) -> None:
        self.chunk.update(_chunk(pd.DataFrame({KEY: known.index, "value": known.to_numpy()})))

    def close(self) -> None:
        pass


class FirstDay(_Known):
    """Adds the first known day of the key, set by the key's first row that has a time."""

    def handleInputRows(self, key, rows, timerValues):
        known, rows = self.known(), _joined(rows)
        fresh = rows[rows["own_first"].notna() & ~rows[KEY].isin(known.index)]
        if len(fresh):
            first = fresh.sort_values([KEY, ORDER], kind="stable").drop_duplicates(KEY)
            known = pd.concat([known, first.set_index(KEY)["own_first"].astype("int64")])
            self.update(known)
        yield pd.DataFrame({ROW: rows[ROW], "first_day": rows[KEY].map(known).astype("Int64")})


class DayMarks(_Known):
    """Passes rows of a new day with the day of the key's row before them, NO_DAY for the very first. A
    row without a day is one of NO_DAY."""

    def handleInputRows(self, key, rows, timerValues):
        known = self.known()
        rows = _joined(rows).sort_values([KEY, MICROS], kind="stable", ignore_index=True, na_position="first")
        start = ~rows[KEY].duplicated()
        last = rows["day"].shift(1, fill_value=NO_DAY)
        last[start] = rows.loc[start, KEY].map(known).fillna(NO_DAY).astype("int64")
        ends = rows[~rows[KEY].duplicated(keep="last")].set_index(KEY)["day"]
        self.update(pd.concat([known[~known.index.isin(ends.index)], ends]))
        new = rows["day"] != last
        if new.any():
            yield pd.DataFrame({ROW: rows.loc[new, ROW], "last_day": last[new],
                                "at": pd.to_datetime(rows.loc[new, MICROS], unit="us", utc=True)})


class Count(_Known):
    """Keeps a count per key and passes what a change replaces and what it leaves, by the kinds of a
    new group, the row before and after a change, and a group that is gone."""

    def __init__(self, kinds: Sequence[str]):
        self.kinds = tuple(kinds)

    def handleInputRows(self, key, rows, timerValues):
        new, before, after, gone = self.kinds
        known = self.known()
        amount = _joined(rows).groupby(KEY)["amount"].sum()
        old = known.reindex(amount.index, fill_value=0).astype("int64")
        now = old + amount
        self.update(pd.concat([known.drop(known.index.intersection(now.index)), now]))
        parts = [(new, now, (old <= 0) & (now > 0)), (before, old, (old > 0) & (now > 0)),
                 (after, now, (old > 0) & (now > 0)), (gone, old, (old > 0) & (now <= 0))]
        shown = [pd.DataFrame({KEY: count.index[there & (old != now)], "kind": kind,
                               "row_count": count[there & (old != now)].to_numpy()})
                 for kind, count, there in parts]
        out = pd.concat(shown, ignore_index=True)
        if len(out):
            yield out


def applied(rows: DataFrame, rule: StatefulProcessor, schema: str, time_mode: str = "None",
            event_time: str = "") -> DataFrame:
    return rows.groupBy(BUCKET).transformWithStateInPandas(rule, schema, "Append", time_mode,
                                                           eventTimeColumnName=event_time)
