"""Behaviour log: dirty split, new-visitor repair, split into five streams."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemart.functions.clock import DAY_MS, day_of_ms
from tidemart.schemas import BEHAVIOUR, COMMON, PAGE, TEXT_MAP

#: What the column of an object's unknown keys is called, after the object.
MORE = "_more"


class Parsed(NamedTuple):
    clean: DataFrame
    dirty: DataFrame


def tag_text(raw: DataFrame, schema: T.StructType = BEHAVIOUR,
             required: str | None = "common.mid") -> DataFrame:
    """Parse the JSON text in `value` and mark what cannot be used.

    A row is dirty when it is empty, no JSON, or lacks the field later steps partition by. Gives
    the fields of `schema`, `value`, the other columns of `raw` and `dirty`. The parsed row passes
    through an explode of one element: filters on it then stay above the parser, which would
    otherwise run once more for every condition pushed below it.

    Objects are open: they are read whole, the fields that `schema` names become a struct, and the
    keys it doesn't know go as text into a map column `<object>_more`, null where there are none.
    """
    corrupt = "_unparsed"
    objects = {field.name: field.dataType for field in schema.fields
               if isinstance(field.dataType, T.StructType)}
    wanted = T.StructType([
        *(T.StructField(field.name, TEXT_MAP) if field.name in objects else field
          for field in schema.fields), T.StructField(corrupt, T.StringType())])
    rest = [name for name in raw.columns if name != "value"]
    text = F.coalesce("value", F.lit(""))
    row = F.from_json(text, wanted, {"columnNameOfCorruptRecord": corrupt})
    parsed = raw.select(*rest, "value", F.explode(F.array(row)).alias("_row"))
    bad = F.col("_row").isNull() | F.col(f"_row.{corrupt}").isNotNull()
    if required:
        bad = bad | F.col(f"_row.{required}").isNull()
    return parsed.select(
        *rest, "value", bad.alias("dirty"),
        *(_known(F.col(f"_row.{field.name}"), objects[field.name]).alias(field.name)
          if field.name in objects else F.col(f"_row.{field.name}").alias(field.name)
          for field in schema.fields),
        *(_unknown(F.col(f"_row.{name}"), kind).alias(f"{name}{MORE}")
          for name, kind in objects.items()))


def _known(whole: Column, kind: T.StructType) -> Column:
    """The named fields of an open object; text that is no number gives a null number."""
    fields = (whole[field.name].try_cast(field.dataType).alias(field.name) for field in kind.fields)
    return F.when(whole.isNotNull(), F.struct(*fields))


def _unknown(whole: Column, kind: T.StructType) -> Column:
    rest = F.map_filter(whole, lambda key, _: ~key.isin(*kind.names))
    return F.when(F.size(rest) > 0, rest)


def whole_objects(rows: DataFrame) -> DataFrame:
    """Open objects as one map of all their keys that have a value, for writing them as JSON."""
    out = rows
    for name in rows.columns:
        if f"{name}{MORE}" in rows.columns:
            kind = rows.schema[name].dataType
            known = F.create_map(*(part for field in kind.names for part in (
                F.lit(field), F.col(name)[field].cast("string"))))
            rest = F.coalesce(F.col(f"{name}{MORE}"), F.create_map().cast(TEXT_MAP))
            merged = F.map_concat(F.map_filter(known, lambda _, value: value.isNotNull()), rest)
            out = out.withColumn(name, F.when(F.col(name).isNotNull(), merged))
    return out.drop(*(name for name in rows.columns if name.endswith(MORE)))


def parse_text(raw: DataFrame, schema: T.StructType = BEHAVIOUR,
               required: str | None = "common.mid") -> Parsed:
    """Parsed rows and rejects as two DataFrames."""
    tagged = tag_text(raw, schema, required)
    return Parsed(tagged.filter("NOT dirty").drop("value", "dirty"),
                  tagged.filter("dirty").select(*raw.columns))


def first_day_of(is_new: Column, ts: Column) -> Column:
    """First day a visitor is known for, as seen from the visitor's first row: its own day when
    the row is marked new, the day before when the device had already been seen elsewhere."""
    return F.when(is_new == "1", day_of_ms(ts)).otherwise(day_of_ms(ts - F.lit(DAY_MS)))


def repaired(is_new: Column, ts: Column, first_day: Column) -> Column:
    return F.when((is_new == "1") & (day_of_ms(ts) != first_day), F.lit("0")).otherwise(is_new)


def _first_day(order: tuple[str, ...]) -> Column:
    """Aggregate for `first_day_of` the first row. Ordered by time alone it takes two minima of
    numbers, which Spark keeps in a hash table; a longer order needs rows, which it has to sort."""
    is_new, ts = F.col("common.is_new"), F.col("ts")
    if tuple(order) == ("ts",):
        starts_new = F.min(F.when(is_new == "1", ts)) == F.min(ts)
        return F.when(starts_new, day_of_ms(F.min(ts))).otherwise(
            day_of_ms(F.min(ts) - F.lit(DAY_MS)))
    return F.min_by(first_day_of(is_new, ts), F.when(ts.isNotNull(), F.struct(*order)))


def repair_new_visitors(log: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Clear `common.is_new` on rows after a visitor's first day.

    The first row of every visitor comes from an aggregation, so a visitor with very many rows
    sends one row per input partition instead of all of them to one task; the join back is
    against one row per visitor and AQE splits hot partitions of the log side. Ordered
    by time alone, a new row counts as first among rows of the same time. A row without a time
    is nobody's first.
    """
    first = log.groupBy(F.col("common.mid").alias("_mid")).agg(
        _first_day(order).alias("_first_day"))
    fixed = repaired(F.col("common.is_new"), F.col("ts"), F.col("_first_day"))
    return (log.join(first, log["common.mid"] == first["_mid"], "left")
            .withColumn("common", F.col("common").withField("is_new", fixed))
            .drop("_mid", "_first_day"))


class LogStreams(NamedTuple):
    page: DataFrame
    start: DataFrame
    display: DataFrame
    action: DataFrame
    error: DataFrame


def split_log(log: DataFrame) -> LogStreams:
    """Error rows are kept whole; every row without its error part is then a start row, or a
    page row that also gives one row per display and per action. Action rows carry no outer
    time stamp."""
    calm = log.drop("err")
    pages = calm.filter(F.col("start").isNull()).drop("start")
    extra = [name for name in log.columns if name not in BEHAVIOUR.names]
    return LogStreams(
        page=pages.drop("displays", "actions"),
        start=calm.filter(F.col("start").isNotNull()),
        display=pages.select(F.explode("displays").alias("display"), "common", "page", "ts", *extra),
        action=pages.select(F.explode("actions").alias("action"), "common", "page", *extra),
        error=log.filter(F.col("err").isNotNull()),
    )


#: Columns of each stream besides what is in all of them.
STREAMS = {"page": ("ts",), "start": ("displays", "actions", "start", "ts"),
           "display": ("display", "ts"), "action": ("action",),
           "error": ("displays", "actions", "start", "err", "ts")}
_PARTS = {"displays": T.ArrayType(TEXT_MAP), "actions": T.ArrayType(TEXT_MAP), "start": TEXT_MAP,
          "err": TEXT_MAP, "display": TEXT_MAP, "action": TEXT_MAP, "ts": T.LongType()}


def tagged(log: DataFrame) -> DataFrame:
    """The rows of all five streams as one table with the name of their `stream`, from one pass:
    every log row gives an array of tagged parts, which is exploded. Parts that a stream doesn't have
    are null; `common`, `page` and further columns go with each row."""
    def part(stream: Column | str, **values: Column) -> Column:
        columns = {name: values.get(name, F.lit(None)).cast(kind) for name, kind in _PARTS.items()}
        name = F.lit(stream) if isinstance(stream, str) else stream
        return F.struct(name.alias("stream"), *(v.alias(k) for k, v in columns.items()))

    own = {name: F.col(name) for name in ("displays", "actions", "start", "err", "ts")}
    page = F.col("start").isNull()
    # a null list would make all parts null
    items = {name: F.when(page & F.col(name).isNotNull(), F.col(name)).otherwise(
        F.array().cast(_PARTS[name])) for name in ("displays", "actions")}
    parts = F.concat(
        F.array(F.when(page, part("page", ts=own["ts"])).otherwise(part(
            "start", displays=own["displays"], actions=own["actions"], start=own["start"],
            ts=own["ts"]))),
        F.transform(items["displays"], lambda one: part("display", display=one, ts=own["ts"])),
        F.transform(items["actions"], lambda one: part("action", action=one)),
        F.filter(F.array(part("error", **own)), lambda _: F.col("err").isNotNull()))
    rest = [name for name in log.columns if name not in _PARTS]
    return log.select(*rest, F.explode(parts).alias("_part")).select(*rest, "_part.*")


def stream_schema(more: T.StructType | None = None) -> T.StructType:
    """The stored form of `tagged` rows, with further columns of the log."""
    return T.StructType([
        T.StructField("common", COMMON), T.StructField("page", PAGE),
        T.StructField(f"common{MORE}", TEXT_MAP), T.StructField(f"page{MORE}", TEXT_MAP),
        *(more.fields if more else []),
        *(T.StructField(name, kind) for name, kind in _PARTS.items()),
        T.StructField("stream", T.StringType())])


def stream_of(rows: DataFrame, stream: str) -> DataFrame:
    """One stream out of tagged rows, with its own columns."""
    rest = [name for name in rows.columns if name not in _PARTS and name != "stream"]
    return rows.filter(F.col("stream") == stream).select(*rest, *STREAMS[stream])


def stream_counts(log: DataFrame) -> DataFrame:
    """Rows each stream of `split_log` gets, per newness flag, from one pass over the log."""
    page = F.col("start").isNull()
    sizes = {"page": F.count_if(page), "start": F.count_if(~page),
             "display": F.sum(F.when(page, _length("displays"))),
             "action": F.sum(F.when(page, _length("actions"))),
             "error": F.count_if(F.col("err").isNotNull())}
    counted = log.groupBy(F.col("common.is_new").alias("is_new")).agg(
        *(F.coalesce(size, F.lit(0)).cast("bigint").alias(name) for name, size in sizes.items()))
    return (counted.unpivot("is_new", list(sizes), "stream", "row_count")
            .filter("row_count > 0"))


def _length(items: str) -> Column:
    return F.coalesce(F.array_size(items), F.lit(0))
