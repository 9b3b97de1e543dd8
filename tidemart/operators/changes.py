"""Reading the change log: table and type filters, extraction, status transitions, increases.

A change log comes as one feed of all tables, with row images as maps, or kept per table, with row
images as structs. The second form is the one to store: column pruning then reaches into the
images, which it cannot do for a map. Every function takes either.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.functions.numbers import whole

# The change types that carry a row image worth keeping in a dimension.
IMAGE_TYPES = ("insert", "update", "bootstrap-insert")


Log = DataFrame | Mapping[str, DataFrame]


def of_table(log: Log, table: str) -> DataFrame:
    """Changes of one source table."""
    return log.filter(F.col("table") == table) if isinstance(log, DataFrame) else log[table]


def typed(log: DataFrame, table: str, fields: Iterable[str]) -> DataFrame:
    """Changes of one table of the feed with images as structs of the fields named, to be stored."""
    names = list(fields)
    images = {image: F.struct(*(F.col(image)[name].alias(name) for name in names))
              for image in ("data", "old")}
    return of_table(log, table).withColumns(images)


def extract(log: Log, table: str, fields: Iterable[str], *,
            types: Iterable[str] | None = None, where: Column | None = None,
            rename: Mapping[str, str] | None = None,
            extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of one table as columns.

    `fields` are keys of the row image, `rename` maps such a key to its column name and `extra`
    adds computed columns.
    """
    rename = rename or {}
    rows = of_table(log, table)
    if types is not None:
        rows = rows.filter(F.col("type").isin(*types))
    if where is not None:
        rows = rows.filter(where)
    return rows.select(
        *(F.col("data")[name].alias(rename.get(name, name)) for name in fields),
        *(column.alias(name) for name, column in (extra or {}).items()))


def changed(field: str) -> Column:
    """The change touched `field`: its previous value is on record."""
    return F.col("old")[field].isNotNull()


def became(field: str, value: str) -> Column:
    """`field` has just turned into `value`."""
    return (F.col("data")[field] == value) & changed(field)


def moved(field: str, before: str, after: str) -> Column:
    return (F.col("data")[field] == after) & (F.col("old")[field] == before)


def row_images(log: DataFrame) -> DataFrame:
    """Changes that leave a current row behind."""
    return log.filter(F.col("type").isin(*IMAGE_TYPES))


def grew(field: str) -> Column:
    """A new row, or an update that raised a number."""
    now, before = whole(F.col("data")[field]), whole(F.col("old")[field])
    return (F.col("type") == "insert") | ((F.col("type") == "update") & (now > before))


def increase(field: str) -> Column:
    """The amount added, as text: the value of a new row, the difference of an update."""
    now, before = F.col("data")[field], F.col("old")[field]
    return (F.when(F.col("type") == "insert", now)
            .otherwise((whole(now) - whole(before)).cast("string")))
