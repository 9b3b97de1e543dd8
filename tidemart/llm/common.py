"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemart.session import work_dir

#: A word is a run of anything but these characters (inside a character class).
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Rows of one Arrow batch to Python; texts of 100 kB make larger batches heavy.
BATCH_ROWS = 512
#: Rows of a batch whose bytes are bounded too, and the bytes.
WIDE_ROWS, BATCH_BYTES = 4096, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches, whatever their number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def byte_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Whole texts go to Python in batches of about so many bytes, whatever their number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WIDE_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table below the shared folder: computed once, and the executors that
    computed them may be lost."""
    path = work_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder as tasks and the driver reach it without the JVM."""
    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def free_name(taken: Sequence[str], name: str) -> str:
    """A column name that none of the given ones equals in any case."""
    known = {column.lower() for column in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered_bytes(keep: bytes | None = None) -> bytes:
    """A table for bytes.translate: A-Z become a-z; with `keep`, other ASCII becomes a space."""
    made = bytearray(range(256))
    for code in range(128):
        low = code + 32 if 65 <= code <= 90 else code
        made[code] = low if keep is None or low in keep else 32
    return bytes(made)


def as_bytes(column) -> list[bytes | None]:
    """UTF-8 values of an Arrow string column."""
    return column.cast("binary").to_pylist()


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]
