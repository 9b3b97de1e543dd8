"""What several test files use; a plain module, so that no other conftest can stand in its place."""

import time

from pyspark.sql import Window, functions as F

from tidemart.session import work_dir
from tidemart.streaming import sinks


class Replay:
    """Feeds a DataFrame to streaming code in time-ordered files, one per micro-batch."""

    def __init__(self, spark):
        self.spark = spark

    def stream(self, rows, order, parts=3):
        path = work_dir(self.spark, "source")
        cut = rows.withColumn("_part", F.ntile(parts).over(Window.orderBy(*order)))
        for part in range(1, parts + 1):
            (cut.filter(F.col("_part") == part).drop("_part").coalesce(1)
             .write.mode("append").parquet(path))
            time.sleep(0.05)
        return (self.spark.readStream.schema(rows.schema)
                .option("maxFilesPerTrigger", 1).parquet(path))

    def appended(self, rows):
        path = work_dir(self.spark, "out")
        schema = rows.schema
        sinks.start(sinks.to_files(rows, path), work_dir(self.spark, "ck")).awaitTermination()
        return self.spark.read.schema(schema).parquet(path)

    def upserted(self, rows, keys, version=(), mode="update"):
        path = work_dir(self.spark, "out")
        sinks.start(sinks.to_upserts(rows, path, keys, version, mode),
                    work_dir(self.spark, "ck")).awaitTermination()
        return sinks.current(self.spark, path, keys, version)


def only_in(left, right):
    """Rows of each side the other lacks."""
    columns = right.columns
    left = left.select(*columns)
    return left.exceptAll(right).count(), right.exceptAll(left).count()
