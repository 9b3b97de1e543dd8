"""The wide orders' job in turns: what a micro-batch holds, and what stays on disk behind it."""

import glob

from pyspark.sql import functions as F

from helpers import only_in
from tidemart.plans import catalog, facts
from tidemart.session import work_dir
from tidemart.sources import standin
from tidemart.streaming import sinks


def test_a_micro_batch_holds_a_number_of_changes_and_leaves_no_input_behind(spark, sf, monkeypatch):
    """More changes come as more parts, a part read by many tasks; read files and old state go."""
    most, seen, batches = 3000, [], []
    start, work = sinks.start, {}
    monkeypatch.setattr(catalog, "PART_CHANGES", most, raising=False)
    monkeypatch.setattr(catalog, "work_dir", lambda spark, name: work.setdefault(name, work_dir(spark, name)))

    def started(writer, checkpoint, *more):
        if not seen:
            seen.extend(sorted(glob.glob(f"{work['order_detail']}/*/*.parquet")))
        query = start(writer, checkpoint, *more)
        assert query.awaitTermination(120)
        batches.extend(p["numInputRows"] for p in query.recentProgress)
        return query

    monkeypatch.setattr(sinks, "start", started)
    names = ("spark.sql.streaming.minBatchesToRetain", "spark.sql.shuffle.partitions",
             "spark.sql.streaming.join.stateFormatVersion")
    before = [spark.conf.get(name) for name in names]
    found = catalog.stream_order_wide(spark, sf)
    assert [spark.conf.get(name) for name in names] == before
    tables = standin.written_together(standin.table_changes(spark, sf, *standin.ORDERING))
    changes = sum(rows.count() for rows in tables.values())
    assert changes > 4 * most and max(batches) < 1.3 * most
    assert len(seen) >= 8 * (changes // most)
    left = [file for name in tables for file in glob.glob(f"{work[name]}/_part=[0-4]/*.parquet")]
    assert not left
    wide = facts.order_wide(tables, standin.dictionary(spark)).withColumn("old_status", F.col("old")["order_status"])
    assert only_in(found, wide.drop("old", "row_op_ts")) == (0, 0)


def test_cuts_of_one_time_or_of_no_rows(spark):
    """A time that all changes share can't be cut; a change without a time is in the first part."""
    assert catalog._cuts([spark.createDataFrame([], "ts string")]) == []
    rows = spark.createDataFrame([("a", "7200"), ("b", "7200"), ("c", None)], "id string, ts string")
    cuts = catalog._cuts([rows, rows])
    assert cuts == [7200.0, 7200.0]
    found = rows.select("id", catalog._part(rows, ends=cuts).alias("part")).collect()
    assert {r.id: r.part for r in found}["c"] == 0 and {r.part for r in found} <= {0, 2}
