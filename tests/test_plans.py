"""What the physical plans must and must not hold, whatever the data."""

import pytest
from pyspark.sql import functions as F

from tidemart.operators import logs, versions, visits
from tidemart.plans import catalog
from tidemart.sources import standin


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("stream_")])
def test_no_cross_or_nested_loop_join(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_versions_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = plan_of(versions.latest_per_key(rows, ["k"], ["id"]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_registered_latest_is_cut_on_both_sides_of_one_exchange(spark, sf):
    plan = plan_of(catalog.latest_by_key(spark, sf))
    assert plan.count("WindowGroupLimit") == 2 and "REPARTITION" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_dimension_is_shuffled_not_broadcast(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.user_spu_window(spark, sf))
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))


def test_scan_reads_only_the_columns_used(spark, sf):
    plan = plan_of(catalog.province_window(spark, sf))
    assert "l_shipdate" in plan and "l_returnflag" not in plan


def test_wide_rows_are_not_shuffled_again_for_activity_and_coupon(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(catalog.order_wide(spark, sf)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    outer = [n for n, line in enumerate(lines) if "SortMergeJoin" in line and "LeftOuter" in line]
    inner = next(n for n, line in enumerate(lines) if n > outer[-1] and "SortMergeJoin" in line)
    assert len(outer) == 2 and "Exchange" not in "".join(lines[outer[0]:inner])


def hot(spark, rows=30_000):
    """A third of all rows belong to one visitor."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("v"),
        (1_704_067_200_000 + F.col("id") * 4_000).alias("ts"), (F.col("id") % 5).alias("k"),
        "id").select(
            F.struct(F.concat(F.lit("m"), "v").alias("mid"),
                     F.when(F.col("k") > 1, "1").otherwise("0").alias("is_new")).alias("common"),
            F.struct(F.when(F.col("k") < 3, "home").alias("last_page_id")).alias("page"), "ts", "id")


def test_hot_visitor_is_spread(spark):
    """The bounce rule sorts per piece of time: no piece of the hot visitor is large."""
    pieces = visits.with_overlap(hot(spark), 10_000, 600_000).groupBy("common.mid", "_piece").count()
    assert pieces.agg(F.max("count")).first()[0] < 200


def test_hot_visitor_gives_whole_results(spark):
    rows = hot(spark)
    fixed = logs.repair_new_visitors(rows, ("ts", "id"))
    assert fixed.count() == rows.count()
    first = rows.filter("common.mid = 'm0'").orderBy("ts", "id").first()
    day = F.to_date(F.timestamp_millis("ts"))
    start = standin.F.lit(first["ts"])
    known = F.to_date(F.timestamp_millis(start)) if first["common"]["is_new"] == "1" else \
        F.date_sub(F.to_date(F.timestamp_millis(start)), 1)
    wrong = (fixed.filter("common.mid = 'm0'").filter((F.col("common.is_new") == "1")
                                                      & (day != known)).count())
    assert wrong == 0


def test_first_day_by_time_alone_is_hashed(spark):
    rows = hot(spark, 3000)
    hashed = logs.repair_new_visitors(rows)
    assert "SortAggregate" not in plan_of(hashed)
    sorted_ = logs.repair_new_visitors(rows, ("ts", "id"))
    assert hashed.exceptAll(sorted_).count() == 0 and sorted_.exceptAll(hashed).count() == 0
