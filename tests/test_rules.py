"""Hand-written cases for rules with edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions import clock, numbers
from tidemart.functions.words import words
from tidemart.operators import changes, dimensions, logs, lookups, versions, visits, windows
from tidemart.plans import facts, summaries
from tidemart.sources import dimension_store, feeds

DAY = 86_400_000
NOON = 1_704_110_400_000  # 2024-01-01 12:00 UTC


def log_rows(spark, rows):
    """(mid, is_new, last_page_id, ts) as page rows."""
    schema = "mid string, is_new string, last_page_id string, ts bigint"
    return spark.createDataFrame(rows, schema).select(
        F.struct("mid", "is_new", F.col("mid").alias("uid"), F.lit("v").alias("vc"),
                 F.lit("c").alias("ch"), F.lit("a").alias("ar")).alias("common"),
        F.struct(F.lit("home").alias("page_id"), "last_page_id",
                 F.lit(10).cast("bigint").alias("during_time")).alias("page"), "ts")


def test_first_row_new_keeps_its_day_and_clears_later_days(spark):
    rows = log_rows(spark, [("m", "1", None, NOON), ("m", "1", None, NOON + 60_000),
                            ("m", "1", None, NOON + DAY), ("m", None, None, NOON + 2 * DAY)])
    found = {r["ts"]: r["common"]["is_new"] for r in logs.repair_new_visitors(rows).collect()}
    assert list(found[t] for t in sorted(found)) == ["1", "1", "0", None]


def test_first_row_old_makes_every_later_row_old(spark):
    rows = log_rows(spark, [("m", "0", None, NOON), ("m", "1", None, NOON + 1),
                            ("m", "1", None, NOON + DAY)])
    assert [r["common"]["is_new"] for r in logs.repair_new_visitors(rows).orderBy("ts").collect()
            ] == ["0", "0", "0"]


@pytest.mark.parametrize("days, back", [(7, 0), (8, 1)])
def test_returning_after_whole_days(spark, days, back):
    late = NOON - NOON % DAY + DAY - 1  # last millisecond of the first day
    rows = log_rows(spark, [("u", "0", None, NOON), ("u", "0", "login", late),
                            ("u", "0", None, NOON - NOON % DAY + days * DAY)])
    found = visits.daily_logins(rows).orderBy("ts").collect()
    assert [(r["uu_ct"], r["back_ct"]) for r in found] == [(1, 0), (1, back)]


@pytest.mark.parametrize("gap, last, kept", [
    (9_999, "home", [False]), (10_000, "home", [True]),       # followed inside / after the gap
    (9_999, None, [True, True]), (0, None, [True, True])])    # followed by another entry page
@pytest.mark.parametrize("start", [NOON, NOON + 599_000])     # inside a piece, across two pieces
def test_bounce_gap(spark, gap, last, kept, start):
    rows = log_rows(spark, [("m", "0", None, start), ("m", "0", last, start + gap)])
    found = sorted(r["ts"] for r in visits.bounces(rows).collect())
    expected = [start + gap * place for place, keep in enumerate(kept) if keep]
    assert found == expected


def test_bounce_pieces_do_not_change_the_result(spark, sf):
    from tidemart.sources import standin
    pages = standin.pages(spark, sf)
    whole = visits.bounces(pages, 3_600_000, 400 * DAY, ("ts", "event_id"))
    cut = visits.bounces(pages, 3_600_000, 3_600_000, ("ts", "event_id"))
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_single_page_bounces(spark):
    assert visits.bounces(log_rows(spark, [("m", "0", None, NOON)])).count() == 1


def test_cart_increase(spark):
    rows = [("insert", "5", None), ("update", "7", {"sku_num": "4"}),
            ("update", "4", {"sku_num": "4"}), ("update", "3", {"sku_num": "4"}),
            ("update", "9", {"source_id": "1"}), ("update", "x", {"sku_num": "4"}),
            ("delete", "9", {"sku_num": "1"})]
    log = spark.createDataFrame(
        [("cart_info", kind, {"id": str(i), "source_type": "2401", "sku_num": n}, old, "1")
         for i, (kind, n, old) in enumerate(rows)],
        "`table` string, type string, data map<string,string>, old map<string,string>, ts string")
    dic = spark.createDataFrame([("2401", "query")], "dic_code string, dic_name string")
    assert {r["id"]: r["sku_num"] for r in facts.cart_add(log, dic).collect()} == {"0": "5", "1": "3"}


def envelope(spark, rows):
    return spark.createDataFrame(rows, S.ENVELOPE)


def test_order_with_no_one_or_two_optional_sides(spark):
    def change(table, data, ts="100", kind="insert", old=None):
        return ("mall", table, kind, data, old, ts)

    rows = [change("order_info", {"id": "o", "user_id": "u", "province_id": "1",
                                  "order_status": "1001"})]
    for detail in ("none", "act", "cou", "both"):
        rows.append(change("order_detail", {
            "id": detail, "order_id": "o", "sku_num": "2", "order_price": "1.255",
            "source_type": "2401", "create_time": "2024-01-01 10:00:00"}))
    rows.append(change("order_detail", {"id": "lost", "order_id": "o", "source_type": "9999"}))
    for detail in ("act", "both"):
        rows.append(change("order_detail_activity", {"order_detail_id": detail, "activity_id": "7"}))
    for detail, coupon in (("cou", "8"), ("both", "8"), ("both", "9")):
        rows.append(change("order_detail_coupon", {"order_detail_id": detail, "coupon_id": coupon}))
    dic = spark.createDataFrame([("2401", "query")], "dic_code string, dic_name string")
    wide = facts.order_wide(envelope(spark, rows), dic)
    found = sorted((r["id"], r["activity_id"], r["coupon_id"]) for r in wide.select(
        "id", F.coalesce("activity_id", F.lit("-")).alias("activity_id"),
        F.coalesce("coupon_id", F.lit("-")).alias("coupon_id")).collect())
    assert found == [("act", "7", "-"), ("both", "7", "8"), ("both", "7", "9"),
                     ("cou", "-", "8"), ("none", "-", "-")]
    assert wide.filter("id = 'none'").first()["split_original_amount"] == "2.5200"
    assert [f.name for f in wide.schema] == S.WIDE_ORDER.names


@pytest.mark.parametrize("kind, status, old, kept", [
    ("update", "1003", {"order_status": "1001"}, 1), ("update", "1003", {"operate_time": "x"}, 0),
    ("insert", "1003", {"order_status": "1001"}, 0), ("update", "1002", {"order_status": "1001"}, 0),
    ("update", "1003", None, 0)])
def test_status_transition(spark, kind, status, old, kept):
    log = envelope(spark, [("mall", "order_info", kind, {"order_status": status}, old, "1")])
    rows = changes.extract(log, "order_info", ["order_status"], types=["update"],
                           where=changes.became("order_status", S.ORDER_CANCELLED))
    assert rows.count() == kept


def test_typed_images_give_the_same_rows(spark):
    log = envelope(spark, [("mall", "t", "insert", {"a": "1", "b": "2"}, None, "5"),
                           ("mall", "other", "insert", {"a": "9"}, None, "6")])
    stored = {"t": changes.typed(log, "t", ["a", "b"])}
    assert (changes.extract(stored, "t", ["a", "b"]).collect()
            == changes.extract(log, "t", ["a", "b"]).collect())


def test_lookup_drops_or_keeps_unknown_codes(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "zz")], "id string, code string")
    dic = spark.createDataFrame([("x", "name")], "dic_code string, dic_name string")
    assert [r["id"] for r in lookups.name_of(rows, dic, "code", "n").collect()] == ["1"]
    assert [r["id"] for r in lookups.unnamed(rows, dic, "code").collect()] == ["2"]
    kept = lookups.enrich(rows, dic, {"code": "dic_code"}, {"n": "dic_name"})
    assert {tuple(r) for r in kept.collect()} == {("1", "x", "name"), ("2", "zz", None)}


def test_latest_version(spark):
    rows = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 0, 0, 0), 1), ("a", dt.datetime(2024, 1, 1, 0, 0, 0, 5000), 2),
         ("b", None, 3), ("b", dt.datetime(2024, 1, 1), 4)], "id string, row_op_ts timestamp, v int")
    found = versions.latest_per_key(rows, ["id"], ("row_op_ts",))
    assert {r["id"]: r["v"] for r in found.collect()} == {"a": 2, "b": 4}
    merged = versions.merge_latest(found, rows.limit(0), ["id"], ("row_op_ts",))
    assert merged.count() == 2


def test_dirty_text(spark):
    good = '{"common":{"mid":"m"},"page":{"page_id":"home"},"ts":5}'
    raw = spark.createDataFrame([(good,), ("",), ("null",), ("{bad",), (None,), ('{"ts":5}',),
                                 ('{"common":{"uid":"u"},"ts":5}',)], "value string")
    parsed = logs.parse_text(raw)
    assert [r["common"]["mid"] for r in parsed.clean.collect()] == ["m"]
    assert parsed.dirty.count() == 6 and parsed.dirty.columns == ["value"]


def test_log_split_keeps_error_rows_whole(spark):
    text = ('{"common":{"mid":"m"},"page":{"page_id":"home"},"displays":[{"item":"1"},{"item":"2"}],'
            '"actions":[{"action_id":"a","ts":"7"}],"err":{"code":"5"},"ts":5}')
    begin = '{"common":{"mid":"m"},"start":{"entry":"icon"},"displays":[{"item":"1"}],"ts":6}'
    raw = spark.createDataFrame([(text,), (begin,)], "value string")
    streams = logs.split_log(logs.parse_text(raw).clean)
    assert {n: rows.count() for n, rows in streams._asdict().items()} == {
        "page": 1, "start": 1, "display": 2, "action": 1, "error": 1}
    assert "displays" in streams.error.columns and "displays" not in streams.page.columns
    assert "ts" not in streams.action.columns and streams.action.first()["action"]["ts"] == "7"


def test_order_on_several_lines_counts_once(spark):
    rows = spark.createDataFrame(
        [("p", "o1", "1.50"), ("p", "o1", "2.25"), ("p", "o2", None), ("q", "o1", "1.00")],
        "province string, order_id string, amount string").withColumn(
            "at", F.timestamp_seconds(F.lit(1_700_000_003)))
    found = windows.bounds(windows.orders_and_amount(
        rows, "at", ["province"], "order_id", numbers.money(F.col("amount"))))
    assert {tuple(r) for r in found.collect()} == {
        ("2023-11-14 22:13:20", "2023-11-14 22:13:30", "p", 2, 3.75),
        ("2023-11-14 22:13:20", "2023-11-14 22:13:30", "q", 1, 1.0)}


def test_new_and_unique_users(spark):
    day = 1_704_067_200
    rows = [("1", "u", day + 5), ("2", "u", day + 7), ("3", "u", day + 86_400), ("4", "w", day + 6)]
    details = spark.createDataFrame(
        [(i, u, "web", "2024-01-02" if t >= day + 86_400 else "2024-01-01", "1.5", None, "2", str(t), 1)
         for i, u, t in rows],
        "id string, user_id string, source_type_name string, date_id string, "
        "split_activity_amount string, split_coupon_amount string, split_original_amount string, "
        "ts string, row_op_ts int")
    found = summaries.order_window(details).orderBy("stt").collect()
    assert [tuple(r)[2:] for r in found] == [(2, 2, 4.5, 0.0, 6.0), (1, 0, 1.5, 0.0, 2.0)]


def test_words(spark):
    row = spark.createDataFrame([("Red SHOES, 42cm 手机壳 好", )], "t string").select(
        words(F.col("t"))).first()
    assert row[0] == ["red", "shoes", "42cm", "手机", "机壳", "好"]


@pytest.mark.parametrize("text, day", [("2024-02-29 23:59:59", "2024-02-29"), ("2024-02-30 1:2:3", None),
                                       ("soon", None), (None, None)])
def test_day_text(spark, text, day):
    row = spark.createDataFrame([(text,)], "t string").select(clock.day_text(F.col("t"))).first()
    assert row[0] == day


def test_page_table_time_is_cut_to_the_second(spark):
    raw = spark.createDataFrame([('{"common":{"mid":"m"},"page":{"item":"x"},"ts":1704110400999}',)],
                                "value string")
    row = feeds.page_table(raw).first()
    assert row["row_time"] == dt.datetime(2024, 1, 1, 12, 0, 0) and row["page"]["item"] == "x"


def test_change_log_text(spark):
    raw = spark.createDataFrame(
        [('{"database":"d","table":"t","type":"insert","data":{"id":1,"n":null,"o":{"a":2}},"ts":7}',),
         ("broken",)], "value string")
    rows = feeds.change_log(raw).filter("`table` = 't'").collect()
    assert rows[0]["data"] == {"id": "1", "n": None, "o": '{"a":2}'} and rows[0]["ts"] == "7"
    checked, dirty = feeds.change_log_checked(raw)
    assert checked.count() == 1 and dirty.count() == 1


def test_routing_config(spark):
    raw = spark.createDataFrame(
        [('{"after":{"source_table":"a","sink_table":"dim_a","sink_columns":"id,x"}}',),
         ('{"before":{"source_table":"a"},"after":null}',)], "value string")
    config = feeds.routing_images(raw)
    row = config.first()
    assert config.count() == 1 and dimensions.target_schema(row).names == ["id", "x"]
    assert [f.nullable for f in dimensions.target_schema(row)] == [False, True]
    log = envelope(spark, [("d", "a", "insert", {"id": "1", "x": "2", "y": "3"}, None, "1"),
                           ("d", "a", "delete", {"id": "1"}, None, "2"),
                           ("d", "b", "insert", {"id": "1"}, None, "3")])
    routed = dimensions.route(log, config, dimensions.source_tables(config)).collect()
    assert [(r["sink_table"], r["pk"], r["data"]) for r in routed] == [
        ("dim_a", "1", {"id": "1", "x": "2"})]
    assert dimensions.unrouted(log, config).count() == 1
    assert dimensions.as_table(dimensions.current_images(
        dimensions.route(log, config)), row).first().asDict() == {"id": "1", "x": "2"}


def test_dimension_reads(spark):
    dim = spark.createDataFrame([("1", "a", "x"), ("1", "a", "y"), ("2", "a", "z")],
                                "id string, kind string, name string")
    assert dimension_store.by_key(dim, {"id": "1", "kind": "a"}).count() == 2
    assert dimension_store.one_per_key(dim, "id", "kind").orderBy("id").collect()[0]["name"] == "x"


def test_comma_lines(spark):
    raw = spark.createDataFrame([("1,ann,paris",), ("2,bob",)], "value string")
    assert [tuple(r) for r in feeds.comma_lines(raw, ("id", "name", "addr")).collect()] == [
        ("1", "ann", "paris"), ("2", "bob", None)]


def test_unknown_keys_stay_with_their_row(spark):
    """Keys that the schema doesn't know survive in all five streams, and in their JSON."""
    common = '"common": {"mid": "m", "is_new": "1", "os": "x", "n": 5}'
    page = '"page": {"page_id": "home", "during_time": 7, "refer": {"id": 3}}'
    text = ['{%s, %s, "displays": [{"item": "1"}], "actions": [{"action_id": "2"}], "err": {"msg": "e"},'
            ' "ts": 1}' % (common, page), '{%s, "start": {"entry": "icon"}, "ts": 2}' % common,
            '{"common": {"mid": "plain"}, "ts": 3}']
    log = logs.parse_text(spark.createDataFrame([(t,) for t in text], "value string")).clean
    streams = logs.split_log(log)._asdict()
    tagged = logs.tagged(log)
    for name, rows in streams.items():
        for some in (rows, logs.stream_of(tagged, name)):
            found = [r for r in some.collect() if r.common.mid == "m"]
            assert found and all(r.common_more == {"os": "x", "n": "5"} for r in found)
            assert all(r.page is None or r.page_more == {"refer": '{"id":3}'} for r in found)
    plain = streams["page"].filter("common.mid = 'plain'").first()
    assert plain.common_more is None and plain.page is None and plain.page_more is None
    whole = logs.whole_objects(streams["page"]).filter("common.mid = 'm'").first()
    assert whole.common == {"mid": "m", "is_new": "1", "os": "x", "n": "5"}
    assert whole.page == {"page_id": "home", "during_time": "7", "refer": '{"id":3}'}

