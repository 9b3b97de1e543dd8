"""The registered queries as plain SQL over the test tables, for an independent engine.

The SQL works on the tables directly: it states what each rule means, not how the mart does it.
"""

from __future__ import annotations

from tidemart.schemas import DICTIONARY_NAMES

_DIC = "dic(dic_code, dic_name) AS (VALUES " + ", ".join(
    f"('{code}', '{name}')" for code, name in DICTIONARY_NAMES.items()) + ")"

# --- behaviour log -----------------------------------------------------------------------------

_LOG = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms
  FROM events),
log AS (
  SELECT event_id, k, 'm' || user_id AS mid,
         CASE WHEN k % 10 <> 9 THEN CAST(user_id AS VARCHAR) END AS uid,
         CAST(k % 2 AS VARCHAR) AS is_new, 'v' || (k % 3) AS vc, event_type AS ch,
         'a' || (user_id % 5) AS ar,
         CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'good_detail'
              ELSE event_type END AS page_id,
         CASE k % 4 WHEN 1 THEN 'search' WHEN 2 THEN 'login' WHEN 3 THEN 'home' END AS last_page_id,
         CASE WHEN k % 4 = 1 THEN event_type || ' Deal ' || (k % 7) || ' sku' || k END AS item,
         CASE WHEN k % 8 = 1 THEN 'keyword' WHEN k % 4 = 1 THEN 'sku_id' END AS item_type,
         CAST(k * 100 AS BIGINT) AS during_time, ms AS ts,
         CAST(make_timestamp(ms * 1000) AS DATE) AS day,
         event_type = 'signup' AS is_start, event_type = 'error' AS is_error
  FROM ev),
page AS (SELECT * FROM log WHERE NOT is_start)"""

_PAGE_COLUMNS = ("event_id, mid, uid, is_new, vc, ch, ar, page_id, last_page_id, item, item_type, "
                 "during_time, ts")


def _log(body: str, *more: str) -> str:
    return "WITH " + ",".join([_LOG, *more]) + "\n" + body


def _bounds(ms: str, size_ms: int) -> str:
    start = f"({ms}) - ({ms}) % {size_ms}"
    return (f"strftime(make_timestamp(({start}) * 1000), '%Y-%m-%d %H:%M:%S') AS stt, "
            f"strftime(make_timestamp(({start} + {size_ms}) * 1000), '%Y-%m-%d %H:%M:%S') AS edt")


_SECOND, _HOUR, _DAY = 1000, 3_600_000, 86_400_000
_GAP = 6 * _HOUR

_REPAIRED = """
firsts AS (
  SELECT mid, first_value(CASE WHEN is_new = '1' THEN day ELSE day - 1 END)
              OVER (PARTITION BY mid ORDER BY ts, event_id) AS first_day, event_id
  FROM {source}),
repaired AS (
  SELECT l.* REPLACE (CASE WHEN l.is_new = '1' AND l.day <> f.first_day THEN '0'
                           ELSE l.is_new END AS is_new)
  FROM {source} l JOIN firsts f USING (event_id))"""

_VISITORS = """
inner_pages AS (
  SELECT *, lag(day) OVER (PARTITION BY mid ORDER BY ts, event_id) AS last_day
  FROM page WHERE last_page_id IS NOT NULL),
visitors AS (SELECT * FROM inner_pages WHERE last_day IS NULL OR last_day <> day)"""

_BOUNCES = f"""
followed AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(last_page_id) OVER w AS next_last
  FROM page WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id)),
bounced AS (
  SELECT * FROM followed
  WHERE last_page_id IS NULL AND (next_ts IS NULL OR next_ts - ts >= {_GAP} OR next_last IS NULL))"""


def _logins(return_days: int, size: int) -> str:
    return _log(f"""
SELECT {_bounds('ts', size)}, CAST(sum(back) AS BIGINT) AS back_ct, count(*) AS uu_ct
FROM (
  SELECT ts, CASE WHEN date_diff('day', last_day, day) >= {return_days} THEN 1 ELSE 0 END AS back
  FROM (SELECT ts, day, lag(day) OVER (PARTITION BY uid ORDER BY ts, event_id) AS last_day
        FROM page
        WHERE uid IS NOT NULL AND (last_page_id IS NULL OR last_page_id = 'login'))
  WHERE last_day IS NULL OR last_day <> day)
GROUP BY 1, 2""")


# --- change log --------------------------------------------------------------------------------

def _clock(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%d %H:%M:%S')"


def _date(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%d')"


_LINES = """
lines AS (
  SELECT *, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS detail_id,
         CAST(epoch(l_shipdate) AS BIGINT) + l_orderkey * 7919 % 86400 AS secs,
         CAST(l_extendedprice AS DECIMAL(16,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_discount AS DECIMAL(4,2))
              AS DECIMAL(16,2)) AS cut,
         CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_tax AS DECIMAL(4,2))
              AS DECIMAL(16,2)) AS tax,
         CAST(l_quantity AS INTEGER) AS num
  FROM lineitem)"""

_ORDERS = """
ord AS (
  SELECT *, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey * 7919 % 86400 AS secs,
         CASE WHEN o_orderkey % 3 <> 0 THEN 'update' ELSE 'insert' END AS type,
         CASE o_orderstatus WHEN 'O' THEN '1001' WHEN 'F' THEN '1003'
              ELSE CASE WHEN o_orderkey % 4 < 2 THEN '1005' ELSE '1006' END END AS order_status,
         CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN '1001' END AS old_status
  FROM orders)"""

_WIDE = f"""
wide AS (
  SELECT d.detail_id AS id, CAST(d.l_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_custkey AS VARCHAR) AS user_id, o.order_status,
         CAST(d.l_partkey AS VARCHAR) AS sku_id, 'sku-' || d.l_partkey AS sku_name,
         CAST(o.o_custkey % 27 AS VARCHAR) AS province_id,
         CAST(act.activity_id AS VARCHAR) AS activity_id,
         CAST(act.activity_rule_id AS VARCHAR) AS activity_rule_id,
         CAST(cou.coupon_id AS VARCHAR) AS coupon_id,
         {_date('d.secs')} AS date_id, {_clock('d.secs')} AS create_time,
         CASE WHEN o.type = 'update' THEN {_date('o.secs + 600')} END AS operate_date_id,
         CASE WHEN o.type = 'update' THEN {_clock('o.secs + 600')} END AS operate_time,
         CAST(d.l_suppkey AS VARCHAR) AS source_id, dic.dic_code AS source_type,
         dic.dic_name AS source_type_name, CAST(d.num AS VARCHAR) AS sku_num,
         CAST(CAST(d.num AS DECIMAL(16,2)) * d.price AS VARCHAR) AS split_original_amount,
         CASE WHEN d.l_discount >= 0.05 THEN CAST(d.cut AS VARCHAR) END AS split_activity_amount,
         CASE WHEN d.l_tax >= 0.06 THEN CAST(d.tax AS VARCHAR) END AS split_coupon_amount,
         CAST(d.price - d.cut - d.tax AS VARCHAR) AS split_total_amount,
         o.type, CAST(d.secs AS VARCHAR) AS od_ts, CAST(o.secs AS VARCHAR) AS oi_ts, o.old_status
  FROM lines d
  JOIN ord o ON d.l_orderkey = o.o_orderkey
  LEFT JOIN (SELECT detail_id, l_partkey % 10 AS activity_id, l_partkey % 30 AS activity_rule_id
             FROM lines WHERE l_discount >= 0.05) act ON d.detail_id = act.detail_id
  LEFT JOIN (SELECT detail_id, l_suppkey % 20 AS coupon_id
             FROM lines WHERE l_tax >= 0.06) cou ON d.detail_id = cou.detail_id
  JOIN dic ON CAST(2401 + d.l_suppkey % 5 AS VARCHAR) = dic.dic_code
  WHERE NOT (d.l_linestatus = 'O' AND d.l_linenumber = 7))"""

_DETAIL_HEAD = ("order_id, user_id, sku_id, sku_name, province_id, activity_id, activity_rule_id, "
                "coupon_id")
_DETAIL = f"""
detail AS (
  SELECT id, {_DETAIL_HEAD}, date_id, create_time, source_id, source_type AS source_type_code,
         source_type_name, sku_num, split_original_amount, split_activity_amount,
         split_coupon_amount, split_total_amount, od_ts AS ts
  FROM wide WHERE type = 'insert')"""

_SETTLED = """
settled AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, sku_id DESC, source_id DESC,
             sku_num DESC, split_original_amount DESC, split_total_amount DESC,
             activity_id DESC NULLS LAST, coupon_id DESC NULLS LAST) AS version
    FROM detail WHERE user_id IS NOT NULL AND source_type_name IS NOT NULL)
  WHERE version = 1)"""

_PAYMENTS = f"""
payments AS (
  SELECT d.id AS order_detail_id, d.order_id, d.user_id, d.sku_id, d.sku_name, d.province_id,
         d.activity_id, d.activity_rule_id, d.coupon_id, dic.dic_code AS payment_type_code,
         dic.dic_name AS payment_type_name, {_clock('o.secs + 900')} AS callback_time, d.source_id,
         d.source_type_code, d.source_type_name, d.sku_num, d.split_original_amount,
         d.split_activity_amount, d.split_coupon_amount,
         d.split_total_amount AS split_payment_amount, CAST(o.secs + 900 AS VARCHAR) AS ts
  FROM ord o JOIN detail d ON CAST(o.o_orderkey AS VARCHAR) = d.order_id
  JOIN dic ON CAST(1101 + o.o_custkey % 4 AS VARCHAR) = dic.dic_code
  WHERE o.o_orderstatus = 'P')"""

_REFUNDS = f"""
refunds AS (
  SELECT detail_id AS id, CAST(l_orderkey % 997 AS VARCHAR) AS user_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id,
         CAST(o_custkey % 27 AS VARCHAR) AS province_id, {_date('l.secs + 3600')} AS date_id,
         {_clock('l.secs + 3600')} AS create_time, kind.dic_code AS refund_type_code,
         kind.dic_name AS refund_type_name, reason.dic_code AS refund_reason_type_code,
         reason.dic_name AS refund_reason_type_name, 'reason ' || (l_partkey % 8) AS refund_reason_txt,
         CAST(num AS VARCHAR) AS refund_num, CAST(price AS VARCHAR) AS refund_amount,
         CAST(l.secs + 3600 AS VARCHAR) AS ts
  FROM lines l JOIN ord o ON l_orderkey = o_orderkey
  JOIN dic kind ON CAST(1501 + l_linenumber % 3 AS VARCHAR) = kind.dic_code
  JOIN dic reason ON CAST(1301 + l_partkey % 8 AS VARCHAR) = reason.dic_code
  WHERE l_returnflag = 'R' AND o.type = 'update' AND o.order_status = '1005'
    AND o.old_status IS NOT NULL)"""

_SKUS = """
sku AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_brand AS trademark_id,
               p_type AS category3_id, CAST(p_size AS VARCHAR) AS spu_id FROM part),
spu AS (SELECT CAST(p_size AS VARCHAR) AS spu_id, min(p_name) AS spu_name FROM part GROUP BY 1)"""

_BRAND_COLUMNS = """trademark_id, upper(trademark_id) AS trademark_name,
       CAST(length(category3_id) % 2 AS VARCHAR) AS category1_id,
       'class ' || (length(category3_id) % 2) AS category1_name,
       CAST(length(category3_id) AS VARCHAR) AS category2_id,
       'group ' || length(category3_id) AS category2_name,
       category3_id, lower(category3_id) AS category3_name"""

_CART = f"""
cart AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
         CAST(k * 3 AS VARCHAR) AS sku_id, CAST(k % 11 AS VARCHAR) AS source_id,
         dic_code AS source_type_code, dic_name AS source_type_name,
         CASE WHEN event_id % 3 = 0 THEN CASE WHEN k % 25 = 24 THEN 'n/a' ELSE CAST(k AS VARCHAR) END
              ELSE CAST(k - k * 7 % 100 AS VARCHAR) END AS sku_num,
         CAST(ms // 1000 AS VARCHAR) AS ts
  FROM ev JOIN dic ON CAST(2401 + k % 5 AS VARCHAR) = dic_code
  WHERE event_type = 'purchase'
    AND (event_id % 3 = 0 OR (k % 25 <> 24 AND event_id % 4 <> 0 AND k > k * 7 % 100)))"""

_IMAGES = """
images(sink_table, type, kept, pk, sku_name, tm_id, name, last_event, last_value, ts) AS (
  SELECT 'dim_user_info', CASE event_type WHEN 'signup' THEN 'insert' ELSE 'update' END,
         'id,last_event,last_value', CAST(user_id AS VARCHAR), NULL, NULL, NULL, event_id,
         CAST(CAST(value AS DECIMAL(16,2)) AS VARCHAR), CAST(ms // 1000 AS VARCHAR)
  FROM ev WHERE event_type IN ('signup', 'purchase')
  UNION ALL
  SELECT 'dim_sku_info', CASE p_partkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update'
                              ELSE 'bootstrap-insert' END,
         'category3_id,id,sku_name,tm_id', CAST(p_partkey AS VARCHAR), p_name, p_brand, NULL, NULL,
         NULL, CAST(1700000000 + p_partkey AS VARCHAR)
  FROM part WHERE p_partkey % 4 <> 3
  UNION ALL
  SELECT 'dim_base_province', 'bootstrap-insert', 'id,name', CAST(n_nationkey AS VARCHAR), NULL,
         NULL, n_name, NULL, NULL, CAST(1700000000 + n_nationkey AS VARCHAR)
  FROM nation)"""


def _with(body: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


_EV = _LOG[:_LOG.index("log AS")].rstrip().rstrip(",")
_LINE_ORDER = ("l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, "
               "l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, "
               "l_linestatus DESC")
_LATEST_LINE = f"""
SELECT * EXCLUDE (version) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER})
            AS version
  FROM lineitem)
WHERE version = 1"""


def _order_totals(keys: str, source: str, amount: str | None, count_name: str) -> str:
    total = f", CAST(sum({amount}) AS DOUBLE) AS order_amount" if amount else ""
    return (f"SELECT {_bounds('CAST(ts AS BIGINT) * 1000', _DAY)}, {keys}, "
            f"count(DISTINCT order_id) AS {count_name}{total} FROM {source} GROUP BY ALL")


ORACLE: dict[str, str] = {
    "dirty_split": _log("""
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'dirty' ELSE 'clean' END AS side,
       CASE WHEN k % 10 <> 0 THEN mid END AS mid, CASE WHEN k % 10 <> 0 THEN ts END AS ts
FROM log"""),
    "log_split_counts": _log("""
SELECT stream, is_new, CAST(sum(n) AS BIGINT) AS row_count FROM (
  SELECT 'page' AS stream, is_new, 1 AS n FROM repaired WHERE NOT is_start
  UNION ALL SELECT 'start', is_new, 1 FROM repaired WHERE is_start
  UNION ALL SELECT 'display', is_new, k % 3 FROM repaired WHERE NOT is_start
  UNION ALL SELECT 'action', is_new, k % 2 FROM repaired WHERE NOT is_start
  UNION ALL SELECT 'error', is_new, 1 FROM repaired WHERE is_error)
WHERE n > 0 GROUP BY 1, 2""", "clean AS (SELECT * FROM log WHERE k % 10 <> 0)",
                             _REPAIRED.format(source="clean")),
    "new_visitor_repair": _log("SELECT event_id, mid, is_new, ts FROM repaired",
                               _REPAIRED.format(source="log")),
    "log_page": _log(f"SELECT {_PAGE_COLUMNS} FROM page"),
    "log_start": _log("""
SELECT event_id, mid, 'icon' AS entry, CAST(k AS VARCHAR) AS loading_time,
       CASE WHEN k % 3 > 0 THEN k % 3 END AS display_count, ts
FROM log WHERE is_start"""),
    "log_display": _log("""
SELECT event_id, mid, page_id, CAST(k + place AS VARCHAR) AS item, CAST(place AS VARCHAR) AS pos_id,
       ts
FROM (SELECT *, unnest(range(1, k % 3 + 1)) AS place FROM page)"""),
    "log_action": _log("""
SELECT event_id, mid, page_id, 'favor_add' AS action_id, CAST(k AS VARCHAR) AS item
FROM page WHERE k % 2 = 1"""),
    "log_error": _log("""
SELECT event_id, mid, CAST(k + 1000 AS VARCHAR) AS error_code, page_id, ts
FROM log WHERE is_error"""),
    "unique_visitor_daily": _log(f"SELECT {_PAGE_COLUMNS} FROM visitors", _VISITORS),
    "bounce_detail": _log(f"SELECT {_PAGE_COLUMNS} FROM bounced", _BOUNCES),
    "keyword_window": _log(f"""
SELECT {_bounds('ts', _HOUR)}, 'SEARCH' AS source, keyword, count(*) AS keyword_count
FROM (SELECT ts, unnest(regexp_extract_all(lower(item), '[a-z0-9]+')) AS keyword
      FROM page WHERE item IS NOT NULL AND last_page_id = 'search' AND item_type = 'keyword')
GROUP BY ALL"""),
    "keyword_docs": r"""
SELECT lang, keyword, count(*) AS keyword_count
FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS keyword
      FROM documents)
GROUP BY ALL""",
    "traffic_window": _log(f"""
SELECT {_bounds('ts', _HOUR)}, vc AS version, ch AS channel, ar AS area, is_new,
       CAST(sum(uv) AS BIGINT) AS uv, CAST(sum(sv) AS BIGINT) AS sv, CAST(sum(pv) AS BIGINT) AS pv,
       CAST(sum(dur) AS BIGINT) AS duration_sum, CAST(sum(uj) AS BIGINT) AS bounce
FROM (
  SELECT ts, vc, ch, ar, is_new, 0 AS uv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS sv,
         1 AS pv, during_time AS dur, 0 AS uj FROM page
  UNION ALL SELECT ts + {_GAP}, vc, ch, ar, is_new, 0, 0, 0, 0, 1 FROM bounced
  UNION ALL SELECT ts, vc, ch, ar, is_new, 1, 0, 0, 0, 0 FROM visitors)
GROUP BY ALL""", _VISITORS, _BOUNCES),
    "home_detail_uv_window": _log(f"""
SELECT {_bounds('ts', _HOUR)}, count(*) FILTER (WHERE page_id = 'home') AS home_uv,
       count(*) FILTER (WHERE page_id = 'good_detail') AS detail_uv
FROM (SELECT *, row_number() OVER (PARTITION BY mid, page_id, day ORDER BY ts, event_id) AS visit
      FROM page WHERE page_id IN ('home', 'good_detail'))
WHERE visit = 1 GROUP BY 1, 2"""),
    "login_back_window": _logins(4, _HOUR),
    "login_back_window_default": _logins(8, 10 * _SECOND),
    "register_window": _with(f"""
SELECT {_bounds('ms', _HOUR)}, count(*) AS register_ct
FROM ev WHERE event_type = 'signup' GROUP BY 1, 2""", _EV),
    "cart_unique_window": _with(f"""
SELECT {_bounds('ts', _HOUR)}, count(*) AS cart_uu_ct
FROM (SELECT min(CAST(ts AS BIGINT)) * 1000 AS ts FROM cart
      GROUP BY user_id, CAST(ts AS BIGINT) // 86400)
GROUP BY 1, 2""", _EV, _DIC, _CART),
    "cdc_extract": _with(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
       CAST(o_custkey % 27 AS VARCHAR) AS province_id,
       CASE WHEN type = 'update' THEN {_clock('secs + 600')} END AS operate_time, order_status, type,
       old_status, CAST(secs AS VARCHAR) AS ts
FROM ord""", _ORDERS),
    "status_change": _with("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, order_status, CAST(secs AS VARCHAR) AS ts
FROM ord WHERE type = 'update' AND old_status IS NOT NULL
  AND order_status IN ('1003', '1005', '1006')""", _ORDERS),
    "cart_delta": _with("SELECT * FROM cart", _EV, _DIC, _CART),
    "order_wide": _with("SELECT * FROM wide", _LINES, _ORDERS, _DIC, _WIDE),
    "order_detail": _with("SELECT * FROM detail", _LINES, _ORDERS, _DIC, _WIDE, _DETAIL),
    "order_cancel": _with(f"""
SELECT id, {_DETAIL_HEAD}, operate_date_id AS date_id, operate_time AS cancel_time, source_id,
       source_type AS source_type_code, source_type_name, sku_num, split_original_amount,
       split_activity_amount, split_coupon_amount, split_total_amount, oi_ts AS ts
FROM wide WHERE type = 'update' AND old_status IS NOT NULL AND order_status = '1003'""",
                          _LINES, _ORDERS, _DIC, _WIDE),
    "payment_detail": _with("SELECT * FROM payments", _LINES, _ORDERS, _DIC, _WIDE, _DETAIL,
                            _PAYMENTS),
    "refund_detail": _with("SELECT * FROM refunds", _LINES, _ORDERS, _DIC, _REFUNDS),
    "refund_paid": _with(f"""
SELECT p.detail_id AS id, CAST(o.o_custkey AS VARCHAR) AS user_id,
       CAST(p.l_orderkey AS VARCHAR) AS order_id, CAST(p.l_partkey AS VARCHAR) AS sku_id,
       CAST(o.o_custkey % 27 AS VARCHAR) AS province_id, dic_code AS payment_type_code,
       dic_name AS payment_type_name, {_date('p.secs + 7200')} AS date_id,
       {_clock('p.secs + 7200')} AS callback_time, CAST(i.num AS VARCHAR) AS refund_num,
       CAST(p.price AS VARCHAR) AS refund_amount, CAST(p.secs + 7200 AS VARCHAR) AS ts
FROM lines p JOIN ord o ON p.l_orderkey = o.o_orderkey
JOIN lines i ON p.l_orderkey = i.l_orderkey AND p.l_partkey = i.l_partkey AND i.l_returnflag = 'R'
JOIN dic ON CAST(1101 + p.l_suppkey % 4 AS VARCHAR) = dic_code
WHERE p.l_returnflag = 'R' AND p.l_linestatus = 'F' AND o.type = 'update'
  AND o.order_status = '1006' AND o.old_status IS NOT NULL""", _LINES, _ORDERS, _DIC),
    "coupon_get": _with(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 50 AS VARCHAR) AS coupon_id,
       CAST(o_custkey AS VARCHAR) AS user_id, {_date('secs - 86400')} AS date_id,
       {_clock('secs - 86400')} AS get_time, CAST(secs AS VARCHAR) AS ts
FROM ord WHERE o_orderkey % 4 = 0""", _ORDERS),
    "coupon_order": _with(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 50 AS VARCHAR) AS coupon_id,
       CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       {_date('secs')} AS date_id, {_clock('secs')} AS order_time, CAST(secs AS VARCHAR) AS ts
FROM ord WHERE o_orderkey % 4 = 1""", _ORDERS),
    "coupon_pay": _with(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 50 AS VARCHAR) AS coupon_id,
       CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       {_date('secs + 900')} AS date_id, {_clock('secs + 900')} AS payment_time,
       CAST(secs AS VARCHAR) AS ts
FROM ord WHERE o_orderkey % 4 = 2""", _ORDERS),
    "favor_add": _with(f"""
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
       CAST(k AS VARCHAR) AS sku_id, {_date('ms // 1000')} AS date_id,
       {_clock('ms // 1000')} AS create_time, CAST(ms // 1000 AS VARCHAR) AS ts
FROM ev WHERE event_type = 'click'""", _EV),
    "comment_dic": _with(f"""
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
       CAST(k AS VARCHAR) AS sku_id, CAST(event_id * 2 AS VARCHAR) AS order_id,
       {_date('ms // 1000')} AS date_id, {_clock('ms // 1000')} AS create_time,
       dic_code AS appraise_code, dic_name AS appraise_name, CAST(ms // 1000 AS VARCHAR) AS ts
FROM ev JOIN dic ON CAST(1201 + k % 5 AS VARCHAR) = dic_code
WHERE event_type = 'view'""", _EV, _DIC),
    "comment_unnamed": _with("""
SELECT CAST(1201 + k % 5 AS VARCHAR) AS appraise, count(*) AS row_count
FROM ev WHERE event_type = 'view' AND k % 5 = 4 GROUP BY 1""", _EV),
    "user_register": _with(f"""
SELECT CAST(user_id AS VARCHAR) AS user_id, {_date('ms // 1000')} AS date_id,
       {_clock('ms // 1000')} AS create_time, CAST(ms // 1000 AS VARCHAR) AS ts
FROM ev WHERE event_type = 'signup'""", _EV),
    "order_window": _with(f"""
SELECT {_bounds('CAST(ts AS BIGINT) * 1000', _DAY)}, CAST(sum(uniq) AS BIGINT) AS unique_users,
       CAST(sum(fresh) AS BIGINT) AS new_users,
       CAST(sum(coalesce(CAST(split_activity_amount AS DECIMAL(16,2)), 0)) AS DOUBLE)
         AS activity_reduce,
       CAST(sum(coalesce(CAST(split_coupon_amount AS DECIMAL(16,2)), 0)) AS DOUBLE)
         AS coupon_reduce,
       CAST(sum(CAST(split_original_amount AS DECIMAL(16,2))) AS DOUBLE) AS original_total
FROM (
  SELECT *, CASE WHEN last IS NULL OR last <> date_id THEN 1 ELSE 0 END AS uniq,
         CASE WHEN last IS NULL THEN 1 ELSE 0 END AS fresh
  FROM (SELECT *, lag(date_id) OVER (PARTITION BY user_id ORDER BY CAST(ts AS BIGINT), id) AS last
        FROM settled))
GROUP BY 1, 2""", _LINES, _ORDERS, _DIC, _WIDE, _DETAIL, _SETTLED),
    "payment_window": _with(f"""
SELECT {_bounds('CAST(ts AS BIGINT) * 1000', _DAY)}, CAST(sum(uniq) AS BIGINT) AS unique_users,
       CAST(sum(fresh) AS BIGINT) AS new_users
FROM (
  SELECT ts, CASE WHEN last IS NULL OR last <> day THEN 1 ELSE 0 END AS uniq,
         CASE WHEN last IS NULL THEN 1 ELSE 0 END AS fresh
  FROM (SELECT ts, CAST(ts AS BIGINT) // 86400 AS day,
               lag(CAST(ts AS BIGINT) // 86400)
                 OVER (PARTITION BY user_id ORDER BY CAST(ts AS BIGINT), order_detail_id) AS last
        FROM (SELECT DISTINCT order_detail_id, user_id, ts FROM payments)))
GROUP BY 1, 2""", _LINES, _ORDERS, _DIC, _WIDE, _DETAIL, _PAYMENTS),
    "province_window": _with(f"""
SELECT t.* EXCLUDE (order_count, order_amount), coalesce(n_name, '') AS province_name, order_count,
       order_amount
FROM ({_order_totals('province_id', 'settled', 'CAST(split_total_amount AS DECIMAL(16,2))',
                     'order_count')}) t
LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = province_id""",
                             _LINES, _ORDERS, _DIC, _WIDE, _DETAIL, _SETTLED),
    "user_spu_window": _with(f"""
SELECT stt, edt, {_BRAND_COLUMNS}, user_id, spu_id, spu_name, order_count, order_amount
FROM ({_order_totals('trademark_id, category3_id, user_id, spu_id',
                     '(SELECT * FROM settled LEFT JOIN sku USING (sku_id))',
                     'CAST(split_total_amount AS DECIMAL(16,2))', 'order_count')})
LEFT JOIN spu USING (spu_id)""", _LINES, _ORDERS, _DIC, _WIDE, _DETAIL, _SETTLED, _SKUS),
    "brand_refund_window": _with(f"""
SELECT stt, edt, {_BRAND_COLUMNS}, user_id, refund_count
FROM ({_order_totals('trademark_id, category3_id, user_id',
                     '(SELECT * FROM refunds LEFT JOIN sku USING (sku_id))', None,
                     'refund_count')})""", _LINES, _ORDERS, _DIC, _REFUNDS, _SKUS),
    "dim_route": _with("""
SELECT sink_table, type, kept, count(*) AS row_count, count(DISTINCT pk) AS key_count
FROM images GROUP BY ALL""", _EV, _IMAGES),
    "dim_latest": _with("""
SELECT sink_table, pk, sku_name, tm_id, name, last_event, last_value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY sink_table, pk
                               ORDER BY ts DESC, last_event DESC NULLS LAST) AS version
  FROM images)
WHERE version = 1""", _EV, _IMAGES),
    "dim_unrouted": _with("""
SELECT 'order_detail' AS "table", count(*) AS row_count FROM lineitem
UNION ALL SELECT 'order_detail_activity', count(*) FROM lineitem WHERE l_discount >= 0.05
UNION ALL SELECT 'order_detail_coupon', count(*) FROM lineitem WHERE l_tax >= 0.06
UNION ALL SELECT 'order_refund_info', count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'refund_payment', count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'order_info', count(*) FROM orders
UNION ALL SELECT 'payment_info', count(*) FROM orders
UNION ALL SELECT 'coupon_use', count(*) FROM orders
UNION ALL SELECT CASE event_type WHEN 'purchase' THEN 'cart_info' WHEN 'click' THEN 'favor_info'
                                 ELSE 'comment_info' END, count(*)
FROM ev WHERE event_type IN ('purchase', 'click', 'view') GROUP BY 1""", _EV),
    "latest_by_key": _LATEST_LINE,
    "upsert_by_key": _LATEST_LINE,
    "changelog_count": "SELECT user_id, count(*) AS row_count FROM events GROUP BY 1",
    "left_lookup": _with("""
SELECT CAST(event_id AS VARCHAR) AS id, CAST(1201 + k % 5 AS VARCHAR) AS appraise,
       dic_name AS appraise_name
FROM ev LEFT JOIN dic ON CAST(1201 + k % 5 AS VARCHAR) = dic_code
WHERE event_type = 'view'""", _EV, _DIC),
    "two_key_lookup": """
SELECT CAST(r.l_orderkey * 10 + r.l_linenumber AS VARCHAR) AS id, r.l_orderkey AS order_id,
       r.l_partkey AS sku_id, CASE WHEN r.l_linestatus = 'F' THEN '0702' ELSE '0701' END
         AS refund_status, i.l_linenumber AS line, i.l_quantity AS quantity
FROM lineitem r LEFT JOIN (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
                                 ORDER BY l_linenumber DESC, l_quantity DESC) AS version
    FROM lineitem) WHERE version = 1) i
  ON r.l_orderkey = i.l_orderkey AND r.l_partkey = i.l_partkey
WHERE r.l_returnflag = 'R'""",
    "click_filter_count": _log(f"""
SELECT {_bounds('ts', _HOUR)}, uid AS user, count(*) AS row_count
FROM log WHERE ch = 'click' GROUP BY ALL"""),
}

# Streams end with the rows of their batch form.
ORACLE.update({f"stream_{name}": ORACLE[name] for name in (
    "bounce_detail", "new_visitor_repair", "unique_visitor_daily", "keyword_window", "register_window",
    "traffic_window", "cart_delta", "refund_detail", "changelog_count")})
ORACLE["stream_login_days"] = _log("""
SELECT uid AS user_id, ts, CAST(1 AS BIGINT) AS uu_ct,
       CAST(CASE WHEN date_diff('day', last_day, day) >= 4 THEN 1 ELSE 0 END AS BIGINT) AS back_ct
FROM (SELECT *, lag(day) OVER (PARTITION BY uid ORDER BY ts, event_id) AS last_day
      FROM page WHERE uid IS NOT NULL AND (last_page_id IS NULL OR last_page_id = 'login'))
WHERE last_day IS NULL OR last_day <> day""")
ORACLE["stream_page_visitors"] = _log("""
SELECT mid, page_id, min(ts) AS ts
FROM page WHERE page_id IN ('home', 'good_detail') GROUP BY mid, page_id, day""")

ORACLE["stream_comment_dic"] = ORACLE["comment_dic"]
ORACLE["stream_changelog_retract"] = """
SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS row_count
FROM events GROUP BY 1 HAVING sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) > 0"""

# An order and all that belongs to it are written at one moment.
_SECS = "CAST(epoch({}) AS BIGINT) + {} * 7919 % 86400 AS secs"
_LINES_TOGETHER = _LINES.replace(_SECS.format("l_shipdate", "l_orderkey"),
                                 "1700000000 + l_orderkey * 60 AS secs")
_ORDERS_TOGETHER = _ORDERS.replace(_SECS.format("o_orderdate", "o_orderkey"),
                                   "1700000000 + o_orderkey * 60 AS secs")
_TOGETHER = {"stream_order_wide": "order_wide", "stream_order_window": "order_window",
             "stream_province_window": "province_window",
             "stream_payment_window": "payment_window", "stream_refund_near": "refund_detail"}
ORACLE.update({stream: ORACLE[name].replace(_LINES, _LINES_TOGETHER).replace(
    _ORDERS, _ORDERS_TOGETHER) for stream, name in _TOGETHER.items()})

# The same rows, however the feed arrives.
ORACLE["change_text"] = ORACLE["stream_change_tables"] = ORACLE["coupon_order"]

# Users are routed in the first two of three micro-batches, provinces in the last two, and the
# products have their full columns in the last two.
ORACLE["stream_dim_route"] = _with("""
SELECT 'dim_user_info' AS sink_table, pk AS id, NULL AS sku_name, NULL AS tm_id,
       NULL AS category3_id, NULL AS name, CAST(last_event AS VARCHAR) AS last_event
FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY CAST(ts AS BIGINT) DESC,
                                   last_event DESC) AS version
      FROM images WHERE sink_table = 'dim_user_info' AND last_event % 3 <> 2)
WHERE version = 1
UNION ALL
SELECT 'dim_sku_info', CAST(p_partkey AS VARCHAR), p_name,
       CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, CASE WHEN p_partkey % 3 <> 0 THEN p_type END,
       NULL, NULL
FROM part WHERE p_partkey % 4 <> 3
UNION ALL
SELECT 'dim_base_province', CAST(n_nationkey AS VARCHAR), NULL, NULL, NULL, n_name, NULL
FROM nation WHERE n_nationkey % 3 <> 0""", _EV, _IMAGES)

ORACLE["stream_log_split"] = _log("""
SELECT event_id, stream, mid, is_new, 'os' || vc AS os, CAST(event_id % 11 AS VARCHAR) AS refer_id,
       detail
FROM (
  SELECT *, 'page' AS stream, last_page_id AS detail FROM repaired WHERE NOT is_start
  UNION ALL SELECT *, 'start', CAST(k AS VARCHAR) FROM repaired WHERE is_start
  UNION ALL SELECT * EXCLUDE (place), 'display', CAST(k + place AS VARCHAR)
  FROM (SELECT *, unnest(range(1, k % 3 + 1)) AS place FROM repaired WHERE NOT is_start)
  UNION ALL SELECT *, 'action', CAST(k AS VARCHAR) FROM repaired WHERE NOT is_start AND k % 2 = 1
  UNION ALL SELECT *, 'error', CAST(k + 1000 AS VARCHAR) FROM repaired WHERE is_error)""",
                                  "clean AS (SELECT * FROM log WHERE k % 10 <> 0)",
                                  _REPAIRED.format(source="clean"))
