"""The retail view in ANSI SQL, for the side-by-side check of every query.

``with_views`` puts in front of a statement the common table expressions it
names, and those they name in turn.
"""

from __future__ import annotations

import re

from counterlift.sources.retail_views import MEDIA

VIEWS: dict[str, str] = {}


def _case(expr: str, pos: int) -> str:
    arms = " ".join(f"WHEN {i} THEN '{m[pos]}'" for i, m in enumerate(MEDIA))
    return f"CASE {expr} {arms} END"


def _fold(col: str) -> str:
    return (
        "DATE '2023-09-03' + CAST(date_diff('day', DATE '1995-01-01', "
        f"CAST({col} AS DATE)) % 168 AS INTEGER)"
    )


VIEWS["sales"] = f"""
SELECT l_suppkey AS site, CAST(l_partkey AS VARCHAR) AS article, {_fold('l_shipdate')} AS txn_date,
       CAST(l_orderkey AS VARCHAR) AS basket_key, l_extendedprice * (1 - l_discount) AS sales_amount,
       l_quantity AS units, CASE WHEN l_linenumber = 1 THEN 'Online' ELSE 'In Store' END AS channel,
       1005 AS sales_org
FROM lineitem"""

VIEWS["store_sales"] = "SELECT * FROM sales WHERE lower(channel) <> 'online' AND sales_org = 1005"

VIEWS["price_lines"] = f"""
SELECT CAST(l_partkey AS VARCHAR) AS article, {_fold('l_shipdate')} AS txn_date,
       l_extendedprice * (1 - l_discount) / 50 AS amount, p_retailprice AS unit_price, l_quantity AS quantity
FROM lineitem JOIN part ON p_partkey = l_partkey"""

VIEWS["articles"] = """
SELECT CAST(p_partkey AS VARCHAR) AS article, p_name AS description, p_brand AS brand,
       'CAT' || CAST(p_size % 5 AS VARCHAR) AS category, p_type AS subcat
FROM part"""

VIEWS["sites"] = "SELECT s_suppkey AS site, CAST(floor(s_suppkey / 50.0) AS BIGINT) AS area FROM supplier"

VIEWS["line_skus"] = """
SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b, CAST(floor(p_partkey / 1000.0) AS INTEGER) AS blk,
       p_partkey
FROM part"""

VIEWS["line_stores"] = """
SELECT s_suppkey % 4 AS bmod, CAST(floor(s_suppkey / 50.0) AS INTEGER) AS blk,
       string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS store_list
FROM supplier GROUP BY 1, 2"""

VIEWS["line_lists"] = """
SELECT a.b, a.blk, a.main_sku, coalesce(a.repeat_sku, '') AS repeat_sku, s.store_list,
       DATE '2023-09-03' + (98 + (a.b % 5) * 7) AS start_date
FROM (SELECT b, blk, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS main_sku,
             string_agg(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END, ','
                        ORDER BY CAST(p_partkey AS VARCHAR)) AS repeat_sku
      FROM line_skus GROUP BY 1, 2) a
LEFT JOIN line_stores s ON s.bmod = a.b % 4 AND s.blk = a.blk"""

VIEWS["booking_kinds"] = """
SELECT *, 'main' AS kind, 'L' AS tag, 0 AS shift, 27 AS len, main_sku || ',NPD,' AS quoteline_sku, (b + blk) % 8 AS idx
FROM line_lists
UNION ALL SELECT *, 'repeat', 'R', -21, 20, repeat_sku, 0 FROM line_lists WHERE b % 4 = 0
UNION ALL SELECT *, 'empty', 'E', 0, 27, 'npd', 0 FROM line_lists WHERE b % 6 = 0"""

VIEWS["bookings"] = f"""
SELECT 'BK' || lpad(CAST(b AS VARCHAR), 2, '0') AS booking_number, tag || CAST(blk AS VARCHAR) AS line_name, kind,
       {_case('idx', 0)} AS media_type, {_case('idx', 1)} AS media_location, {_case('idx', 2)} AS media,
       'Supermarket' AS business_unit, CASE WHEN b % 12 = 11 THEN 'Draft' ELSE 'Approved' END AS quote_status,
       start_date + shift AS campaign_start_date, start_date + (shift + len) AS campaign_end_date,
       start_date + (shift + 7 * (blk % 2)) AS media_start_date, start_date + (shift + len) AS media_end_date,
       quoteline_sku, store_list, CAST(blk % 3 + 1 AS BIGINT) AS quantity,
       CAST(1000 + b * 10 + blk AS DOUBLE) AS media_spend
FROM booking_kinds"""

VIEWS["campaigns"] = """
SELECT booking_number AS campaign_id, min(media_start_date) AS media_start_date, max(media_end_date) AS media_end_date,
       min(campaign_start_date) AS campaign_start_date, max(campaign_end_date) AS campaign_end_date
FROM bookings WHERE kind = 'main' GROUP BY 1"""

VIEWS["campaign_skus"] = """
SELECT 'BK' || lpad(CAST(b AS VARCHAR), 2, '0') AS campaign_id, CAST(p_partkey AS VARCHAR) AS article FROM line_skus"""

VIEWS["campaign_stores"] = """
SELECT 'BK' || lpad(CAST(b AS VARCHAR), 2, '0') AS campaign_id, s_suppkey AS site
FROM (SELECT DISTINCT b FROM line_skus) x JOIN supplier ON s_suppkey % 4 = b % 4"""

VIEWS["compliance"] = """
SELECT booking_number AS campaign_id, line_name AS quote_line, store_id, w.label AS week_number,
       CASE WHEN (CAST(store_id AS BIGINT) + CAST(substr(booking_number, 3, 2) AS BIGINT) + w.n) % 3 > 0
            THEN 1 ELSE 0 END AS result,
       CASE WHEN CAST(store_id AS BIGINT) % 17 = 0 THEN 1 ELSE 0 END AS missing_record_flag
FROM (SELECT *, unnest(string_split(store_list, ',')) AS store_id FROM bookings
      WHERE kind = 'main' AND media_location NOT IN ('Digital', 'None')) x
CROSS JOIN (VALUES ('Installation', 1), ('Week 2', 2), ('Week 3', 3)) w(label, n)"""

VIEWS["ev"] = """
SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
FROM events"""

VIEWS["stock"] = """
SELECT CAST(k AS VARCHAR) AS article, user_id AS site, CAST(ts AS DATE) AS soh_date, hour(ts) AS soh_hour,
       min(CASE WHEN value < 8 THEN 0.0 ELSE CAST(floor(value) AS DOUBLE) END) AS soh
FROM ev GROUP BY 1, 2, 3, 4"""

_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_hours = []
for _i, _d in enumerate(_DAYS):
    _open = f"lpad(CAST(6 + (s_suppkey + {_i}) % 3 AS VARCHAR), 2, '0') || '0000'"
    if _i == 0:
        _open = f"CASE WHEN s_suppkey % 23 = 0 THEN '' ELSE {_open} END"
    _hours.append(f"{_open} AS {_d}_open")
    _hours.append(
        f"CASE (s_suppkey + {_i}) % 4 WHEN 0 THEN '240000' WHEN 1 THEN '213000' ELSE '220000' END AS {_d}_close"
    )
VIEWS["site_hours"] = "SELECT s_suppkey AS site, " + ", ".join(_hours) + " FROM supplier"

VIEWS["transactions"] = f"""
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'Online Order' ELSE 'Instore Order' END AS order_context,
       {_fold('o_orderdate')} AS start_txn_date,
       CAST({_fold('o_orderdate')} AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS start_txn_time,
       CAST(o_custkey AS VARCHAR) AS shopper_id, CAST(l_partkey AS VARCHAR) AS article, p_brand AS brand,
       p_type AS subcat, CAST(l_orderkey AS VARCHAR) AS basket_key, l_extendedprice * (1 - l_discount) AS amount
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""

VIEWS["hits"] = """
SELECT event_id, CAST(user_id AS VARCHAR) AS visitor_id, ts AS date_time,
       CASE event_type WHEN 'view' THEN 'ww:shop:catalogue' WHEN 'signup' THEN 'ww:homepage'
            WHEN 'click' THEN 'ww:shop:asset' WHEN 'purchase' THEN 'ww:order:confirmation'
            ELSE 'ww:other' END AS page_name,
       CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'Catalogue' ELSE 'shop' END AS section,
       CASE WHEN event_type = 'click' THEN
            CASE WHEN k % 10 = 0 THEN 'BK' || lpad(CAST(k % 25 + 1 AS VARCHAR), 2, '0')
                 ELSE 'BK' || lpad(CAST(k % 25 + 1 AS VARCHAR), 2, '0') || ':web:x:L'
                      || CAST((k // 25) % 2 AS VARCHAR) END END AS packed_key,
       CASE WHEN event_type = 'purchase' THEN 'Order Confirmation Section' ELSE 'Browse' END AS channel,
       CASE WHEN event_type IN ('click', 'view') THEN 'impression' ELSE 'other' END AS action,
       CASE WHEN k % 2 = 0 THEN 'web' ELSE 'app' END AS site_platform,
       CASE WHEN event_type IN ('click', 'view') THEN ' term' || CAST(k % 7 AS VARCHAR) || ' | rest' END AS search_term
FROM ev"""

VIEWS["id_map"] = """
SELECT CAST(user_id AS VARCHAR) AS visitor_id, 'S' || CAST(user_id * 10 + w.n AS VARCHAR) AS shopper_id,
       CASE WHEN user_id % 11 <> 0 THEN CAST(user_id * 10 + w.n AS VARCHAR) END AS crn,
       w.a AS effective_time, w.z AS expiry_time
FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (VALUES (0, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-16 12:00:00'),
                   (1, TIMESTAMP '2024-01-16 00:00:00', TIMESTAMP '2024-02-01 00:00:00')) w(n, a, z)"""


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in VIEWS and word not in ordered and word not in pending:
                pending.add(word)
                visit(VIEWS[word])
                ordered.append(word)

    pending: set[str] = set()
    visit(sql)
    if not ordered:
        return sql
    texts = [sql, *[VIEWS[name] for name in ordered]]

    def shape(name: str) -> str:
        """A view that is read several times is computed once."""
        often = sum(len(re.findall(rf"\b{name}\b", text)) for text in texts)
        return f"{name} AS {'MATERIALIZED ' if often > 1 else ''}({VIEWS[name].strip()})"

    head = ",\n".join(shape(name) for name in ordered)
    return f"WITH {head}\n{sql.strip()}"
