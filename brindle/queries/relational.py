"""Scans, filters, joins, subqueries, set operations, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators.joins import asof_join, dominance_join, interval_join
from brindle.operators.log import numbered

from .base import Entry, frame, sql

MONEY = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE)"


def _asof(customer_orders, events):
    left = events.select("event_id", "user_id", "ts")
    right = customer_orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate"), "o_orderkey")
    return asof_join(left, right, on="user_id", left_time="ts", right_time="o_orderdate", take=["o_orderkey"], tie_break="o_orderkey", bin_width=90 * 86400).select("event_id", F.col("o_orderkey").alias("last_order"))


def _interval(events):
    a = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("p_ts"))
    b = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("c_ts"))
    return interval_join(a, b, a["user_id"] == b["u"], point="c_ts", low=F.col("p_ts") - F.expr("INTERVAL 1 HOUR"), high=F.col("p_ts"), width_seconds=3600).select("purchase_id", "click_id")


def _theta_range(part):
    a = part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    b = part.select(F.col("p_partkey").alias("other"), "p_brand", F.col("p_size").alias("other_size"), (F.col("p_retailprice") + 800).alias("above"))
    return dominance_join(a, b, on="p_brand", less=("p_size", "other_size"), more=("p_retailprice", "above")).select("p_partkey", "other")


def _sort_nulls(orders):
    rows = orders.select("o_orderkey", F.expr("NULLIF(o_orderpriority, '2-HIGH')").alias("k"))
    up = numbered(rows, [F.col("k").asc_nulls_last(), "o_orderkey"], "up", 1)
    return numbered(up, [F.col("k").desc_nulls_first(), "o_orderkey"], "down", 1).select("o_orderkey", "up", "down")


ENTRIES: dict[str, Entry] = {
    "flagship_revenue_by_nation": sql(f"""
        SELECT n_name, {MONEY} AS revenue, COUNT(*) AS items
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10"""),
    "scan_project": sql("SELECT o_orderkey, o_totalprice FROM orders"),
    "scan_count": sql("SELECT COUNT(*) AS n FROM lineitem"),
    "project_star_exclude": sql("SELECT * EXCLUDE (c_acctbal) FROM customer"),
    "filter_predicates": sql("""
        SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
        WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'"""),
    "filter_null_logic": sql("""
        SELECT o_orderkey, k IS NULL AS is_null, k IS NOT DISTINCT FROM 'O' AS same, (k = 'O') IS UNKNOWN AS unknown, (k = 'O') IS TRUE AS sure
        FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS k FROM orders) t WHERE (k <> 'P') IS NOT FALSE""", """
        SELECT o_orderkey, k IS NULL AS is_null, k IS NOT DISTINCT FROM 'O' AS same, (k = 'O') IS NULL AS unknown, coalesce(k = 'O', false) AS sure
        FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS k FROM orders) t WHERE coalesce(k <> 'P', true)"""),
    "case_cast": sql("""
        SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band,
          CAST(p_size AS VARCHAR) AS size_text, p_retailprice::INT8 AS whole, COALESCE(NULLIF(p_size, 1), -1) AS filled FROM part""", """
        SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band,
          CAST(p_size AS VARCHAR) AS size_text, CAST(trunc(p_retailprice) AS BIGINT) AS whole, COALESCE(NULLIF(p_size, 1), -1) AS filled FROM part"""),
    "try_cast": sql("SELECT conv_id, turn, TRY_CAST(role AS INT) AS number, TRY_CAST(turn::TEXT AS INT) AS same FROM conversations"),
    "regex_like": sql("SELECT p_partkey, p_type ~ '^[A-M].*' AS early, p_name !~* 'A' AS no_a, p_type ~* 'brass' AS brass, p_type !~ '^S' AS no_s FROM part", "SELECT p_partkey, regexp_matches(p_type, '^[A-M].*') AS early, NOT regexp_matches(p_name, '(?i)A') AS no_a, regexp_matches(p_type, '(?i)brass') AS brass, NOT regexp_matches(p_type, '^S') AS no_s FROM part"),
    "similar_to": sql("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#[1-3].*' AND p_type NOT SIMILAR TO p_brand"),
    "like_ilike": sql("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%' AND c_name LIKE '%1%' AND c_name NOT LIKE '%9'"),
    "int_div": sql("SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, -o_orderkey / 7 AS nq, o_totalprice / 2 AS half, o_custkey / (o_orderkey / 9 + 1) / 2 AS nested FROM orders WHERE o_custkey / 3 >= 0", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, CAST(trunc(-o_orderkey / 7) AS BIGINT) AS nq, o_totalprice / 2 AS half, o_custkey // (o_orderkey // 9 + 1) // 2 AS nested FROM orders"),
    "arithmetic_bits": sql("SELECT p_partkey, p_size & 6 AS b_and, p_size | 8 AS b_or, p_size # 5 AS b_xor, p_size << 2 AS b_left, p_size >> 1 AS b_right, -p_size AS negated, p_size * 3 - 1 AS line FROM part", "SELECT p_partkey, p_size & 6 AS b_and, p_size | 8 AS b_or, xor(p_size, 5) AS b_xor, p_size << 2 AS b_left, p_size >> 1 AS b_right, -p_size AS negated, p_size * 3 - 1 AS line FROM part"),
    "string_concat_op": sql("SELECT n_nationkey, n_name || '/' || n_regionkey::VARCHAR AS path FROM nation"),
    "join_inner": sql("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "join_left": sql("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    "join_right": sql("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'"),
    "join_full": sql("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_nationkey < 5"),
    "join_cross": sql("SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_semi": sql("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": sql("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000"),
    "join_right_semi": frame(lambda o, c: c.join(o, o["o_custkey"] == c["c_custkey"], "left_semi").select("c_custkey", "c_name"), "orders", "customer", oracle="SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "join_theta_range": frame(_theta_range, "part", oracle="SELECT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND a.p_retailprice > b.p_retailprice + 800"),
    "join_using": sql("SELECT k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) a JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey) b USING (k)"),
    "join_natural": sql("SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n NATURAL JOIN region"),
    "join_lateral": sql("SELECT c_custkey, top_price FROM customer, LATERAL (SELECT MAX(o_totalprice) AS top_price FROM orders WHERE o_custkey = c_custkey) t"),
    "join_self": sql("SELECT a.event_id, b.event_id AS next_id FROM events a JOIN events b ON a.event_id + 1 = b.event_id AND a.event_type = b.event_type"),
    "join_null_safe": sql("SELECT a.k AS ka, b.k AS kb FROM (SELECT NULLIF(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 0) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k"),
    "join_asof": frame(_asof, "orders", "events", oracle="""
        SELECT event_id, (SELECT o_orderkey FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM events"""),
    "join_interval": frame(_interval, "events", oracle="""
        SELECT p.event_id AS purchase_id, c.event_id AS click_id FROM events p JOIN events c
        ON p.user_id = c.user_id AND c.ts >= p.ts - INTERVAL 1 HOUR AND c.ts <= p.ts WHERE p.event_type = 'purchase' AND c.event_type = 'click'"""),
    "subq_scalar": sql("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)"),
    "subq_exists": sql("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)"),
    "subq_not_exists": sql("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 0)"),
    "subq_in": sql("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"),
    "subq_not_in_nulls": sql("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 99) FROM region)"),
    "subq_not_in_with_null": sql("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 2) FROM region)"),
    "subq_correlated": sql("SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "subq_from": sql("SELECT seg, MAX(n) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY seg"),
    "sort_nulls": sql("""
        SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY k, o_orderkey) AS up, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY k DESC, o_orderkey) AS down
        FROM (SELECT o_orderkey, o_custkey, NULLIF(o_orderpriority, '2-HIGH') AS k FROM orders) t""", """
        SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY k ASC NULLS LAST, o_orderkey) AS up, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY k DESC NULLS FIRST, o_orderkey) AS down
        FROM (SELECT o_orderkey, o_custkey, NULLIF(o_orderpriority, '2-HIGH') AS k FROM orders) t""", up="bigint", down="bigint"),
    "topk_nulls": sql("SELECT o_orderkey, NULLIF(o_orderpriority, '2-HIGH') AS k FROM orders ORDER BY k DESC, o_orderkey LIMIT 30", "SELECT o_orderkey, NULLIF(o_orderpriority, '2-HIGH') AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 30"),
    "sort_nulls_all": frame(_sort_nulls, "orders", oracle="""
        SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY k ASC NULLS LAST, o_orderkey) AS up, ROW_NUMBER() OVER (ORDER BY k DESC NULLS FIRST, o_orderkey) AS down
        FROM (SELECT o_orderkey, NULLIF(o_orderpriority, '2-HIGH') AS k FROM orders) t"""),
    "topk": sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "limit_offset": sql("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 35"),
    "set_union": sql("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_union_all": sql("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "set_intersect": sql("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "set_intersect_all": sql("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "set_except": sql("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "set_except_all": sql("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "cte": sql("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n > 1"),
    "cte_recursive": sql("WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t"),
    "values_rows": sql("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)"),
    "select_without_from": sql("SELECT 1 + 1 AS two, 'x' AS letter, TRUE AS flag"),
    "unnest": sql("SELECT vec_id, v::DOUBLE AS v FROM embeddings CROSS JOIN UNNEST(embedding) AS u(v)", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    "unnest_select": sql("SELECT vec_id, unnest(embedding) AS v FROM embeddings"),
    "unnest_literal": sql("SELECT x, y FROM UNNEST(ARRAY[3, 1, 2], ['c', 'a', 'b']) AS t(x, y)", "SELECT unnest([3, 1, 2]) AS x, unnest(['c', 'a', 'b']) AS y"),
    "from_generate_series": sql("SELECT n, r FROM generate_series(1, 20, 3) AS t(n) CROSS JOIN range(5, 0, -2) AS u(r)", n="bigint", r="bigint"),
    "array_literals": sql("SELECT n_nationkey, [n_nationkey, 7][1] AS one, ARRAY[1, 2, 3][2:3][1] AS two, [[1], [2, 3]][2][2] AS three, [n_name][9] AS none, {a: n_name, b: 2}['a'] AS field, MAP {'k': n_regionkey}['k'] AS entry FROM nation", "SELECT n_nationkey, n_nationkey AS one, 2 AS two, 3 AS three, CAST(NULL AS VARCHAR) AS none, n_name AS field, n_regionkey AS entry FROM nation"),
    "unnest_all": sql("SELECT vec_id, pos, v::DOUBLE AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v", "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    "distinct_rows": sql("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_on": sql("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "distinct_on_nested": sql("WITH top AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN top ON o_custkey = c_custkey UNION ALL SELECT n_nationkey, x FROM (SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey AS x FROM customer ORDER BY c_nationkey, c_acctbal, c_custkey) t JOIN nation ON n_nationkey = c_nationkey"),
    "qualify": sql("SELECT c_nationkey, c_custkey FROM customer QUALIFY RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2"),
    "qualify_nested": sql("WITH best AS (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 3) SELECT n_name, c_custkey, r FROM best JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 2)", r="bigint"),
    "quoted_names": sql('SELECT "n_name" AS "Nation Name", "n_regionkey" AS "a/b" FROM nation'),
}
