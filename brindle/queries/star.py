"""Star-schema queries in the manner of decision-support benchmarks."""

from __future__ import annotations

from .base import Entry, sql

NET = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


def both(text: str) -> Entry:
    """The same text for both engines."""
    return sql(text)


ENTRIES: dict[str, Entry] = {
    "star_shipping_priority": both(f"""
        SELECT l_orderkey, CAST(SUM({NET}) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""),
    "star_local_supplier_volume": both(f"""
        SELECT n_name, CAST(SUM({NET}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY n_name"""),
    "star_forecast_revenue": both("""
        SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND CAST(l_discount AS DECIMAL(18,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""),
    "star_returned_items": both(f"""
        SELECT c_custkey, c_name, CAST(SUM({NET}) AS DOUBLE) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""),
    "star_order_priority": both("""
        SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1993-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1994-07-01 00:00:00'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority"""),
    "star_promotion_share": both(f"""
        SELECT ROUND(100.0 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END) AS DOUBLE) / CAST(SUM({NET}) AS DOUBLE), 8) AS share FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "star_large_orders": both("""
        SELECT c_name, o_orderkey, o_totalprice, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) GROUP BY c_name, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""),
    "star_customer_distribution": both("""
        SELECT orders_n, COUNT(*) AS customers FROM (SELECT c_custkey, COUNT(o_orderkey) AS orders_n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY orders_n"""),
    "star_top_supplier": both(f"""
        WITH revenue AS (SELECT l_suppkey, SUM({NET}) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, CAST(total AS DOUBLE) AS total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT MAX(total) FROM revenue)"""),
    "star_small_quantity": both("""
        SELECT ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 7.0, 6) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_size < 20 AND l_quantity < (SELECT 0.4 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)"""),
    "star_idle_customers": both("""
        SELECT c_nationkey, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer
        WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey"""),
    "star_funnel": both("""
        SELECT COUNT(*) AS users, COUNT(viewed) AS viewed, COUNT(CASE WHEN clicked > viewed THEN 1 END) AS clicked, COUNT(CASE WHEN clicked > viewed AND bought > clicked THEN 1 END) AS bought FROM (
          SELECT user_id, MIN(CASE WHEN event_type = 'view' THEN ts END) AS viewed, MIN(CASE WHEN event_type = 'click' THEN ts END) AS clicked, MAX(CASE WHEN event_type = 'purchase' THEN ts END) AS bought FROM events GROUP BY user_id) t"""),
}
