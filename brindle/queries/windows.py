"""Window functions and frames, and windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators.frames import over_groups

from .base import Entry, frame, sql


def _groups(orders):
    ranked = over_groups(orders, F.count(F.lit(1)), "n", ["o_orderstatus"], [F.col("o_orderpriority").asc_nulls_last()], 1, 1)
    return ranked.select("o_orderkey", "n")


ENTRIES: dict[str, Entry] = {
    "win_row_number_lag": sql("SELECT event_id, ROW_NUMBER() OVER w AS r, LAG(event_type) OVER w AS before, LEAD(event_type, 2, 'none') OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", r="bigint"),
    "win_rank_family": sql("SELECT p_partkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, ROUND(PERCENT_RANK() OVER w, 9) AS p FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size NULLS LAST)", r="bigint", d="bigint"),
    "win_ntile_cume": sql("SELECT c_custkey, NTILE(7) OVER (ORDER BY c_acctbal, c_custkey) AS bucket, ROUND(CUME_DIST() OVER (ORDER BY c_nationkey), 9) AS share FROM customer", bucket="bigint"),
    "win_first_last_nth": sql("""
        SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER w AS f, LAST_VALUE(o_totalprice) OVER w AS l, NTH_VALUE(o_totalprice, 2) OVER w AS s
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "win_ignore_nulls": sql("SELECT event_id, LAST_VALUE(NULLIF(event_type, 'click')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events", "SELECT event_id, LAST_VALUE(NULLIF(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events"),
    "win_rows_frame": sql("SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS near FROM orders"),
    "win_range_frame": sql("SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM part"),
    "win_range_time": sql("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_events FROM events"),
    "win_groups_frame": frame(_groups, "orders", oracle="SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority NULLS LAST GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders"),
    "win_groups_frame_sql": sql("SELECT o.o_orderkey, c_name, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, SUM(c.c_custkey) OVER (PARTITION BY o.o_custkey ORDER BY o_orderpriority DESC, o_orderstatus GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS s FROM orders o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c_acctbal > 0", "SELECT o.o_orderkey, c_name, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority NULLS LAST GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, CAST(SUM(c.c_custkey) OVER (PARTITION BY o.o_custkey ORDER BY o_orderpriority DESC NULLS FIRST, o_orderstatus GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c_acctbal > 0"),
    "win_null_order": sql("SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY NULLIF(p_size, 7) DESC, p_partkey) AS down, FIRST_VALUE(p_partkey) OVER (PARTITION BY p_brand ORDER BY NULLIF(p_size, 7), p_partkey) AS least FROM part", "SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY NULLIF(p_size, 7) DESC NULLS FIRST, p_partkey) AS down, FIRST_VALUE(p_partkey) OVER (PARTITION BY p_brand ORDER BY NULLIF(p_size, 7) ASC NULLS LAST, p_partkey) AS least FROM part", down="bigint"),
    "win_whole_partition": sql("SELECT s_suppkey, MAX(s_acctbal) OVER (PARTITION BY s_nationkey) AS top_balance, COUNT(*) OVER () AS suppliers FROM supplier"),
    "win_over_aggregate": sql("SELECT o_orderstatus, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_orderstatus", r="bigint"),
    "win_topk_per_group": sql("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) t WHERE r <= 3"),
    "time_tumbling": sql("SELECT w.start AS w_start, event_type, n FROM (SELECT window(ts, '6 hours') AS w, event_type, COUNT(*) AS n FROM events GROUP BY window(ts, '6 hours'), event_type) t", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL"),
    "time_sliding": sql("SELECT w.start AS w_start, n FROM (SELECT window(ts, '1 day', '12 hours') AS w, COUNT(*) AS n FROM events GROUP BY window(ts, '1 day', '12 hours')) t", """
        SELECT b - INTERVAL 12 HOUR * i AS w_start, COUNT(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), (SELECT unnest([0, 1]) AS i) GROUP BY ALL"""),
    "time_session": sql("SELECT user_id, w.start AS s_start, w.end AS s_end, n FROM (SELECT user_id, session_window(ts, '8 hours') AS w, COUNT(*) AS n FROM events GROUP BY user_id, session_window(ts, '8 hours')) t", """
        SELECT user_id, MIN(ts) AS s_start, MAX(ts) + INTERVAL 8 HOUR AS s_end, COUNT(*) AS n FROM (
          SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""),
}
