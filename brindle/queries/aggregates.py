"""Aggregation: hash, distinct, filtered, multi-level, statistical, ordered and approximate."""

from __future__ import annotations

from .base import Entry, sql

D = "CAST({} AS DECIMAL(18,2))"

ENTRIES: dict[str, Entry] = {
    "agg_hash": sql("SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, MIN(l_shipdate) AS first_ship, MAX(l_extendedprice) AS top_price, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_global": sql("SELECT COUNT(*) AS n, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, CAST(SUM(o_custkey) AS BIGINT) AS keys FROM orders"),
    "agg_empty_input": sql("SELECT COUNT(*) AS n, MAX(o_totalprice) AS high FROM orders WHERE o_orderkey < 0"),
    "agg_having": sql("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "agg_avg": sql("SELECT c_mktsegment, ROUND(AVG(c_acctbal), 6) AS mean_balance FROM customer GROUP BY c_mktsegment"),
    "agg_distinct": sql("SELECT event_type, COUNT(DISTINCT user_id) AS users, CAST(SUM(DISTINCT user_id) AS BIGINT) AS ids FROM events GROUP BY event_type"),
    "agg_distinct_two": sql("SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey, l_suppkey) AS pairs FROM lineitem", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem"),
    "agg_filter": sql("SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS top_open FROM orders GROUP BY o_orderpriority"),
    "agg_rollup": sql("SELECT c_mktsegment, c_nationkey, GROUPING(c_mktsegment) AS g1, GROUPING(c_nationkey) AS g2, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", g1="bigint", g2="bigint"),
    "agg_cube": sql("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": sql("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_group_by_all": sql("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL"),
    "agg_group_by_ordinal": sql("SELECT o_orderstatus, year(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY 1, 2", "SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1, 2"),
    "agg_stats": sql("SELECT event_type, ROUND(STDDEV_SAMP(value), 6) AS sd, ROUND(STDDEV_POP(value), 6) AS sdp, ROUND(VAR_SAMP(value), 4) AS v, ROUND(VAR_POP(value), 4) AS vp, ROUND(MEDIAN(value), 6) AS mid FROM events GROUP BY event_type"),
    "agg_regr_corr": sql("""
        SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c, ROUND(COVAR_POP(l_quantity, l_extendedprice), 2) AS cp, ROUND(COVAR_SAMP(l_quantity, l_extendedprice), 2) AS cs,
          ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag"""),
    "agg_regr_all": sql("""
        SELECT ROUND(REGR_AVGX(l_extendedprice, l_quantity), 4) AS ax, ROUND(REGR_AVGY(l_extendedprice, l_quantity), 4) AS ay, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 2) AS icept,
          ROUND(REGR_SXX(l_extendedprice, l_quantity) / 1000, 2) AS sxx, ROUND(REGR_SYY(l_extendedprice, l_quantity) / 1000000, 1) AS syy, ROUND(REGR_SXY(l_extendedprice, l_quantity) / 1000, 1) AS sxy FROM lineitem"""),
    "agg_bits_bools": sql("SELECT p_brand, BIT_AND(p_size) AS a, BIT_OR(p_size) AS o, BIT_XOR(p_size) AS x, BOOL_AND(p_size > 1) AS every_one, BOOL_OR(p_size > 49) AS any_one FROM part GROUP BY p_brand"),
    "agg_string_agg_ordered": sql("SELECT r_name, STRING_AGG(n_name, ',' ORDER BY n_name DESC) AS names, STRING_AGG(n_name, '+' ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 9) AS late FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "agg_array": sql("SELECT n_regionkey, ARRAY_TO_STRING(ARRAY_AGG(n_nationkey ORDER BY n_name DESC), '-') AS keys, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 3))) AS n, ARRAY_TO_STRING(ARRAY_AGG(n_nationkey ORDER BY n_nationkey % 3, n_nationkey DESC) FILTER (WHERE n_nationkey > 4), '-') AS some, ARRAY_TO_STRING(ARRAY_AGG(DISTINCT n_nationkey % 3 ORDER BY n_nationkey % 3), '-') AS kinds FROM nation GROUP BY n_regionkey", n="bigint"),
    "agg_first_last_nth": sql("""
        SELECT user_id, FIRST_VALUE(event_id ORDER BY ts, event_id) AS first_event, LAST_VALUE(event_id ORDER BY ts, event_id) AS last_event, NTH_VALUE(event_id, 3 ORDER BY ts, event_id) AS third,
          FIRST_VALUE(event_id ORDER BY event_type DESC, ts, event_id) AS by_type, LAST_VALUE(event_type ORDER BY NULLIF(event_type, 'view') DESC, event_id DESC) AS last_type FROM events GROUP BY user_id""", """
        SELECT user_id, FIRST(event_id ORDER BY ts, event_id) AS first_event, LAST(event_id ORDER BY ts, event_id) AS last_event, LIST(event_id ORDER BY ts, event_id)[3] AS third,
          FIRST(event_id ORDER BY event_type DESC, ts, event_id) AS by_type, LAST(event_type ORDER BY NULLIF(event_type, 'view') DESC NULLS FIRST, event_id DESC) AS last_type FROM events GROUP BY user_id"""),
    "agg_percentile_cont": sql("SELECT o_orderpriority, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, ROUND(QUANTILE_CONT(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority"),
    "agg_approx": Entry(sql("SELECT event_type, APPROX_COUNT_DISTINCT(user_id) AS users, APPROX_PERCENTILE(value, 0.5) AS mid FROM events GROUP BY event_type").run, None),
    "agg_approx_within_bounds": sql("""
        SELECT ABS(APPROX_COUNT_DISTINCT(o_custkey, 0.02) - COUNT(DISTINCT o_custkey)) <= 0.1 * COUNT(DISTINCT o_custkey) AS distinct_near,
          ABS(APPROX_PERCENTILE(o_totalprice, 0.5, 10000) - MEDIAN(o_totalprice)) <= 0.02 * MEDIAN(o_totalprice) AS median_near FROM orders""", "SELECT TRUE AS distinct_near, TRUE AS median_near"),
    "agg_weighted_percentile": sql("SELECT PERCENTILE(CAST(p_size AS DOUBLE), 0.5, p_size) AS weighted FROM part", "SELECT QUANTILE_CONT(CAST(p_size AS DOUBLE), 0.5) AS weighted FROM (SELECT p_size, unnest(range(p_size)) AS i FROM part)"),
    "agg_null_groups": sql("SELECT NULLIF(o_orderstatus, 'P') AS k, COUNT(*) AS n, COUNT(NULLIF(o_orderpriority, '1-URGENT')) AS filled FROM orders GROUP BY NULLIF(o_orderstatus, 'P')"),
    "agg_tpch_q1": sql("""
        SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
          CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS sum_disc, COUNT(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""", """
        SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
          CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS sum_disc, COUNT(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""),
}
