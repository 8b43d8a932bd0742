"""Scalar functions, by family."""

from __future__ import annotations

from .base import Entry, sql

ENTRIES: dict[str, Entry] = {
    "fn_math": sql("""
        SELECT p_partkey, ABS(-p_size) AS a, ROUND(SQRT(p_size), 9) AS s, ROUND(LN(p_size), 9) AS l, ROUND(LOG10(p_size), 9) AS l10, ROUND(EXP(p_size / 50.0D), 9) AS e, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f,
          ROUND(SIN(p_size), 9) AS si, ROUND(ATAN2(p_size, 3), 9) AS at2, ROUND(CBRT(p_size), 9) AS cb, ROUND(DEGREES(1.0D), 9) AS d, GCD(p_size, 12) AS g, LCM(p_size, 4) AS m, ISZERO(p_size - 7) AS z,
          TRUNC(p_retailprice, 1) AS t, CAST(FACTORIAL(p_size % 10) AS BIGINT) AS fa, SIGN(p_size - 25) AS sg, POWER(p_size, 2) AS pw, p_size % 7 AS md FROM part""", """
        SELECT p_partkey, ABS(-p_size) AS a, ROUND(SQRT(p_size), 9) AS s, ROUND(LN(p_size), 9) AS l, ROUND(LOG10(p_size), 9) AS l10, ROUND(EXP(p_size / 50.0::DOUBLE), 9) AS e, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f,
          ROUND(SIN(p_size), 9) AS si, ROUND(ATAN2(p_size, 3), 9) AS at2, ROUND(CBRT(p_size), 9) AS cb, ROUND(DEGREES(1.0::DOUBLE), 9) AS d, CAST(GCD(p_size, 12) AS BIGINT) AS g, CAST(LCM(p_size, 4) AS BIGINT) AS m, p_size = 7 AS z,
          TRUNC(p_retailprice * 10) / 10 AS t, CAST(FACTORIAL(p_size % 10) AS BIGINT) AS fa, CAST(SIGN(p_size - 25) AS DOUBLE) AS sg, POWER(p_size, 2) AS pw, p_size % 7 AS md FROM part"""),
    "fn_math_trig": sql("SELECT vec_id, ROUND(ACOS(x), 7) AS ac, ROUND(ASIN(x), 7) AS asn, ROUND(ATAN(x), 7) AS atn, ROUND(COSH(x), 7) AS ch, ROUND(SINH(x), 7) AS sh, ROUND(TANH(x), 7) AS th, ROUND(RADIANS(x), 9) AS r, ISNAN(x) AS nan FROM (SELECT vec_id, CAST(element_at(embedding, 1) AS DOUBLE) AS x FROM embeddings) t", "SELECT vec_id, ROUND(ACOS(x), 7) AS ac, ROUND(ASIN(x), 7) AS asn, ROUND(ATAN(x), 7) AS atn, ROUND(COSH(x), 7) AS ch, ROUND(SINH(x), 7) AS sh, ROUND(TANH(x), 7) AS th, ROUND(RADIANS(x), 9) AS r, ISNAN(x) AS nan FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) t"),
    "fn_conditional": sql("SELECT p_partkey, COALESCE(NULLIF(p_size, 1), 0) AS c, NVL(NULLIF(p_size, 2), -2) AS n, NVL2(NULLIF(p_size, 3), 'has', 'none') AS n2, GREATEST(p_size, 10, NULL) AS g, LEAST(p_size, NULL, 40) AS l FROM part", "SELECT p_partkey, COALESCE(NULLIF(p_size, 1), 0) AS c, COALESCE(NULLIF(p_size, 2), -2) AS n, CASE WHEN NULLIF(p_size, 3) IS NULL THEN 'none' ELSE 'has' END AS n2, GREATEST(p_size, 10, NULL) AS g, LEAST(p_size, NULL, 40) AS l FROM part"),
    "fn_string": sql("""
        SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, INITCAP(LOWER(c_mktsegment)) AS i, LENGTH(c_name) AS n, REVERSE(c_name) AS r, LPAD(c_name, 22, '*') AS lp, RPAD(c_name, 22, '-') AS rp, SUBSTR(c_name, 3, 5) AS s, SUBSTR(c_name, 0, 3) AS s0,
          SUBSTR(c_name, -1, 4) AS sn, REPLACE(c_name, '0', 'o') AS rep, TRANSLATE(c_name, '01', 'ab') AS tr, SPLIT_PART(c_name, '#', 2) AS sp, STRPOS(c_name, '#') AS p, LEFT(c_name, 3) AS le, RIGHT(c_name, 3) AS ri, REPEAT(c_mktsegment, 2) AS rt, CONCAT(c_name, NULLIF(c_mktsegment, 'BUILDING'), '!') AS ct FROM customer""", """
        SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, UPPER(c_mktsegment[1]) || LOWER(c_mktsegment[2:]) AS i, CAST(LENGTH(c_name) AS INTEGER) AS n, REVERSE(c_name) AS r, LPAD(c_name, 22, '*') AS lp, RPAD(c_name, 22, '-') AS rp, SUBSTR(c_name, 3, 5) AS s, SUBSTR(c_name, 1, 2) AS s0,
          SUBSTR(c_name, 1, 2) AS sn, REPLACE(c_name, '0', 'o') AS rep, TRANSLATE(c_name, '01', 'ab') AS tr, SPLIT_PART(c_name, '#', 2) AS sp, CAST(STRPOS(c_name, '#') AS INTEGER) AS p, LEFT(c_name, 3) AS le, RIGHT(c_name, 3) AS ri, REPEAT(c_mktsegment, 2) AS rt, CONCAT(c_name, NULLIF(c_mktsegment, 'BUILDING'), '!') AS ct FROM customer"""),
    "fn_string_more": sql("SELECT n_nationkey, ASCII(n_name) AS a, CHR(65 + n_nationkey) AS c, BIT_LENGTH(n_name) AS b, OCTET_LENGTH(n_name) AS o, LEVENSHTEIN(n_name, 'CANADA') AS d, CONCAT_WS('-', n_name, NULL, 'x') AS w, STARTSWITH(n_name, 'A') AS st, ENDSWITH(n_name, 'A') AS en, CONTAINS(n_name, 'AN') AS co, LTRIM('  x') AS lt, RTRIM('x  ') AS rt, BTRIM('--x-', '-') AS bt, OVERLAY(n_name PLACING '##' FROM 2 FOR 1) AS ov FROM nation", "SELECT n_nationkey, ASCII(n_name) AS a, CHR(65 + n_nationkey) AS c, CAST(BIT_LENGTH(n_name) AS INTEGER) AS b, CAST(STRLEN(n_name) AS INTEGER) AS o, CAST(LEVENSHTEIN(n_name, 'CANADA') AS INTEGER) AS d, CONCAT_WS('-', n_name, NULL, 'x') AS w, STARTS_WITH(n_name, 'A') AS st, ENDS_WITH(n_name, 'A') AS en, CONTAINS(n_name, 'AN') AS co, LTRIM('  x') AS lt, RTRIM('x  ') AS rt, TRIM('--x-', '-') AS bt, n_name[1] || '##' || n_name[3:] AS ov FROM nation"),
    "fn_string_hex": sql("SELECT n_nationkey, TO_HEX(n_nationkey * 1000) AS h, SUBSTRING_INDEX(n_name, 'A', 1) AS si, FIND_IN_SET(n_name, 'BRAZIL,CANADA') AS f FROM nation", "SELECT n_nationkey, printf('%x', n_nationkey * 1000) AS h, SPLIT_PART(n_name, 'A', 1) AS si, CAST(CASE n_name WHEN 'BRAZIL' THEN 1 WHEN 'CANADA' THEN 2 ELSE 0 END AS INTEGER) AS f FROM nation"),
    "fn_regex": sql("SELECT p_partkey, REGEXP_COUNT(p_type, '[AEIOU]') AS n, REGEXP_LIKE(p_type, 'TIN|BRASS') AS m, REGEXP_REPLACE(p_type, '[AEIOU]', '_') AS one, REGEXP_REPLACE(p_type, '[AEIOU]', '_', 'g') AS every FROM part", "SELECT p_partkey, CAST(LEN(REGEXP_EXTRACT_ALL(p_type, '[AEIOU]')) AS INTEGER) AS n, REGEXP_MATCHES(p_type, 'TIN|BRASS') AS m, REGEXP_REPLACE(p_type, '[AEIOU]', '_') AS one, REGEXP_REPLACE(p_type, '[AEIOU]', '_', 'g') AS every FROM part"),
    "fn_date": sql("""
        SELECT o_orderkey, YEAR(o_orderdate) AS y, QUARTER(o_orderdate) AS q, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DATE_PART('dow', o_orderdate) AS w, DAYOFYEAR(o_orderdate) AS doy, CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP_NTZ) AS mon,
          CAST(CAST(o_orderdate AS DATE) AS STRING) AS dt, o_orderdate + INTERVAL 3 DAYS AS later, UNIX_TIMESTAMP(CAST(o_orderdate AS TIMESTAMP_LTZ)) AS ep, CAST(MAKE_DATE(YEAR(o_orderdate), 1, 1) AS STRING) AS ny, DATEDIFF(o_orderdate, DATE '1992-01-01') AS dd FROM orders""", """
        SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(QUARTER(o_orderdate) AS INTEGER) AS q, CAST(MONTH(o_orderdate) AS INTEGER) AS m, CAST(DAY(o_orderdate) AS INTEGER) AS d, CAST(DAYOFWEEK(o_orderdate) AS INTEGER) AS w, CAST(DAYOFYEAR(o_orderdate) AS INTEGER) AS doy, CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS mon,
          CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, o_orderdate + INTERVAL 3 DAYS AS later, CAST(EPOCH(o_orderdate) AS BIGINT) AS ep, CAST(MAKE_DATE(YEAR(o_orderdate), 1, 1) AS VARCHAR) AS ny, CAST(DATE_DIFF('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dd FROM orders"""),
    "fn_date_bin": sql("SELECT event_id, DATE_BIN(INTERVAL '900 seconds', ts) AS b, DATE_BIN(INTERVAL '3600 seconds', ts, TIMESTAMP '2024-01-01 00:10:00') AS shifted FROM events", "SELECT event_id, TIME_BUCKET(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b, TIME_BUCKET(INTERVAL 60 MINUTE, ts, TIMESTAMP '2024-01-01 00:10:00') AS shifted FROM events"),
    "fn_date_parse": sql("SELECT n_nationkey, CAST(TO_DATE(CONCAT('2024-03-', LPAD(CAST(n_nationkey + 1 AS STRING), 2, '0'))) AS STRING) AS d, TIMESTAMP_SECONDS(n_nationkey * 86400) = TIMESTAMP_MILLIS(n_nationkey * 86400000) AS same, TO_CHAR(TIMESTAMP '2024-02-29 13:05:09', '%Y/%m/%d %H:%M') AS f, DATE_FORMAT(TIMESTAMP '2024-02-29 13:05:09', 'yyyy-MM') AS g, TO_TIMESTAMP('29.02.2024 at 13h', '%d.%m.%Y at %Hh') AS p, TO_DATE('2024/02/09', '%Y/%m/%d')::TEXT AS q, to_char(TIMESTAMP '2024-02-09 03:05:09.25', '%b %e, %y %I:%M %p %j%%') AS h FROM nation", "SELECT n_nationkey, CAST(CAST('2024-03-' || LPAD(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS d, TRUE AS same, STRFTIME(TIMESTAMP '2024-02-29 13:05:09', '%Y/%m/%d %H:%M') AS f, '2024-02' AS g, TIMESTAMP '2024-02-29 13:00:00' AS p, '2024-02-09' AS q, 'Feb 9, 24 03:05 AM 040%' AS h FROM nation"),
    "fn_array": sql("""
        SELECT vec_id, SIZE(a) AS n, ARRAY_CONTAINS(a, 3) AS has, ARRAY_POSITION(a, 4) AS pos, ARRAY_JOIN(ARRAY_REMOVE(a, 2), ',') AS less, ARRAY_JOIN(ARRAY_DISTINCT(a), ',') AS dis, ARRAY_JOIN(ARRAY_SORT(a), ',') AS srt, ARRAY_HAS_ALL(a, make_array(1, 2)) AS every, ARRAY_HAS_ANY(a, make_array(8, 9)) AS some,
          ARRAY_JOIN(ARRAY_SLICE(a, 2, 3), ',') AS sl, ARRAY_JOIN(ARRAY_POSITIONS(a, 2), ',') AS ps, ARRAY_JOIN(ARRAY_POP_FRONT(a), ',') AS pf, ARRAY_JOIN(ARRAY_RESIZE(a, 6, 0), ',') AS rz, ARRAY_JOIN(ARRAY_REPLACE(a, 2, 7), ',') AS rp, ARRAY_JOIN(ARRAY_REVERSE(a), ',') AS rv
        FROM (SELECT vec_id, ARRAY(label, 2, CAST(vec_id % 5 AS INT), 2) AS a FROM embeddings) t""", """
        SELECT vec_id, CAST(LEN(a) AS INTEGER) AS n, LIST_CONTAINS(a, 3) AS has, CAST(COALESCE(LIST_POSITION(a, 4), 0) AS BIGINT) AS pos, ARRAY_TO_STRING(a[:p-1] || a[p+1:], ',') AS less, ARRAY_TO_STRING(LIST_FILTER(a, lambda e, i: NOT LIST_CONTAINS(a[:i-1], e)), ',') AS dis, ARRAY_TO_STRING(LIST_SORT(a), ',') AS srt, LIST_HAS_ALL(a, [1, 2]) AS every, LIST_HAS_ANY(a, [8, 9]) AS some,
          ARRAY_TO_STRING(a[2:3], ',') AS sl, ARRAY_TO_STRING(LIST_FILTER(RANGE(1, 5), lambda i: a[i] = 2), ',') AS ps, ARRAY_TO_STRING(a[2:], ',') AS pf, ARRAY_TO_STRING(LIST_RESIZE(a, 6, 0), ',') AS rz, ARRAY_TO_STRING(a[:p-1] || [7] || a[p+1:], ',') AS rp, ARRAY_TO_STRING(LIST_REVERSE(a), ',') AS rv
        FROM (SELECT vec_id, a, LIST_POSITION(a, 2) AS p FROM (SELECT vec_id, [label, 2, CAST(vec_id % 5 AS INTEGER), 2] AS a FROM embeddings)) t"""),
    "fn_array_sets": sql("SELECT vec_id, ARRAY_JOIN(ARRAY_SORT(ARRAY_UNION(a, b)), ',') AS u, ARRAY_JOIN(ARRAY_SORT(ARRAY_INTERSECT(a, b)), ',') AS i, ARRAY_JOIN(ARRAY_SORT(ARRAY_EXCEPT(a, b)), ',') AS e, ARRAY_JOIN(FLATTEN(ARRAY(a, b)), ',') AS f, ARRAY_JOIN(ARRAY_APPEND(ARRAY_PREPEND(a, 0), 9), ',') AS ap, ARRAY_JOIN(SEQUENCE(1, 7, 3), ',') AS sq FROM (SELECT vec_id, ARRAY(label, 1) AS a, ARRAY(1, 5) AS b FROM embeddings) t", "SELECT vec_id, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(a || b)), ',') AS u, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_INTERSECT(a, b))), ',') AS i, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_FILTER(a, lambda v: NOT LIST_CONTAINS(b, v)))), ',') AS e, ARRAY_TO_STRING(a || b, ',') AS f, ARRAY_TO_STRING([0] || a || [9], ',') AS ap, ARRAY_TO_STRING(RANGE(1, 8, 3), ',') AS sq FROM (SELECT vec_id, [label, 1] AS a, [1, 5] AS b FROM embeddings) t"),
    "fn_array_distance": sql("SELECT vec_id, ROUND(ARRAY_DISTANCE(embedding, reverse(embedding)), 5) AS d FROM embeddings", "SELECT vec_id, ROUND(SQRT(LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(embedding) + 1), lambda i: CAST((embedding[i] - embedding[LEN(embedding) + 1 - i]) * (embedding[i] - embedding[LEN(embedding) + 1 - i]) AS DOUBLE)))), 5) AS d FROM embeddings"),
    "fn_string_to_array": sql("SELECT doc_id, SIZE(STRING_TO_ARRAY(text, '. ')) AS n FROM documents", "SELECT doc_id, CAST(LEN(STRING_SPLIT(text, '. ')) AS INTEGER) AS n FROM documents"),
    "fn_map_struct": sql("SELECT n_nationkey, ELEMENT_AT(MAP('k', n_name, 'r', CAST(n_regionkey AS STRING)), 'k') AS v, ARRAY_JOIN(ARRAY_SORT(MAP_KEYS(MAP('b', 1, 'a', 2))), ',') AS ks, NAMED_STRUCT('x', n_regionkey, 'y', n_name).x AS sx, MAP_EXTRACT(MAP(1, n_name), 1)[1] AS me FROM nation", "SELECT n_nationkey, n_name AS v, 'a,b' AS ks, n_regionkey AS sx, n_name AS me FROM nation"),
    "fn_hash": sql("SELECT n_nationkey, MD5(n_name) AS m, LOWER(HEX(SHA256(n_name))) AS s, HEX(ENCODE(n_name, 'UTF-8')) AS h, BASE64(CAST(n_name AS BINARY)) AS b FROM nation", "SELECT n_nationkey, MD5(n_name) AS m, SHA256(n_name) AS s, HEX(n_name) AS h, BASE64(ENCODE(n_name)) AS b FROM nation"),
    "fn_json_ext": sql("SELECT event_id, COALESCE(GET_JSON_OBJECT(props, '$.k') IS NOT NULL, FALSE) AS has_k, LENGTH(props) AS n FROM events", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, CAST(LENGTH(props) AS INTEGER) AS n FROM events"),
    "fn_vec_norm": sql("SELECT vec_id, ROUND(SQRT(AGGREGATE(embedding, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)), 6) AS norm FROM embeddings", "SELECT vec_id, ROUND(SQRT(LIST_SUM(LIST_TRANSFORM(embedding, lambda v: CAST(v AS DOUBLE) * v))), 6) AS norm FROM embeddings"),
    "fn_typeof": sql("SELECT ARROW_TYPEOF(CAST(1 AS BIGINT)) AS t, ARROW_CAST('7', 'Int64') AS c", "SELECT 'bigint' AS t, CAST(7 AS BIGINT) AS c"),
}
