"""Keyed tables, logs, joins in time, rendering and streams."""

import math
import random
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from brindle.functions.compat import call
from brindle.operators import keyed as kv
from brindle.operators import joins, log
from brindle.operators.joins import asof_join
from brindle.plans import render
from brindle.queries import entries
from brindle.streaming import tail as st


def layer(spark, keys, prefix, deleted=()):
    return spark.createDataFrame([(k.to_bytes(8, "big"), f"{prefix}_{k:04d}", k in deleted) for k in keys], "key binary, value string, deleted boolean")


def keys(df):
    return [int.from_bytes(r["key"], "big") for r in df.collect()]


def test_scans_in_byte_order(spark):
    run = layer(spark, [3, 255, 256, 1, 2**40], "value")
    assert keys(kv.range_scan(run, "key")) == [1, 3, 255, 256, 2**40]
    assert keys(kv.range_scan(run, "key", reverse=True)) == [2**40, 256, 255, 3, 1]
    at = lambda k: bytearray(k.to_bytes(8, "big"))
    assert keys(kv.range_scan(run, "key", kv.Bound.excluded(at(1)), kv.Bound.included(at(255)))) == [3, 255]


def test_seeks(spark):
    run = spark.createDataFrame([(k,) for k in [0, 1, 2, 3, 5, 6, 7, 8]], "key long")
    first = lambda t, **o: [r[0] for r in kv.seek(run, "key", t, **o).collect()]
    assert first(7) == [7] and first(4) == [5] and first(9) == []
    assert first(4, reverse=True) == [3] and first(-1, reverse=True) == [] and first(99, reverse=True) == [8]


def test_merge_keeps_and_shadow_drops(spark):
    mem, run = layer(spark, range(5), "mem", deleted={3}), layer(spark, range(3, 8), "value")
    assert keys(kv.merge([mem, run], "key")) == [0, 1, 2, 3, 3, 4, 4, 5, 6, 7]
    assert keys(kv.merge([layer(spark, range(3), "a"), layer(spark, range(1, 4), "b")], "key", reverse=True)) == [3, 2, 2, 1, 1, 0]
    shadowed = {int.from_bytes(r["key"], "big"): r for r in kv.shadow([mem, run], "key").collect()}
    assert len(shadowed) == 8 and shadowed[4]["value"] == "mem_0004" and shadowed[5]["value"] == "value_0005"
    assert shadowed[3]["deleted"] and len(kv.live(kv.shadow([mem, run], "key")).collect()) == 7


def test_latest_and_compact(spark):
    rows = spark.createDataFrame([("a", 1, "v1", False), ("a", 2, "v2", False), ("b", 3, "x", False), ("b", 4, None, True)], "key string, seq long, value string, deleted boolean")
    assert {r["key"]: r["value"] for r in kv.latest(rows, "key", ["seq"]).collect()} == {"a": "v2", "b": None}
    assert [r["key"] for r in kv.compact(rows, "key", ["seq"]).collect()] == ["a"]


@pytest.mark.parametrize("partitions", [4, 16, 200])
def test_numbers_are_dense_and_in_order_at_size(spark, partitions):
    n, before = 2_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = log.numbered(spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), F.pmod("id", F.lit(90)).cast("int")).alias("pad")), ["k"])
        found = rows.agg(F.count(F.lit(1)), F.countDistinct("lsn"), F.min("lsn"), F.max("lsn")).first()
        assert tuple(found) == (n, n, 0, n - 1)
        some = rows.where("lsn % 997 = 0").orderBy("lsn").select("k").collect()
        assert [r[0] for r in some] == sorted(r[0] for r in some)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_index_entries_and_headers(spark):
    frames = spark.range(10).select(F.col("id").alias("lsn"), log.frame(F.col("id"), F.repeat(F.lit("p"), F.col("id").cast("int")).cast("binary")).alias("frame"))
    rows = log.indexed(frames, per_segment=4).select("segment", "key", log.decode_entry(F.col("key"), F.col("value")).alias("e")).orderBy("key").collect()
    assert [(r["segment"], r["e"]["lsn"], r["e"]["length"]) for r in rows] == [(k // 4, k, 16 + k) for k in range(10)]
    assert [r["e"]["offset"] for r in rows] == [0, 16, 33, 51, 0, 20, 41, 63, 0, 24]
    made = spark.range(1).select(log.segment_header(F.lit(7), F.lit(4).cast("long"), F.lit(2**40), F.lit(9)).alias("h"))
    raw = bytes(made.first()["h"])
    fields = b"WIDX" + b"".join(x.to_bytes(n, "little") for x, n in ((1, 4), (7, 4), (4, 8), (2**40, 8), (9, 4)))
    assert raw == fields + zlib.crc32(fields).to_bytes(4, "little")
    bad = raw[:9] + b"!" + raw[10:]
    read = lambda a, b: spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary").select(log.decode_header(F.col("a"), F.col("b")).alias("h")).first()["h"]
    assert tuple(read(raw, bad)) == tuple(read(bad, raw + b"pad")) == (7, 4, 2**40, 9)
    assert read(bad, raw[:30]) is None


def test_log_numbers_ranges_and_frames(spark):
    payload = spark.range(50).select(F.format_string("payload-%04d", "id").alias("payload")).repartition(7)
    numbered = log.numbered(payload, ["payload"])
    assert [r["lsn"] for r in log.read(numbered, 0, 50).collect()] == list(range(50))
    assert [r["payload"] for r in log.read(numbered, 10, 12).collect()] == ["payload-0010", "payload-0011"]
    assert log.durable_lsn(numbered).first()[0] == 49 and log.read(numbered, 0, 50, durable=3).count() == 4
    assert log.numbered(payload.limit(0), ["payload"]).count() == 0
    framed = numbered.select("lsn", log.frame(F.col("lsn"), F.col("payload").cast("binary")).alias("f"))
    one = framed.where("lsn = 42").first()["f"]
    body = (42).to_bytes(8, "little") + b"payload-0042"
    assert bytes(one) == (12).to_bytes(4, "little") + zlib.crc32(body).to_bytes(4, "little") + body
    bad = spark.createDataFrame([(bytearray(one),), (bytearray(one[:-1]),), (bytearray(one[:5]),), (bytearray(one[:-1]) + b"X",)], "f binary")
    assert [r["d"]["state"] for r in bad.select(log.decode(F.col("f")).alias("d")).collect()] == ["ok", "torn", "torn", "corrupt"]


@pytest.mark.parametrize("bin_width", [None, 2, 100])
def test_asof_takes_the_last_at_or_before(spark, bin_width):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (3, 4)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c"), (3, 4, None)], "k int, at int, v string")
    got = sorted((r["k"], r["t"], r["v"]) for r in asof_join(left, right, "k", "t", "at", ["v"], tie_break="v", bin_width=bin_width).collect())
    assert got == [(1, 1, None), (1, 5, "b"), (2, 9, None), (3, 4, None)]
    later = spark.createDataFrame([(1, t) for t in range(4, 30, 5)], "k int, t int")
    assert [r["v"] for r in sorted(asof_join(later, right, "k", "t", "at", ["v"], bin_width=bin_width).collect())] == ["a", "b", "b", "b", "b", "b"]


@pytest.mark.parametrize("n, broadcast", [(0, 100_000), (1, 100_000), (300, 100_000), (300, -1)])
def test_two_inequalities_against_every_pair(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    draw = random.Random(n)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5, 2.5, 1e308, *[draw.uniform(-9, 9) for _ in range(40)]]
    rows = lambda: [(draw.choice(["a", "a", "b", "", None]), i, draw.choice([None, -(2**31), 2**31 - 1, *range(9)]), draw.choice(values)) for i in range(n)]
    a, b = rows(), rows()
    left, right = spark.createDataFrame(a, "k string, i int, x int, y double"), spark.createDataFrame(b, "k string, j int, u int, v double")
    above = lambda y, v: not math.isnan(v) if math.isnan(y) else y > v  # noqa: E731  a NaN is above all else
    want = [(k, i, x, j) for k, i, x, y in a for q, j, u, v in b if None not in (k, x, y, q, u, v) and k == q and x < u and above(y, v)]
    got = joins.dominance_join(left, right, "k", less=("x", "u"), more=("y", "v"))
    assert got.columns == ["k", "i", "x", "y", "j", "u", "v"]
    assert sorted((r["k"], r["i"], r["x"], r["j"]) for r in got.collect()) == sorted(want)


def test_two_inequalities_that_hold_for_no_pair_at_once(spark):
    left, right = spark.createDataFrame([("a", 0, 0.0), ("a", 5, 9.0), ("a", 2, 4.0)], "k string, x int, y double"), spark.createDataFrame([("a", 3, 4.0), ("a", 1, 2.0)], "k string, u int, v double")
    assert joins.dominance_join(left, right, "k", less=("x", "u"), more=("y", "v")).collect() == []


def test_two_inequalities_make_no_pair_that_fails_one(spark, tmp_path):
    """One brand with 8e10 pairs by size, of which 799,997 hold; made one by one they take many minutes, so jobs end after two."""
    n = 400_000
    price = F.when(F.col("id") == 0, 50.0).when(F.col("id") == n - 1, 5000.0).otherwise(900 + F.col("id") % 1000 / 10)
    size = F.when(F.col("id") == 0, 50).when(F.col("id") == n - 1, 0).otherwise(F.col("id") % 48 + 1)
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), size.cast("int").alias("p_size"), price.alias("p_retailprice"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    clock = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    clock.start()
    try:
        got = entries()["join_theta_range"].run(spark, str(tmp_path))
        pairs = got.agg(F.count(F.lit(1)), F.count_if(F.col("other") == 0), F.count_if(F.col("p_partkey") == n - 1), F.countDistinct("p_partkey", "other")).first()
    finally:
        clock.cancel()
    # the cheap part goes with all others, as the dear one does
    assert tuple(pairs) == (2 * n - 3, n - 1, n - 1, 2 * n - 3)


@pytest.mark.parametrize(("value", "want"), [(1.0, "1"), (1e20, "100000000000000000000"), (0.1, "0.1"), (1e-7, "0.0000001"), (math.nan, "NaN"), (-math.inf, "-inf"), (True, "t"), (None, None), ([1, None], "{1,NULL}"), (b"\x01", "\\x01")])
def test_text(value, want):
    assert render.value_text(value) == want


def test_json_response(spark):
    df = spark.sql("SELECT 'Mona' AS name, CAST(30 AS BIGINT) AS age")
    assert render.json_response(df) == {"schema": [{"name": "name", "type": "Utf8"}, {"name": "age", "type": "Int64"}], "data": [{"name": "Mona", "age": 30}]}
    odd = spark.sql("SELECT '30' AS a, 'true' AS b, CAST('NaN' AS DOUBLE) AS c, NULL AS d, '18446744073709551615' AS e, '1.5' AS f")
    assert render.json_response(odd)["data"] == [{"a": 30, "b": True, "c": "NaN", "d": None, "e": 18446744073709551615, "f": 1.5}]
    assert render.json_response(odd, sniff=False)["data"][0]["a"] == "30"
    assert render.json_response(df.limit(0)) == {"schema": render.json_response(df)["schema"], "data": []}
    assert render.text_rows(df) == [["Mona", "30"]] and render.wire_types(df) == [("name", "TEXT"), ("age", "INT8")]


def test_function_columns(spark):
    df = spark.sql("SELECT array(1, 2, 2, 3) AS a, 'abcabc' AS s")
    got = df.select(call("array_remove", "a", 2).alias("r"), call("array_positions", "a", 2).alias("p"), call("array_slice", "a", 2, 9).alias("s"), call("regexp_replace", "s", "'b'", "'X'").alias("x"), call("array_resize", "a", 6, 0).alias("z"), call("array_pop_back", "a").alias("b")).first()
    assert tuple(got) == ([1, 2, 3], [2, 3], [2, 2, 3], "aXcabc", [1, 2, 2, 3, 0, 0], [1, 2, 2])


def test_streams_equal_their_batches(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, k int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ltz"))
    for i in range(3):
        df.where(f"id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.timed(st.tail(spark, f"{tmp_path}/in", df.schema, per_trigger=1), "ts", "1 hour")
    st.refresh(st.windowed(stream, "ts", "10 minutes", "5 minutes", keys=["k"]), f"{tmp_path}/w", f"{tmp_path}/c1").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/w").collect())) == sorted(map(tuple, st.windowed(df, "ts", "10 minutes", "5 minutes", keys=["k"]).collect()))
    st.newest_wins(st.tail(spark, f"{tmp_path}/in", df.schema, per_trigger=1), f"{tmp_path}/n", "k", ["id"], f"{tmp_path}/c2").awaitTermination()
    assert sorted((r["k"], r["id"]) for r in st.newest_version(spark, f"{tmp_path}/n").collect()) == [(0, 27), (1, 28), (2, 29)]
    assert st.sessions(df, "ts", "2 minutes", ["k"]).count() == 30


def test_late_rows_stay_out_of_closed_windows(spark, tmp_path):
    def put(*minutes):
        spark.createDataFrame([(m, k) for k, m in enumerate(minutes)], "m int, k int").selectExpr("timestamp_seconds(1700000400 + m * 60) as ts", "k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    schema = "ts timestamp, k int"
    from pyspark.sql.types import _parse_datatype_string

    def advance():
        rows = st.timed(st.tail(spark, f"{tmp_path}/in", _parse_datatype_string(schema)), "ts", "10 minutes")
        st.append_to(st.windowed(rows, "ts", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
        return sorted((r["w_start"].minute, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put(0, 1, 12)
    first = advance()
    put(35)
    advance()
    put(2, 36)  # the first window is closed by now
    put(70)
    closed = advance()
    start = (1700000400 // 60) % 60
    assert first == [] or first[0][1] == 2
    assert ((start) % 60, 2) in closed and not any(n == 3 for _, n in closed)


def test_newest_wins_rewrites_the_parts_it_touches_only(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "k long, id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = st.tail(spark, f"{tmp_path}/in", spark.createDataFrame([], "k long, id long").schema)
        st.newest_wins(stream, f"{tmp_path}/n", "k", ["id"], f"{tmp_path}/c", parts=8).awaitTermination()
        return sorted((r["k"], r["id"]) for r in st.newest_version(spark, f"{tmp_path}/n").collect())

    put([(k, 0) for k in range(100)])
    run()
    for n in (1, 2, 3):
        put([(5, n)])
        assert run() == sorted([(k, 0) for k in range(100) if k != 5] + [(5, n)])
    sizes = sorted(len(list((tmp_path / "n" / f"version={v}").glob("part=*"))) for v in range(4))
    assert sizes == [0, 1, 1, 7]
