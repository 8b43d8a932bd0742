import pytest
from pyspark.sql import functions as F

from brindle.operators.keyed import Bound
from brindle.plans.errors import Code, EngineError
from brindle.sources import definitions, stores


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"]) if r["value"] is not None else None) for r in df.collect()]


def test_shards_write_scan_delete_compact(spark, tmp_path):
    kv = stores.Shards(spark, f"{tmp_path}/kv")
    with pytest.raises(EngineError) as e:
        kv.scan(1)
    assert e.value.code == Code.KEY_NOT_FOUND
    kv.create_shard(1)
    kv.create_shard(1)
    assert kv.shards() == [1] and pairs(kv.scan(1)) == []
    kv.write(1, stores.batch(spark, (b"a", b"1"), (b"c", b"1"), (b"a", b"2")))
    kv.write(1, stores.batch(spark, (b"b", b"3"), (b"c",)))
    assert pairs(kv.scan(1)) == [(b"a", b"2"), (b"b", b"3"), (b"c", None)]
    assert pairs(kv.scan(1, reverse=True)) == [(b"c", None), (b"b", b"3"), (b"a", b"2")]
    assert pairs(kv.scan(1, Bound.included(bytearray(b"b")), Bound.excluded(bytearray(b"c")))) == [(b"b", b"3")]
    assert pairs(kv.get(1, b"a")) == [(b"a", b"2")] and pairs(kv.get(1, b"z")) == []
    kv.compact(1)
    assert pairs(kv.scan(1)) == [(b"a", b"2"), (b"b", b"3")]
    kv.write(1, stores.batch(spark, (b"b",)))
    assert pairs(kv.scan(1)) == [(b"a", b"2"), (b"b", None)]


def test_log_appends_scans_truncates_and_closes(spark, tmp_path):
    made = stores.Log(spark, f"{tmp_path}/log")
    assert made.durable_lsn() is None and made.scan().count() == 0
    rows = spark.range(10).select("id", F.format_string("payload-%04d", "id").alias("p"))
    assert made.append(rows, "p", "id") == 0 and made.durable_lsn() == 9
    assert made.append(rows, "p", "id") == 10
    again = stores.Log(spark, f"{tmp_path}/log")  # another process finds what is there
    assert again.durable_lsn() == 19
    assert [(r["lsn"], bytes(r["payload"])) for r in again.scan(9, 11).collect()] == [(9, b"payload-0009"), (10, b"payload-0000")]
    again.truncate_before(12)
    assert [r["lsn"] for r in again.scan().collect()] == list(range(10, 20)) and again.durable_lsn() == 19 and len(again.compact()) == 1
    again.close()
    again.close()
    with pytest.raises(EngineError):
        again.append(rows, "p", "id")


def test_metadata():
    meta = stores.Metadata()
    with pytest.raises(EngineError):
        meta.create_table("t", 1)
    meta.create_group(1)
    assert meta.create_table("t", 1, size=3) == 1 and meta.create_table("u", 1) == 2
    assert meta.shard_for("u") == 2 and meta.options("t") == {"size": 3}
    with pytest.raises(EngineError):
        meta.shard_for("x")


def test_partition_kinds(spark):
    df = spark.range(100)
    assert stores.partitioned(df, "hash", "id", 3).select(F.spark_partition_id()).distinct().count() == 3
    assert stores.partitioned(df, "range", "id", 4).groupBy(F.spark_partition_id()).agg(F.max("id") - F.min("id")).count() == 4
    assert stores.partitioned(df, "none", "id") is df


def test_definitions(spark):
    found = definitions.tables(spark, {"tables": [
        {"name": "second", "columns": [{"name": "id", "type": "UInt64"}, {"name": "label", "type": "Utf8", "nullable": True}], "rows": [[1, "hello"], [2, None], [3]]},
        {"name": "first", "columns": [{"name": "val", "type": "UInt64"}, {"name": "flag", "type": "Boolean", "nullable": True}], "rows": [[10, True], [20, False], [30, "x"]]},
        {"name": "none", "columns": [{"name": "x", "type": "Float64"}]},
    ]})
    assert list(found) == ["second", "first", "none"] and found["none"].count() == 0
    assert [tuple(r) for r in found["second"].collect()] == [(1, "hello"), (2, None), (3, None)]
    assert [tuple(r) for r in found["first"].collect()] == [(10, True), (20, False), (30, None)]
    assert [f.nullable for f in found["first"].schema.fields] == [False, True]
    with pytest.raises(EngineError, match="unsupported type: Date"):
        definitions.table(spark, {"name": "t", "columns": [{"name": "x", "type": "Date"}]})
    with pytest.raises(EngineError, match="not nullable"):
        definitions.table(spark, {"name": "t", "columns": [{"name": "x", "type": "UInt64"}], "rows": [[-1]]})


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    made = stores.Log(spark, f"{tmp_path}/log", per_segment=4)
    rows = spark.range(10).select("id", F.format_string("p%04d", "id").alias("p"))
    with ThreadPoolExecutor(4) as pool:
        firsts = sorted(pool.map(lambda _: stores.Log(spark, f"{tmp_path}/log", per_segment=4).append(rows, "p", "id"), range(4)))
    assert firsts == [0, 10, 20, 30] and [r["lsn"] for r in made.scan().collect()] == list(range(40))
    assert len(made.segments()) == 12 and made.segments()[:3] == [(0, 3), (4, 7), (8, 9)]
    kv = stores.Shards(spark, f"{tmp_path}/kv")
    kv.create_shard(7)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: kv.write(7, stores.batch(spark, (b"k", b"%d" % i), (b"own%d" % i, b"x"))), range(4)))
    seqs = [r["seq"] for r in kv._shard(7).rows("seq").collect()]
    assert sorted(seqs) == list(range(8)) and kv.scan(7).count() == 5


def test_a_log_is_cut_at_either_end(spark, tmp_path):
    made = stores.Log(spark, f"{tmp_path}/log", per_segment=4)
    rows = spark.range(10).select("id", F.format_string("p%04d", "id").alias("p"))
    made.append(rows, "p", "id")
    made.truncate_after(5)
    assert made.durable_lsn() == 5 and made.segments() == [(0, 3), (4, 5)]
    assert made.append(rows.where("id > 7"), "p", "id") == 6
    assert [(r["lsn"], bytes(r["payload"])) for r in made.scan(4).collect()] == [(4, b"p0004"), (5, b"p0005"), (6, b"p0008"), (7, b"p0009")]
    made.truncate_before(4)
    assert made.get(3) is None and made.get(6) == b"p0008" and made.sync() == 7
    again = stores.Log(spark, f"{tmp_path}/log")
    again.truncate_after(7)
    assert [r["lsn"] for r in again.scan().collect()] == [4, 5, 6, 7] and again.compact() == []


def test_compaction_keeps_what_is_written_meanwhile(spark, tmp_path, monkeypatch):
    kv = stores.Shards(spark, f"{tmp_path}/kv")
    kv.create_shard(1)
    kv.write(1, stores.batch(spark, (b"a", b"1"), (b"b", b"1"), (b"a", b"2"), (b"b",)))
    before, then = kv.scan(1), stores._Parts.live
    calls = []

    def live(parts):  # another writer comes in between the compaction's reading and its commit
        found = then(parts)
        if not calls:
            calls.append(1)
            kv.write(1, stores.batch(spark, (b"c", b"9")))
        return found

    monkeypatch.setattr(stores._Parts, "live", live)
    assert kv.compact(1)
    monkeypatch.undo()
    assert pairs(kv.scan(1)) == [(b"a", b"2"), (b"c", b"9")]
    assert pairs(before) == [(b"a", b"2"), (b"b", None)]  # a reader of the old state goes on
    assert len(kv.vacuum(1)) == 1 and pairs(kv.scan(1)) == [(b"a", b"2"), (b"c", b"9")]


def test_metadata_is_durable_and_routes(spark, tmp_path):
    router = stores.Router(spark, f"{tmp_path}/data")
    meta = stores.Metadata(spark, f"{tmp_path}/meta", router)
    meta.create_group(0)
    meta.create_group(0)
    shard = meta.create_table("t", 0, size=3)
    router.write(stores.LSM, shard, stores.batch(spark, (b"a", b"1")))
    again = stores.Metadata(spark, f"{tmp_path}/meta", stores.Router(spark, f"{tmp_path}/data"))
    assert again.groups == {0} and again.options("t") == {"size": 3} and again.kind_of("t") == stores.LSM
    assert pairs(again.router.scan(again.kind_of("t"), again.shard_for("t"))) == [(b"a", b"1")]
    assert again.create_table("t", 0) == 2 and meta.shard_for("t") == 2
    assert again.router.logs.get(0).append(spark.range(3).selectExpr("id", "'p' as p"), "p", "id") == 0
    for fails in (lambda: router.logs.get(9), lambda: router.write("btree", 1, None), lambda: router.create_shard(stores.LSM, 5, 9)):
        with pytest.raises(EngineError) as e:
            fails()
        assert e.value.code == Code.KEY_NOT_FOUND
