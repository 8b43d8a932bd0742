"""Key-ordered tables and sequence logs over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import keyed as kv
from brindle.operators import log
from brindle.sources import scratch, stores

from .base import Entry, frame

KEYS = ["o_orderkey", "o_totalprice"]


def _events(events):
    return events.select("user_id", "ts", F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("deleted"))


def _bounds(orders):
    rows = orders.select("o_orderkey")
    out = None
    for name, lo, hi in (("ii", kv.Bound.included(100), kv.Bound.included(120)), ("ie", kv.Bound.included(100), kv.Bound.excluded(120)), ("ei", kv.Bound.excluded(100), kv.Bound.included(120)), ("ee", kv.Bound.excluded(100), kv.Bound.excluded(120)), ("ui", kv.UNBOUNDED, kv.Bound.included(120)), ("iu", kv.Bound.included(14000), kv.UNBOUNDED)):
        part = rows.where(kv.within(F.col("o_orderkey"), lo, hi)).select(F.lit(name).alias("bounds"), "o_orderkey")
        out = part if out is None else out.union(part)
    return out


def _cut(orders, where):
    """Rows of the whole table by a condition on ``top``, its largest key."""
    return orders.select("o_orderkey").crossJoin(F.broadcast(orders.agg(F.max("o_orderkey").alias("top")))).where(where).select("o_orderkey")


def _layers(orders):
    """Two layers that together hold every order: keys from a third on over those up to two thirds."""
    return [_cut(orders, "o_orderkey >= top div 3").withColumn("v", F.lit("new")), _cut(orders, "o_orderkey <= 2 * top div 3").withColumn("v", F.lit("base"))]


def _numbered(events):
    return log.numbered(events.select("event_id", "ts", "value"), ["ts", "event_id"])


def _torn(events):
    """Frames whole, short of their last byte, and with a byte changed."""
    whole = _numbered(events).select("lsn", log.frame(F.col("lsn"), F.col("event_id").cast("string").cast("binary")).alias("f"))
    cut = F.substring("f", 1, F.octet_length("f") - 1)
    bad = F.concat(cut, F.lit(b"!"))
    states = [log.decode(c)["state"].alias(n) for n, c in (("whole", F.col("f")), ("short", cut), ("changed", bad), ("head", F.substring("f", 1, 9)))]
    return whole.select("lsn", *states)


def _stored(orders):
    """A shard: two writes, a delete of every order of one status, and a compaction between."""
    spark = orders.sparkSession
    shards = stores.Shards(spark, scratch.folder(spark, "shards"))
    shards.create_shard(1)
    rows = orders.select(F.col("o_orderkey").cast("string").cast("binary").alias("key"), F.col("o_orderpriority").cast("binary").alias("value"), F.lit(False).alias("deleted"), F.col("o_orderkey").alias("at"), "o_orderstatus", "o_orderkey")
    batch = ["key", "value", "deleted", "at"]
    shards.write(1, rows.select(batch))
    shards.write(1, rows.where("o_orderstatus = 'F'").withColumns({"value": F.lit(None).cast("binary"), "deleted": F.lit(True)}).select(batch))
    shards.compact(1)
    shards.write(1, rows.where("o_orderstatus = 'O'").withColumn("value", F.lit("new").cast("binary")).select(batch))
    return shards.scan(1).select(F.col("key").cast("string").cast("bigint").alias("o_orderkey"), F.col("value").cast("string").alias("v"), "deleted")


def _logged(events):
    """A log of two appends, cut at both ends."""
    spark = events.sparkSession
    made = stores.Log(spark, scratch.folder(spark, "log"), per_segment=1000)
    rows = events.select(F.col("event_id").cast("string").alias("p"), "event_id")
    made.append(rows, "p", "event_id")
    n = made.next_lsn()
    made.truncate_after(n // 2)
    made.append(rows, "p", "event_id")
    made.truncate_before(n // 2 - 1)
    return made.scan(n // 2 - 5).select("lsn", F.col("payload").cast("string").cast("bigint").alias("event_id"))


def _entries(events):
    frames = _numbered(events).select("lsn", log.frame(F.col("lsn"), F.col("event_id").cast("string").cast("binary")).alias("frame"))
    entry = log.decode_entry(F.col("key"), F.col("value"))
    return log.indexed(frames, per_segment=1024).select("segment", entry.alias("e")).select("segment", "e.lsn", "e.offset", "e.length")


def _headers(events):
    per = log.segments(_numbered(events), 1024)
    raw = log.segment_header(F.col("segment").cast("int"), F.col("first_lsn"), F.col("last_lsn"), F.col("records").cast("int"))
    stored = scratch.store(per.select(raw.alias("raw")))  # as on disk; else the planner repeats the whole in each field's expression
    return stored.select(log.decode_header(F.substring("raw", 1, 20), F.col("raw")).alias("h")).select("h.*")


LSN = "(SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS lsn FROM events)"
TOP = "(SELECT MAX(o_orderkey) FROM orders)"

ENTRIES: dict[str, Entry] = {
    "kv_range_fwd": frame(lambda o: kv.range_scan(o.select(*KEYS), "o_orderkey", kv.Bound.included(1000), kv.Bound.excluded(1100)), "orders", oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 1100"),
    "kv_range_rev": frame(lambda o: kv.range_scan(o.select(*KEYS), "o_orderkey", kv.Bound.excluded(50), kv.Bound.included(90), reverse=True), "orders", oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 50 AND o_orderkey <= 90"),
    "kv_bounds_matrix": frame(_bounds, "orders", oracle="""
        SELECT b AS bounds, o_orderkey FROM orders, (VALUES ('ii', 100, 120, true, true), ('ie', 100, 120, true, false), ('ei', 100, 120, false, true), ('ee', 100, 120, false, false), ('ui', NULL, 120, true, true), ('iu', 14000, NULL, true, true)) t(b, lo, hi, li, hi_in)
        WHERE (lo IS NULL OR o_orderkey > lo OR (li AND o_orderkey = lo)) AND (hi IS NULL OR o_orderkey < hi OR (hi_in AND o_orderkey = hi))"""),
    "kv_get": frame(lambda o: kv.get(o.select(*KEYS), "o_orderkey", 777), "orders", oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 777"),
    "kv_seek_past_end": frame(lambda o: kv.seek(o.select(*KEYS), "o_orderkey", 10**9), "orders", oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000000000"),
    "kv_latest": frame(lambda e: kv.latest(_events(e), "user_id", ["ts", "seq"]).select("user_id", "seq", "value", "deleted"), "events", oracle="""
        SELECT user_id, event_id AS seq, value, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""),
    "kv_live_tombstone": frame(lambda e: kv.live(kv.latest(_events(e), "user_id", ["ts", "seq"])).select("user_id", "seq", "value"), "events", oracle="SELECT user_id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"),
    "kv_compact": frame(lambda e: kv.compact(_events(e), "user_id", ["seq"]).select("user_id", "seq"), "events", oracle="SELECT user_id, seq FROM (SELECT user_id, MAX(event_id) AS seq FROM events GROUP BY user_id) m JOIN (SELECT event_id, event_type FROM events) e ON e.event_id = m.seq WHERE event_type <> 'error'"),
    "kv_seek_ge": frame(lambda o: kv.seek(o.select(*KEYS), "o_orderkey", 1233.5), "orders", oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1233.5 ORDER BY o_orderkey LIMIT 1"),
    "kv_seek_le": frame(lambda o: kv.seek(o.select(*KEYS), "o_orderkey", 1233.5, reverse=True), "orders", oracle="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 1233.5 ORDER BY o_orderkey DESC LIMIT 1"),
    "kv_merge_nodedup": frame(lambda o: kv.merge(_layers(o), "o_orderkey"), "orders", oracle=f"SELECT o_orderkey, 'new' AS v, 0 AS layer FROM orders WHERE o_orderkey >= {TOP} // 3 UNION ALL SELECT o_orderkey, 'base', 1 FROM orders WHERE o_orderkey <= 2 * {TOP} // 3"),
    "kv_merge_shadow": frame(lambda o: kv.shadow(_layers(o), "o_orderkey"), "orders", oracle=f"SELECT o_orderkey, CASE WHEN o_orderkey >= {TOP} // 3 THEN 'new' ELSE 'base' END AS v, CASE WHEN o_orderkey >= {TOP} // 3 THEN 0 ELSE 1 END AS layer FROM orders"),
    "kv_concat": frame(lambda o: kv.merge([_cut(o, "o_orderkey < top div 2"), _cut(o, "o_orderkey >= top div 2")], "o_orderkey").select("o_orderkey"), "orders", oracle="SELECT o_orderkey FROM orders"),
    "kv_write_batch": frame(lambda o: kv.write_batch(o.select("o_orderkey"), 500, ["o_orderkey"]), "orders", oracle="SELECT o_orderkey, 499 + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders"),
    "log_scan_range": frame(lambda e: log.read(_numbered(e), 100, 200).select("lsn", "event_id"), "events", oracle=f"SELECT lsn, event_id FROM {LSN} WHERE lsn >= 100 AND lsn < 200"),
    "log_scan_durable": frame(lambda e: log.read(_numbered(e), 100, 200, durable=150).select("lsn", "event_id"), "events", oracle=f"SELECT lsn, event_id FROM {LSN} WHERE lsn >= 100 AND lsn <= 150"),
    "log_durable": frame(lambda e: log.durable_lsn(_numbered(e)), "events", oracle=f"SELECT MAX(lsn) AS durable_lsn FROM {LSN}"),
    "log_segments": frame(lambda e: log.segments(_numbered(e), 1024), "events", oracle=f"SELECT lsn // 1024 AS segment, MIN(lsn) AS first_lsn, MAX(lsn) AS last_lsn, COUNT(*) AS records FROM {LSN} GROUP BY 1"),
    "log_truncate": frame(lambda e: log.truncate_after(log.truncate_before(_numbered(e), 5000), 5100).select("lsn", "event_id"), "events", oracle=f"SELECT lsn, event_id FROM {LSN} WHERE lsn BETWEEN 5000 AND 5100"),
    "log_frames": frame(lambda e: _numbered(e).select("lsn", log.decode(log.frame(F.col("lsn"), F.concat(F.lit("payload-"), F.col("event_id").cast("string")).cast("binary"))).alias("d")).select("lsn", F.col("d.lsn").alias("decoded"), F.col("d.payload").cast("string").alias("payload"), F.col("d.state").alias("state")), "events", oracle=f"SELECT lsn, lsn AS decoded, 'payload-' || event_id AS payload, 'ok' AS state FROM {LSN}"),
    "log_states": frame(_torn, "events", oracle=f"SELECT lsn, 'ok' AS whole, 'torn' AS short, 'corrupt' AS changed, 'torn' AS head FROM {LSN}"),
    "log_index": frame(_entries, "events", oracle=f"SELECT lsn // 1024 AS segment, lsn, CAST(coalesce(sum(size) OVER (PARTITION BY lsn // 1024 ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, size AS length FROM (SELECT lsn, 16 + strlen(CAST(event_id AS VARCHAR)) AS size FROM {LSN})"),
    "log_header": frame(_headers, "events", oracle=f"SELECT lsn // 1024 AS segment, MIN(lsn) AS first_lsn, MAX(lsn) AS last_lsn, COUNT(*) AS records FROM {LSN} GROUP BY 1"),
    "log_store": frame(_logged, "events", oracle="SELECT n // 2 + 1 + i AS lsn, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) UNION ALL SELECT i, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i BETWEEN n // 2 - 5 AND n // 2 AND least(i // 1000 * 1000 + 999, n // 2) >= n // 2 - 1"),
    "kv_store": frame(_stored, "orders", oracle="SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderpriority END AS v, FALSE AS deleted FROM orders WHERE o_orderstatus <> 'F'"),
    "kv_partitioned": frame(lambda o: stores.partitioned(stores.partitioned(o.select("o_orderkey", "o_custkey"), "hash", "o_custkey"), "range", "o_orderkey").select("o_orderkey"), "orders", oracle="SELECT o_orderkey FROM orders"),
}
