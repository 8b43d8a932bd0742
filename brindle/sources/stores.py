"""Durable stores in a shared folder: sharded key-value tables, sequence logs and their metadata.

Data are Parquet folders that never change; a journal says which of them are live and where their numbers start.  A
write puts its files down first and then commits one journal entry, so it is visible as a whole or not at all, and two
writers at once get numbers of their own.  Files that are no longer live stay for readers that still look at them, until
:meth:`_Parts.vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import keyed, log
from brindle.operators.keyed import UNBOUNDED, Bound
from brindle.plans.errors import Code, EngineError

from .journal import Journal

BATCH = "key binary, value binary, deleted boolean"
RECORDS = "lsn long, payload binary"
EVERYTHING = 2**62


def batch(spark: SparkSession, *entries: tuple) -> DataFrame:
    """A write batch: (key, value) puts and (key,) deletes, in order; a later entry of a key wins."""
    rows = [(bytearray(e[0]), bytearray(e[1]) if len(e) > 1 else None, len(e) == 1, i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, BATCH + ", at long")


class _Parts:
    """Numbered rows in parts.  A part: its folder, the number that its rows' ``at`` counts from, and its first and last number."""

    def __init__(self, spark: SparkSession, folder: str, columns: str):
        self.spark, self.columns, self.journal = spark, columns, Journal(spark, folder)

    @staticmethod
    def state(entries: Sequence[dict]) -> tuple[dict[str, dict], int]:
        """(live parts by folder, next number)."""
        live: dict[str, dict] = {}
        after = 0
        for entry in entries:
            for name in entry.get("drop", []):
                live.pop(name, None)
            live |= {p["folder"]: p for p in entry.get("add", [])}
            after = entry.get("next", after)
            if "keep_to" in entry:
                live = {n: p | {"last": min(p["last"], entry["keep_to"])} for n, p in live.items() if p["first"] <= entry["keep_to"]}
        return live, after

    def live(self) -> tuple[dict[str, dict], int]:
        return self.state(self.journal.entries())

    def rows(self, number: str, start: int = 0, end: int = EVERYTHING) -> DataFrame:
        """The live rows with start <= number < end; parts outside are not read."""
        return self.rows_of([p for p in self.live()[0].values() if p["first"] < end and p["last"] >= start], number).where((F.col(number) >= start) & (F.col(number) < end))

    def rows_of(self, parts: Sequence[dict], number: str) -> DataFrame:
        names = [c.split()[0] for c in self.columns.split(", ")]
        if not parts:
            return self.spark.createDataFrame([], f"{self.columns}, {number} long")
        root = self.journal.folder
        read = self.spark.read.schema(f"{self.columns}, at long").parquet(*[f"{root}/{p['folder']}" for p in parts])
        # one entry a live part: compaction keeps them few
        base = F.create_map(*[F.lit(x) for p in parts for x in (p["folder"], p["base"])])
        last = F.create_map(*[F.lit(x) for p in parts for x in (p["folder"], p["last"])])
        folder = F.regexp_extract(F.col("_metadata.file_path"), "(data/[0-9a-f]+(?:/segment=[0-9]+)?)/[^/]*$", 1)
        placed = read.select(*names, "at", folder.alias("__f")).select(*names, (F.col("at") + base[F.col("__f")]).alias(number), last[F.col("__f")].alias("__last"))
        return placed.where(F.col(number) <= F.col("__last")).drop("__last")

    def add(self, rows: DataFrame, per_segment: int | None = None) -> int:
        """Commit rows (self.columns, and ``at``: 0, 1, 2 ...); returns the number of the first."""
        folder = f"data/{uuid.uuid4().hex}"
        path = f"{self.journal.folder}/{folder}"
        if per_segment:
            rows.withColumn("segment", F.expr(f"at div {per_segment}")).write.partitionBy("segment").parquet(path)
        else:
            rows.write.parquet(path)
        n = self.spark.read.schema("at long").parquet(path).count()
        cuts = range(0, n, per_segment or max(n, 1))

        def entry(entries: list[dict]) -> dict:
            after = self.state(entries)[1]
            parts = [{"folder": f"{folder}/segment={a // per_segment}" if per_segment else folder, "base": after, "first": after + a, "last": after + min(a + cuts.step, n) - 1} for a in cuts]
            return {"add": parts, "next": after + n}

        return self.journal.commit(entry)["next"] - n

    def vacuum(self) -> list[str]:
        """Delete data that no live part names; for when no reader or writer is at work.  Returns the folders' names."""
        kept = {name.split("/")[1] for name in self.live()[0]}
        gone = [n for n in self.journal.names("data") if n not in kept]
        for name in gone:
            self.journal.drop(f"data/{name}")
        return gone


class Shards:
    """Key-ordered tables by shard number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _shard(self, shard: int) -> _Parts:
        parts = _Parts(self.spark, f"{self.folder}/shard={shard}", BATCH)
        if not parts.journal.exists():
            raise EngineError(f"not found: shard {shard}", Code.KEY_NOT_FOUND)
        return parts

    def create_shard(self, shard: int, **options: object) -> None:
        """Nothing happens if it is there."""
        Journal(self.spark, f"{self.folder}/shard={shard}").make()

    def shards(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in Journal(self.spark, self.folder).names() if n.startswith("shard="))

    def write(self, shard: int, rows: DataFrame) -> None:
        """Append a batch (columns of BATCH, and ``at``, its order)."""
        self._shard(shard).add(log.numbered(rows.withColumnRenamed("at", "__order"), ["__order"], "at").select("key", "value", "deleted", "at"))

    def scan(self, shard: int, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, reverse: bool = False) -> DataFrame:
        """(key, value, deleted): one row a key, its newest, in key order.  Tombstones are rows; the caller drops them.

        The bounds come before the merge, so they reach the files.
        """
        inside = self._shard(shard).rows("seq").where(keyed.within(F.col("key"), lower, upper))
        newest = keyed.latest(inside, "key", ["seq"]).select("key", "value", "deleted")
        return newest.orderBy(F.col("key").desc() if reverse else F.col("key").asc())

    def get(self, shard: int, key: bytes) -> DataFrame:
        return self.scan(shard, Bound.included(bytearray(key)), Bound.included(bytearray(key)))

    def compact(self, shard: int) -> bool:
        """Rewrite the shard's present parts without shadowed rows and tombstones, sorted by key so that files have narrow
        key ranges.  Batches written meanwhile stay as they are; if another compaction was first, nothing changes."""
        parts = self._shard(shard)
        merged, _ = parts.live()
        if not merged:
            return True
        kept = keyed.compact(parts.rows_of(list(merged.values()), "seq"), "key", ["seq"]).select("key", "value", "deleted", F.col("seq").alias("at"))
        folder = f"data/{uuid.uuid4().hex}"
        kept.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{parts.journal.folder}/{folder}")

        def entry(entries: list[dict]) -> dict | None:
            live, after = parts.state(entries)
            if not set(merged) <= set(live):
                return None
            return {"drop": list(merged), "add": [{"folder": folder, "base": 0, "first": 0, "last": max(p["last"] for p in merged.values())}], "next": after}

        return parts.journal.commit(entry) is not None

    def vacuum(self, shard: int) -> list[str]:
        return self._shard(shard).vacuum()


class Log:
    """Records numbered 0, 1, 2 ... in segments of at most ``per_segment``; closed logs take no more."""

    def __init__(self, spark: SparkSession, folder: str, per_segment: int = 1 << 20):
        self.spark, self.closed, self.per_segment = spark, False, per_segment
        self._parts = _Parts(spark, folder, "payload binary")

    def next_lsn(self) -> int:
        return self._parts.live()[1]

    def durable_lsn(self) -> int | None:
        """The highest lsn whose append has been committed; None before the first."""
        after = self.next_lsn()
        return after - 1 if after else None

    def segments(self) -> list[tuple[int, int]]:
        """(first lsn, last lsn) of each live segment, in order."""
        return sorted((p["first"], p["last"]) for p in self._parts.live()[0].values())

    def append(self, payloads: DataFrame, payload: str, order: str) -> int:
        """Append rows in the order of a column; returns the first lsn.  It is durable when this returns."""
        if self.closed:
            raise EngineError("the log is closed", Code.STORAGE_IO)
        rows = log.numbered(payloads.select(F.col(payload).cast("binary").alias("payload"), F.col(order).alias("__order")), ["__order"], "at")
        return self._parts.add(rows.select("payload", "at"), self.per_segment)

    def sync(self) -> int | None:
        """Appends are durable when they return; this tells up to where."""
        return self.durable_lsn()

    def scan(self, start: int = 0, end: int = EVERYTHING) -> DataFrame:
        return log.read(self._parts.rows("lsn", start, end).select("lsn", "payload"), start, end)

    def get(self, lsn: int) -> bytes | None:
        row = self._parts.rows("lsn", lsn, lsn + 1).first()
        return bytes(row["payload"]) if row else None

    def truncate_before(self, keep_from: int) -> None:
        """Drop the segments that end below ``keep_from``; a segment that holds it stays whole."""

        def entry(entries: list[dict]) -> dict | None:
            gone = [n for n, p in _Parts.state(entries)[0].items() if p["last"] < keep_from]
            return {"drop": gone} if gone else None

        self._parts.journal.commit(entry)

    def truncate_after(self, keep_to: int) -> None:
        """Forget the records above ``keep_to``; the next append takes their numbers."""

        def entry(entries: list[dict]) -> dict | None:
            after = _Parts.state(entries)[1]
            return {"keep_to": keep_to, "next": keep_to + 1} if keep_to + 1 < after else None

        self._parts.journal.commit(entry)

    def compact(self) -> list[str]:
        """Delete the files of dropped segments."""
        return self._parts.vacuum()

    def close(self) -> None:
        self.closed = True


class LogService:
    """One log per replication group, each in a folder of its own below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._logs: dict[int, Log] = {}

    def create_group(self, group: int, per_segment: int = 1 << 20) -> None:
        """Nothing happens if it is there."""
        if group not in self._logs:
            made = Log(self.spark, f"{self.root}/{group}", per_segment)
            made._parts.journal.make()
            self._logs[group] = made

    def get(self, group: int) -> Log:
        if group not in self._logs and Journal(self.spark, f"{self.root}/{group}").exists():
            self.create_group(group)
        if group not in self._logs:
            raise EngineError(f"not found: replication group {group}", Code.KEY_NOT_FOUND)
        return self._logs[group]


LSM = "lsm"


class Router:
    """Storage engines by kind, and the logs that their shards' groups share.  It knows shards, not table names."""

    def __init__(self, spark: SparkSession, folder: str, engines: dict[str, Any] | None = None):
        root = folder.rstrip("/")
        self.engines = engines or {LSM: Shards(spark, f"{root}/shards")}
        self.logs = LogService(spark, f"{root}/log")

    def engine(self, kind: str) -> Any:
        if kind not in self.engines:
            raise EngineError(f"not found: engine {kind} is not registered", Code.KEY_NOT_FOUND)
        return self.engines[kind]

    def create_group(self, group: int, per_segment: int = 1 << 20) -> None:
        self.logs.create_group(group, per_segment)

    def create_shard(self, kind: str, shard: int, group: int, **options: object) -> None:
        engine = self.engine(kind)
        self.logs.get(group)
        engine.create_shard(shard, **options)

    def write(self, kind: str, shard: int, rows: DataFrame) -> None:
        self.engine(kind).write(shard, rows)

    def scan(self, kind: str, shard: int, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, reverse: bool = False) -> DataFrame:
        return self.engine(kind).scan(shard, lower, upper, reverse)


class Metadata:
    """Replication groups, and tables with their one shard each.  With a folder it is durable and shared; with a router,
    groups get their logs and tables their shards."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None, router: Router | None = None):
        self._journal = Journal(spark, folder) if spark is not None and folder is not None else None
        self._memory: list[dict] = []
        self.router = router

    def _entries(self) -> list[dict]:
        return self._journal.entries() if self._journal else self._memory

    def _commit(self, build) -> dict | None:
        if self._journal:
            return self._journal.commit(build)
        entry = build(self._memory)
        self._memory += [entry] if entry else []
        return entry

    @property
    def groups(self) -> set[int]:
        return {e["group"] for e in self._entries() if "name" not in e}

    def create_group(self, group: int) -> None:
        """Nothing happens if it is there."""
        if self.router:
            self.router.create_group(group)
        self._commit(lambda entries: None if any(e["group"] == group and "name" not in e for e in entries) else {"group": group})

    def create_table(self, name: str, group: int, kind: str = LSM, **options: object) -> int:
        """The new table's shard; a name that is taken is given anew."""
        if group not in self.groups:
            raise EngineError(f"not found: replication group {group}", Code.KEY_NOT_FOUND)
        entry = self._commit(lambda entries: {"name": name, "group": group, "kind": kind, "shard": 1 + sum("name" in e for e in entries), "options": options})
        if self.router:
            self.router.create_shard(kind, entry["shard"], group, **options)
        return entry["shard"]

    def _table(self, name: str) -> dict:
        found = [e for e in self._entries() if e.get("name") == name]
        if not found:
            raise EngineError(f"not found: table {name}", Code.KEY_NOT_FOUND)
        return found[-1]

    def shard_for(self, name: str) -> int:
        return self._table(name)["shard"]

    def kind_of(self, name: str) -> str:
        return self._table(name)["kind"]

    def options(self, name: str) -> dict:
        return dict(self._table(name)["options"])


def partitioned(df: DataFrame, kind: str, key: str, parts: int | None = None) -> DataFrame:
    """Deal rows out by 'hash' or 'range' of a key; 'none' leaves them."""
    if kind == "none":
        return df
    columns = ([parts] if parts else []) + [F.col(key)]
    return df.repartition(*columns) if kind == "hash" else df.repartitionByRange(*columns)
