"""Exact k nearest binary codes by incremental multi-index hashing.

Codes are cut into segments, each with an index from its value to the codes that have it; segments are so wide that an
entry has about four.  A query probes the indexes at segment distance 0, 1, 2 ..., segment by segment; after radius r
on the first a segments and r - 1 on the others, any code not yet met differs by more than that in each, so by
``segments * r + a`` bits at least.  A query is finished when its kth verified distance is below that: no code unmet
can come before, or tie with, it.  Probes of few values go in one step, so that steps stay few.

An index is kept in blocks by the leading bits of its values, larger ones split by the codes' hash.  A query goes, with
others, to the blocks whose leading bits are near enough; there its probes are looked up, the codes met are compared as
arrays, and at most k + 1 rows come back per query and block.

Equal codes are one index entry with the k + 1 smallest ids, as no other of them can be among the k nearest; queries of
equal code are one search.  A pair is verified once: at the first segment in which it is that near.

Defined results: rows without a usable vector (see :mod:`vectors`; zero vectors take part) are no query and no neighbour;
a query's own row does not count, but other rows of equal code do; rows that repeat an id are one; ties go to the
smaller id; fewer rows than k give all; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store, tidy
from .vectors import clean, matrix


def cut(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment, as even as possible."""
    bounds = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def codes(table: DataFrame, id_column: str, vector_column: str, segments: int) -> DataFrame:
    """(id, code): the signs of the components (positive: 1), as one number per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = matrix(batch.column("raw")) > 0
            parts = [bits[:, a : a + n] @ (1 << np.arange(n)) for a, n in cut(bits.shape[1], segments)]
            flat = np.stack(parts, axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "code"])

    return clean(table, id_column, vector_column, zero_too=True).mapInArrow(tidy(run), "id long, code array<int>")


def steps(widths: list[int], least: int = 1000) -> list[list[tuple[int, int]]]:
    """(radius, segment) in the order of probing, cut into steps of ``least`` probes a query or one pair."""
    out: list[list[tuple[int, int]]] = [[]]
    size = 0
    for radius in range(max(widths) + 1):
        for segment, width in enumerate(widths):
            if size >= least:
                out.append([])
                size = 0
            out[-1].append((radius, segment))
            size += math.comb(width, radius)
    return out


MOST_PROBES = 1 << 18  # numbers that a block's lookups hold at once


@functools.lru_cache(maxsize=1024)
def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` of them set."""
    if radius > width:
        return np.zeros(0, dtype=np.int64)
    if radius in (0, width):
        return np.array([(1 << radius) - 1], dtype=np.int64)
    return np.concatenate([_masks(width - 1, radius), _masks(width - 1, radius - 1) | (1 << (width - 1))])


def _met_values(value: np.ndarray, prefix: int, tail: int, some: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, query) where a block's sorted values, all of one prefix, differ from a query's in ``radius`` of the ``tail``
    trailing bits: each such value is looked up, or all values are compared where that is less."""
    low_bits = some & ((1 << tail) - 1)
    if math.comb(tail, radius) > len(value):
        owner, entry = np.nonzero(np.bitwise_count((value & ((1 << tail) - 1))[None, :] ^ low_bits[:, None]) == radius)
        return entry, owner
    masks = _masks(tail, radius)
    probe = ((prefix << tail) | (low_bits[:, None] ^ masks)).ravel()
    low = np.searchsorted(value, probe, side="left")
    each = np.searchsorted(value, probe, side="right") - low
    entry = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return entry, np.repeat(np.repeat(np.arange(len(some)), len(masks)), each)


def _slices(at: np.ndarray, each: int) -> list[np.ndarray]:
    """``at`` cut so that ``each`` numbers for every one stay within MOST_PROBES."""
    step = max(MOST_PROBES // max(each, 1), 1)
    return [at[i : i + step] for i in range(0, len(at), step)] if each else []


def blocks_of(entries: DataFrame, widths: list[int], lead: int, block: int) -> DataFrame:
    """(segment, prefix, values, codes, ids, counts): the index in blocks, each sorted by value."""
    shift = F.element_at(F.array(*[F.lit(w - lead) for w in widths]), F.col("segment") + 1)
    exploded = entries.select("code", "ids", F.posexplode("code").alias("segment", "value"))
    rows = exploded.withColumn("prefix", F.call_function("shiftright", F.col("value"), shift))
    sizes = rows.groupBy("segment", "prefix").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = rows.join(sizes, ["segment", "prefix"]).withColumn("part", F.pmod(F.xxhash64("code"), "parts"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        value = table.column("value").to_numpy()
        order = np.argsort(value, kind="stable")
        code = np.stack([np.asarray(c) for c in table.column("code").to_pylist()])[order].astype("<i4")
        ids = table.column("ids").to_pylist()
        flat = [i for o in order.tolist() for i in sorted(ids[o])]
        counts = np.array([len(ids[o]) for o in order.tolist()], dtype="<i4")
        cells = [value[order].astype("<i4"), code, np.array(flat, dtype="<i8"), counts]
        return pa.table({"segment": table.column("segment").slice(0, 1), "prefix": table.column("prefix").slice(0, 1), **{n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(("values", "codes", "ids", "counts"), cells, strict=True)}})

    packed = dealt.groupBy("segment", "prefix", "part").applyInArrow(lambda t: pack(t), "segment int, prefix int, values binary, codes binary, ids binary, counts binary")
    return store(packed)


def _routed(active: DataFrame, widths: list[int], lead: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """(segment, prefix, radius, queries): queries together, for each block that may have values at a radius from theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = {r: np.concatenate([_masks(lead, i) for i in range(min(r, lead) + 1)]) for r, _ in pairs}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                code = some.column("query").flatten().to_numpy().reshape(some.num_rows, -1)
                for r, s in pairs:
                    if r > widths[s]:
                        continue
                    prefix = (code[:, s : s + 1] >> (widths[s] - lead)) ^ turn[r]
                    owner = np.broadcast_to(np.arange(len(code))[:, None], prefix.shape).ravel()
                    order = np.argsort(prefix.ravel(), kind="stable")
                    names, starts = np.unique(prefix.ravel()[order], return_index=True)
                    queries = [code[x].astype("<i4").tobytes() for x in np.split(owner[order], starts[1:])]
                    n = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s] * n, pa.int32()), pa.array(names.astype(np.int32)), pa.array([r] * n, pa.int32()), pa.array(queries, pa.binary())], ["segment", "prefix", "radius", "queries"]
                    )

    return active.mapInArrow(tidy(run), "segment int, prefix int, radius int, queries binary")


def _met(widths: list[int], lead: int, k: int):
    """Compares queries with a block: the k + 1 nearest ids of each among those met first at this radius and segment."""
    parts = len(widths)

    def one(row: dict) -> tuple[np.ndarray, ...]:
        s, r, prefix = row["segment"], row["radius"], row["prefix"]
        value, counts, ids = (np.frombuffer(row[c], dtype=t) for c, t in (("values", "<i4"), ("counts", "<i4"), ("ids", "<i8")))
        codes_, queries = (np.frombuffer(row[c], dtype="<i4").reshape(-1, parts) for c in ("codes", "queries"))
        first_id = np.cumsum(counts) - counts
        tail, out = widths[s] - lead, []
        flips = np.bitwise_count((queries[:, s] >> tail) ^ prefix).astype(np.int64)
        # what the leading bits differ in is known, so the rest of the radius lies in the trailing ones
        for f, at in [(f, at) for f in np.unique(flips).tolist() for at in _slices(np.flatnonzero(flips == f), min(math.comb(tail, r - f), len(value)))]:
            some = queries[at]
            entry, owner = _met_values(value.astype(np.int64), prefix, tail, some[:, s].astype(np.int64), r - f)
            apart = np.bitwise_count(some[owner] ^ codes_[entry]).astype(np.int32)
            # met here first: nearer in no segment, and as near in none before this one
            good = (apart[:, s:] >= r).all(axis=1) & (apart[:, :s] > r).all(axis=1)
            entry, owner, distance = entry[good], owner[good], apart[good].sum(axis=1)
            n = counts[entry]
            owner, distance = np.repeat(owner, n), np.repeat(distance, n)
            member = ids[np.repeat(first_id[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            order = np.lexsort((member, distance, owner))
            owner, distance, member = owner[order], distance[order], member[order]
            near = np.arange(len(owner)) - np.searchsorted(owner, owner) <= k
            out.append((some[owner[near]], distance[near], member[near]))
        if not out:
            return np.zeros((0, parts), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                code, distance, member = one({n: (batch.column(n)[row].as_buffer() if pa.types.is_binary(batch.schema.field(n).type) else batch.column(n)[row].as_py()) for n in batch.schema.names})
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts), pa.int32()), pa.array(code.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(distance.astype(np.int32)), pa.array(member)], ["query", "distance", "id"])

    return run


def nearest(table: DataFrame, id_column: str, vector_column: str, queries: F.Column, k: int = 10, block: int = 8192) -> DataFrame:
    """(query_id, rank, id, distance); ``queries``: a condition on column id."""
    vectors = store(clean(table, id_column, vector_column, zero_too=True))
    n, size = vectors.agg(F.count(F.lit(1)), F.max(F.octet_length("raw"))).first()
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance int")
    width = size // 8
    parts = max(1, min(width, round(width / max(math.log2(n) - 2, 2))), -(-width // 24))
    widths = [w for _, w in cut(width, parts)]
    lead = min(max(math.ceil(math.log2(n / block)), 0), min(widths))
    rows = store(codes(table, id_column, vector_column, parts).distinct())
    first = Window.partitionBy("code").orderBy("id")
    entries = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).groupBy("code").agg(F.collect_list("id").alias("ids"))
    index = blocks_of(entries, widths, lead, block)
    asked = store(rows.where(queries).select(F.col("id").alias("query_id"), F.col("code").alias("query")))

    active, best, done = asked.select("query").distinct(), None, []
    plan = steps(widths)
    for number, pairs in enumerate(plan):
        meeting = _routed(active, widths, lead, pairs).join(index.hint("merge"), ["segment", "prefix"])
        found = meeting.mapInArrow(_met(widths, lead, k), "query array<int>, distance int, id long")
        if best is not None:
            found = found.union(best)
        top = Window.partitionBy("query").orderBy("distance", "id")
        best = store(found.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1).drop("at"))
        known = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last"))
        if number < len(plan) - 1:
            radius, segment = pairs[-1]
            known = known.where((F.col("n") > k) & (F.col("last") < parts * radius + segment + 1))
        settled = store(known.select("query"))
        done.append(best.join(settled, "query", "left_semi"))
        best = store(best.join(settled, "query", "left_anti"))
        active = store(active.join(settled, "query", "left_anti"))
        if active.isEmpty():
            break
    everything = done[0]
    for more in done[1:]:
        everything = everything.union(more)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    out = asked.join(everything, "query").where("id != query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), "id", "distance")


ORACLE_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.bits) + 1), lambda i: abs(q.bits[i] - c.bits[i]))) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id AND len(q.bits) = len(c.bits) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
