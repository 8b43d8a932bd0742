"""Near-duplicate classes by min-max hashing.

A document is its set of distinct word shingles.  Under each of ``permutations`` hash permutations both the
minimum and the maximum are kept: two signature values for one evaluation.  ``rows`` successive values make a
band; sets that agree in a band are candidates, and a link holds only if the full sets say so.

Equal sets form one vertex.  In a band's bucket every member is compared with the bucket's hub (the member with
most bucket mates), not with every other; links found so give components.  Only where a bucket still holds
several components are members outside its largest one compared with others, through an exact set-similarity join:
members without enough shingles that any other has leave, and pairs must share one of their rarest shingles.  So a
group of thousands of copies costs one comparison a member and few more for its strays, and no candidate is capped.

With 64 permutations and rows of 4, two sets at similarity 0.75 share no band with probability 5e-6.

Keys that many rows share (a text's copies, a band's bucket, a hub) meet a broadcast of such keys, which are few by
count, or are salted; other keys are exchanged.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; rows that repeat an id
are one vertex, linked by each of their texts; a row of null id takes no part (component null, kept); an empty
table gives no rows; extra columns are kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import hot_limit, join_counted, store, tidy
from .wordhash import mix, shingle_sets

SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Per set (none empty) its minima and maxima, alternating: (sets, 2 * permutations) uint32."""
    flat = np.concatenate(sets)
    low = ((flat >> np.uint64(32)) ^ flat).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * permutations), dtype=np.uint32)
    for k, (a, b) in enumerate(zip(*_permutations(permutations), strict=True)):
        p = low * a + b
        out[:, 2 * k] = np.minimum.reduceat(p, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(p, starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band: its number and its values."""
    n = signature.shape[1] // rows
    values = signature.reshape(len(signature), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return key.view(np.int64)


def sign(docs: DataFrame, size: int, permutations: int, rows: int) -> DataFrame:
    """Per row: the set's size, a 128-bit key of the set, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column("text"), size):
                full = [i for i, s in enumerate(sets) if len(s)]
                n, keys = np.array([len(s) for s in sets]), np.zeros((2, len(sets)), dtype=np.uint64)
                band = [None] * len(sets)
                if full:
                    some = [sets[i] for i in full]
                    for i, s, b in zip(full, some, bands(signatures(some, permutations), rows), strict=True):
                        keys[:, i] = s.sum(), mix(s ^ np.uint64(0x5DEECE66D)).sum()
                        band[i] = b
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(sets)), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(band, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), SIGNED)


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, members): the full shingle set, as sorted 8-byte numbers, of each text of the given ids."""
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    found = found.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "members"])

    return found.mapInArrow(tidy(run), "id long, members binary")


def _with_set(pairs: DataFrame, sets: DataFrame, column: str, name: str, limit: int) -> DataFrame:
    """``pairs`` with the sets of ``column``'s ids: the set of an id in many pairs is copied, so that its pairs are dealt out."""
    hot = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    hot = F.broadcast(hot.select(F.col(column).alias("__id"), F.ceil(F.col("n") / limit).alias("__copies")))  # see hot_limit
    dealt = pairs.join(hot, F.col(column) == F.col("__id"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("v", "u"), "__copies"), F.lit(0))).drop("__id", "__copies")
    copied = sets.select(F.col("id").alias(column), F.col("members").alias(name)).join(hot, F.col(column) == F.col("__id"), "left")
    copied = copied.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1)) - 1))).drop("__id", "__copies")
    return dealt.join(copied, [column, "__salt"]).drop("__salt")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The (v, u) of ``pairs`` (each once, stored) whose full sets have 100 * intersection >= percent * union."""
    limit = hot_limit(pairs.count())
    both = _with_set(_with_set(pairs, sets, "v", "set_v", limit), sets, "u", "set_u", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_v"), batch.column("set_u"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                small, large = sorted((x, y), key=len)
                if not len(small) or 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["v", "u"]).filter(pa.array(keep))

    return store(both.select("v", "u", "set_v", "set_u").mapInArrow(tidy(run), "v long, u long").distinct())


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, shingle) of sets (id, members); text tells the sets of one id apart."""
    import xxhash

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            raw = [x.as_buffer() for x in some.column("members")]
            parts = [np.frombuffer(x, dtype=np.int64) for x in raw]
            names = np.array([xxhash.xxh3_64_intdigest(x) for x in raw], dtype=np.uint64).view(np.int64)
            n = [len(x) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column("id").to_numpy(), n)), pa.array(np.repeat(names, n)), pa.array(np.concatenate(parts))], ["id", "text", "shingle"])


SPREAD = "id long, text long, shingle long"


def promising(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Those of ``ids`` with enough shingles that another of ``ids`` has too: the others cannot be linked with any."""
    some = sets.join(ids, "id", "left_semi")
    only = some.mapInArrow(tidy(_spread), SPREAD).groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    private = only.groupBy("id").agg(F.count(F.lit(1)).alias("private"))
    sizes = some.groupBy("id").agg((F.min(F.octet_length("members")) / 8).alias("n"), (F.sum(F.octet_length("members")) / 8).alias("all"))
    return sizes.join(private, "id", "left").where(100 * (F.col("all") - F.coalesce("private", F.lit(0))) >= percent * F.col("n")).select("id")


def prefix_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (v, u) among ``members`` (id, part, stray) of different parts, one stray at least, that may be linked.

    Sets of n and m shingles are linked only if they share k = ceil(percent * (n + m) / (100 + percent)).  With the
    shingles of each in one order, rare ones first, such sets share one of the first n - k + 1 and m - k + 1.
    """
    rows = store(sets.join(members.select("id"), "id", "left_semi").mapInArrow(tidy(_spread), SPREAD), "lz4")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    own = Window.partitionBy("id", "text")
    placed = rows.join(often, "shingle").select(
        "id", "shingle", F.row_number().over(own.orderBy("often", "shingle")).alias("at"), F.count(F.lit(1)).over(own).alias("n")
    )
    first = store(placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).join(members, "id"), "lz4")
    a, b = first.where("stray").alias("a"), first.alias("b")
    k = F.expr(f"ceil({percent} * (a.n + b.n) / {100 + percent})")
    near = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.part") != F.col("b.part"))
    near &= (F.col("a.at") <= F.col("a.n") - k + 1) & (F.col("b.at") <= F.col("b.n") - k + 1)
    return a.join(b, near).select(F.greatest("a.id", "b.id").alias("v"), F.least("a.id", "b.id").alias("u")).distinct()


def classes(docs: DataFrame, size: int = 5, percent: int = 75, permutations: int = 64, rows: int = 4) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id reachable by links) and kept (whether that is its own)."""
    signed = store(sign(docs, size, permutations, rows), "lz4")
    limit = hot_limit(signed.count())
    active = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    text = ["key_a", "key_b"]
    vertex = store(active.groupBy(*text).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # by text and id, so that copies do not meet
    own = active.join(vertex.select(*text, F.col("rep").alias("doc_id")), [*text, "doc_id"]).select(F.col("doc_id").alias("id"), *text, "bands")
    reps = store(own.dropDuplicates(["id", *text]), "lz4")
    named = store(join_counted(signed.select("doc_id", "n_shingles", *text), vertex, text, "copies", limit, "left").withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep"))).drop(*text, "copies"))
    ties = _ties(named)

    exploded = reps.select("id", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bucket = store(join_counted(exploded, shared, ["key"], "c", hot_limit(32 * limit)))
    degree = bucket.groupBy("id").agg(F.sum("c").alias("degree"))
    hub = bucket.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top"), F.count(F.lit(1)).alias("n")).select("key", (-F.col("top.minus")).alias("hub"), "n")
    crowded = hot_limit(bucket.count())
    ordered = lambda a, b: [F.greatest(a, b).alias("v"), F.least(a, b).alias("u")]
    tried = store(join_counted(bucket.select("key", "id"), hub, ["key"], "n", crowded).where("id != hub").select(*ordered("id", "hub")).distinct())
    sets = store(full_sets(docs, bucket.select("id").distinct(), size), "lz4")
    links = verified(sets, tried, percent).union(ties)
    label = components(links)

    in_parts = bucket.join(label.select(F.col("v").alias("id"), F.col("u").alias("part")), "id", "left").select("key", "id", F.coalesce("part", "id").alias("part"))
    per_part = in_parts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_part.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("members")).where("parts > 1").select("key", F.col("top.part").alias("main"), "members")
    crowd = store(join_counted(in_parts, mixed, ["key"], "members", crowded).withColumn("stray", F.col("part") != F.col("main")))
    likely = store(crowd.join(promising(sets, crowd.select("id").distinct(), percent), "id"))
    live = likely.where("stray").select("key").distinct()
    members = store(likely.join(live, "key", "left_semi").groupBy("id", "part").agg(F.max("stray").alias("stray")))
    rest = store(prefix_pairs(sets, members, percent).join(tried, ["v", "u"], "left_anti"))
    if not rest.isEmpty():
        label = components(links.union(verified(sets, rest, percent)))

    # a row without shingles is its id's vertex all the same, where other rows of that id have some
    bare = named.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    lent = named.where("rep is not null").join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("lent"))
    found = named.join(lent, "doc_id", "left").withColumn("rep", F.coalesce("rep", "lent"))
    found = found.join(label.select(F.col("v").alias("rep"), F.col("u").alias("least")), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _ties(named: DataFrame) -> DataFrame:
    """(v, u) between the representatives of the texts that one id has."""
    per_id = named.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u < last")
    return named.where("rep is not null").join(per_id, "doc_id").where("rep > u").select(F.col("rep").alias("v"), "u").distinct()


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` per class: that of the class's least id; rows of null id all stay.

    Where several rows have that id, the one whose text and then whole row have the least hash stays, on every run alike.
    """
    dropped = classes(docs, **settings).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(dropped, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
    repeated = docs.where(docs["doc_id"].isNotNull()).groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again")
    repeated = store(repeated)  # reads ids alone
    if repeated.isEmpty():
        return left
    again = docs["doc_id"] == F.col("__again")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # an aggregate, so that an id of many rows combines before the exchange
    first = left.join(repeated, again, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(*hashed))).alias("__first"))
    return left.join(repeated, again, "left_anti").unionByName(first.select("__first.*"))
