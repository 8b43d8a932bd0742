"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``sample`` vectors of smallest hash, at most 64 MB); every vector is then put into its leaf.
For inner products vectors get one more component, which makes all as long as the longest: the nearest are then those
of largest inner product.  A query keeps a priority queue of tree nodes by distance to their centres and opens the
nearest until it has visited as many leaves as calibration asked for: on sample queries with known neighbours among
the half of the sample that the tree was not fitted to, the least number that finds ``recall`` of them.  With vectors of no structure that may be most leaves.

Neighbouring leaves share a bin of at most ``block`` vectors, to which a bundle of queries goes once, each with the bits
of the leaves it opens; a leaf above that (a vector that a third of the rows share) is cut by hash and many tasks' work.  Scores are exact inner products in double precision; a query's kth best among the
sample's vectors in its leaves bounds its kth best of all found from below, so a block reports only what reaches that, at most k a query.

Defined results: rows without a usable vector (see :mod:`vectors`) take no part; a query's own row does not count; rows
that repeat an id are one; ties go to the smaller id; fewer candidates than k give all found; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store, tidy
from .vectors import clean, matrix


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * (x @ centres.T)  # less the row's own square, the same for all centres


class Tree:
    """Nodes are numbered; children[i] is empty for a leaf, whose number among leaves is leaf[i]."""

    def __init__(self, x: np.ndarray, leaf_size: int, fan: int = 8, rounds: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [x.mean(axis=0)], [[]], [-1]
        self.leaves = 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(x[rows], fan, rounds, rng) if len(rows) > leaf_size else None
            if parts is None or len(np.unique(parts)) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for p in np.unique(parts):
                inside = rows[parts == p]
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), inside))
                self.centres.append(x[inside].mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x: np.ndarray, fan: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
        centres = x[rng.choice(len(x), min(fan, len(x)), replace=False)]
        for _ in range(rounds):
            part = _distances(x, centres).argmin(axis=1)
            centres = np.array([x[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(len(centres))])
        return _distances(x, centres).argmin(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child's, from the root down."""
        out, todo = np.empty(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            best = _distances(x[rows], self.centres[self.children[node]]).argmin(axis=1)
            todo += [(child, rows[best == i]) for i, child in enumerate(self.children[node]) if (best == i).any()]
        return out

    def visit(self, query: np.ndarray, leaves: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves in best-bin-first order: ``leaves`` of them, and on until they hold ``least`` vectors, by ``held``."""
        near = _distances(query[None, :], self.centres)[0].tolist()
        queue, out, met = [(near[0], 0)], [], 0
        while queue and (len(out) < leaves or met < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (near[child], child))
            else:
                out.append(self.leaf[node])
                met += int(held[out[-1]]) if held is not None else 0
        return out


SAMPLE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
LEAST_BINS = 32  # so that small tables are shared out too


def bins(held: np.ndarray, room: int) -> np.ndarray:
    """The bin of each leaf, by the leaves' numbers of vectors: leaves in turn, up to ``room`` vectors, or one leaf that has more."""
    out, used = np.zeros(len(held), dtype=np.int64), 0
    for leaf, n in enumerate(held.tolist()):
        new = leaf > 0 and used + n > room
        out[leaf] = out[leaf - 1] + new if leaf else 0
        used = n if new else used + n
    return out


def calibrated(tree: Tree, x: np.ndarray, plain: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """Leaves to visit so that ``recall`` of the k best of sample queries among the sample are found."""
    leaf = tree.assign(x)
    at = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    needed = []
    for i in at:
        scores = plain @ plain[i]
        scores[i] = -np.inf
        best = np.argsort(-scores)[: min(k, len(x) - 1)]
        query = np.append(plain[i], 0.0)
        place = np.empty(tree.leaves, dtype=np.int64)
        place[tree.visit(query, tree.leaves)] = np.arange(1, tree.leaves + 1)
        needed.append(place[leaf[best]])
    every = np.sort(np.concatenate(needed)) if needed else np.array([1])
    if not len(every):
        return tree.leaves
    return int(every[min(int(np.ceil(recall * len(every))), len(every)) - 1])


def nearest(table: DataFrame, id_column: str, vector_column: str, queries: F.Column, k: int = 20, sample: int = 20_000, leaf_size: int = 128, recall: float = 0.97, block: int = 8192) -> DataFrame:
    """(query_id, rank, id, score); ``queries``: a condition on column id."""
    spark = table.sparkSession
    rows = store(clean(table, id_column, vector_column).dropDuplicates(["id"]))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    width = len(rows.select("raw").first()["raw"]) // 8
    sample = max(min(sample, SAMPLE_BYTES // (8 * width)), 1)
    # about twice the sample's size passes the bound; the exact size is then taken in order of hash
    order = F.xxhash64(F.lit(3), "id")
    bound = -(2**63) + min(2 * sample * 2**64 // n, 2**64 - 1)
    some = rows.where(order <= F.lit(bound)).orderBy(order, "id").limit(sample).toPandas()
    plain = np.frombuffer(b"".join(some["raw"]), dtype="<f8").reshape(len(some), -1)
    sample_ids = some["id"].to_numpy()

    def longest_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((float(np.sqrt((matrix(b.column("raw")) ** 2).sum(axis=1)).max()) for b in batches if b.num_rows), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    longest = rows.select("raw").mapInArrow(tidy(longest_in), "most double").agg(F.max("most")).first()[0]
    x = lengthened(plain, longest)
    # calibration looks at vectors that the tree was not fitted to, as most are not
    fitted, other = (slice(0, None, 2), slice(1, None, 2)) if len(some) >= 200 else (slice(None), slice(None))
    tree = Tree(x[fitted], max(leaf_size * len(x[fitted]) // n, 16))
    visits = calibrated(tree, x[other], plain[other], k, recall)
    shared = spark.sparkContext.broadcast((tree, plain, sample_ids, tree.assign(x)))  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_ = shared.value[0]
        for batch in batches:
            if batch.num_rows:
                leaf = tree_.assign(lengthened(matrix(batch.column("raw")), longest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    placed = store(rows.mapInArrow(tidy(place), "id long, raw binary, leaf int"))
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf
        held[r["leaf"]] = r["count"]
    room = max(min(block, BLOCK_BYTES // (8 * width), n // LEAST_BINS), 1)
    bin_of = bins(held, room)
    ends = np.searchsorted(bin_of, np.arange(bin_of[-1] + 2))  # of each bin's leaves
    cuts = -(-held // room)  # above 1 only for a leaf that is a bin of its own
    known = spark.sparkContext.broadcast((held, ends, np.array([max(cuts[a:b].max(), 1) if b - a == 1 else 1 for a, b in zip(ends[:-1], ends[1:], strict=True)])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.searchsorted(known.value[1], batch.column("leaf").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(known.value[2][of])], [*batch.schema.names, "bin", "cuts"])

    dealt = placed.mapInArrow(deal, "id long, raw binary, leaf int, bin int, cuts long").withColumn("block", F.pmod(F.xxhash64("id"), "cuts").cast("int"))

    def gather(of: pa.Table) -> pa.Table:
        of = of.select(["bin", "block", "leaf", "id", "raw"]).sort_by("leaf")
        packed = [of.column(c).to_numpy().astype(t).tobytes() for c, t in (("leaf", "<i4"), ("id", "<i8"))] + [b"".join(of.column("raw").to_pylist())]
        return pa.table({**{c: of.column(c).slice(0, 1) for c in ("bin", "block")}, **{c: pa.array([x], pa.binary()) for c, x in zip(("leaves", "ids", "rows"), packed, strict=True)}})

    blocks = dealt.select("bin", "block", "leaf", "id", "raw").groupBy("bin", "block").applyInArrow(gather, "bin int, block int, leaves binary, ids binary, rows binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_, plain_, ids_, leaf_of = shared.value
        held_, ends_, cuts_ = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, ids = matrix(part.column("raw")), part.column("id").to_numpy()
                opened = np.zeros((len(q), tree_.leaves), dtype=bool)
                for i, query in enumerate(q):
                    opened[i, tree_.visit(np.append(query, 0.0), visits, held_, k + 1)] = True  # the query itself may be one
                scores = q @ plain_.T
                scores[(ids[:, None] == ids_[None, :]) | ~opened[:, leaf_of]] = -np.inf
                floor = np.partition(scores, len(ids_) - k, axis=1)[:, len(ids_) - k] if len(ids_) > k else np.full(len(ids), -np.inf)
                told = []
                for b, (first, last) in enumerate(zip(ends_[:-1].tolist(), ends_[1:].tolist(), strict=True)):
                    pick = np.flatnonzero(opened[:, first:last].any(axis=1))
                    if len(pick):
                        told.append((b, int(cuts_[b]), *[x[pick].tobytes() for x in (ids.astype("<i8"), floor, q)], np.packbits(opened[pick, first:last]).tobytes()))
                columns = list(zip(*told, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], ["bin", "cuts", "query_ids", "floors", "queries", "opened"])

    asked = rows.where(queries).mapInArrow(tidy(ask), "bin int, cuts int, query_ids binary, floors binary, queries binary, opened binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = {c: batch.column(c)[row].as_buffer() for c in batch.schema.names if c != "bin"}
                first, last = known.value[1][batch.column("bin")[row].as_py() :][:2].tolist()
                leaf, ids, query_ids, floors = (np.frombuffer(raw[c], dtype=t) for c, t in (("leaves", "<i4"), ("ids", "<i8"), ("query_ids", "<i8"), ("floors", "<f8")))
                v, q = (np.frombuffer(raw[c], dtype="<f8").reshape(m, -1) for c, m in (("rows", len(ids)), ("queries", len(query_ids))))
                opened = np.unpackbits(np.frombuffer(raw["opened"], dtype=np.uint8), count=len(q) * (last - first)).reshape(len(q), -1).astype(bool)
                floors = floors - 1e-9 * (1 + np.abs(floors))  # the product of matrices may round otherwise than the sample's did
                met: list[tuple[np.ndarray, np.ndarray]] = []
                starts = np.flatnonzero(np.diff(leaf, prepend=-1))
                for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True):
                    asks = np.flatnonzero(opened[:, leaf[a] - first])
                    i, j = np.nonzero(q[asks] @ v[a:z].T >= floors[asks, None])
                    met.append((asks[i], j + a))
                i, j = (np.concatenate(x) for x in zip(*met, strict=True))
                other = query_ids[i] != ids[j]
                i, j = i[other], j[other]
                exact = np.einsum("ij,ij->i", q[i], v[j])
                best = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[best], j[best], exact[best]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                keep = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i[keep]]), pa.array(ids[j[keep]]), pa.array(exact[keep])], ["query_id", "id", "score"])

    # a key has one block, which the join holds while bundles of queries pass
    found = asked.join(blocks, ["bin", "block"]).drop("block").mapInArrow(tidy(scan), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "id", "score")
