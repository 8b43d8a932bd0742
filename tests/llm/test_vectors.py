import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import hamming, kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=700, dims=24, seed=0, hot=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if clusters:
        x = rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] * 2 + x
    if hot:
        x[rng.choice(n, hot, replace=False)] = x[0]
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), 0) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [float("nan")] * dims, 0), (n + 2, [None] + [1.0] * (dims - 1), 0), (n + 3, [1.0] * 3, 0), (None, x[1].tolist(), 0), (7, x[7].tolist(), 1)]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(5), x.astype(float)


@pytest.mark.parametrize("hot", [0, 300])
def test_hamming_against_brute_force(spark, hot):
    df, x = table(spark, hot=hot)
    bits = x > 0
    got = {}
    for r in hamming.nearest(df, "vec_id", "embedding", F.col("id") % 50 == 0, k=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    assert sorted(got) == list(range(0, 700, 50))
    for q, found in got.items():
        d = (bits != bits[q]).sum(axis=1)
        want = [(int(d[i]), int(i)) for i in np.lexsort((np.arange(len(d)), d)) if i != q][:6]
        assert [(a, b) for _, a, b in sorted(found)] == want and [r for r, *_ in sorted(found)] == list(range(1, 7))


def test_hamming_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0], 0), (100, [1.0, 1.0], 0), (5, [0.0, 0.0], 0)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in hamming.nearest(df, "vec_id", "embedding", F.col("id") % 100 == 0).collect())
    assert got == [(0, 1, 5, 1), (0, 2, 100, 1), (100, 1, 0, 1), (100, 2, 5, 2)]
    assert hamming.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


@pytest.mark.parametrize(("hot", "clusters"), [(0, 0), (250, 0), (0, 12)])
def test_tree_search_recall_and_exact_scores(spark, hot, clusters):
    df, x = table(spark, n=1500, hot=hot, clusters=clusters)
    got = {}
    found = kmeans_tree.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=10, sample=600, leaf_size=40, block=64)
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["id"]))
    hits = 0
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(np.lexsort((np.arange(len(x)), -scores))[:10].tolist())
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert [(-s, i) for _, s, i in mine] == sorted((-s, i) for _, s, i in mine)
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, s, i in mine)
        hits += len(best & {i for *_, i in mine})
    assert hits >= 0.9 * 75 * 10


def test_tree_search_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0], 0), (20, [1.0, 1.0], 0), (5, [0.0, 0.0], 0), (6, [0.5, 0.5], 0)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in kmeans_tree.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 6, 0.0), (0, 2, 20, 0.0), (20, 1, 6, 1.0), (20, 2, 0, 0.0)]
    assert kmeans_tree.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


@pytest.mark.parametrize(("n", "k"), [(1500, 120), (200, 400)])
def test_tree_search_opens_leaves_until_k_are_met(spark, n, k):
    df, _ = table(spark, n=n)
    found = kmeans_tree.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=k, sample=600, leaf_size=40, recall=0.01)
    got = [r["count"] for r in found.groupBy("query_id").count().collect()]
    assert got == [min(k, n - 1)] * (n // 20)


def test_bins_hold_neighbouring_leaves_up_to_their_room():
    assert kmeans_tree.bins(np.array([3, 4, 3, 25, 0, 10, 1, 9]), 10).tolist() == [0, 0, 0, 1, 2, 2, 3, 3]
    assert kmeans_tree.bins(np.array([25, 1]), 10).tolist() == [0, 1] and kmeans_tree.bins(np.array([0, 0]), 10).tolist() == [0, 0]
    rng = np.random.default_rng(8)
    for _ in range(50):
        held, room = rng.integers(0, 12, 40), int(rng.integers(1, 15))
        bin_of = kmeans_tree.bins(held, room)
        assert set(np.diff(bin_of)) <= {0, 1} and bin_of[0] == 0
        for b in range(bin_of[-1] + 1):
            assert held[bin_of == b].sum() <= room or (bin_of == b).sum() == 1


def test_values_met_by_lookup_and_by_comparison():
    import numpy as np

    from brindle.llm import hamming

    rng = np.random.default_rng(4)
    for width, lead in ((12, 4), (9, 0), (10, 9)):
        tail = width - lead
        prefix = 5 & ((1 << lead) - 1)
        for n in (3, 400):
            value = np.sort((prefix << tail) | rng.integers(0, 1 << tail, n))
            some = rng.integers(0, 1 << width, 20)
            for radius in range(tail + 1):
                entry, owner = hamming._met_values(value, prefix, tail, some, radius)
                low = (1 << tail) - 1
                want = {(e, q) for q in range(20) for e in range(n) if bin((int(value[e]) ^ int(some[q])) & low).count("1") == radius}
                assert len(entry) == len(want) and set(zip(entry.tolist(), owner.tolist(), strict=True)) == want
    assert hamming._masks(17, 4).tolist() == sorted(hamming._masks(17, 4).tolist()) and len(hamming._masks(17, 4)) == 2380 and not len(hamming._masks(3, 4))
