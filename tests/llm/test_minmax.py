import random
import re
from collections import Counter

from brindle.llm import components, minmax

from . import fixtures as fx

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def family(rng, base, n, edits, first):
    out = []
    for k in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append((first + k, " ".join(words), "en", "s", 1))
    return out


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    rows = fx.rows(n=150)
    for f in range(4):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(150))
        rows += family(rng, base, 60, 3 + 3 * f, 1000 * (f + 1))
    rows += [(7000, "A b  c\nd", "en", "s", 1), (7001, "a B c d", "en", "s", 1), (7002, "a b c d e", "en", "s", 1), (7003, "x " * 3000, "en", "s", 1)]
    df = spark.createDataFrame(rows, fx.COLUMNS).repartition(6)
    want, got = brute(rows), fx.by_id(minmax.classes(df))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(t)) for i, t, *_ in rows if (r := got[i]))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_a_group_of_borderline_copies_is_whole(spark):
    """Siblings mostly below the threshold, each near enough to the base only."""
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(200))
    rows = [(500, base, "en", "s", 1)]
    for k in range(80):
        words = base.split()
        for i in rng.sample(range(0, 200, 12), 5):
            words[i] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words), "en", "s", 1))
    got = fx.by_id(minmax.classes(spark.createDataFrame(rows, fx.COLUMNS)))
    assert {i: r["component_id"] for i, r in got.items()} == brute(rows)


def test_nulls_repeats_and_empty(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None), (4, "  ", "en", "s", 1), (5, "", "en", "s", 1)]
    df = spark.createDataFrame(rows, fx.COLUMNS).selectExpr("*", "1 as component_id", "2 as kept", "3 as rep", "4 as key_a")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minmax.classes(df).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (None, None, True): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 5, True): 1})
    left = minmax.keep_one(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3, 4, 5]
    assert minmax.classes(fx.empty(spark)).count() == 0


def test_long_words_and_texts_hash_as_their_words():
    import numpy as np
    import pyarrow as pa

    from brindle.llm import wordhash

    long = " ".join(f"w{i % 5000}" for i in range(900_000)) + " " + "q" * 3_000_000
    texts = [long, "a b", None, "", long.upper()]
    sets = {}
    for at, out in wordhash.shingle_sets(pa.array(texts), 5):
        sets |= {at + k: s for k, s in enumerate(out)}
    assert np.array_equal(sets[0], sets[4]) and len(sets[0]) == len(shingles(long)) and len(sets[1]) == 1 and not len(sets[2]) and not len(sets[3])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(7, 1)]
    got = {r["v"]: r["u"] for r in components.components(spark.createDataFrame(edges, "v long, u long")).collect()}
    assert got == {k: 100 for k in range(101, 161)} | {k: 1 for k in [7, *range(300, 340)]}


def test_rows_of_one_id_with_other_texts_are_one_vertex(spark):
    rng = random.Random(12)
    a, b, lone = (" ".join(f"{p}{rng.randrange(10**5)}" for _ in range(60)) for p in "abz")
    near = " ".join(b.split()[:-1] + ["changed"])
    rows = [(2, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (9, near, "en", "s", 1), (5, "", "en", "s", 0), (7, lone, "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, fx.COLUMNS)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minmax.classes(df).collect())
    assert got == Counter({(2, 2, True): 1, (5, 2, False): 3, (9, 2, False): 1, (7, 7, True): 2, (8, 8, True): 2})
    left = minmax.keep_one(df)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 7, 8]
    assert sorted(map(str, left.collect())) == sorted(map(str, minmax.keep_one(df.repartition(3)).collect()))


def test_repeated_ids_against_brute_force(spark):
    rng = random.Random(21)
    rows = fx.rows(n=60)
    for f in range(3):
        rows += family(rng, " ".join(f"v{rng.randrange(300)}" for _ in range(120)), 25, 6, 1000 * (f + 1))
    rows += [(i, rows[rng.randrange(len(rows))][1], "en", "s", 1) for i in (3, 3, 17, 1001, 2004, 3011) for _ in range(2)]
    got = {}
    for r in minmax.classes(spark.createDataFrame(rows, fx.COLUMNS).repartition(5)).collect():
        assert got.setdefault(r["doc_id"], r["component_id"]) == r["component_id"]
    assert got == brute(rows)


def test_hot_keys_join_as_others_do(spark):
    from brindle.llm.shared import join_counted

    rows = spark.createDataFrame([(k % 7, k) for k in range(300)] + [(99, -1)], "key long, x long")
    keyed = spark.createDataFrame([(k, 10 * k, 40 + k) for k in range(7)], "key long, y long, n long")
    plain = sorted(map(tuple, rows.join(keyed, "key").collect()))
    assert sorted(map(tuple, join_counted(rows, keyed, ["key"], "n", 44).select("key", "x", "y", "n").collect())) == plain and len(plain) == 300
    left = join_counted(rows, keyed, ["key"], "n", 44, "left").collect()
    assert len(left) == 301 and [r["y"] for r in left if r["key"] == 99] == [None]
