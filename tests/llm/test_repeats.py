import hashlib
import random

import numpy as np
import pytest

from brindle.llm import repeats, suffix_array

from . import fixtures as fx


def brute(rows, least=50):
    first = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    rank = lambda i: repeats.NO_ID if i is None else i
    for i, b in data:
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, repeats.NO_ID), rank(i))
    out = []
    for i, b in data:
        keep = [True] * len(b)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < rank(i):
                keep[k : k + least] = [False] * least
        left = bytes(x for x, y in zip(b, keep, strict=True) if y)
        runs = sum(1 for k in range(len(b)) if not keep[k] and (k == 0 or keep[k - 1]))
        out.append((i, len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=lambda x: (rank(x[0]), x))


def run(df, **settings):
    got = [tuple(r) for r in repeats.digests(df, **settings).collect()]
    return sorted(got, key=lambda x: (repeats.NO_ID if x[0] is None else x[0], x))


def hot_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(150):
        text = " ".join(word() for _ in range(rng.randint(0, 30)))
        if i % 2:
            text = f"{text} {passage[rng.randint(0, 40):]} {word()}"
        rows.append((i, text, "en", "s", 1))
    rows += [(i, "be " * 400 + word(), "en", "s", 1) for i in range(200, 210)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 3000}, {"chunk_bytes": 3000, "most_strings": 3}])
def test_digests_against_brute_force(spark, settings):
    rows = fx.rows(n=100) + [(5, fx.rows(n=100)[5][1], "en", "s", 1), (None, fx.rows(n=100)[9][1], None, None, None), (-3, fx.rows(n=100)[18][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, fx.COLUMNS).repartition(4).selectExpr("*", "1 as chunk", "2 as ids", "3 as spans")
    assert run(df, **settings) == brute(rows)


@pytest.mark.parametrize("settings", [{"chunk_bytes": 2000}, {"chunk_bytes": 2000, "most_strings": 5}])
def test_a_passage_in_many_documents(spark, settings):
    rows = hot_rows()
    assert run(spark.createDataFrame(rows, fx.COLUMNS).repartition(5), **settings) == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    text = "a passage of more than fifty bytes that two rows of one id have in full"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (None, text + "!", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    assert run(spark.createDataFrame(rows, fx.COLUMNS)) == brute(rows)
    assert repeats.digests(fx.empty(spark)).count() == 0


def test_text_longer_than_a_block(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(repeats.BLOCK + 5000))
    rows = [(1, long[repeats.BLOCK - 500 : repeats.BLOCK + 500], "en", "s", 1), (2, long, "en", "s", 1)]
    got = run(spark.createDataFrame(rows, fx.COLUMNS))
    assert [g[2] for g in got] == [0, 1000] and [g[3] for g in got] == [0, 1]


def test_maximal_repeats_with_all_occurrences():
    rng = random.Random(8)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        strings += [b"\x00\x00a\x00", strings[0]]
        got = {w: set(p) for w, p in suffix_array.repeat_groups(strings, 3)}
        places = {}
        for s, t in enumerate(strings):
            for a in range(len(t)):
                for b in range(a + 3, len(t) + 1):
                    places.setdefault(t[a:b], set()).add((s, a))
        want = {}
        for w, at in places.items():
            if len(at) < 2:
                continue
            left = {strings[s][p - 1] if p else (s, "start") for s, p in at}
            right = {strings[s][p + len(w)] if p + len(w) < len(strings[s]) else (s, "end") for s, p in at}
            if (len(left) > 1 or any(isinstance(x, tuple) for x in left)) and (len(right) > 1 or any(isinstance(x, tuple) for x in right)):
                want[w] = at
        assert got == want


def test_suffixes_are_in_order():
    rng = np.random.default_rng(3)
    strings = [rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint8).tobytes() for _ in range(40)]
    data, starts = suffix_array.concatenated(strings)
    array = suffix_array.SuffixArray(data, starts, 5)
    suffixes = [strings[array.string[i]][i - starts[array.string[i]] :] for i in array.order]
    assert suffixes == sorted(suffixes) and all(len(x) >= 5 for x in suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1], suffixes[k]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert array.lcp[k] == n


def test_counts_on_the_scale_are_never_too_low():
    n = np.array([1, 2, 3, 7, 100, 127, 128, 5000, 10**6, 2**25])
    back = repeats.unscaled(repeats.scaled(n))
    assert (back >= n * (1 - 1e-9)).all() and (back <= 1.15 * n).all()


def test_one_chunk_of_very_many_strings_of_an_anchor_is_hot(spark):
    rng = random.Random(14)
    letters = "bcdefghijklmnop"
    passage = "".join(rng.choice(letters) for _ in range(60))
    rows = [(i, "".join(rng.choice(letters) for _ in range(40)) + passage + "".join(rng.choice(letters) for _ in range(40)), "en", "s", 1) for i in range(5000)]
    df = spark.createDataFrame(rows, fx.COLUMNS).coalesce(1)
    chunks = repeats.chunked(df, 4 << 20)
    assert chunks.count() == 1
    hot = lambda most: [m for r in repeats.shared_anchors(chunks, 50, 6, most).collect() for m in r["marks"] if m["hot"] is not None]
    assert hot(500) and hot(2000) and not hot(50_000)
    got = run(df, most_strings=500)
    assert got == run(df) and all(60 <= g[2] <= 70 for g in got[1:]) and got[0][2] == 0


def test_nothing_stays_in_the_catalog(spark):
    repeats.digests(fx.docs(spark)).count()
    assert spark.sql("SHOW TABLES IN default").where("not isTemporary").count() == 0
