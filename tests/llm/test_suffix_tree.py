import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import suffix_tree
from brindle.llm.suffix_tree import Rule

from . import fixtures as fx

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), ""]


def trains(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 != 0


class Plain:
    """The same model on dictionaries of word tuples."""

    def __init__(self, texts, rule):
        self.rule, self.pairs, self.after = rule, [Counter() for _ in range(rule.depth + 1)], defaultdict(Counter)
        for text in texts:
            w = words(text)
            for i in range(len(w)):
                for k in range(min(i, rule.depth) + 1):
                    self.after[tuple(w[i - k : i])][w[i]] += 1
        self.c = self.after[()]
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.states = {}
        for context, following in self.after.items():
            total = sum(following.values())
            if not context or total < rule.least_context:
                continue
            kept = {x: c for x, c in following.items() if c >= rule.least_next}
            shorter = self.after[context[1:]]
            m = sum(shorter.values())
            p, q = sum(kept.values()) / total, sum(shorter[x] for x in kept) / m
            gain = sum(c / total * math.log2(c / total / (shorter[x] / m)) for x, c in kept.items())
            gain += (1 - p) * math.log2((1 - p) / max(1 - q, 1e-12)) if p < 1 else 0
            if total * gain >= rule.divergence:
                self.states[context] = (total, kept, 1 - sum(c - rule.discount for c in kept.values()) / total)

    def probability(self, history, word):
        out = (self.c[word] + 0.1) / (self.n + 0.1 * (self.v + 1))
        for k in range(1, min(len(history), self.rule.depth) + 1):
            if (state := self.states.get(tuple(history[-k:]))) is not None:
                total, kept, left = state
                out = (kept[word] - self.rule.discount) / total + left * out if word in kept else left * out
        return out

    def score(self, text):
        w = words(text)
        return sum(math.log10(self.probability(w[:i], w[i])) for i in range(len(w)))


def corpus():
    rows = fx.rows(n=150)
    rows += [(300 + i, "red green blue yellow " * 9 + ("Red green" if i % 3 else "blue"), "en", "s", 1) for i in range(20)]
    rows += [(900, "The THE the ÀB àb", "en", "s", 1)] * 2 + [(None, "red green blue and more", None, None, None)] * 2
    return rows


@pytest.mark.parametrize(("rule", "chunk_bytes"), [(Rule(), 8 << 20), (Rule(), 3000), (Rule(depth=1, least_context=2, least_next=3, discount=0.8, divergence=2.0), 3000), (Rule(depth=6, divergence=0.5), 10_000)])
def test_scores_against_a_model_of_dictionaries(spark, rule, chunk_bytes):
    rows = corpus()
    df = spark.createDataFrame(rows, fx.COLUMNS).repartition(4).selectExpr("*", "1 as held_out", "2 as stream", "3 as chunk")
    got = [r.asDict() for r in suffix_tree.scores(df, rule=rule, chunk_bytes=chunk_bytes).collect()]
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    model = Plain([r[1] for r in rows if trains(r[0])], rule)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        w = words(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(model.c[x] > 0 for x in w), model.n)
        assert r["held_out"] == (not trains(r["doc_id"]))
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c[x] + 0.1) / (model.n + 0.1 * (model.v + 1))) for x in w), rel=1e-12)
        assert r["score"] == pytest.approx(model.score(text[r["doc_id"]]), rel=1e-9)
    assert max(map(len, model.states)) >= min(rule.depth, 3)


def test_the_plain_model_sums_to_one_and_depth_helps():
    texts = [r[1] for r in corpus() if trains(r[0])]
    model = Plain(texts, Rule(depth=3))
    everything = [*model.c, None]  # None: any unseen word
    for history in ([], ["red"], ["green", "blue"], ["red", "green", "blue"], ["the", "of"], ["unseen", "word"]):
        assert sum(model.probability(history, w) for w in everything) == pytest.approx(1)


def test_contexts_that_tell_the_next_word_raise_scores(spark):
    rows = [(i, " ".join("red green blue".split() * 30 if i % 2 else "blue green red".split() * 30), "en", "s", 1) for i in range(200)]
    df = spark.createDataFrame(rows, fx.COLUMNS)
    deep, flat = ({r["doc_id"]: r for r in suffix_tree.scores(df, rule=Rule(depth=d)).collect()} for d in (4, 1))
    # after two words the third is certain
    assert all(r["score"] > 0.2 * r["base_score"] for r in deep.values() if r["held_out"])
    assert sum(r["score"] for r in deep.values() if r["held_out"]) > 2 * sum(r["score"] for r in flat.values() if r["held_out"]) / 3


def test_what_is_kept_grows_with_the_corpus(spark):
    """Twice as many passages, each seen often enough, are twice as many that score as known."""
    for n in (20, 40):
        rows = [(k * 10 + c, " ".join(f"p{k}x{j}" for j in range(30)), "en", "s", 1) for k in range(n) for c in range(10)]
        got = suffix_tree.scores(spark.createDataFrame(rows, fx.COLUMNS)).collect()
        known = {r["doc_id"] // 10 for r in got if r["score"] > 0.35 * r["base_score"]}
        assert len(known) == n


def test_keys_travel_whole():
    rng = np.random.default_rng(7)
    for keys in (np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64)), np.array([5], dtype=np.uint64), np.arange(9, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64)):
        assert np.array_equal(suffix_tree.unpack_sorted(suffix_tree.pack_sorted(keys)), keys)
        cut = np.unique((keys >> np.uint64(13)) << np.uint64(13))
        assert np.array_equal(suffix_tree.unpack_sorted(suffix_tree.pack_sorted(cut, 13)), cut)
    for n in (1, 7, 8, 9, 63, 64, 65, 1000):
        flags = rng.integers(0, 2, n).astype(bool)
        counts, speaks = suffix_tree._told_counts(suffix_tree._zip(n.to_bytes(4, "little") + suffix_tree._planes(np.arange(n)) + np.packbits(flags).tobytes()))
        assert np.array_equal(counts, np.arange(n)) and np.array_equal(speaks, flags)
    keys = rng.integers(0, 50, 400).astype(np.uint64)
    found, first, number = suffix_tree.distinct(keys)
    assert np.array_equal(found[number], keys) and np.array_equal(keys[first], found)


def test_tokens_travel_whole_and_small():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        vocab = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        stream = np.append(rng.permutation(n), n).astype("<i4")[np.minimum(rng.zipf(1.3, 50_000) - 1, n)]
        packed = suffix_tree.pack_tokens(vocab, stream)
        words_, numbers = suffix_tree.unpack_tokens(*packed)
        assert np.array_equal(words_, vocab) and np.array_equal(numbers, stream)
        if n == 3000:
            assert sum(map(len, packed)) < 0.9 * len(suffix_tree._zip(vocab.tobytes()) + suffix_tree._zip(stream.tobytes()))


def test_no_step_moves_the_contexts_of_all_orders(spark, monkeypatch):
    steps, by_chunk = [], suffix_tree._by_chunk

    def seen(answers, kinds, buckets):
        steps.append({r["kind"] for r in answers.select("kind").distinct().collect()})
        return by_chunk(answers, kinds, buckets)

    monkeypatch.setattr(suffix_tree, "_by_chunk", seen)
    suffix_tree.scores(spark.createDataFrame(corpus(), fx.COLUMNS), rule=Rule(divergence=0.5))
    states = [{k - suffix_tree.STATES for k in kinds if k >= suffix_tree.STATES} for kinds in steps]
    assert states == [set(), set(), set(), {2}, {3}, {1, 4}]


def test_nulls_and_empty(spark):
    rows = [(None, "a b c a b c", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 1)]
    got = suffix_tree.scores(spark.createDataFrame(rows, fx.COLUMNS).selectExpr("*", "1 as h", "2 as other", "3 as train")).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 4, 7] and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert suffix_tree.scores(fx.empty(spark)).count() == 0
    blank = suffix_tree.scores(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], fx.COLUMNS)).collect()
    assert [(r["n_tokens"], r["n_known"]) for r in blank] == [(1, 1), (1, 1)]


def test_a_very_long_text(spark):
    long = " ".join(f"w{k * k % 7919}" for k in range(400_000))
    got = {r["doc_id"]: r for r in suffix_tree.scores(spark.createDataFrame([(1, long, "en", "s", 1), (2, "w1 w4 w9", "en", "s", 1)], fx.COLUMNS), chunk_bytes=1 << 20).collect()}
    assert got[1]["n_tokens"] == 400_001 and got[1]["score"] > got[1]["base_score"] and got[2]["n_tokens"] == 4


def test_numbers_lie_in_the_buckets_that_spark_gives_them(spark):
    from itertools import islice

    from pyspark.sql import functions as F

    from brindle.llm.shared import bucket_of, numbers_for

    numbers = [0, 1, -1 % 2**62, 2**40 + 7, *islice(numbers_for(3, 13, 4), 40)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(F.pmod(F.hash("n"), F.lit(13))).collect()]
    assert got == bucket_of(np.array(numbers), 13).tolist() and got[4:8] == [12, 0, 1, 2] and len(set(numbers)) == len(numbers)
