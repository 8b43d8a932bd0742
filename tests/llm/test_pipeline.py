"""The pipeline's stages, each held against a plain version on the rows that it was given."""

import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from brindle.llm import language, mixing, secrets

from . import fixtures as fx
from .test_minmax import brute
from .test_narrow_operators import SECRETS, base_spans, encoder, plain_sizes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = [r for r in fx.rows(n=160)] + [(3000 + i, f"the and of with {t}", "en", "s1", None) for i, t in enumerate(SECRETS)]
    rows += [(4000, rows[5][1], "en", "s9", None), (4001, rows[5][1], "en", "s9", None), rows[7], rows[7]]
    spark.createDataFrame(rows, fx.COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return str(folder), {name: (a, b) for name, a, b in out}


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mixture", "packing"]
    for name, (_, after) in stages[1].items():
        assert name == "packing" or after.columns == COLUMNS


def test_language(stages):
    before, after = stages[1]["language"]
    dictionaries, want = language.fit(before.select("doc_id", "text", "lang")), Counter()
    for r in before.collect():
        if any(c.isalpha() for c in r["text"] or ""):
            best, second, *_ = sorted(plain_sizes(r["text"], dictionaries).values())
            want[tuple(r)] += second - best >= 0.004 * second
    want = +want
    assert Counter(map(tuple, after.collect())) == want and sum(want.values()) < before.count()


def test_near_copies(stages):
    before, after = stages[1]["near_copies"]
    rows = [tuple(r) for r in before.collect()]
    component = brute(rows)
    want = Counter(r for r in rows if r[0] is None) + Counter({r for r in rows if r[0] is not None and component[r[0]] == r[0]})
    assert {component[r["doc_id"]] for r in after.collect() if r["doc_id"] is not None} == set(component.values())  # each class leaves a survivor
    assert Counter(map(tuple, after.collect())) == want and 0 < sum(want.values()) < len(rows)


def test_secrets(stages):
    before, after = stages[1]["secrets"]
    spans = {(r["doc_id"], r["text_hash"]): r for r in secrets.spans(before).collect()}
    assert len(spans) and any(len(r["spans"]) > len(r["base"]) for r in spans.values())
    clean = lambda df: Counter(tuple(r) for r in df.collect() if not re.search(r"AKIA|://|REDACTED", r["text"]) and not base_spans(r["text"]))
    assert clean(before) == clean(after) and sum(clean(after).values()) > 50
    assert after.count() == before.count()
    assert not any(base_spans(r["text"]) for r in after.collect())


def test_mixture(stages):
    before, after = stages[1]["mixture"]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixture_plan(before).collect() if r["size"]}
    got = Counter(r["doc_id"] for r in after.collect())
    assert {i: n for i, n in got.items() if i in taken} == {i: n for i, n in taken.items() if n}
    assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))


def test_packing(stages):
    before, after = stages[1]["packing"]
    encode, want, got = encoder(), defaultdict(Counter), defaultdict(Counter)
    for r in before.collect():
        for k, x in enumerate(encode(r["text"] or "")):
            want[r["doc_id"]][k, x] += 1
    lengths = {i: encode(t or "") for i, t in {(r["doc_id"], r["text"]) for r in before.collect()}}
    filled = defaultdict(int)
    for p in after.collect():
        ids = lengths[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        for k, x in enumerate(ids, p["start"]):
            got[p["doc_id"]][k, x] += 1
        filled[p["sequence_id"]] += p["length"]
    assert got == want and all(n == 1024 for k, n in filled.items() if k < len(filled) - 1)


def test_run_gives_the_last_stage(spark, stages):
    folder, by_name = stages
    assert corpus_pipeline.run(spark, folder).count() == by_name["packing"][1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_of_no_documents(spark, tmp_path):
    fx.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.path.exists(f"{tmp_path}/documents.parquet")
