"""Queries that meet every row of their table: nothing above a constant, or outside a modulus, stays out."""

import pytest
from pyspark.sql import functions as F

from brindle.queries import entries
from brindle.sources.tables import load

from .test_catalogue import FOLDER


@pytest.mark.parametrize("name", ["kv_merge_nodedup", "kv_merge_shadow", "kv_concat", "kv_write_batch", "sort_nulls", "sort_nulls_all"])
def test_every_order_comes_out(spark, name):
    keys = load(spark, FOLDER, "orders").select("o_orderkey")
    got = entries()[name].run(spark, FOLDER)
    assert got.select("o_orderkey").distinct().count() == keys.count()
    assert (got.count() > keys.count()) == (name == "kv_merge_nodedup")


def test_seeks_for_an_absent_key_meet_its_neighbours(spark):
    seen = [entries()[f"kv_seek_{way}"].run(spark, FOLDER).first()["o_orderkey"] for way in ("ge", "le")]
    assert seen == [1234, 1233]


def test_every_component_is_unnested(spark):
    whole = load(spark, FOLDER, "embeddings").agg(F.sum(F.size("embedding"))).first()[0]
    assert entries()["unnest_all"].run(spark, FOLDER).count() == whole
