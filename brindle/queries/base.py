"""How catalogue entries are written down."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.engine import Engine
from brindle.sources.tables import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]
COMMIT, BUILT = "f00dcafe99", "20250102030405"
_engines: WeakKeyDictionary[SparkSession, Engine] = WeakKeyDictionary()


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


def engine(spark: SparkSession) -> Engine:
    """An engine on a session of its own beside ``spark``, whose settings stay as they are."""
    if spark not in _engines:
        _engines[spark] = Engine(spark.newSession(), COMMIT, BUILT)
    _engines[spark].spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return _engines[spark]


def sql(text: str, oracle: str | None = None, **casts: str) -> Entry:
    """A query in the engine's dialect over the driver's tables; the oracle is the same text unless one is given.
    ``casts``: types of columns whose width differs between engines."""
    words = set(re.findall(r"\w+", text))
    used = [t for t in TABLES if t in words]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = engine(spark)
        for t in used:
            load(at.spark, sf_dir, t).createOrReplaceTempView(t)
        df = at.query(text)
        return df.withColumns({c: df[c].cast(kind) for c, kind in casts.items()}) if casts else df

    return Entry(run, text if oracle is None else oracle)


def frame(build: Callable[..., DataFrame], *tables: str, oracle: str | None = None) -> Entry:
    """A query built by the DataFrame API: ``build`` takes one DataFrame per table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(load(spark, sf_dir, t) for t in tables))

    return Entry(run, oracle)
