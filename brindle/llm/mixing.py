"""Mixing sources to target weights, with DataFrame functions alone.

Tokens (here: words) are summed per source; a water level shares all tokens out by weight under a limit on
repetition; a document is emitted floor(rate) times, and once more if a hash of its id, read as a number in
[0, 1), is below the rate's fraction.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null doc_id
is hashed as the text 'null'; rows that repeat a doc_id share its draw; a source without words has target 0
and its documents stay once each; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, store

MOST_COPIES = 3
MOST_BROADCAST = 100_000  # rows of a source's name and a number


def words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: F.Column, seed: int) -> F.Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The windows below run over one row per source, not per document; weights 1, 2, 3 follow the order of
    all sources, which only such a window gives.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("weight", ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1).cast("long"))
    wide = ranked.withColumn("limit", F.col("source_size") * MOST_COPIES)
    # in the order of limit / weight, a source is at its limit if the level that ignores it and those after it exceeds that
    before = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = "decimal(38,0)"
    level = (
        wide.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("left").cast(exact) * F.col("weight") >= F.col("limit").cast(exact) * F.col("heft"))
    )
    open_left = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything)
    open_heft = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    share = open_left.cast("double") * F.col("weight") / open_heft
    return level.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def _plan(sizes: DataFrame, seed: int) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for narrow rows (doc_id, source, size)."""
    goal = targets(sizes).withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    return (
        sizes.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("copies", (whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("int"))
    )


def narrow(docs: DataFrame) -> DataFrame:
    """Sizes are needed for the sums and again for the draw: the regular expression runs once, into a scratch table."""
    return store(docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size")))


def mixture_plan(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document what the mix takes of it, in words."""
    planned = _plan(narrow(docs), seed)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its source's rate and its draw say.

    The rates reach the documents as one row per source, broadcast if there are at most MOST_BROADCAST.
    """
    goal = targets(narrow(docs)).select(
        F.col("source").alias("__goal_source"),
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(1.0)).alias("__rate"),
    )
    goal = store(goal)
    if goal.count() <= MOST_BROADCAST:  # else the join exchanges the documents
        goal = F.broadcast(goal)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"))
    whole = F.floor("__rate")
    copies = (whole + F.when(draw(F.col("__id"), seed) < F.col("__rate") - whole, 1).otherwise(0)).cast("int")
    joined = rows.join(goal, F.col("__source").eqNullSafe(F.col("__goal_source")))
    return joined.select("__row", F.explode(F.array_repeat(F.lit(1), copies))).select("__row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM per_source),
level AS (
  SELECT *, sum(source_size) OVER () AS total,
    sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS heft
  FROM ranked WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, remaining * weight >= CAST(most AS HUGEINT) * heft AS is_full FROM level),
goal AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE)
    ELSE CAST(total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER () AS DOUBLE) * weight
      / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM capped),
rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 1.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
