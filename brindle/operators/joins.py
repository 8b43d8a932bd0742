"""Joins that SQL has no keyword for here, or no plan: as-of, interval and of two inequalities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators.log import numbered
from brindle.sources.scratch import store

BROADCAST_ROWS = 100_000


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: Sequence[str], tie_break: str | None = None, bin_width: float | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its key at or before its time (else nulls).

    Both sides go through one exchange and one sort, and a running last non-null value: no pair of rows is made, whatever
    the number of right rows a left row could match.  With ``bin_width`` (seconds, or units of a numeric time) a key's
    rows are dealt by time bin as well, so that a key with a third of all rows is many tasks' work; a window over one row
    per key and bin carries the last value from bin to bin.
    """
    columns = left.columns
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in take]
    tie = F.col(tie_break) if tie_break else F.lit(None)
    tie_type = right.schema[tie_break].dataType if tie_break else "int"
    row_type = left.select(F.struct(*columns).alias("r")).schema["r"].dataType
    a = left.select(F.col(on).alias("__on"), F.col(left_time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"), F.struct(*columns).alias("__row"), *none)
    b = right.select(F.col(on).alias("__on"), F.col(right_time).alias("__at"), F.lit(0).alias("__side"), tie.cast(tie_type).alias("__tie"), F.lit(None).cast(row_type).alias("__row"), *[F.col(c).alias(f"__{c}") for c in take])
    rows = a.unionByName(b).withColumn("__taken", F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{c}").alias(c) for c in take])))
    keys = ["__on"]
    if bin_width is not None:
        number = F.col("__at") if dict(rows.dtypes)["__at"] in ("int", "bigint", "double", "float", "smallint") else F.unix_micros(F.col("__at").cast("timestamp_ltz")) / 1e6
        rows = rows.withColumn("__bin", F.floor(number / bin_width))
        keys.append("__bin")
    # on equal times right rows come first; among them the largest tie break is the last
    order = Window.partitionBy(*keys).orderBy("__at", "__side", F.asc_nulls_first("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__last", F.last("__taken", ignorenulls=True).over(order)).where("__side = 1")
    if bin_width is not None:
        at = F.when(F.col("__side") == 0, F.struct("__at", "__tie"))
        ends = rows.groupBy("__on", "__bin").agg(F.max_by("__taken", at).alias("__end"))
        before = Window.partitionBy("__on").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("__on").alias("__c_on"), F.col("__bin").alias("__c_bin"), F.last("__end", ignorenulls=True).over(before).alias("__carried"))
        filled = filled.join(carried, F.col("__on").eqNullSafe(F.col("__c_on")) & F.col("__bin").eqNullSafe(F.col("__c_bin")), "left")
        filled = filled.withColumn("__last", F.coalesce("__last", "__carried"))
    return filled.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in take])


def interval_join(left: DataFrame, right: DataFrame, same: Column, point: str, low: Column, high: Column, width_seconds: int, how: str = "inner") -> DataFrame:
    """Rows of equal keys where the right side's ``point`` lies in the left side's [low, high].

    An equality on time bins of ``width_seconds`` comes first, so that the join hashes or merges on key and bin and each
    row meets neighbours in time only; a left row is repeated once per bin that its interval touches.
    """
    seconds = lambda t: F.unix_timestamp(t.cast("timestamp_ltz"))
    bins = F.sequence(F.floor(seconds(low) / width_seconds), F.floor(seconds(high) / width_seconds))
    a = left.withColumn("__bin", F.explode(bins))
    b = right.withColumn("__bin_of", F.floor(seconds(F.col(point)) / width_seconds))
    joined = a.join(b, same & (F.col("__bin") == F.col("__bin_of")) & (F.col(point) >= low) & (F.col(point) <= high), how)
    return joined.drop("__bin", "__bin_of")


def _with(rows: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows with those of a stored table, which is sent to all while it is short; sizes in files say too little of rows."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge"), on)


def _cell(rank: Column, bit: Column, count: int) -> Column:
    """One row per binary digit of ``rank`` that is ``bit``: the digits above it and its place, as a number."""
    shifted = lambda n: F.call_function("shiftright", rank, n)
    places = F.filter(F.sequence(F.lit(0), F.lit(max(count - 1, 1).bit_length() - 1)), lambda n: shifted(n).bitwiseAND(1) == bit)
    return F.explode(F.transform(places, lambda n: shifted(n + 1) * 64 + n))


def dominance_join(left: DataFrame, right: DataFrame, on: str, less: tuple[str, str], more: tuple[str, str]) -> DataFrame:
    """Pairs of equal ``on`` with left ``less[0]`` < right ``less[1]`` and left ``more[0]`` > right ``more[1]``.

    Columns compared are of one type; all others but ``on`` have names of their own.  No pair is made that is not in the
    result.  Of two different ranks the lower has a 0 and the higher a 1 at the first binary digit where they part, so a
    left row goes to a cell for each 0 in its rank by ``less``, a right row to one for each 1, and a pair that holds meets
    in one cell.  Cells of ranks by ``more`` divide these in the same way, the digits being the other way round.  Before
    that, rows without any partner leave: by bounds of their key first, then by those of their cell, where the first
    inequality holds for all, so that each row that stays has a pair there.
    """
    kinds = {name: t.select(F.struct(*t.columns).alias("r")).schema["r"].dataType for name, t in (("__left", left), ("__right", right))}

    def side(n: int, table: DataFrame, name: str, other: str) -> DataFrame:
        return table.select(
            F.col(on).alias("__on"), F.lit(n).alias("__side"), F.col(less[n]).alias("__x"), F.col(more[n]).alias("__y"),
            F.struct(*table.columns).alias(name), F.lit(None).cast(kinds[other]).alias(other),
        )

    rows = side(0, left, "__left", "__right").unionByName(side(1, right, "__right", "__left"))
    is_left = F.col("__side") == 0
    of_left, of_right = (lambda c: F.when(is_left, F.col(c))), (lambda c: F.when(~is_left, F.col(c)))

    keys = rows.groupBy("__on").agg(F.min(of_left("__x")).alias("__low"), F.max(of_right("__x")).alias("__high"), F.max(of_left("__y")).alias("__most"), F.min(of_right("__y")).alias("__least"))
    keys = store(keys.where("__low < __high AND __most > __least"))
    if keys.isEmpty():
        return left.sparkSession.createDataFrame([], StructType(left.schema.fields + [f for f in right.schema.fields if f.name != on]))
    has = F.when(is_left, (F.col("__x") < F.col("__high")) & (F.col("__y") > F.col("__least"))).otherwise((F.col("__x") > F.col("__low")) & (F.col("__y") < F.col("__most")))
    rows = store(_with(rows, keys, "__on").where(has).select(*rows.columns))

    counts = {}
    for c in ("__x", "__y"):
        ranks = numbered(rows.select(c).distinct(), [c], f"{c}_rank")
        counts[c] = ranks.count()
        rows = _with(rows, ranks, c)
    celled = rows.select("__on", "__side", "__y_rank", "__left", "__right", _cell(F.col("__x_rank"), F.col("__side"), counts["__x"]).alias("__x_cell"))
    bounds = celled.groupBy("__on", "__x_cell").agg(F.max(of_left("__y_rank")).alias("__most"), F.min(of_right("__y_rank")).alias("__least"))
    bounds = store(bounds.where("__most > __least"))
    kept = _with(celled, bounds, ["__on", "__x_cell"]).where(F.when(is_left, F.col("__y_rank") > F.col("__least")).otherwise(F.col("__y_rank") < F.col("__most")))
    met = kept.select("__on", "__x_cell", "__side", "__left", "__right", _cell(F.col("__y_rank"), 1 - F.col("__side"), counts["__y"]).alias("__y_cell"))
    cells = ["__on", "__x_cell", "__y_cell"]
    joined = met.where(is_left).select(*cells, "__left").join(met.where(~is_left).select(*cells, "__right").hint("merge"), cells)
    return joined.select("__left.*", *[F.col(f"__right.{c}").alias(c) for c in right.columns if c != on])
