"""Window frames counted in peer groups, which Spark's SQL does not have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_groups(table: DataFrame, aggregate: Column, name: str, partition_by: Sequence[str], order_by: Sequence[Column], preceding: int, following: int) -> DataFrame:
    """``aggregate`` over GROUPS BETWEEN preceding PRECEDING AND following FOLLOWING: a range over dense ranks."""
    ranked = table.withColumn("__group", F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    frame = Window.partitionBy(*partition_by).orderBy("__group").rangeBetween(-preceding, following)
    return ranked.withColumn(name, aggregate.over(frame)).drop("__group")
