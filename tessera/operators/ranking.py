"""Ranks and running totals within groups that stay distributed when one group, or one value, holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Rows from which a group is ordered in several tasks, and in how many.
HOT_ROWS, SLICES = 200_000, 64


def _hot(df: DataFrame, group: list[str], hot_rows: int) -> DataFrame:
    """The groups of more than ``hot_rows`` rows; at most one in so many rows, so they may be broadcast."""
    return cut(df.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows).select(*group))


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Like a join by name, but nulls are equal to one another."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    both = a.alias("a").join(b.alias("b"), same, how)
    return both.select("a.*", *(f"b.{c}" for c in b.columns if c not in on)) if how == "inner" else both.select("a.*")


def _sliced_total(df: DataFrame, group: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """``name``: the total weight of the rows before in the group's order, by ranges of the whole order, so that ties in one column are parted too."""
    placed = cut(df.withColumn("__w", weight).repartitionByRange(SLICES, *group, *order).withColumn("__slice", F.spark_partition_id()))
    whole = placed.groupBy(*group, "__slice").agg(F.sum("__w").alias("__t"))
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*group, "__slice", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__earlier"))  # SLICES rows a group at most
    own = Window.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__own", F.coalesce(F.sum("__w").over(own), F.lit(0)))
    moved = _joined(summed, before, [*group, "__slice"]).withColumn(name, F.col("__own") + F.col("__earlier"))
    return moved.drop("__w", "__slice", "__own", "__earlier")


def running_total(df: DataFrame, group: list[str], order: list[Column], weight: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``name``: the total weight of the rows before in the group's order, 0 for the first.

    A group of more than ``hot_rows`` rows is cut into ranges of its order that are summed apart, and each is moved up by those before it.
    """
    own = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = lambda some: some.withColumn(name, F.coalesce(F.sum(weight).over(own), F.lit(0)))
    large = _hot(df, group, hot_rows)
    if large.isEmpty():
        return plain(df)
    hot = _sliced_total(_joined(df, F.broadcast(large), group, "left_semi"), group, order, weight, name)
    return plain(_joined(df, F.broadcast(large), group, "left_anti")).unionByName(hot)


def rank_in_groups(df: DataFrame, group: list[str], value: str, name: str, ties: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``name``: the rank of the row in its group by ``value``, the greatest first.

    Equal values share a rank (1, 1, 3) unless ``ties`` names columns that break them in ascending order. Values must not be null. Rows
    with a null in the group are ranked as a group of their own.

    A group of more than ``hot_rows`` rows is cut into ranges of the whole order, so no task sorts it alone, even if one
    value holds most of it. Where equal values share a rank, only the different values and their counts are ordered.
    """
    order = [F.col(value).desc(), *(F.col(c).asc() for c in ties or [])]
    number = F.row_number() if ties else F.rank()
    plain = lambda some: some.withColumn(name, number.over(Window.partitionBy(*group).orderBy(*order)))
    large = _hot(df, group, hot_rows)
    if large.isEmpty():
        return plain(df)
    hot = _joined(df, F.broadcast(large), group, "left_semi")
    calm = plain(_joined(df, F.broadcast(large), group, "left_anti"))
    if ties:
        ranked = _sliced_total(hot, group, order, F.lit(1), "__before").withColumn(name, (F.col("__before") + 1).cast("int")).drop("__before")
    else:
        values = hot.groupBy(*group, value).agg(F.count("*").alias("__c"))
        places = _sliced_total(values, group, [F.col(value).desc()], F.col("__c"), "__before")
        ranked = _joined(hot, places, [*group, value]).withColumn(name, (F.col("__before") + 1).cast("int")).drop("__c", "__before")
    return calm.unionByName(ranked.select(*calm.columns))
