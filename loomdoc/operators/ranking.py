"""Positions within groups, and joins by keys, without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.session import cut, tasks


def spread_positions(df: DataFrame, keys: list[str], order: list[Column], out: str = "position", partitions: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row within its group of ``keys`` in ``order``.

    A range shuffle on keys and order cuts large groups into several ranges, so that a group that
    holds a third of all rows is ranked by many tasks. Rows are ranked inside a range, then moved on
    by the rows of the group in earlier ranges: one small row per group and range.
    The cut is checkpointed: range bounds are sampled, so that a second reading could cut elsewhere.
    ``order`` must end in a unique key. Null keys form a group; an empty table stays empty.
    """
    n = partitions or tasks(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = ranged.withColumn("_inside", F.row_number().over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(*keys, "_range").agg(F.max("_inside").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where("_before > 0")
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        ranked.join(offsets, same, "left")
        .withColumn(out, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_range", "_inside", "_r", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def spread_before(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str = "before", partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of each row's group of ``keys`` in ``order``; 0 for the first.

    Ranges as in ``spread_positions``: sums inside a range are moved on by the sums of the group's earlier ranges.
    """
    n = partitions or tasks(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .where("_before != 0")
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        summed.join(offsets, same, "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .drop("_range", "_inside", "_r", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """``left`` joined with the rows of ``right``, unique by ``keys``, where very many rows of ``left`` have the same keys.

    ``hot`` tells on ``right`` which keys these are; the caller proves that there are few. Their rows are broadcast, so
    that the rows of ``left`` stay where they are; all others meet by a shuffle. Both sides are read twice: cut them.
    """
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(few, keys).unionByName(rest)
