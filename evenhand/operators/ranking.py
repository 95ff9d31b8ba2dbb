"""Ranks inside groups of any size: rows are counted in bins first, and only the rows of one bin meet in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.sources.staging import cut

#: Rows of a bin, about.
RANKED = 20_000


def ranked(df: DataFrame, keys: list[str], place, order: list, name: str, most: Column | None = None) -> DataFrame:
    """df with ``name``, the number of a row (from 1) in its group of ``keys`` by ``order``.

    ``place`` makes of the number of bins asked for a whole number that never falls along that order. With ``most`` only
    rows up to that number are kept, and bins beyond it are not ranked at all.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / RANKED).alias("~bins"))  # one row for each group
    binned = df.join(F.broadcast(sizes), keys).withColumn("~bin", place(F.col("~bins"))).drop("~bins")
    before = Window.partitionBy(*keys).orderBy("~bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*keys, "~bin").agg(F.count(F.lit(1)).alias("~c"))
    starts = counts.select(*keys, "~bin", F.coalesce(F.sum("~c").over(before), F.lit(0)).alias("~start"))
    placed = binned.join(starts, [*keys, "~bin"])
    if most is not None:
        placed = placed.where(F.col("~start") < most)
    inside = Window.partitionBy(*keys, "~bin").orderBy(*order)
    out = placed.withColumn(name, F.col("~start") + F.row_number().over(inside)).drop("~bin", "~start")
    return out if most is None else out.where(F.col(name) <= most)


def by_uniform(u: Column):
    """Bins of a number between 0 and 1."""
    return lambda bins: F.floor(u * bins).cast("long")


def by_octave(value: Column):
    """Bins of a positive number: 8 or more for each power of two."""
    return lambda bins: F.floor(F.log2(value) * F.greatest(bins, F.lit(8))).cast("long")


def in_order(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with ``name``, the number of a row (from 1) in its group of ``keys`` by ``value``, a number or a text, however its values
    are spread: ranges are cut at sampled quantiles. Rows of equal values are numbered in any order."""
    ranged = cut(df.repartitionByRange(*keys, value, F.xxhash64(*df.columns)).withColumn("~range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "~range").agg(F.count(F.lit(1)).alias("~c"))
    before = Window.partitionBy(*keys).orderBy("~range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select(*keys, "~range", F.coalesce(F.sum("~c").over(before), F.lit(0)).alias("~start"))
    inside = Window.partitionBy(*keys, "~range").orderBy(value)
    return ranged.join(starts, [*keys, "~range"]).withColumn(name, F.col("~start") + F.row_number().over(inside)).drop("~range", "~start")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and the exact median of ``value`` for each key. df is read three times."""
    rows = df.select(key, F.col(value).cast("double").alias("~v"))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("~n"))
    numbered = in_order(rows, [key], "~v", "~rk").join(F.broadcast(sizes), key)
    middle = numbered.where((F.col("~rk") >= F.floor((F.col("~n") + 1) / 2)) & (F.col("~rk") <= F.floor(F.col("~n") / 2) + 1))
    return middle.groupBy(key).agg(F.avg("~v").alias("median"))
