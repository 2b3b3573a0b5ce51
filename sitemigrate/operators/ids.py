"""New ids: an old id is kept where it is free, all others get the next free numbers in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemigrate.storage import dealt, keep


def dense_rank_rows(spark: SparkSession, df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """Numbers the rows from 1 in ``order``, without one window over all of them.

    Rows are range-partitioned and written once; each partition's rows are numbered on their own, and the counts of the
    partitions before (one row for each) are added.
    """
    ranged = keep(spark, df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(out, (F.col("__n") + F.col("__before")).cast("long")).drop("__part", "__n", "__before")


def running_sum(spark: SparkSession, df: DataFrame, keys: list[str], order: list[Column | str], of: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``of`` over the rows of the same ``keys`` up to and with this one, in ``order``.

    Rows are range-partitioned by keys and order and written once, so that one hot key fills many partitions; each sums up its
    own part of a key, and what the partitions before hold of that key (one row for each) is added. Null keys are a key.
    """
    ranged = keep(spark, df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()).withColumn("__of", of.cast("long")))
    sums = ranged.groupBy("__part", *keys).agg(F.sum("__of").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.sum("__sum").over(earlier)).filter("__before IS NOT NULL").select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__before")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__own", F.sum("__of").over(within)).join(before, same, "left")
    return summed.withColumn(out, F.col("__own") + F.coalesce("__before", F.lit(0))).select(*df.columns, out)


def max_id(df: DataFrame, col: str) -> DataFrame:
    """One row: the largest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("long").alias("max_id"))


def allocate_ids(spark: SparkSession, rows: DataFrame, existing: DataFrame, old_col: str, existing_col: str, order: list[Column | str], out: str = "new_id") -> DataFrame:
    """``rows`` with ``out``: the old id if it is positive, taken by no existing row and asked for by one row only; else a
    number above all old and existing ids, in ``order``.

    Of rows that ask for one id, the first in ``order`` gets it.
    """
    taken = existing.select(F.col(existing_col).alias("__taken")).distinct()
    asking = F.col(old_col) > 0  # rows without an id don't meet in one partition
    first = F.row_number().over(Window.partitionBy(old_col).orderBy(*order)) == 1
    marked = rows.filter(asking).withColumn("__first", first).join(dealt(taken), F.col(old_col) == F.col("__taken"), "left")
    marked = marked.withColumn("__free", F.col("__first") & F.col("__taken").isNull()).drop("__first", "__taken")
    marked = keep(spark, marked.unionByName(rows.filter(~F.coalesce(asking, F.lit(False))).withColumn("__free", F.lit(False))))
    top = max_id(existing, existing_col).union(max_id(rows, old_col)).agg(F.max("max_id").alias("__top"))
    fresh = dense_rank_rows(spark, marked.filter("NOT __free"), order, "__rank").crossJoin(F.broadcast(top)).withColumn(out, F.col("__top") + F.col("__rank"))
    kept = marked.filter("__free").withColumn(out, F.col(old_col).cast("long"))
    return kept.drop("__free").unionByName(fresh.drop("__free", "__rank", "__top"))
