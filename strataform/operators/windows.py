"""Windows and limits that Spark lacks as such."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.storage import written


def groups_frame(df: DataFrame, by: list[str], order: str, value: Column, before: int, after: int, name: str) -> DataFrame:
    """GROUPS BETWEEN: peers count as one step. Ranks of peers, then a range over ranks."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(order))
    w = Window.partitionBy(*by).orderBy("__rank").rangeBetween(-before, after)
    return df.withColumn("__rank", rank).withColumn(name, value.over(w)).drop("__rank")


def shifted(df: DataFrame, by: list[str], order: list[str], col: str, offset: Column, default: Column, name: str, lead: bool = True) -> DataFrame:
    """lead or lag by an offset of each row's own; a negative offset counts as 0. A join of row numbers."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__n", F.row_number().over(w))
    n = F.greatest(offset, F.lit(0))
    rows = rows.withColumn("__to", F.col("__n") + n if lead else F.col("__n") - n)
    other = rows.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(by)], F.col("__n").alias("__at"), F.col(col).alias("__v"), F.lit(True).alias("__hit"))
    cond = F.col("__to") == F.col("__at")
    for k, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    return rows.join(other, cond, "left").select(*df.columns, F.when(F.col("__hit"), F.col("__v")).otherwise(default).alias(name))


def limit_by(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def with_totals(aggregated: DataFrame, total: DataFrame) -> DataFrame:
    """The groups and one more row over all of them, whose keys are NULL."""
    return aggregated.unionByName(total, allowMissingColumns=True)


def running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums up to each row within its keys, however many rows a key has.

    Rows are dealt by sampled ranges of keys and order, each of which sums its own; what comes from the ranges
    before, a row for each range and key, is added. Rows alike in keys and order may come in any order, and be in
    different ranges.
    """
    spark = df.sparkSession
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(size, *[F.asc_nulls_first(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    totals = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_range") == F.col("_at"))
    local = ranges.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(k) for k, c in sums.items()])
    return local.join(totals, same).select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])
