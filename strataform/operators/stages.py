"""Aggregation in stages: states that are made, merged and read in steps of their own.

A state is a column for each part of an aggregate. What Spark plans for ``groupBy().agg()`` is Complete; Partial1 makes
states, Partial2 merges them, Final reads them. States may be stored and merged later, or be made where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.storage import written


@dataclass
class Staged:
    """``make`` are the parts from rows, ``merge`` the parts from parts, ``read`` the value from parts."""

    make: dict[str, Column]
    merge: dict[str, Column]
    read: Column


def _same(name: str, make: Column, f) -> Staged:
    return Staged({name: make}, {name: f(name)}, F.col(name))


def count(name: str) -> Staged:
    return _same(f"{name}_n", F.count(F.lit(1)), F.sum)


def total(name: str, col: str) -> Staged:
    return _same(f"{name}_sum", F.sum(col), F.sum)


def least(name: str, col: str) -> Staged:
    return _same(f"{name}_min", F.min(col), F.min)


def greatest(name: str, col: str) -> Staged:
    return _same(f"{name}_max", F.max(col), F.max)


def mean(name: str, col: str) -> Staged:
    s, n = f"{name}_sum", f"{name}_n"
    return Staged({s: F.sum(col), n: F.count(col)}, {s: F.sum(s), n: F.sum(n)}, F.try_divide(F.col(s), F.col(n)))


def partial1(df: DataFrame, keys: list[str], aggs: dict[str, Staged]) -> DataFrame:
    """States from rows."""
    return df.groupBy(*keys).agg(*[c.alias(k) for a in aggs.values() for k, c in a.make.items()])


def partial2(states: DataFrame, keys: list[str], aggs: dict[str, Staged]) -> DataFrame:
    """States from states."""
    return states.groupBy(*keys).agg(*[c.alias(k) for a in aggs.values() for k, c in a.merge.items()])


def final(states: DataFrame, keys: list[str], aggs: dict[str, Staged]) -> DataFrame:
    return partial2(states, keys, aggs).select(*keys, *[a.read.alias(k) for k, a in aggs.items()])


def complete(df: DataFrame, keys: list[str], aggs: dict[str, Staged]) -> DataFrame:
    return partial1(df, keys, aggs).select(*keys, *[a.read.alias(k) for k, a in aggs.items()])


def two_stages(df: DataFrame, keys: list[str], aggs: dict[str, Staged], salts: int = 16) -> DataFrame:
    """States by key and salt first, so that a hot key is spread over tasks before its states converge."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(salts)))
    return final(partial1(salted, [*keys, "_salt"], aggs), keys, aggs)


def pass_through(df: DataFrame, keys: list[str], aggs: dict[str, Staged], share: float = 0.8) -> DataFrame:
    """Rows whose keys are nearly all different aren't aggregated before the shuffle, for that would only cost.

    A sketch of the keys says so, in one pass over the key columns.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(*keys)).alias("keys")).first()
    if seen.n and seen["keys"] > share * seen.n:
        df = df.repartition(*keys)  # rows of a key are together: Spark then plans one aggregation, behind the shuffle
    return complete(df, keys, aggs)


def local(df: DataFrame, keys: list[str], aggs: dict[str, Staged], table: str, buckets: int = 8) -> DataFrame:
    """From a table that is stored in buckets of its keys, without a shuffle of the query's own."""
    spark = df.sparkSession
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return written(complete(spark.table(table), keys, aggs), "local-aggregation")
