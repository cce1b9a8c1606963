"""Joins that Spark lacks as such: existence as a value with three-valued logic, ANY strictness, mixed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """A side with a broadcast hint if a bounded count says that it is small; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def exists(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], name: str = "matched", anti: bool = False) -> DataFrame:
    """Left rows with a two-valued match flag: the left outer semi (or anti) join."""
    found = right.select(*[F.col(r).alias(f"__{k}") for k, (_, r) in enumerate(keys)]).distinct().withColumn("__hit", F.lit(True))
    cond = reduce(lambda a, b: a & b, [left[l_] == found[f"__{k}"] for k, (l_, _) in enumerate(keys)])
    flag = F.coalesce(F.col("__hit"), F.lit(False))
    joined = left.join(found, cond, "left")
    return joined.select(*[left[c] for c in left.columns], (~flag if anti else flag).alias(name))


def in_value(left: DataFrame, right: DataFrame, key: str, of: str, name: str = "matched", anti: bool = False) -> DataFrame:
    """Left rows with ``key IN (right)`` as a value: TRUE, FALSE or NULL as three-valued logic has it.

    One aggregate says whether the right side is empty or has a NULL; its distinct values are joined.
    """
    about = right.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.max(F.col(of).isNull()), F.lit(False)).alias("__null"))
    found = right.where(F.col(of).isNotNull()).select(F.col(of).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    joined = left.join(found, left[key] == found["__k"], "left").crossJoin(F.broadcast(about))  # one row
    value = F.when(F.col("__n") == 0, F.lit(False)).when(F.col("__hit"), F.lit(True)).when(left[key].isNull() | F.col("__null"), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.select(*[left[c] for c in left.columns], (~value if anti else value).alias(name))


def not_in(left: DataFrame, right: DataFrame, key: str, of: str) -> DataFrame:
    """Rows for which NOT IN is true: the null-aware anti join."""
    return in_value(left, right, key, of, "__v", True).where("__v").drop("__v")


def any_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """At most one match for each left row: the right row that comes first by all its columns."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__one")).select(*keys, "__one.*")
    return left.join(one, keys, how)


#: Right rows that one list of ``gathered`` has, about.
GATHERED = 1024


def gathered(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """An inner join for keys that have many rows on both sides, where the result is far larger than its inputs.

    The right side's values (told apart by themselves) are gathered in lists of ``GATHERED`` or so, and each left row
    meets each list of its key once, in a task by key and list. Pairs are made from lists, after the join.
    """
    right = right.where(F.col(key).isNotNull()).select(key, value)
    salts = (right.groupBy(key).count().agg(F.max("count")).first()[0] or 0) // GATHERED + 1
    lists = right.groupBy(key, F.pmod(F.xxhash64(value), F.lit(salts)).cast("int").alias("__salt")).agg(F.concat(F.collect_list(value), F.array_repeat(F.lit(None), F.count_if(F.col(value).isNull()).cast("int"))).alias("__list"))
    each = left.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = each.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "__salt")
    return dealt.join(lists, [key, "__salt"]).select(*left.columns, F.explode("__list").alias(value))


def decimal_key(c: Column) -> Column:
    """Decimals of any scale as equal text: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def collated(c: Column, collation: str = "UNICODE_CI_RTRIM") -> Column:
    return F.collate(c, collation)


def salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose left side has hot keys: its rows are dealt over salts, and the right side repeated for each.

    For keys that adaptive execution can't split, as below an aggregate.
    """
    names = [c for c in left.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*[left[c] for c in (names or keys)]), F.lit(salts))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*keys, "__salt"], how).drop("__salt")
