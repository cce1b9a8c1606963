"""All registered queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary: scan, filter, project, aggregate, sort."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _register_functions() -> None:
    from strataform.functions import CATALOGUE
    from strataform.operators import aggregates

    for f in [*CATALOGUE.values(), *aggregates.CATALOGUE.values()]:
        QUERIES[f.query_name] = f.query
        if f.oracle:
            ORACLE_SQL[f.query_name] = f.oracle


def _register_plans() -> None:
    from strataform.plans import catalogue

    QUERIES.update(catalogue.QUERIES)
    ORACLE_SQL.update(catalogue.ORACLE)


_register_functions()
_register_plans()
QUERIES["q1_pricing_summary"] = flagship
ORACLE_SQL["q1_pricing_summary"] = """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
"""
