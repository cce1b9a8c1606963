"""What the session knows of itself, as tables ``name, of, kind, detail``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, of string, kind string, detail string"


def _frame(spark: SparkSession, kind: str, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame([(name, of or "", kind, detail or "") for name, of, detail in rows], SCHEMA)


def databases(spark: SparkSession) -> DataFrame:
    return _frame(spark, "database", [(x.name, "", x.locationUri) for x in spark.catalog.listDatabases()])


def tables(spark: SparkSession) -> DataFrame:
    """Of the current database, views of the session included."""
    return _frame(spark, "table", [(x.name, ".".join(x.namespace or []), x.tableType) for x in spark.catalog.listTables()])


def columns(spark: SparkSession, table: str) -> DataFrame:
    return _frame(spark, "column", [(x.name, table, x.dataType) for x in spark.catalog.listColumns(table)])


def functions(spark: SparkSession) -> DataFrame:
    """Spark's and this engine's."""
    from strataform.functions import CATALOGUE

    own = [(name, "", "strataform") for name in CATALOGUE]
    return _frame(spark, "function", [(x.name, "", "spark") for x in spark.catalog.listFunctions()] + own)


def settings(spark: SparkSession) -> DataFrame:
    return _frame(spark, "setting", [(k, "", v) for k, v in spark.conf.getAll.items()])


TABLES = {"database": databases, "table": tables, "function": functions, "setting": settings}
