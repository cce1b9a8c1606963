"""Statements from clients: each is planned and run on its own, and answers with rows or an error class."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from strataform.session import table


def run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over the tables of a folder, which it names in braces."""
    return spark.sql(statement, **{name: table(spark, sf_dir, name) for name in set(re.findall(r"\{(\w+)\}", statement))})


def answers(spark: SparkSession, sf_dir: str, requests: list[tuple[int, str]]) -> DataFrame:
    """``id, n, error``: the number of rows of each answer, or the class of what went wrong."""
    out = []
    for number, statement in requests:
        try:
            out.append((number, run(spark, sf_dir, statement).count(), ""))
        except PySparkException as wrong:
            out.append((number, 0, wrong.getCondition() or type(wrong).__name__))
    return spark.createDataFrame(out, "id int, n long, error string")
