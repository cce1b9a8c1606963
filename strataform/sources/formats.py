"""Text and binary formats by the reference's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataform.sources import binary

_TSV = {"sep": "\t", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Reader and writer of Spark, and their options.
FORMATS = {
    "Native": ("native", {}),
    "RowBinary": ("row", {}),
    "TabSeparated": ("csv", _TSV),
    "TabSeparatedWithNames": ("csv", _TSV | {"header": "true"}),
    "JSONEachRow": ("json", {"ignoreNullFields": "false"}),
    "Null": ("noop", {}),
}


def _escaped(c):
    """Backslash, tab and line ends as two characters, NULL as \\N."""
    text = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return F.coalesce(text, F.lit("\\N"))


def _unescaped(c, kind: str):
    def part(p):
        for raw, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            p = F.replace(p, F.lit(code), F.lit(raw))
        return p

    text = F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\\\\"), part), "\\")
    return F.when(F.coalesce(c, F.lit("")) != "\\N", text).cast(kind)


def write(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    kind, options = FORMATS[name]
    if name in binary.WRITERS:
        binary.write(df, path, name)
        return
    if kind == "csv":
        df = df.select(*[_escaped(F.col(f"`{c}`")).alias(c) for c in df.columns])
    writer = df.write.format(kind).options(**options).mode(mode)
    writer.save() if kind == "noop" else writer.save(path)


def read(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """Schemas are given, never inferred: no pass over the data to guess them."""
    kind, options = FORMATS[name]
    if name in binary.WRITERS:
        return binary.read(spark, path, name, schema)
    if kind != "csv":
        return spark.read.format(kind).options(**options).schema(schema).load(path)
    text = spark.read.format(kind).options(**options).schema(", ".join(f"`{f.name}` string" for f in schema)).load(path)
    return text.select(*[_unescaped(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in schema])


def literal(c) -> F.col:
    text = F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def as_values(df: DataFrame) -> DataFrame:
    """Rows as SQL tuples: numbers plain, strings and times quoted."""
    kinds = dict(df.dtypes)
    plain = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) if kinds[c] in plain or kinds[c].startswith("decimal") else literal(F.col(c)) for c in df.columns]
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")")).alias("value"))


def from_values(spark: SparkSession, tuples: str, names: list[str]) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {tuples} AS t({', '.join(names)})")


def as_json_compact(df: DataFrame) -> DataFrame:
    """Rows as JSON arrays."""
    return df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("value"))
