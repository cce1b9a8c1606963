"""The function catalogue: each function builds a Column, and has a sample query and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.session import table


def rounded(c: Column, places: int = 6) -> Column:
    """Doubles as SQL rounds them: scaled, halves away from zero. A zero keeps its sign, which Spark's own rounding drops."""
    scaled, unit = c * 10.0**places, F.lit(10.0**places)
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.abs(scaled) < float("inf"), whole / unit).otherwise(c)


#: Result kinds of sample queries: a Spark type, and how both sides are cast to it.
KINDS = {
    "l": ("CAST({} AS BIGINT)", lambda c: c.cast("long")),
    "d": ("ROUND(CAST({} AS DOUBLE), 6)", lambda c: rounded(c.cast("double"))),
    "s": ("CAST({} AS VARCHAR)", lambda c: c.cast("string")),
    "b": ("CAST({} AS BOOLEAN)", lambda c: c.cast("boolean")),
    "D": ("CAST({} AS DATE)", lambda c: c.cast("date")),
    "T": ("strftime({}, '%Y-%m-%d %H:%M:%S')", lambda c: F.ltrim(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("+"))),  # years from 10000 on have a sign in Java
    "V": ("list_transform({}, lambda x: round(x::DOUBLE, 6))", lambda c: F.transform(c, lambda x: rounded(x.cast("double")))),
    "x": ("UPPER({})", lambda c: F.hex(c)),
}

#: Sample rows by name: table, then columns for Spark, and for the SQL where they differ.
_COMMON = {
    "id": "o_orderkey",
    "i": "CAST(o_orderkey % 23 - 11 AS INT)",
    "j": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 13 - 6 AS INT) END",
    "n": "CAST(o_orderkey % 78 AS INT)",
    "bi": "o_orderkey * 1000003 - 5000000000",
    "x": "o_totalprice / 1000 - 250",
    "y": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) / 100 END",
    "h": "CAST(o_orderkey % 41 - 20 AS DOUBLE) / 2",
    "z": "CAST(o_orderkey % 201 - 100 AS DOUBLE) / 100",
    "dc": "CAST(CAST(o_totalprice AS DECIMAL(15,2)) - 250000 AS DECIMAL(15,2))",
    "s": "o_orderpriority",
    "t": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE substr(o_orderpriority, 3) END",
    "m": "CASE o_orderkey % 4 WHEN 0 THEN 'Ünï-' || o_orderstatus WHEN 1 THEN '  ab ' || o_orderstatus || '  ' WHEN 2 THEN 'a-b-c-' || o_orderstatus ELSE '' END",
    "sn": "CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN '-7.25' WHEN 2 THEN 'abc' WHEN 3 THEN '2006-01' WHEN 4 THEN '-42' WHEN 5 THEN '300' WHEN 6 THEN '' ELSE NULL END",
    "sd": "CASE o_orderkey % 4 WHEN 0 THEN '2021-03-04' WHEN 1 THEN '2020-02-30' WHEN 2 THEN 'no date' ELSE '1999-12-31' END",
    "st": "CASE o_orderkey % 4 WHEN 0 THEN '2021-03-04 05:06:07' WHEN 1 THEN '2020-02-30 00:00:00' WHEN 2 THEN 'no date' ELSE '1999-12-31 23:59:59' END",
    "ip": "CASE o_orderkey % 5 WHEN 0 THEN '192.168.0.' || CAST(o_custkey % 256 AS VARCHAR(20)) WHEN 1 THEN '1.2.3' WHEN 2 THEN '256.1.1.1' WHEN 3 THEN '10.0.0.1' ELSE NULL END",
    "d": "CAST(o_orderdate AS DATE)",
    "d2": "CAST(o_orderdate AS DATE) + CAST(o_custkey % 1000 - 500 AS INT)",
    "b": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END",
    "c": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 2 = 0 END",
}
SAMPLES = {
    "o": (
        "orders",
        _COMMON
        | {
            "ts": "o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 86400)",
            "ts2": "o_orderdate + make_dt_interval(CAST(o_custkey % 900 - 450 AS INT), 0, 0, (o_orderkey * 104729) % 86400)",
            "iv": "make_dt_interval(0, CAST(o_orderkey % 60 AS INT), CAST(o_custkey % 60 AS INT), o_orderkey % 59)",
        },
        _COMMON
        | {
            "ts": "o_orderdate + to_seconds((o_orderkey * 7919) % 86400)",
            "ts2": "o_orderdate + to_days(CAST(o_custkey % 900 - 450 AS INT)) + to_seconds((o_orderkey * 104729) % 86400)",
            "ivs": "(o_orderkey % 60) * 3600 + (o_custkey % 60) * 60 + o_orderkey % 59",
            "ivh": "o_orderkey % 60",
            "ivm": "o_custkey % 60",
            "ivx": "o_orderkey % 59",
        },
    ),
    "e": (
        "events",
        e := {
            "id": "event_id",
            "js": "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{\"a\": [1, 2, {\"b\": 3}], \"kk\": \"x\"}' WHEN 2 THEN '[1, \"two\", null]' WHEN 3 THEN '\"text\"' WHEN 4 THEN '17' ELSE NULL END",
            "jt": "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{bad' WHEN 2 THEN '[1, 2]' ELSE NULL END",
            "k": "CAST(event_id % 9 AS INT)",
            "v": "value",
            "et": "event_type",
        },
        e,
    ),
    "u": ("pages", u := {"id": "page_id", "url": "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://www.shop.example.co.uk/a/b?x=1&y=2#top' WHEN 2 THEN 'ftp://files.example.org/z' WHEN 3 THEN 'http://example.com/p%20q?name=a%2Bb' ELSE NULL END"}, u),
    "v": (
        "embeddings",
        {"id": "vec_id", "v": "embedding", "w": "transform(embedding, (x, p) -> CAST(x * CAST(p + 1 AS FLOAT) AS FLOAT))", "label": "label"},
        {"id": "vec_id", "v": "embedding", "w": "list_transform(embedding, lambda x, p: CAST(x * CAST(p AS FLOAT) AS FLOAT))", "label": "label"},
    ),
}


@dataclass
class Function:
    """``build`` makes the Column from argument Columns, and from constants from the argument ``constants`` on.

    Formats, units, paths and the like are constants: plain Python values. What the sample query passes for them
    is in ``given``.
    """

    row: int
    name: str
    build: Callable[..., Column]
    args: str
    kind: str
    sql: str | None
    sample: str = "o"
    constants: int | None = None
    given: tuple = ()

    def __call__(self, *args) -> Column:
        at = len(args) if self.constants is None else self.constants
        for k, a in enumerate(args[at:], at + 1):
            if isinstance(a, Column):
                raise TypeError(f"argument {k} of {self.name} is a constant: pass a plain value, not a Column")
        return self.build(*[a if isinstance(a, Column) else F.lit(a) for a in args[:at]], *args[at:])

    @property
    def query_name(self) -> str:
        return f"s{self.row:03d}_{self.name}"

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sample(spark, sf_dir, self.sample)
        args = [F.expr(a) for a in self.args.split(" ; ")] if self.args else []
        return rows.select("id", KINDS[self.kind][1](self(*args, *self.given)).alias("v"))

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        name, _, columns = SAMPLES[self.sample]
        inner = ", ".join(f"{x} AS {k}" for k, x in columns.items())
        return f"SELECT id, {KINDS[self.kind][0].format(self.sql)} AS v FROM (SELECT {inner} FROM {name})"


CATALOGUE: dict[str, Function] = {}


def sample(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    name, columns, _ = SAMPLES[which]
    return table(spark, sf_dir, name).selectExpr(*[f"{x} AS {k}" for k, x in columns.items()])


def add(row: int, name: str, build: Callable[..., Column], args: str, kind: str, sql: str | None, sample: str = "o", constants: int | None = None, given: tuple = ()) -> None:
    if name in CATALOGUE:
        raise ValueError(f"{name} is there already")
    CATALOGUE[name] = Function(row, name, build, args, kind, sql, sample, constants, given)


def unsigned(c: Column) -> Column:
    """A 64-bit pattern as the unsigned number it is."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)
