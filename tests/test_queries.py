"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strataform.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("family", ["o", "a", "s0", "s1", "s2", "s3", "q"])
def test_queries_match_their_sql(spark, duck, family):
    wrong = []
    for name in [x for x in QUERIES if x.startswith(family)]:
        got = QUERIES[name](spark, DATA)
        columns = sorted(got.columns)
        rows = sorted((tuple(plain(r[x]) for x in columns) for r in got.collect()), key=repr)
        if name not in ORACLE_SQL:
            assert rows, name
            continue
        want = duck.sql(ORACLE_SQL[name])
        if sorted(want.columns) != columns or sorted((tuple(plain(r[want.columns.index(x)]) for x in columns) for r in want.fetchall()), key=repr) != rows:
            wrong.append(name)
    assert not wrong


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "l_linestatus", "sum_qty", "sum_disc_price", "avg_disc", "count_order"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_is_covered():
    rows = {x.split("_")[0] for x in QUERIES}
    assert {f"o{k:03d}" for k in range(1, 117)} <= rows
    assert {f"a{k:02d}" for k in range(1, 76)} <= rows
    assert {f"s{k:03d}" for k in range(1, 377)} - rows <= {"s327"}
