"""Stored forms, indexes, replicas, stages of aggregation, and plans that must be as they are."""

import datetime

import pytest

from strataform.operators import stages
from strataform.plans.catalogue import QUERIES
from strataform.sources import binary, formats, remote, search
from strataform.storage import work_dir

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["RowBinary", "Native"])
def test_binary_formats_keep_all_types(spark, name):
    schema = "a tinyint, b smallint, c int, d bigint, e float, f double, g boolean, h date, i string, j binary, k bigint NOT NULL"
    rows = [(1, 2, 3, 4, 0.5, -0.0, True, datetime.date(2020, 2, 29), "é\n", b"\x00\xff", 7), (None,) * 10 + (8,), (-128, -1, -(2**31), 2**63 - 1, 1e30, 1e300, False, datetime.date(1970, 1, 1), "", b"", 9), (0, 0, 0, 0, 0.0, 0.0, False, datetime.date(2149, 6, 6), "x" * 300, b"y", 10)]
    df = spark.createDataFrame(rows, schema).repartition(2)
    path = work_dir(spark, "binary")
    formats.write(df, path, name)
    key = lambda r: r.k
    assert sorted(formats.read(spark, path, name, df.schema).collect(), key=key) == sorted(df.collect(), key=key)
    none = work_dir(spark, "binary")
    formats.write(df.where("false"), none, name)
    assert formats.read(spark, none, name, df.schema).count() == 0
    with pytest.raises(ValueError):
        formats.write(spark.range(1).selectExpr("array(id) AS x"), path, name)


def test_layouts_of_binary_formats():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), pa.array(["ab", None])], ["n", "s"])
    kinds = [("n", "int", False), ("s", "string", True)]
    assert binary._row_binary(batch, kinds) == b"\1\0\0\0\0\2ab" + b"\2\0\0\0\1\0"[:5]
    assert binary._native(batch, kinds) == b"\2\2" + b"\1n\5Int32" + b"\1\0\0\0\2\0\0\0" + b"\1s\x10Nullable(String)" + b"\0\1" + b"\2ab\0"
    assert binary._length(300) == b"\xac\x02"


def test_replicas(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b"))
    assert remote.from_replicas(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 3
    with pytest.raises(FileNotFoundError):
        remote.from_replicas(spark, [str(tmp_path / "a")])


def test_database_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:strataform;create=true"
    spark.range(100).selectExpr("id AS K", "id % 7 AS V").write.jdbc(url, "T", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    rows = remote.from_database(spark, url, "T", "K", (0, 100), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    some = rows.where("V = 3").select("K")
    assert rows.rdd.getNumPartitions() == 4 and "PushedFilters: [*IsNotNull(V), *EqualTo(V,3)]" in plan(some) and some.count() == 14


def test_inverted_index_reads_named_rows_only(spark):
    path = work_dir(spark, "table")
    spark.range(1000).selectExpr("id", "id % 97 AS v", "IF(id % 10 = 0, NULL, id % 5) AS w").repartitionByRange(5, "id").write.parquet(path)
    search.store_inverted(path, "v", f"{path}-v", spark)
    assert {r.id for r in search.read_inverted(spark, path, f"{path}-v", [3, 96]).collect()} == {i for i in range(1000) if i % 97 in (3, 96)}
    assert search.read_inverted(spark, path, f"{path}-v", [500]).count() == 0
    search.store_inverted(path, "id", f"{path}-id", spark)
    assert len(search.read_inverted(spark, path, f"{path}-id", [1, 2]).inputFiles()) <= 2  # the table's file, and the index


def test_stored_postings_are_read_by_bucket(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "A")], "id int, text string")
    path = work_dir(spark, "postings")
    search.store_postings(docs, "id", "text", path)
    found = search.bm25_stored(spark, path, ["a", "zz"], 5)
    assert [r.doc for r in found.collect()] == [1, 4] or [r.doc for r in found.collect()] == [4, 1]
    assert "PartitionFilters: [isnotnull(bucket" in plan(found) or "PartitionFilters: [bucket" in plan(found)


def test_lists_hold_every_row(spark):
    import numpy as np

    r = np.random.default_rng(3)
    points = [(i, r.normal(size=8).tolist()) for i in range(2000)] + [(5000, None)]
    df = spark.createDataFrame(points, "id int, v array<double>")
    path = work_dir(spark, "lists")
    index = search.build_lists(df, "id", "v", path, lists=20, sample=500)
    assert spark.read.parquet(path).count() == 2000
    asked = df.where("id % 20 = 0").selectExpr("id", "v AS q")
    exact = {(x.query, x.id) for x in search.exact_nearest(df.where("v IS NOT NULL"), "id", "v", asked, "id", "q", 5).collect()}
    found = {(x.query, x.id) for x in search.lists_nearest(spark, index, asked, "id", "q", 5, probes=10).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact) == 500
    assert {(x.query, x.id) for x in search.lists_nearest(spark, index, asked, "id", "q", 5, probes=20).collect()} == exact


def test_stages_agree(spark):
    rows = spark.range(4000).selectExpr("IF(id % 3 > 0, 1, id) AS k", "IF(id % 5 = 0, NULL, id) AS x", "id")
    aggs = lambda: {"n": stages.count("n"), "s": stages.total("s", "x"), "m": stages.mean("m", "x"), "lo": stages.least("lo", "x")}
    want = sorted(map(str, stages.complete(rows, ["k"], aggs()).collect()))
    assert sorted(map(str, stages.two_stages(rows, ["k"], aggs()).collect())) == want
    assert sorted(map(str, stages.final(stages.partial2(stages.partial1(rows, ["k"], aggs()), ["k"], aggs()), ["k"], aggs()).collect())) == want
    assert sorted(map(str, stages.pass_through(rows, ["k"], aggs()).collect())) == want


def test_pass_through_aggregates_once(spark):
    rows = spark.range(5000).selectExpr("id", "id % 2 AS k")
    one = lambda keys: plan(stages.pass_through(rows, keys, {"n": stages.count("n")}))
    assert "functions=[partial_count" in one(["k"]) and one(["k"]).index("Exchange") < one(["k"]).index("partial_count")
    unique = one(["id"])
    assert unique.index("partial_count") < unique.index("Exchange")  # both aggregations are above the shuffle


def test_local_aggregation_has_no_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 5 AS k", "id AS x")
    rows.write.mode("overwrite").bucketBy(4, "k").format("parquet").saveAsTable("bucketed_for_test")
    assert "Exchange" not in plan(stages.complete(spark.table("bucketed_for_test"), ["k"], {"s": stages.total("s", "x")}))
    spark.sql("DROP TABLE bucketed_for_test")


def test_runtime_filter_is_planned(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert "might_contain" in QUERIES["o045_runtime_filter"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_two_operators_are_one_query():
    code = lambda f: (f.__code__.co_code, repr(f.__code__.co_consts), f.__code__.co_names, repr([x.cell_contents for x in f.__closure__ or ()]))
    assert len({code(f) for f in QUERIES.values()}) == len(QUERIES)


def test_hash_exchange_sends_what_is_needed(spark):
    assert "hashpartitioning(k" in plan(QUERIES["o029_exchange_hash"](spark, DATA))


def test_nearest_rows_are_those_of_brute_force(spark, monkeypatch):
    """With many equal distances, vectors of other lengths and missing elements, and more queries than meet a batch at once."""
    import numpy as np

    monkeypatch.setattr(search, "ASKED_FILE", 50)
    r = np.random.default_rng(5)
    points = {i: [1.0, 2.0, 3.0] if i % 3 == 0 else np.round(r.normal(size=3), 1).tolist() for i in range(900)}
    df = spark.createDataFrame([(f"k{i:04}", v) for i, v in points.items()] + [("short", [1.0]), ("hole", [1.0, None, 3.0]), ("none", None)], "id string, v array<double>")
    asked = df.where("id LIKE '%0'").selectExpr("id", "v AS q")
    got = search.exact_nearest(df, "id", "v", asked, "id", "q", 7)
    want = set()
    for i in range(0, 900, 10):
        near = sorted((round(float(np.linalg.norm(np.subtract(v, points[i]))), 6), f"k{j:04}") for j, v in points.items())
        want |= {(f"k{i:04}", j, d) for d, j in near[:7]}
    assert {(x.query, x.id, x.distance) for x in got.collect()} == want
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)  # no row for each pair


def test_ranges_of_an_index_are_bounded(spark, monkeypatch):
    """One value in all rows of one file; the index has no larger file for it, and few places are sent to the rows."""
    monkeypatch.setattr(search, "ROWS", 100, raising=False)
    path = work_dir(spark, "table")
    spark.range(2000).selectExpr("id", "IF(id % 500 = 0, 2, 1) AS v").coalesce(1).write.parquet(path)
    search.store_inverted(path, "v", f"{path}-v", spark)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}-v").selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 400
    found = search.read_inverted(spark, path, f"{path}-v", [2])
    assert sorted(r.id for r in found.collect()) == [0, 500, 1000, 1500] and "BroadcastHashJoin" in plan(found)
