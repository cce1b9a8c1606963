"""The relational and dataflow operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.operators import joins, stages, windows
from strataform.session import table
from strataform.plans import service, sinks
from strataform.sources import formats, remote, search, system, versioned
from strataform.storage import work_dir, written
from strataform.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def op(row: int, name: str, sql: str | None):
    def register(f):
        key = f"o{row:03d}_{name}"
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return register


def scratch(spark: SparkSession, label: str) -> str:
    """A folder for tables that a query writes and reads back, where executors and driver find it."""
    return work_dir(spark, f"scratch-{label}")


# --- scans and sources


@op(1, "table_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(s, d):
    return table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@op(2, "partition_table_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(s, d):
    path = scratch(s, "parts")
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return s.read.parquet(path).where(c("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


def _versions(s, d):
    """Three versions of customers: all, every third changed, every seventh deleted."""
    base = table(s, d, "customer").select("c_custkey", "c_acctbal")
    one = versioned.versions_of(base, F.lit(1).cast("long"), F.lit(False))
    two = versioned.versions_of(base.where("c_custkey % 3 = 0").withColumn("c_acctbal", c("c_acctbal") + 1), F.lit(2).cast("long"), F.lit(False))
    three = versioned.versions_of(base.where("c_custkey % 7 = 0"), F.lit(3).cast("long"), F.lit(True))
    return one.unionByName(two).unionByName(three)


_BAL = "c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END"


@op(3, "fast_scan", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def _(s, d):
    return versioned.fast(_versions(s, d))


@op(4, "raw_scan", "SELECT c_custkey, 1::BIGINT AS ver FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_custkey % 7 = 0")
def _(s, d):
    return versioned.raw(_versions(s, d)).select("c_custkey", c(versioned.VERSION).alias("ver"))


@op(5, "mvcc_filter", f"SELECT c_custkey, {_BAL} AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def _(s, d):
    return versioned.snapshot(_versions(s, d), "c_custkey")


@op(6, "stale_read", f"SELECT c_custkey, {_BAL} AS c_acctbal FROM customer")
def _(s, d):
    return versioned.snapshot(_versions(s, d), "c_custkey", at=2)


@op(7, "exchange_receiver", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
def _(s, d):
    sent = written(table(s, d, "customer").repartition("c_nationkey").select("c_nationkey", "c_acctbal", F.spark_partition_id().alias("sender")), "exchange")
    received = sent.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.count_distinct("sender").alias("senders"))
    return received.where("senders = 1").drop("senders")  # a hash exchange sends a key to one place


@op(8, "cte_source", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT x.o_custkey FROM a x JOIN a y ON x.o_custkey = y.o_custkey + 1 WHERE x.t > y.t")
def _(s, d):
    table(s, d, "orders").createOrReplaceTempView("cte_orders")
    return s.sql("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM cte_orders GROUP BY 1) SELECT x.o_custkey FROM a x JOIN a y ON x.o_custkey = y.o_custkey + 1 WHERE x.t > y.t")


@op(9, "remote_read", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    gone = f"{work_dir(s, 'replica')}/orders.parquet"
    return remote.from_replicas(s, [gone, f"{d.rstrip('/')}/orders.parquet"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@op(10, "null_and_concat_sources", "SELECT n_nationkey AS k, 'nation' AS origin FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region")
def _(s, d):
    nation = table(s, d, "nation").select(c("n_nationkey").alias("k"), F.lit("nation").alias("origin"))
    region = table(s, d, "region").select(c("r_regionkey").alias("k"), F.lit("region").alias("origin"))
    return nation.union(nation.where("false")).union(region)


@op(11, "generated_column", "SELECT c_custkey, lower(c_name) AS name_low FROM customer")
def _(s, d):
    return table(s, d, "customer").withColumn("name_low", F.lower("c_name")).select("c_custkey", "name_low")


@op(12, "object_store_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000")
def _(s, d):
    path = scratch(s, "store")
    rows = table(s, d, "supplier")
    rows.repartition(3).write.parquet(f"{path}/a/b")
    return remote.object_store(s, path, "part-*.parquet", rows.schema).where("s_acctbal > 5000").select("s_suppkey", "s_name")


_Q = [0.1 * ((i * 7) % 5 - 2) for i in range(64)]


def _vec_sql(expr: str) -> str:
    q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _Q) + "]"
    return f"SELECT vec_id AS id, round({expr.replace('Q', q)}, 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 20"


@op(13, "vector_ann_scan", _vec_sql("sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: pow(embedding[k]::DOUBLE - (Q)[k], 2))))"))
def _(s, d):
    return search.nearest(table(s, d, "embeddings"), "vec_id", "embedding", _Q, "l2", 20)


@op(131, "vector_index_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def _(s, d):
    e = table(s, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select("vec_id", c("embedding").alias("q"))
    index = search.build_lists(e, "vec_id", "embedding", scratch(s, "lists"))
    found = search.lists_nearest(s, index, asked, "vec_id", "q", 10).select("query", "id")
    exact = search.exact_nearest(e, "vec_id", "embedding", asked, "vec_id", "q", 10).select("query", c("id").alias("near"))
    both = exact.join(found, (exact["query"] == found["query"]) & (c("near") == c("id")), "left").select(exact["query"], "id")
    return both.agg(F.count_distinct("query").alias("queries"), (F.count("id") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@op(
    14,
    "full_text_scan",
    r"""WITH w AS (SELECT item_id AS doc, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    c AS (SELECT doc, len(w) AS length, len(list_filter(w, lambda x: x = 'that')) AS a, len(list_filter(w, lambda x: x = 'for')) AS b FROM w),
    t AS (SELECT count(*) AS n, avg(length) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c)
    SELECT doc, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
    FROM c, t WHERE a > 0 OR b > 0 ORDER BY score DESC, doc LIMIT 10""",
)
def _(s, d):
    path = scratch(s, "postings")
    search.store_postings(table(s, d, "benchmark"), "item_id", "text", path)
    return search.bm25_stored(s, path, ["that", "for"], 10)


@op(15, "inverted_index_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (5, 77, 150)")
def _(s, d):
    path = scratch(s, "indexed")
    search.in_ranges(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").write.parquet(path)
    search.store_inverted(path, "l_partkey", f"{path}-index", s)
    return search.read_inverted(s, path, f"{path}-index", [5, 77, 150])


def _round_trip(s, d, name):
    rows = table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = scratch(s, name)
    formats.write(rows, path, name)
    return formats.read(s, path, name, rows.schema)


for _row, _name in ((16, "Native"), (17, "RowBinary"), (18, "TabSeparated"), (19, "TabSeparatedWithNames"), (21, "JSONEachRow")):
    op(_row, f"format_{_name}", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")((lambda n: lambda s, d: _round_trip(s, d, n))(_name))


@op(20, "format_Values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)")
def _(s, d):
    return formats.from_values(s, "(1, 'a'), (2, NULL)", ["k", "v"])


@op(22, "delta_merge_table", "SELECT count(*) AS n, round(sum(c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END), 2) AS total FROM customer WHERE c_custkey % 7 <> 0")
def _(s, d):
    path = scratch(s, "delta")
    for _, part in sorted({1: "_version = 1", 2: "_version = 2", 3: "_version = 3"}.items()):
        _versions(s, d).where(part).write.mode("append").parquet(path)
    return versioned.snapshot(s.read.parquet(path), "c_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@op(23, "memory_table", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    table(s, d, "region").createOrReplaceTempView("memory_region")
    return s.table("memory_region")


@op(24, "log_table", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def _(s, d):
    path = scratch(s, "log")
    for _ in range(2):
        table(s, d, "nation").select("n_nationkey").write.mode("append").parquet(path)
    return s.read.parquet(path)


@op(25, "set_table", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(s, d):
    keys = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(joins.sized(keys), "o_custkey", "left_semi").select("o_orderkey")


@op(26, "null_table", "SELECT 0::BIGINT AS kept FROM (SELECT 1)")
def _(s, d):
    formats.write(table(s, d, "nation"), "", "Null")
    return s.range(1).select(F.lit(0).cast("long").alias("kept"))


@op(27, "numbers", "SELECT range AS number FROM range(1000)")
def _(s, d):
    return s.range(1000).withColumnRenamed("id", "number")


@op(28, "system_tables", "SELECT 'n_nationkey' AS name, 'system_nation' AS of, 'column' AS kind UNION ALL SELECT 'n_name', 'system_nation', 'column' UNION ALL SELECT 'n_regionkey', 'system_nation', 'column' UNION ALL SELECT 'system_nation', '', 'table' UNION ALL SELECT 'abs', '', 'function' UNION ALL SELECT 'default', '', 'database' UNION ALL SELECT 'spark.sql.session.timeZone', '', 'setting'")
def _(s, d):
    table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").createOrReplaceTempView("system_nation")
    found = [system.columns(s, "system_nation"), *[system.TABLES[k](s) for k in ("table", "function", "database", "setting")]]
    wanted = ("n_nationkey", "n_name", "n_regionkey", "system_nation", "abs", "default", "spark.sql.session.timeZone")
    return reduce(DataFrame.unionByName, found).where(c("name").isin(*wanted)).select("name", "of", "kind").distinct()


# --- sinks


@op(29, "exchange_hash", "SELECT o_custkey % 7 AS k, count(*) AS n, true AS together FROM orders GROUP BY 1")
def _(s, d):
    sent = table(s, d, "orders").select((c("o_custkey") % 7).alias("k")).repartition("k").withColumn("to", F.spark_partition_id())
    return sent.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.min("to") == F.max("to")).alias("together"))


@op(30, "exchange_broadcast", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return table(s, d, "nation").join(joins.sized(table(s, d, "region")), c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")


@op(31, "fine_grained_shuffle", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(s, d):
    w = Window.partitionBy("o_custkey")
    return table(s, d, "orders").repartition("o_custkey").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("rn"), F.count(F.lit(1)).over(w).alias("n"))


@op(32, "cte_sink", "WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT count(*) AS n FROM a x, a y WHERE x.k < y.k AND x.m > y.m")
def _(s, d):
    a = table(s, d, "customer").groupBy(c("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("m"))
    b = a.select(c("k").alias("k2"), c("m").alias("m2"))
    return a.join(b, (c("k") < c("k2")) & (c("m") > c("m2"))).agg(F.count(F.lit(1)).alias("n"))


@op(33, "result_sink", "SELECT n_nationkey, n_name, (row_number() OVER (ORDER BY n_name) - 1) // 10 AS page FROM nation")
def _(s, d):
    return sinks.pages(table(s, d, "nation").select("n_nationkey", "n_name"), [c("n_name")], 10)


@op(34, "wire_encodings", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    rows = table(s, d, "nation").select("n_nationkey", "n_name")
    return sinks.from_wire(sinks.to_wire(rows), rows.schema)


@op(35, "output_values", "SELECT '(' || r_regionkey || ', ''' || r_name || ''')' AS value FROM region")
def _(s, d):
    return formats.as_values(table(s, d, "region").select("r_regionkey", "r_name"))


@op(351, "output_json_compact", "SELECT '[\"' || r_regionkey || '\",\"' || r_name || '\"]' AS value FROM region")
def _(s, d):
    return formats.as_json_compact(table(s, d, "region").select("r_regionkey", "r_name"))


@op(36, "insert_select", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(s, d):
    path = scratch(s, "insert")
    table(s, d, "nation").createOrReplaceTempView("insert_nation")
    s.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT n_nationkey, n_name FROM insert_nation WHERE n_regionkey = 1")
    return s.read.parquet(path)


@op(37, "ddl", "SELECT 1 AS k, 'a' AS v, NULL::VARCHAR AS extra")
def _(s, d):
    name = f"ddl_{uuid.uuid4().hex}"
    s.sql(f"CREATE TABLE {name} (k INT, v STRING) USING parquet")
    s.sql(f"INSERT INTO {name} VALUES (1, 'a')")
    s.sql(f"ALTER TABLE {name} ADD COLUMNS (extra STRING)")
    rows = written(s.table(name), "ddl")
    s.sql(f"DROP TABLE {name}")
    return rows


# --- projections and filters


@op(38, "projection", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS price FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("price"))


@op(39, "final_projection", "SELECT CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM orders")
def _(s, d):
    return table(s, d, "orders").select(c("o_orderkey").cast("string").alias("k"), F.date_format(c("o_orderdate") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("local"))


@op(40, "selection", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_linenumber % 2 <> 0")
def _(s, d):
    return table(s, d, "lineitem").where((c("l_quantity") > 10) & (c("l_linenumber") % 2).cast("boolean")).select("l_orderkey", "l_linenumber")


@op(41, "filter_pushdown", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice < 50000")
def _(s, d):
    return table(s, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND o_totalprice < 50000").select("o_orderkey")


@op(42, "late_materialization", "SELECT * FROM lineitem WHERE l_extendedprice > 90000 AND l_discount = 0.1")
def _(s, d):
    return table(s, d, "lineitem").where("l_extendedprice > 90000 AND l_discount = 0.1D")


@op(43, "rough_set_predicates", "SELECT o_orderkey FROM orders WHERE (o_orderkey BETWEEN 100 AND 900 OR o_custkey = 5) AND NOT o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AND o_totalprice IS NOT NULL")
def _(s, d):
    return table(s, d, "orders").where("(o_orderkey BETWEEN 100 AND 900 OR o_custkey = 5) AND NOT o_orderstatus <=> 'F' AND o_orderpriority LIKE '1%' AND o_totalprice IS NOT NULL").select("o_orderkey")


@op(44, "in_mixed_set", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (1, 2, l_suppkey)")
def _(s, d):
    return table(s, d, "lineitem").where(c("l_partkey").isin(1, 2) | (c("l_partkey") == c("l_suppkey"))).select("l_orderkey", "l_linenumber")


@op(45, "runtime_filter", "SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#4'")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part").where("p_brand = 'Brand#4'"), c("l_partkey") == c("p_partkey")).agg(F.count(F.lit(1)).alias("n"))


# --- joins

_CO = "c_custkey = o_custkey"


def _cust_orders(s, d):
    return table(s, d, "customer"), table(s, d, "orders").where("o_totalprice > 400000")


_BIG = "(SELECT * FROM orders WHERE o_totalprice > 400000)"
for _row, _name, _how, _sql in (
    (46, "inner_join", "inner", f"SELECT c_custkey, o_orderkey FROM customer JOIN {_BIG} ON {_CO}"),
    (47, "left_outer_join", "left", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_BIG} ON {_CO}"),
    (48, "right_outer_join", "right", f"SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN {_BIG} ON {_CO}"),
    (49, "full_outer_join", "full", f"SELECT c_custkey, o_orderkey FROM customer FULL JOIN {_BIG} ON {_CO}"),
):
    op(_row, _name, _sql)((lambda how: lambda s, d: (lambda a, b: a.join(b, a["c_custkey"] == b["o_custkey"], how).select("c_custkey", "o_orderkey"))(*_cust_orders(s, d)))(_how))
for _row, _name, _how, _sql in (
    (50, "semi_join", "left_semi", f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {_BIG} WHERE {_CO})"),
    (51, "anti_join", "left_anti", f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_BIG} WHERE {_CO})"),
):
    op(_row, _name, _sql)((lambda how: lambda s, d: (lambda a, b: a.join(b, a["c_custkey"] == b["o_custkey"], how).select("c_custkey"))(*_cust_orders(s, d)))(_how))


@op(52, "left_outer_semi", f"SELECT c_custkey, EXISTS (SELECT 1 FROM {_BIG} WHERE {_CO}) AS matched FROM customer")
def _(s, d):
    a, b = _cust_orders(s, d)
    return joins.exists(a.select("c_custkey"), b, [("c_custkey", "o_custkey")])


@op(53, "left_outer_anti", f"SELECT c_custkey, NOT EXISTS (SELECT 1 FROM {_BIG} WHERE {_CO}) AS matched FROM customer")
def _(s, d):
    a, b = _cust_orders(s, d)
    return joins.exists(a.select("c_custkey"), b, [("c_custkey", "o_custkey")], anti=True)


_LEFT = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer)"


def _null_sides(s, d, nulls: bool):
    left = table(s, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k")
    right = table(s, d, "supplier").selectExpr(f"CASE WHEN s_suppkey % 4 = 0 AND {str(nulls).lower()} THEN NULL ELSE s_nationkey % 11 END AS r")
    return left, right


@op(54, "null_aware_anti", f"SELECT c_custkey, k FROM {_LEFT} WHERE k NOT IN (SELECT s_nationkey % 11 FROM supplier)")
def _(s, d):
    return joins.not_in(*_null_sides(s, d, False), "k", "r")


@op(55, "null_aware_outer_semi", f"SELECT c_custkey, k, k IN (SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey % 11 END FROM supplier) AS matched FROM {_LEFT}")
def _(s, d):
    return joins.in_value(*_null_sides(s, d, True), "k", "r")


@op(551, "null_aware_outer_anti", f"SELECT c_custkey, k, k NOT IN (SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey % 11 END FROM supplier) AS matched FROM {_LEFT}")
def _(s, d):
    return joins.in_value(*_null_sides(s, d, True), "k", "r", anti=True)


@op(56, "cartesian_inner", "SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_nationkey > r_regionkey * 5")
def _(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), c("n_nationkey") > c("r_regionkey") * 5).select("n_nationkey", "r_regionkey")


@op(57, "cartesian_left_outer", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_nationkey > r_regionkey * 8 + 10")
def _(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), c("n_nationkey") > c("r_regionkey") * 8 + 10, "left").select("n_nationkey", "r_regionkey")


@op(58, "cartesian_semi", "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE n_nationkey > r_regionkey * 8 + 10)")
def _(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), c("n_nationkey") > c("r_regionkey") * 8 + 10, "left_semi").select("n_nationkey")


@op(581, "cartesian_anti", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE n_nationkey > r_regionkey * 8 + 10)")
def _(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), c("n_nationkey") > c("r_regionkey") * 8 + 10, "left_anti").select("n_nationkey")


@op(59, "cartesian_outer_semi", "SELECT n_nationkey, EXISTS (SELECT 1 FROM region WHERE n_nationkey > r_regionkey * 8 + 10) AS matched FROM nation")
def _(s, d):
    table(s, d, "nation").createOrReplaceTempView("cos_nation")
    table(s, d, "region").createOrReplaceTempView("cos_region")
    return s.sql("SELECT n_nationkey, EXISTS (SELECT 1 FROM cos_region WHERE n_nationkey > r_regionkey * 8 + 10) AS matched FROM cos_nation")


@op(60, "any_join", f"SELECT c_custkey, first_price FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY 1) ON {_CO}")
def _(s, d):
    orders = table(s, d, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderkey", c("o_totalprice").alias("first_price"))
    return joins.any_join(table(s, d, "customer").select("c_custkey"), orders, ["c_custkey"]).select("c_custkey", "first_price")


@op(61, "comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def _(s, d):
    table(s, d, "nation").createOrReplaceTempView("comma_nation")
    table(s, d, "region").createOrReplaceTempView("comma_region")
    return s.sql("SELECT n_name, r_name FROM comma_nation, comma_region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")


@op(62, "hash_join_v2", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders").hint("shuffle_hash"), c("l_orderkey") == c("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@op(63, "broadcast_or_shuffled", "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").join(joins.sized(table(s, d, "supplier")), c("l_suppkey") == c("s_suppkey")).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@op(64, "decimal_key_join", "SELECT p_partkey, q.k AS other FROM part JOIN (SELECT p_partkey AS k, CAST(p_retailprice AS DECIMAL(20,6)) AS pr FROM part) q ON CAST(p_retailprice AS DECIMAL(12,2)) = q.pr")
def _(s, d):
    part = table(s, d, "part")
    a = part.select("p_partkey", joins.decimal_key(c("p_retailprice").cast("decimal(12,2)")).alias("k"))
    b = part.select(c("p_partkey").alias("other"), joins.decimal_key(c("p_retailprice").cast("decimal(20,6)")).alias("k"))
    return joins.gathered(a, b, "k", "other").select("p_partkey", "other")


@op(65, "collated_key_join", "SELECT r_regionkey, k FROM region JOIN (SELECT r_regionkey AS k, lower(r_name) || '  ' AS n FROM region) ON lower(r_name) = rtrim(n)")
def _(s, d):
    region = table(s, d, "region")
    other = region.select(c("r_regionkey").alias("k"), F.concat(F.lower("r_name"), F.lit("  ")).alias("n"))
    return region.join(other, joins.collated(c("r_name")) == joins.collated(c("n"))).select("r_regionkey", "k")


@op(66, "join_spill", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders").hint("merge"), c("l_orderkey") == c("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("t"))


@op(67, "salted_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    right = table(s, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.salted(table(s, d, "orders").select("o_custkey", "o_orderkey"), right, ["o_custkey"], 4).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# --- aggregation

_AGG = "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag"


def _agg(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


_staged = lambda: {"n": stages.count("n"), "q": stages.total("q", "l_quantity"), "mean": stages.mean("mean", "l_quantity"), "lo": stages.least("lo", "l_quantity"), "hi": stages.greatest("hi", "l_quantity")}
_STAGED_SQL = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag"
_rounded = lambda df: df.withColumn("mean", F.round("mean", 6))
op(68, "hash_aggregation", _AGG)(lambda s, d: _agg(table(s, d, "lineitem"), "l_returnflag"))


@op(70, "two_stage_aggregation", _STAGED_SQL)
def _(s, d):
    return _rounded(stages.two_stages(table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey"), ["l_returnflag"], _staged()))


@op(71, "aggregation_modes", _STAGED_SQL)
def _(s, d):
    lines = table(s, d, "lineitem")
    states = [written(stages.partial1(lines.where(f"l_linenumber % 2 = {k}"), ["l_returnflag", "l_linestatus"], _staged()), "states") for k in (0, 1)]
    return _rounded(stages.final(stages.partial2(states[0].unionByName(states[1]), ["l_returnflag", "l_linestatus"], _staged()), ["l_returnflag"], _staged()))


@op(72, "pass_through_aggregation", "SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return stages.pass_through(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"n": stages.count("n"), "q": stages.total("q", "l_quantity")})


@op(83, "aggregation_spill", "SELECT l_orderkey, l_partkey, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    """Many groups: what memory doesn't hold goes to disk in sorted runs."""
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n"))


op(69, "stream_aggregation", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem")(lambda s, d: _agg(table(s, d, "lineitem")))


@op(73, "local_aggregation", _STAGED_SQL)
def _(s, d):
    name = f"local_{uuid.uuid4().hex}"
    out = _rounded(stages.local(table(s, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], _staged(), name))
    s.sql(f"DROP TABLE {name}")
    return out



op(74, "distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct())


@op(75, "expand_multi_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("p"), F.count_distinct("l_suppkey").alias("s"))


@op(76, "grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def _(s, d):
    rf, ls = c("l_returnflag"), c("l_linestatus")
    return table(s, d, "lineitem").groupingSets([[rf, ls], [ls], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@op(761, "cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@op(77, "with_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::BIGINT AS g1, grouping(l_linestatus)::BIGINT AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"))


@op(78, "with_totals", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT NULL, count(*) FROM lineitem")
def _(s, d):
    rows = table(s, d, "lineitem")
    return windows.with_totals(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), rows.agg(F.count(F.lit(1)).alias("n")))


@op(79, "having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@op(80, "empty_aggregation", "SELECT count(*) AS n, sum(o_totalprice) AS t FROM orders WHERE o_orderkey < 0")
def _(s, d):
    return table(s, d, "orders").where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))


@op(81, "first_row_of_key", "SELECT n_regionkey, n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def _(s, d):
    return table(s, d, "nation").groupBy("n_regionkey").agg(F.first("n_regionkey").alias("k"), F.count(F.lit(1)).alias("n"))


@op(82, "collated_group_by", "SELECT count(*) AS n FROM orders GROUP BY lower(o_orderpriority)")
def _(s, d):
    mixed = F.when(c("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(c("o_orderpriority"))
    return table(s, d, "orders").select(F.collate(mixed, "UTF8_LCASE").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("n")


# --- windows

_PO = "PARTITION BY o_custkey ORDER BY o_orderkey"


def _win(sql_expr: str) -> str:
    return f"SELECT o_orderkey, {sql_expr} AS v FROM orders"


def _over(build):
    return lambda s, d: table(s, d, "orders").select("o_orderkey", build(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("v"))


_PRI = Window.partitionBy
op(84, "window", _win(f"round(sum(o_totalprice) OVER ({_PO}), 2)"))(_over(lambda w: F.round(F.sum("o_totalprice").over(w), 2)))
op(85, "window_sort", _win(f"(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey))::BIGINT"))(lambda s, d: table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("v")))
op(86, "row_number", _win(f"(row_number() OVER ({_PO}))::BIGINT"))(_over(lambda w: F.row_number().over(w).cast("long")))
_BYP = "PARTITION BY o_custkey ORDER BY o_orderpriority"
for _row, _name, _f, _sql in ((87, "rank", F.rank, "rank"), (88, "dense_rank", F.dense_rank, "dense_rank")):
    op(_row, _name, _win(f"({_sql}() OVER ({_BYP}))::BIGINT"))((lambda f: lambda s, d: table(s, d, "orders").select("o_orderkey", f().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("v")))(_f))
op(89, "lead", _win(f"lead(o_orderkey, 2, -1::BIGINT) OVER ({_PO})"))(_over(lambda w: F.lead("o_orderkey", 2, -1).over(w)))
op(90, "lag", _win(f"lag(o_orderkey) OVER ({_PO})"))(_over(lambda w: F.lag("o_orderkey").over(w)))


@op(891, "lead_by_column", f"SELECT o_orderkey, lead(o_orderkey, (o_orderkey % 3)::INT, -1::BIGINT) OVER ({_PO}) AS v FROM orders")
def _(s, d):
    return windows.shifted(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey", (c("o_orderkey") % 3).cast("int"), F.lit(-1).cast("long"), "v").select("o_orderkey", "v")


op(91, "first_value", _win(f"first_value(o_totalprice) OVER ({_PO} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))(_over(lambda w: F.first_value("o_totalprice").over(w.rowsBetween(-1, 1))))
op(92, "last_value", _win(f"last_value(o_totalprice) OVER ({_PO} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))(_over(lambda w: F.last_value("o_totalprice").over(w.rowsBetween(-1, 1))))
op(93, "aggregates_over_frame", _win(f"round(avg(o_totalprice) OVER ({_PO} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4)"))(_over(lambda w: F.round(F.avg("o_totalprice").over(w.rowsBetween(-3, 0)), 4)))
op(94, "rows_frame", _win(f"count(*) OVER ({_PO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))(_over(lambda w: F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))))
op(95, "range_frame", _win(f"count(*) OVER ({_PO} RANGE BETWEEN 500 PRECEDING AND 200 FOLLOWING)"))(_over(lambda w: F.count(F.lit(1)).over(w.rangeBetween(-500, 200))))
op(96, "groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM orders")(lambda s, d: windows.groups_frame(table(s, d, "orders"), ["o_custkey"], "o_orderpriority", F.count(F.lit(1)), 1, 0, "v").select("o_orderkey", "v"))
op(97, "default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS v FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.count(F.lit(1)).over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("v")))
op(98, "ntile_and_others", f"SELECT o_orderkey, round(cume_dist() OVER ({_PO}), 6) AS cd, round(percent_rank() OVER ({_PO}), 6) AS pr, (ntile(3) OVER ({_PO}))::BIGINT AS nt, nth_value(o_orderkey, 2) OVER ({_PO}) AS nv FROM orders")(
    lambda s, d: (lambda w: table(s, d, "orders").select("o_orderkey", F.round(F.cume_dist().over(w), 6).alias("cd"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.ntile(3).over(w).cast("long").alias("nt"), F.nth_value("o_orderkey", 2).over(w).alias("nv")))(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
)

# --- sorts and limits

op(99, "top_n", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 25")(lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderpriority"), "o_totalprice", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority"))
op(100, "merge_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice"))
op(101, "limit", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 37)")(lambda s, d: table(s, d, "orders").limit(37).agg(F.count(F.lit(1)).alias("n")))
op(102, "limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")(lambda s, d: table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(20).limit(10))
op(103, "limit_by", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")(lambda s, d: windows.limit_by(table(s, d, "orders"), 2, ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")]).select("o_custkey", "o_orderkey"))
op(104, "sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5('5:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT < 0.1 * 4294967296")(lambda s, d: sinks.sampled(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], 0.1, 5).select("l_orderkey", "l_linenumber"))

# --- sets

op(105, "union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")(lambda s, d: table(s, d, "nation").select(c("n_nationkey").alias("k")).union(table(s, d, "region").select("r_regionkey")))
op(106, "union_below_join", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY k")(
    lambda s, d: table(s, d, "customer").select(c("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).join(table(s, d, "nation"), c("k") == c("n_nationkey")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
)
op(1061, "union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(lambda s, d: table(s, d, "customer").select(c("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct())
op(107, "intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")(lambda s, d: table(s, d, "customer").select(c("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")))
op(1071, "except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")(lambda s, d: table(s, d, "customer").select(c("c_nationkey").alias("k")).exceptAll(table(s, d, "supplier").select("s_nationkey")))
op(108, "cte", "WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT count(*) AS n FROM a WHERE o_totalprice > (SELECT avg(o_totalprice) FROM a)")(
    lambda s, d: (table(s, d, "orders").createOrReplaceTempView("shared_orders"), s.sql("WITH a AS (SELECT * FROM shared_orders WHERE o_orderstatus = 'F') SELECT count(*) AS n FROM a WHERE o_totalprice > (SELECT avg(o_totalprice) FROM a)"))[1]
)

# --- streams, user functions, statements

op(109, "tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: streams.run(s, streams.tumbling(streams.source(s, d), "1 hour"), "complete"))
op(1091, "sliding_windows", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")(lambda s, d: streams.run(s, streams.sliding(streams.source(s, d), "2 hours", "1 hour"), "complete"))
op(1092, "session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k")(lambda s, d: streams.run(s, streams.sessions(streams.source(s, d), "30 minutes"), "complete"))
op(1093, "streaming_distinct", "SELECT DISTINCT user_id, event_type FROM events")(lambda s, d: streams.run(s, streams.source(s, d).select("user_id", "event_type").dropDuplicates(), "append"))
op(1094, "stateful_operator", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")(lambda s, d: streams.run(s, streams.totals(streams.source(s, d)), "update", ("user_id",)))


@op(110, "change_ingestion", "SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(s, d):
    path = scratch(s, "changes")
    counted = streams.source(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn(versioned.DELETED, F.lit(False))
    streams.drain(counted.writeStream.outputMode("update").foreachBatch(versioned.upsert(path, "user_id")), s)
    return versioned.snapshot(s.read.parquet(path).drop("batch"), "user_id")


@op(111, "user_functions", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _(s, d):
    twice = F.pandas_udf(lambda x: x * 2 + 1, "long")
    return table(s, d, "part").select("p_partkey", twice("p_size").alias("v"))


op(112, "array_functions", "SELECT vec_id, list_max(embedding)::DOUBLE AS top, len(embedding)::BIGINT AS n FROM embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("top"), F.size("embedding").cast("long").alias("n")))
op(113, "sql_text", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")(lambda s, d: s.sql("SELECT n_regionkey, count(*) AS n FROM {t} GROUP BY 1", t=table(s, d, "nation")))
op(114, "service_surface", "SELECT 1 AS id, 3::BIGINT AS n, '' AS error UNION ALL SELECT 2, 0, 'TABLE_OR_VIEW_NOT_FOUND' UNION ALL SELECT 3, 5, '' UNION ALL SELECT 4, 0, 'PARSE_SYNTAX_ERROR'")(
    lambda s, d: service.answers(s, d, [(1, "SELECT r_regionkey FROM {region} WHERE r_regionkey > 1"), (2, "SELECT * FROM nowhere"), (3, "SELECT r_regionkey, count(*) FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY 1"), (4, "SELEC 1")])
)



@op(115, "compaction", f"SELECT c_custkey, {_BAL} AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def _(s, d):
    path = scratch(s, "compact")
    versioned.compact(_versions(s, d), "c_custkey", path, 4)
    return versioned.snapshot(s.read.parquet(path), "c_custkey")


@op(116, "mock_tables", "SELECT 1 AS b UNION ALL SELECT 2")
def _(s, d):
    s.createDataFrame([(1, "x"), (2, "y")], "a int, gone string").createOrReplaceTempView("mock_table")
    return s.table("mock_table").drop("gone").withColumnRenamed("a", "b")
