"""Search over text and vectors: stored postings with BM25, exact nearest neighbours, and an index of lists around centres."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strataform.functions.nested import cosine, dot, l2
from strataform.operators.joins import sized
from strataform.storage import get, put, work_dir, written

K1, B = 1.2, 0.75
METRICS = {"l2": l2, "cosine": cosine, "inner": lambda v, w: -dot(v, w)}


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, doc, tf, length``. Words of letters and digits in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc"), words.alias("w")).select("doc", F.size("w").alias("length"), F.explode("w").alias("term"))
    return rows.groupBy("term", "doc", "length").agg(F.count(F.lit(1)).alias("tf"))


def nearest(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], metric: str, k: int) -> DataFrame:
    """Exact: a distance for each row, and a top-k that keeps k rows in a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), F.round(METRICS[metric](F.col(vec_col), q), 6).alias("distance")).orderBy("distance", "id").limit(k)


@dataclass
class Lists:
    """An index of vectors: its folder, and the centres of its lists. Rows of a list are a folder of their own."""

    path: str
    centres: np.ndarray
    schema: StructType


def build_lists(vectors: DataFrame, id_col: str, vec_col: str, path: str, lists: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> Lists:
    """Every row is filed under its nearest centre. Centres are fitted to a bounded sample, the rows with the least
    hashes of their identifiers, on the driver; rows without a vector are left out."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    some = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("v").toArrow().column(0).to_pylist()
    points = np.array(some, float)
    if not len(points):
        centres = np.zeros((1, 0))
    else:
        r = np.random.default_rng(seed)
        centres = points[r.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(rounds):
            near = _nearest_centres(points, centres, 1)[:, 0]
            counts = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    filed = rows.withColumn("list", F.pandas_udf(lambda v: pd.Series(_nearest_centres(np.stack(v.to_numpy()), centres, 1)[:, 0]), "int")("v"))
    filed.repartition("list").write.partitionBy("list").parquet(path)
    return Lists(path, centres, rows.schema)


def _nearest_centres(points: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    distance = (centres * centres).sum(1)[None, :] - 2 * points @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :k].astype(np.int32)


#: Queries that meet a batch of rows at once, and queries of one stored file.
ASKED, ASKED_FILE = 256, 4096


def lists_nearest(spark: SparkSession, index: Lists, queries: DataFrame, query_id: str, query_vec: str, k: int, probes: int = 40) -> DataFrame:
    """``query, id, distance``: the k nearest of each query among the lists around its nearest centres.

    Lists that no query probes aren't read. How many lists must be probed for a recall hangs on the data: 40 of 64 give
    0.95 for directions at random, which have no clusters at all.
    """
    centres = index.centres
    nearest = F.pandas_udf(lambda v: pd.Series(list(_nearest_centres(np.stack(v.to_numpy()), centres, probes))), "array<int>")
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("q"))
    asked = written(asked.withColumn("lists", nearest("q")), "asked")
    probed = [r.list for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]  # of the index's lists
    rows = spark.read.schema(StructType([*index.schema.fields, StructField("list", IntegerType())])).parquet(index.path)
    return _nearest_of_each(rows.where(F.col("list").isin(probed)), asked, k)


def exact_nearest(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str, k: int) -> DataFrame:
    """``query, id, distance`` by brute force, for a stated set of queries against all rows."""
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("q"))
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return _nearest_of_each(rows, asked, k)


def _nearest_of_each(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k rows ``id, v`` with the least distances from each of ``query, q``, to six places and then by ``id``. Rows with
    a ``list`` meet the queries that have it among their ``lists``.

    Every pair is compared, as products of matrices: queries are stored in files, and each task brings them, some at a
    time, to its rows, a batch at a time. Of a batch, and of its lists, k rows of a query leave. Vectors of other lengths
    don't meet, and those with missing elements have no distance.
    """
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession, "asked")
    listed = "list" in rows.columns

    def store(batches):
        out = pa.BufferOutputStream()
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        with pa.ipc.new_stream(out, whole.schema) as stream:
            stream.write_table(whole.combine_chunks(), max_chunksize=ASKED)
        path = f"{folder}/{TaskContext.get().partitionId()}"
        put(path, [out.getvalue()])
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    files = asked.repartition(asked.count() // ASKED_FILE + 1, "query").mapInArrow(store, "path string").collect()
    paths = sorted(r.path for r in files)

    def meet(batches):
        for batch in batches:
            ids, parts = batch.column("id"), []
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            for at, points in _matrices(batch.column("v")):
                of = batch.column("list").to_numpy()[at] if listed else np.zeros(len(at), int)
                parts += [(one, at[of == one], points[of == one]) for one in np.unique(of)]
            for path in paths if parts else []:
                for some in pa.ipc.open_stream(pa.py_buffer(get(path))):
                    lists = np.array(some.column("lists").to_pylist()) if listed else None
                    for mine, vectors in _matrices(some.column("q")):
                        for one, at, points in parts:
                            if points.shape[1] != vectors.shape[1]:
                                continue
                            which = np.flatnonzero((lists[mine] == one).any(1)) if listed else np.arange(len(mine))
                            if len(which):
                                q, p, distance = _closest(vectors[which], points, rank[at], k)
                                yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(mine[which][q])), ids.take(pa.array(at[p])), pa.array(distance)], ["query", "id", "distance"])

    keys = ["list", "id"] if listed else ["id"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    met = dealt.mapInArrow(meet, StructType([asked.schema["query"], rows.schema["id"], StructField("distance", DoubleType())]))
    first = Window.partitionBy("query").orderBy("distance", "id")
    return met.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k).drop("rn")


def _matrices(vectors: pa.Array):
    """Vectors of each length, without those that have missing elements: their places, and a matrix."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
    flat = vectors.flatten()
    if flat.null_count:
        lengths[pc.list_parent_indices(vectors).filter(flat.is_null()).to_numpy()] = -1
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)


def _closest(asked: np.ndarray, points: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k points with the least distances, to six places and then by rank: the places of both, and the distances.

    Squares from a product of matrices say which pairs may be among them, ties included; only these are measured.
    """
    with np.errstate(all="ignore"):
        a, b = (asked * asked).sum(1), (points * points).sum(1)
        squares = a[:, None] + b[None, :] - 2 * (asked @ points.T)
        if len(points) > k:
            error = 1e-12 * (a + b.max())
            last = np.partition(squares, k - 1, axis=1)[:, k - 1]
            most = (np.sqrt(np.maximum(last, 0) + error) + 2e-6) ** 2 + error
            q, p = np.nonzero(~(squares > most[:, None]))
        else:
            q, p = (x.ravel() for x in np.indices(squares.shape))
        distance = np.empty(len(q))
        for at in range(0, len(q), 65536):
            some = slice(at, at + 65536)
            distance[some] = np.sqrt(((points[p[some]] - asked[q[some]]) ** 2).sum(1))
        distance = np.where(distance < 1e9, np.floor(distance * 1e6 + 0.5) / 1e6, distance)
    order = np.lexsort((rank[p], distance, q))
    q, p, distance = q[order], p[order], distance[order]
    mine = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[mine], p[mine], distance[mine]


#: Folders of stored postings.
BUCKETS = 64


def store_postings(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Postings by buckets of terms, sorted, and what BM25 needs of the corpus: one scan of the documents, one of postings."""
    found = written(postings(docs, id_col, text_col), "postings")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    found.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths = found.groupBy("doc").agg(F.max("length").alias("length")).agg(F.sum("length").alias("words"))
    docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(lengths).write.parquet(f"{path}/corpus")  # one row each


def bm25_stored(spark: SparkSession, path: str, terms: list[str], k: int) -> DataFrame:
    """The k best documents, from the postings of the terms alone: their buckets' folders and rows are all that is read."""
    terms = sorted(set(terms))
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b")).collect()]
    corpus = spark.read.parquet(f"{path}/corpus").select("n", (F.col("words") / F.col("n")).alias("mean"))
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # a row for each term, and one
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("doc").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


#: Rows that a task sorts or writes, about: the number of tasks grows with the rows.
ROWS = 500_000


def in_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by ranges of keys, so that a range has ``ROWS`` or so at most; Spark may only join the ranges of so few rows."""
    n = rows.count()
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(*keys) if n <= ROWS else rows.repartitionByRange(max(session, n // ROWS + 1), *keys)


def store_inverted(path: str, column: str, index: str, spark: SparkSession) -> None:
    """Where each value of a column of stored files is: values in order, with file and row number."""
    rows = spark.read.parquet(path).select(F.col(column).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    in_ranges(rows.where("value IS NOT NULL"), "value", "file", "row").sortWithinPartitions("value").write.parquet(index)


def read_inverted(spark: SparkSession, path: str, index: str, values: list) -> DataFrame:
    """The rows of stored files that have one of the values: the index is filtered in its scan, and only files that it
    names are read, at the rows that it names."""
    places = spark.read.parquet(index).where(F.col("value").isin(values)).select("file", "row")
    files = [r.file for r in places.select("file").distinct().collect()]  # of a table's files
    if not files:
        return spark.read.parquet(path).limit(0)
    rows = spark.read.parquet(*files)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return rows.select("*", *place).join(sized(places), (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row")), "left_semi").drop("_file", "_row")
