"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised text by its first characters (whose order is that of their
bytes), then by a hash where many texts begin alike, so that splitters stay small whatever the texts. The sort
within each range (it spills to disk) places equal texts next to each other, and the window over a run of equals
compares neighbours in full.

A text with a large share of all rows would fill one range. Rows whose text's 64-bit hash counts more than
1 / (4 * partitions) of all rows carry a salt as a third splitter, so that such a text is sorted as several runs of
a bounded size, in the same sort; the few runs, a row each, are then merged and their results joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.common import partitions, written

#: Merged runs, texts included, are broadcast up to so many bytes; beyond, they are joined by a shuffle on text and salt.
BROADCAST_BYTES = 64 << 20
#: Characters of a text in a splitter.
HEAD = 32


def label_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    payload: bool = False,
) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep``: "smallest" or "largest", the identifier that stays of a group of equals. ``normalise`` maps the
    text column to what is compared; without it texts are compared as they are. With ``payload`` a column ``row``
    carries the whole input row as a struct, so that input columns of any name do no harm.

    A null text counts as empty. Null identifiers never win over others; a group of only nulls has a null
    keep_id. Of rows equal in text and identifier exactly one is kept. An empty table gives no rows.
    """
    spark = df.sparkSession
    n_out = partitions(spark)
    compared = F.coalesce(F.col(text_col), F.lit(""))
    compared = normalise(compared) if normalise else compared
    # A text that is compared as it is travels once: the row has only whether it is null.
    kept_columns = [(F.col(c).isNull() if c == text_col and not normalise else F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)]
    work = df.select(F.col(id_col).alias("doc_id"), compared.alias("key"), *([F.struct(*kept_columns).alias("row")] if payload else []))

    def finish(labelled: DataFrame) -> DataFrame:
        back = [F.when(~F.col(f"row.c{k}"), F.col("key")) if c == text_col and not normalise else F.col(f"row.c{k}") for k, c in enumerate(df.columns)]
        row = [F.struct(*[x.alias(c) for x, c in zip(back, df.columns, strict=True)]).alias("row")] if payload else []
        return labelled.select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.col("key").cast("binary"), 256).alias("text_sha256"), *row)

    total = df.count()
    least = max(1, total // (4 * n_out))
    counted = df.select(F.xxhash64(compared).alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    hot_hashes = [(r.tail, -(-r.n // least)) for r in counted.collect()]  # at most 4 * n_out + 3, each with its number of runs
    work = work.withColumn("head", F.substring("key", 1, HEAD)).withColumn("tail", F.xxhash64("key"))
    if not hot_hashes:
        return finish(_sorted(work, n_out, keep))
    hot = F.broadcast(spark.createDataFrame(hot_hashes, "tail long, runs long"))
    cold = _sorted(work.join(hot.select("tail"), "tail", "left_anti"), n_out, keep)
    # Rows of one identifier, null ones too, are told apart by their partition.
    salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("runs")).cast("int")
    runs = written(_sorted(work.join(hot, "tail").withColumn("salt", salt).drop("runs"), n_out, keep, "salt"), "hot-runs")
    return finish(cold.unionByName(_merged(runs, keep).drop("salt")))


def _sorted(rows: DataFrame, n_out: int, keep: str, *salt: str) -> DataFrame:
    """The sort, and what neighbours say: of each run of equal texts (and salts) the winner (``kept``), its id and the run's size.

    The window needs rows of a run together, which the range partitioning on parts of it gives: no second shuffle.
    """
    run = Window.partitionBy("head", "tail", *salt, "key")
    first = run.orderBy(F.desc_nulls_last("doc_id") if keep == "largest" else F.asc_nulls_last("doc_id"))
    return (
        rows.repartitionByRange(n_out, "head", "tail", *salt)
        .withColumn("rn", F.row_number().over(first))
        .withColumn("keep_id", (F.max if keep == "largest" else F.min)("doc_id").over(run))
        .withColumn("group_size", F.count(F.lit(1)).over(run))
        .withColumn("kept", F.col("rn") == 1)
        .drop("rn", "head")
    )


def _merged(runs: DataFrame, keep: str) -> DataFrame:
    """Rows of salted runs with the results of the whole text. One row for each run, of which there are few, is merged."""
    text = Window.partitionBy("tail", "key")
    first = text.orderBy(F.desc_nulls_last("keep_id") if keep == "largest" else F.asc_nulls_last("keep_id"), "salt")
    whole = runs.where("kept").select(
        "tail",
        "key",
        "salt",
        (F.row_number().over(first) == 1).alias("wins"),
        F.first("keep_id").over(first).alias("best"),
        F.sum("group_size").over(text).alias("size"),
    )
    whole = written(whole, "merged-runs")
    size = whole.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0)).alias("b")).first().b
    rows = runs.join(F.broadcast(whole) if size <= BROADCAST_BYTES else whole, ["tail", "salt", "key"])
    return rows.withColumn("keep_id", F.col("best")).withColumn("group_size", F.col("size")).withColumn("kept", F.col("kept") & F.col("wins")).drop("best", "size", "wins")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with its columns as they were."""
    return label_copies(df, id_col, text_col, keep, payload=True).where("kept").select("row.*")
