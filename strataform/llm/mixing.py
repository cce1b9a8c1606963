"""Mixing sources to target weights: repetition rates from word counts, then whole copies and one seeded draw.

Sizes are summed for each source; targets follow from weights and a limit on repetition; a document is
taken floor(rate) times, and once more when a hash of the seed and the document falls below the rest. Rows that
are alike in identifier, source and text are numbered, and draw by their number too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.common import WORD, partitions, written

#: So many sources, or rows of few bytes, are broadcast at most; beyond, they are joined by a shuffle that can split a hot source.
BROADCAST_SOURCES = 100_000
#: Hexadecimal digits of the digest that make the draw: 52 bits, which a double holds exactly.
DIGITS = 13


def words(text_col: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def _before(df: DataFrame, by: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over all rows before each in an order, however many rows there are.

    A range for each task, whose sums are few; then the sum within the range.
    """
    ranges = written(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn("range", F.spark_partition_id()), "ranges")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    totals = ranges.groupBy("range").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()])
    totals = totals.select("range", *[F.coalesce(F.sum(f"{k}_all").over(whole), F.lit(0)).alias(f"{k}_all") for k in sums])
    inside = Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    both = ranges.join(F.broadcast(totals), "range")
    return both.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{k}_all")).alias(k) for k, c in sums.items()])


def source_targets(df: DataFrame, source_col: str, text_col: str, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """``source, source_size, target``, one row for each source, null being one.

    Sources in code-point order, null last, take the weights in turn. Shares are of all words. No target is
    above ``max_repeat`` times its source's size: what is cut off goes to the others by weight, again and again.
    In the order of size by weight, those that are cut come first; so the level at which the rest shares what is
    left follows from sums over the sources before each.
    """
    sizes = df.select(F.col(source_col).alias("source"), words(text_col).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _before(sizes, [F.asc_nulls_last("source")], {"rank": F.lit(1).cast("long")})
    turn = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * max_repeat)
    ranked = written(ranked.withColumn("level", F.col("cap") / F.col("weight")), "source-ranks")
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    steps = _before(ranked, [F.col("level"), F.col("rank")], {"cut": F.col("cap"), "done": F.col("weight")})
    steps = steps.withColumn("share", (F.lit(total) - F.col("cut")).cast("double") / (F.lit(weight) - F.col("done")).cast("double"))
    open_ = steps.where(F.col("cap") > F.col("weight") * F.col("share"))
    share = open_.agg(F.min_by("share", F.struct("level", "rank"))).first()[0] or 0.0
    target = F.when(F.col("cap") <= F.col("weight") * share, F.col("cap").cast("double")).otherwise(F.col("weight") * share)
    return ranked.select("source", "source_size", target.alias("target"))


def label_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 42,
    payload: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for each row of ``df``, and ``row`` with ``payload``.

    A null text has size 0 and is taken as often as others of its source; a null source is a source. A source
    without words has target 0 and rate 0. The draw hangs on the seed and on the row's identifier, text and
    source; rows that have these in common, null ones too, are numbered from 0 and draw apart. So reruns and
    retried tasks agree, up to which of such rows is which.
    """
    targets = source_targets(df, source_col, text_col, weights, max_repeat)
    few = targets.count() <= BROADCAST_SOURCES
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        words(text_col).alias("size"),
        F.col(source_col).alias("source"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if payload else []),
    )
    rows = _numbered(rows, df.select(F.col(id_col).alias("doc_id")))
    targets = targets.withColumnRenamed("source", "of")
    joined = rows.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", F.when(F.col("nth") > 0, F.col("nth").cast("string")))
    draw = F.conv(F.substring(F.md5(named.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    out = joined.withColumn("rate", rate).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken", *(["row"] if payload else []))


def _numbered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, the number of a row among those alike in identifier, source and text.

    Only rows whose identifier is null or repeated are looked at. They are numbered by partition, then the
    partitions are: no task has more rows of a kind than one task of the input.
    """
    repeated = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    repeated = written(repeated, "repeated-ids")
    n = repeated.count()
    if not n:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    repeated, same = F.broadcast(repeated) if n <= BROADCAST_SOURCES else repeated, F.col("doc_id").eqNullSafe(F.col("again"))
    once = rows.join(repeated, same, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    rows = written(rows.withColumn("part", F.spark_partition_id()).join(repeated, same, "left_semi"), "repeated-rows")
    kind = ["doc_id", "source", "digest", "part"]
    local = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*kind).orderBy(F.lit(1))) - 1)
    counts = rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("doc_id", "source", "digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"of_{c}") for c in kind], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    placed = local.join(counts, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in kind])
    return once.unionByName(placed.withColumn("nth", F.col("nth") + F.col("earlier")).select(*once.columns))


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns of ``df``."""
    labelled = label_mix(df, payload=True, **options).where("copies > 0")
    return labelled.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
