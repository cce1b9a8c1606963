"""Tables of row versions: (handle, version, delete mark) appended, newest read; snapshots, fast and raw reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import ship  # noqa: F401

VERSION, DELETED = "_version", "_deleted"


def versions_of(df: DataFrame, version, deleted) -> DataFrame:
    return df.withColumn(VERSION, version).withColumn(DELETED, deleted)


def snapshot(df: DataFrame, handle: str, at: int | None = None) -> DataFrame:
    """The newest version of each handle, up to a version if one is given, without deleted rows.

    A max_by aggregate: it combines map-side, so many versions of one handle meet as few rows.
    """
    rows = df if at is None else df.where(F.col(VERSION) <= at)
    newest = rows.groupBy(handle).agg(F.max_by(F.struct(*rows.columns), F.col(VERSION)).alias("r"))
    return newest.select("r.*").where(~F.col(DELETED)).drop(VERSION, DELETED)


def fast(df: DataFrame) -> DataFrame:
    """No version filter: rows that aren't delete marks."""
    return df.where(~F.col(DELETED)).drop(VERSION, DELETED)


def raw(df: DataFrame) -> DataFrame:
    return df


def upsert(path: str, handle: str):
    """A batch writer for a stream of changes: a folder of versions for each batch, which a retried one writes anew.
    Versions merge on read."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn(VERSION, F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def compact(df: DataFrame, handle: str, path: str, files: int) -> None:
    """Rewrites a table without superseded versions, ordered by handle in so many files."""
    current = snapshot(df, handle)
    versions_of(current, F.lit(0).cast("long"), F.lit(False)).repartitionByRange(files, handle).sortWithinPartitions(handle).write.mode("overwrite").parquet(path)
