"""Where results go: pages, wire blocks, stable samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataform.operators.windows import running_sums


def pages(df: DataFrame, order: list, size: int) -> DataFrame:
    """Rows with the number of the page that a client gets them on, by a sort that no single task makes."""
    numbered = running_sums(df.withColumn("_one", F.lit(1)), ["_one"], order, {"_nth": F.lit(1).cast("long")})
    return numbered.select(*df.columns, F.floor((F.col("_nth") - 1) / size).cast("long").alias("page"))


def to_wire(df: DataFrame) -> DataFrame:
    """``block``: rows as Arrow streams, one for each batch, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return df.mapInArrow(run, "block binary")


def from_wire(blocks: DataFrame, schema: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from pa.ipc.open_stream(block.as_buffer())

    return blocks.mapInArrow(run, schema)


def sampled(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """Rows by a hash of their keys: the same ones whatever the files and tasks are."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < share * 2**32)
