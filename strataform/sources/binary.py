"""Rows and blocks in binary: RowBinary, value after value, and Native, blocks of columns with their names and types.

Numbers are little-endian, a string is its length as a variable-length number and its bytes, a date the days
since 1970 in 16 bits. A column that may be null has a byte before each value (RowBinary) or a byte for each row
before its values (Native): 1 for null. Tasks write a file each, by rename; files are read one to a row.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strataform.storage import make_folder, put

#: Type names and layouts by Spark's names.
TYPES = {"tinyint": ("Int8", "<i1"), "smallint": ("Int16", "<i2"), "int": ("Int32", "<i4"), "bigint": ("Int64", "<i8"), "float": ("Float32", "<f4"), "double": ("Float64", "<f8"), "boolean": ("UInt8", "<u1"), "date": ("Date", "<u2"), "string": ("String", None), "binary": ("String", None)}
EPOCH = datetime.date(1970, 1, 1)


def _kinds(schema: StructType) -> list[tuple[str, str, bool]]:
    """Name, Spark's type, and whether it may be null."""
    wrong = [f.name for f in schema if f.dataType.simpleString() not in TYPES]
    if wrong:
        raise ValueError(f"no binary layout for {wrong}")
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in schema]


def _length(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _text(value) -> bytes:
    raw = value.encode() if isinstance(value, str) else bytes(value)
    return _length(len(raw)) + raw


def _cells(column: pa.Array, kind: str) -> list[bytes]:
    """The bytes of each value; a null's are those of a zero or an empty string."""
    layout = TYPES[kind][1]
    if layout is None:
        return [_text(x or "") for x in column.to_pylist()]
    values = column.to_pylist()
    if kind == "date":
        values = [0 if x is None else (x - EPOCH).days for x in values]
    raw = np.array([0 if x is None else x for x in values], layout)
    return [raw[i : i + 1].tobytes() for i in range(len(raw))]


def _row_binary(batch: pa.RecordBatch, kinds) -> bytes:
    columns = []
    for column, (_, kind, nullable) in zip(batch.columns, kinds, strict=True):
        cells = _cells(column, kind)
        if nullable:
            cells = [b"\1" if null else b"\0" + cell for cell, null in zip(cells, column.is_null().to_pylist(), strict=True)]
        columns.append(cells)
    return b"".join(cell for row in zip(*columns, strict=True) for cell in row)


def _native(batch: pa.RecordBatch, kinds) -> bytes:
    parts = [_length(len(kinds)), _length(batch.num_rows)]
    for column, (name, kind, nullable) in zip(batch.columns, kinds, strict=True):
        of = TYPES[kind][0]
        parts += [_text(name), _text(f"Nullable({of})" if nullable else of)]
        if nullable:
            parts.append(bytes(column.is_null().to_pylist()))
        parts += _cells(column, kind)
    return b"".join(parts)


class Reader:
    """Goes through the bytes of a file."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def length(self) -> int:
        n = shift = 0
        while True:
            byte = self.raw[self.at]
            self.at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    def bytes(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a file ends within a value")
        self.at += n
        return out

    def text(self) -> bytes:
        return self.bytes(self.length())

    def value(self, kind: str):
        layout = TYPES[kind][1]
        if layout is None:
            return _read(self.text(), kind)
        return _read(struct.unpack("<" + {"i1": "b", "i2": "h", "i4": "i", "i8": "q", "f4": "f", "f8": "d", "u1": "B", "u2": "H"}[layout[1:]], self.bytes(int(layout[2:])))[0], kind)


def _read(value, kind: str):
    if kind == "date":
        return EPOCH + datetime.timedelta(days=int(value))
    return value.decode() if kind == "string" else bool(value) if kind == "boolean" else value


def _read_rows(raw: bytes, kinds) -> Iterator[list[list]]:
    reader, columns = Reader(raw), [[] for _ in kinds]
    while reader.at < len(raw):
        for column, (_, kind, nullable) in zip(columns, kinds, strict=True):
            column.append(None if nullable and reader.bytes(1) == b"\1" else reader.value(kind))
        if len(columns[0]) == 10_000:
            yield columns
            columns = [[] for _ in kinds]
    yield columns


def _read_blocks(raw: bytes, kinds) -> Iterator[list[list]]:
    """Columns are found by name; those that aren't asked for are passed over."""
    reader, by_type = Reader(raw), {of: kind for kind, (of, _) in TYPES.items() if kind not in ("binary", "boolean")}
    by_type["UInt8"] = "boolean"
    while reader.at < len(raw):
        n_columns, rows = reader.length(), reader.length()
        found = {}
        for _ in range(n_columns):
            name, of = reader.text().decode(), reader.text().decode()
            nulls = reader.bytes(rows) if of.startswith("Nullable(") else bytes(rows)
            kind = dict((k, v) for k, v, _ in kinds).get(name) or by_type[of.removeprefix("Nullable(").rstrip(")")]
            if TYPES[kind][1] is None:
                values = [_read(reader.text(), kind) for _ in range(rows)]
            else:
                layout = np.dtype(TYPES[kind][1])
                values = [_read(x, kind) for x in np.frombuffer(reader.bytes(rows * layout.itemsize), layout).tolist()]
            found[name] = [None if null else x for x, null in zip(values, nulls, strict=True)]
        yield [found[name] for name, _, _ in kinds]


WRITERS = {"RowBinary": (_row_binary, _read_rows), "Native": (_native, _read_blocks)}


def write(df: DataFrame, path: str, name: str) -> None:
    kinds, encode = _kinds(df.schema), WRITERS[name][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0

        def parts():
            nonlocal rows
            for batch in batches:
                if batch.num_rows:
                    rows += batch.num_rows
                    yield encode(batch, kinds)

        put(f"{path}/part-{TaskContext.get().partitionId():06d}.bin", parts())
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.mapInArrow(run, "rows long").agg({"rows": "sum"}).collect()
    make_folder(df.sparkSession, path)  # where there was no task


def read(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """Files are read whole, so they are as large as a task's share of what was written."""
    kinds, decode = _kinds(schema), WRITERS[name][1]
    names = [k for k, _, _ in kinds]
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for columns in decode(raw.as_py(), kinds):
                    yield pa.RecordBatch.from_arrays([pa.array(c, arrow[kind]) for c, (_, kind, _) in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("content")
    return files.mapInArrow(run, schema)
