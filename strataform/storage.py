"""Results that are read more than once, and whole files, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the application ends.

    The folder is what ``spark.checkpoint.dir`` names. Only where a session names none (tests on one
    machine) is one made, and set for the whole session.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="strataform-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage is cut, and losing executors loses nothing."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Schemes that Spark and Arrow name differently, and stores whose files appear when they are complete.
ALIASES = {"s3a://": "s3://", "s3n://": "s3://"}
OBJECT_STORES = ("s3a://", "s3n://", "s3://", "gs://", "abfs://", "abfss://")


def _store(path: str):
    from pyarrow import fs

    for spark_name, arrow_name in ALIASES.items():
        path = path.replace(spark_name, arrow_name, 1) if path.startswith(spark_name) else path
    return fs.FileSystem.from_uri(path)


def put(path: str, parts) -> None:
    """Writes a file of the shared folder, so that a retried task leaves whole files only.

    By a temporary name and a rename; in object stores, where a file appears when it is complete, at once.
    """
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{local}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(draft, local)
        return
    store, name = _store(path)
    whole = path.startswith(OBJECT_STORES)
    draft = name if whole else f"{name}.{uuid.uuid4().hex}"
    if not whole:
        store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    if not whole:
        store.move(draft, name)


def get(path: str):
    """The bytes of a file as a numpy array: mapped where the file is in a mounted folder, read elsewhere."""
    import numpy as np

    local = _local(path)
    if local:
        return np.memmap(local, np.uint8, "r").view(np.ndarray) if os.path.getsize(local) else np.zeros(0, np.uint8)
    store, name = _store(path)
    with store.open_input_stream(name) as f:
        return np.frombuffer(f.read(), np.uint8)


def _local(path: str) -> str:
    return path.split(":", 1)[1].replace("//", "", 1) if path.startswith("file:") else "" if "://" in path else path
