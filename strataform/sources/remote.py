"""Tables that are somewhere else: replicas that stand in for one another, and object stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Reader options for stores whose listings lag: what vanishes between listing and reading is passed over, not fatal.
LENIENT = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "false"}
#: Retries and connections of Hadoop's client for S3; other stores ignore them.
CLIENT = {"fs.s3a.attempts.maximum": "10", "fs.s3a.retry.limit": "7", "fs.s3a.connection.maximum": "200", "fs.s3a.experimental.input.fadvise": "random"}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def from_replicas(spark: SparkSession, locations: list[str]) -> DataFrame:
    """A table from the first of its locations that is there."""
    for path in locations:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {locations}")


def object_store(spark: SparkSession, url: str, pattern: str = "*", schema=None) -> DataFrame:
    """Files of an object store that match a pattern, in folders of any depth. With a schema no footer is read to plan."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in CLIENT.items():
        conf.setIfUnset(key, value)
    reader = spark.read.options(**LENIENT, recursiveFileLookup="true", pathGlobFilter=pattern)
    return (reader.schema(schema) if schema is not None else reader).parquet(url)


def from_database(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options) -> DataFrame:
    """A table of another database over JDBC, in ranges of a key, each a query of its own; filters and columns are
    pushed into these queries."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, **options)
    return reader.load()
