"""Batch and stream connectors.

Folder-based connectors work anywhere.  JDBC and Kafka need their jars on the
cluster; they are plain option builders, so nothing is imported here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def folder_stream(spark: SparkSession, folder: str, schema: str, name: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``name`` picks files by glob."""
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table; with a numeric ``key`` it is read in ``parts`` ranges in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Key, value and position of a topic; ordered within a partition."""
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"} | options)
    return reader.load().selectExpr("cast(key as string) as key", "cast(value as string) as value", "topic", "partition", "offset", "timestamp")


def write_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    return stream.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}).start()


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Files as ``(path, modificationTime, length, content)``; files without a byte are left out, as the reader does."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def json_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def write_by_tenant(df: DataFrame, folder: str, key: str = "tenant_id", files_per_key: int = 1) -> None:
    """Parquet partitioned by tenant; hot tenants are spread over ``files_per_key`` writers."""
    from pyspark.sql import functions as F

    spread = df.repartition(key, F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(files_per_key)))
    spread.write.mode("overwrite").partitionBy(key).parquet(folder)
