"""Streaming twins of the event-log operators.

Streams are at-least-once; results are exactly once because every step is
idempotent per micro-batch: repeats are dropped by key within a watermark (or by
a per-shard high-water mark where order is guaranteed), and a batch's output
folder is named by the batch id and overwritten when the batch is retried.
Sources and sinks are folders; ``sources.streams`` gives others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import trending as tr
from loamgraph.session import Scratch

LATE = "15 days"  # retention of daily buckets; nothing within it is dropped as late


def drain(stream: DataFrame, folder: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there and stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def keep_batches(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Each micro-batch in a folder of its own; ``batch`` orders them."""
    drain(stream, folder, mode, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return stream.sparkSession.read.schema(f"{stream_schema(stream)}, batch long").parquet(f"{folder}/out")


def stream_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def once(stream: DataFrame) -> DataFrame:
    """Repeats of (tenant, shard, seq) dropped while the watermark keeps their key."""
    return stream.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["tenant", "shard", "seq"])


def bucket_counts(stream: DataFrame, folder: str) -> DataFrame:
    """``(tenant, grain, bucket, tag, attaches)``; the newest batch's value of each counter stands."""
    counted = tr.activity(once(stream))
    key = ["tenant", "grain", "bucket", "tag"]
    return keep_batches(counted, folder, "update").groupBy(*key).agg(F.max_by("attaches", "batch").alias("attaches"))


def above_marks(stream: DataFrame, folder: str) -> DataFrame:
    """Ordered logs: events at or below the mark of their (tenant, shard) are skipped.

    The marks after each batch are a table, one row a shard; a batch is joined
    with those of the batch before, so no shard is gathered, and a batch that is
    run again overwrites what it wrote.
    """
    spark = stream.sparkSession
    marks_schema, out_schema = "tenant string, shard string, last_seq long", "tenant string, shard string, seq long, tag string"

    def each(df: DataFrame, n: int) -> None:
        marks = spark.read.schema(marks_schema).parquet(f"{folder}/marks/batch={n - 1}") if n else spark.createDataFrame([], marks_schema)
        tr.above_mark(df.select("tenant", "shard", "seq", "tag"), marks).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        fresh = spark.read.schema(out_schema).parquet(f"{folder}/out/batch={n}")
        reached = marks.unionByName(fresh.select("tenant", "shard", F.col("seq").alias("last_seq")))
        reached.groupBy("tenant", "shard").agg(F.max("last_seq").alias("last_seq")).write.mode("overwrite").parquet(f"{folder}/marks/batch={n}")

    drain(stream, folder, "append", each)
    return spark.read.schema(f"{out_schema}, batch int").parquet(f"{folder}/out").drop("batch")


def folded(stream: DataFrame, folder: str) -> DataFrame:
    """Index state: the last event of each (tenant, tag, entity) decides."""
    last = stream.groupBy("tenant", "tag", "entity").agg(F.max(F.struct("seq", "type")).alias("last"))
    newest = keep_batches(last, folder, "update").groupBy("tenant", "tag", "entity").agg(F.max("last").alias("last"))
    return newest.where("last.type = 'TAGS_ATTACHED'").select("tenant", "tag", "entity")


def relayed(stream: DataFrame, folder: str, gap_timeout: str) -> DataFrame:
    """``(seq, at)`` relayed so far: what waits behind a young gap is carried to the next batch."""
    spark = stream.sparkSession
    schema = stream_schema(stream.select("seq", "at"))

    def each(df: DataFrame, n: int) -> None:
        rows = df.select("seq", "at")
        if n:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/waiting/batch={n - 1}"))
        rows.distinct().write.mode("overwrite").parquet(f"{folder}/seen/batch={n}")
        rows = spark.read.schema(schema).parquet(f"{folder}/seen/batch={n}")
        judged = tr.relay_positions(rows, rows.agg(F.max("at")).scalar(), gap_timeout)
        judged.where("relayed").drop("relayed").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        judged.where("not relayed").drop("relayed").write.mode("overwrite").parquet(f"{folder}/waiting/batch={n}")

    drain(stream, folder, "append", each)
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out").select("seq", "at").distinct()


def folder_for(spark: SparkSession, what: str) -> str:
    return Scratch(spark, what).base
