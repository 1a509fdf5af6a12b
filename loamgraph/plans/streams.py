"""Streaming queries: they drain the event stream and are compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.plans.views import using
from loamgraph.sources.streams import EVENTS, folder_stream
from loamgraph.streaming import trends

Q: dict = {}
SQL: dict = {}


def _q(sql: str | None = None, views: str = ""):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = using(views, sql)
        return f

    return add


def _log(s, d) -> DataFrame:
    e = folder_stream(s, d, EVENTS, "events.parquet")
    kind = F.when(F.col("event_type") == "error", "TAGS_DETACHED").otherwise("TAGS_ATTACHED")
    return e.select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("s"), F.col("user_id") % 2).alias("shard"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant"), kind.alias("type"), F.concat("event_type", F.lit(":"), F.col("user_id") % 10).alias("tag"), F.col("ts").cast("timestamp").alias("at"))


def _redelivered(s, d) -> DataFrame:
    return _log(s, d).unionByName(_log(s, d).where("seq % 7 = 0"))


_ACT = "SELECT tenant, g AS grain, CAST(floor(epoch(at_time) / g) AS BIGINT) AS bucket, tag, count(*) AS attaches FROM tag_log, (SELECT unnest([3600, 86400]) AS g) WHERE type = 'TAGS_ATTACHED' GROUP BY ALL"


@_q(_ACT, "tag_log")
def t32_stream_counts(s, d):
    return trends.bucket_counts(_redelivered(s, d), trends.folder_for(s, "counts"))


@_q("SELECT tenant, shard, count(*) AS events, max(seq) AS last_seq FROM tag_log GROUP BY ALL", "tag_log")
def t31_stream_marks(s, d):
    kept = trends.above_marks(_redelivered(s, d), trends.folder_for(s, "marks"))
    return kept.groupBy("tenant", "shard").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


@_q("WITH ends AS (SELECT tenant, tag, seq % 20 AS entity, arg_max(type, seq) AS type FROM tag_log GROUP BY ALL) SELECT tenant, tag, entity FROM ends WHERE type = 'TAGS_ATTACHED'", "tag_log")
def t39_stream_index(s, d):
    log = _redelivered(s, d).withColumn("entity", F.col("seq") % 20)
    return trends.folded(log, trends.folder_for(s, "index"))


@_q(
    "WITH kept AS (SELECT seq, min(at_time) AS at_time FROM tag_log WHERE seq % 1000 <> 500 AND seq <> 9877 GROUP BY seq), gaps AS (SELECT seq, at_time, seq - lag(seq) OVER (ORDER BY seq) > 1 AS gap FROM kept), stop AS (SELECT min(seq) AS s FROM gaps WHERE gap AND at_time > (SELECT max(at_time) FROM kept) - INTERVAL 12 HOURS) SELECT seq FROM kept, stop WHERE s IS NULL OR seq < s",
    "tag_log",
)
def t30_stream_relay(s, d):
    return trends.relayed(_log(s, d).where("seq % 1000 <> 500 and seq <> 9877"), trends.folder_for(s, "relay"), "12 hours").select("seq")


QUERIES = Q
