"""Trending: exactly-once bucket counts from an at-least-once log, and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAINS = (3600, 86400)
WINDOWS = {"24h": (3600, 24), "7d": (86400, 7)}


def once(log: DataFrame) -> DataFrame:
    """Each (tenant, shard, seq) once, however often and wherever it was delivered."""
    return log.dropDuplicates(["tenant", "shard", "seq"])


def above_mark(log: DataFrame, progress: DataFrame) -> DataFrame:
    """Events beyond the per-(tenant, shard) high-water mark; sequence numbers start at 1."""
    mark = progress.groupBy("tenant", "shard").agg(F.max("last_seq").alias("mark"))
    return once(log).join(mark, ["tenant", "shard"], "left").where(F.col("seq") > F.coalesce("mark", F.lit(0))).drop("mark")


def bucket(at: Column, grain: Column) -> Column:
    """Epoch-aligned UTC bucket number (floor, also before 1970)."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / (grain.cast("double") * 1e6)).cast("long")


def activity(log: DataFrame) -> DataFrame:
    """``(tenant, grain, bucket, tag, attaches)`` at both grains; detaching does not subtract."""
    on = log.where("type = 'TAGS_ATTACHED'").select("tenant", "tag", "at", F.explode(F.array(*[F.lit(g) for g in GRAINS])).alias("grain"))
    return on.groupBy("tenant", "grain", bucket(F.col("at"), F.col("grain")).alias("bucket"), "tag").agg(F.count("*").alias("attaches"))


def without_deleted(counts: DataFrame, deleted: DataFrame) -> DataFrame:
    """A deleted tag loses all its counters."""
    return counts.join(deleted.select("tenant", "tag").distinct(), ["tenant", "tag"], "left_anti")


def window_counts(counts: DataFrame, window: str, last_bucket: Column) -> DataFrame:
    """``(tenant, tag, cnt, prev)`` in the window ending with ``last_bucket`` and in the one before it."""
    grain, n = WINDOWS[window]
    rows = counts.where((F.col("grain") == grain) & (F.col("bucket") > last_bucket - 2 * n) & (F.col("bucket") <= last_bucket))
    now = F.col("bucket") > last_bucket - n
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("attaches"))), F.lit(0)).cast("long")
    return rows.groupBy("tenant", "tag").agg(total(now).alias("cnt"), total(~now).alias("prev"))


def top(windowed: DataFrame, rank: str, limit: int, live: DataFrame | None = None) -> DataFrame:
    """Top-N per tenant.  POPULAR: count, then tag; RISING: only rises, by rise, count, tag.

    Tags that are not live leave before the limit, so no over-fetching is needed.
    """
    rows = windowed if live is None else windowed.join(live.select("tenant", "tag").distinct(), ["tenant", "tag"], "left_semi")
    if rank == "POPULAR":
        rows, order = rows.where("cnt > 0"), [F.desc("cnt"), F.col("tag")]
    else:
        rows, order = rows.where("cnt > prev"), [F.desc(F.col("cnt") - F.col("prev")), F.desc("cnt"), F.col("tag")]
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("tenant").orderBy(*order)))
    return ranked.where(F.col("place") <= limit)


def prune(counts: DataFrame, grain: int, before: int | Column) -> DataFrame:
    return counts.where(~((F.col("grain") == grain) & (F.col("bucket") < before)))


def relay_positions(log: DataFrame, as_of: Column, gap_timeout: str) -> DataFrame:
    """Outbox order with gaps: ``(seq, at, relayed)``.

    The relay stops at the first gap younger than the timeout and skips aged
    ones; a gap's age is that of the event behind it.  Sequences are dense per
    log, so gaps are rare and the search for the first is one aggregate.
    """
    first = log.agg(F.min("seq")).scalar()
    order = Window.partitionBy(F.floor(F.col("seq") / F.lit(100_000))).orderBy("seq")
    keyed = log.groupBy("seq").agg(F.min("at").alias("at"))
    # a block's first row takes its predecessor from the block before, one row a block
    ends = keyed.groupBy((F.floor(F.col("seq") / F.lit(100_000)) + 1).alias("blk")).agg(F.max("seq").alias("end"))
    linked = keyed.withColumn("blk", F.floor(F.col("seq") / F.lit(100_000))).withColumn("prev", F.lag("seq").over(order)).join(ends, "blk", "left")
    linked = linked.withColumn("prev", F.coalesce("prev", "end"))
    young = (F.col("seq") != first) & ((F.col("prev").isNull()) | (F.col("prev") < F.col("seq") - 1)) & (F.col("at") > as_of - F.expr(f"interval {gap_timeout}"))
    stop = linked.where(young).agg(F.min("seq")).scalar()
    return keyed.select("seq", "at", (stop.isNull() | (F.col("seq") < stop)).alias("relayed"))


def fold_log(snapshot: DataFrame, log: DataFrame, snapshot_seq: Column) -> DataFrame:
    """State at the log's end: the snapshot taken at a sequence, then buffered events beyond it.

    ``snapshot(tenant, tag, entity)``; ``log(tenant, tag, entity, seq, type)``.  The last event per key decides.
    """
    late = log.where(F.col("seq") > snapshot_seq).select("tenant", "tag", "entity", "seq", "type")
    base = snapshot.select("tenant", "tag", "entity", F.lit(-1).cast("long").alias("seq"), F.lit("TAGS_ATTACHED").alias("type"))
    last = base.unionByName(late).groupBy("tenant", "tag", "entity").agg(F.max_by("type", "seq").alias("type"))
    return last.where("type = 'TAGS_ATTACHED'").drop("type")


def newest(rows: DataFrame, key: list[str], seq: str, *values: str) -> DataFrame:
    """Versioned cache: the value with the highest sequence of each key; a null value is a tombstone."""
    return rows.groupBy(*key).agg(F.max(seq).alias(seq), *[F.max_by(v, seq).alias(v) for v in values])


def signed_rows(log: DataFrame) -> DataFrame:
    """Analytics rows: +1 for an attached tag, -1 for a detached one."""
    return once(log).where("type in ('TAGS_ATTACHED', 'TAGS_DETACHED')").select("tenant", "tag", "at", F.when(F.col("type") == "TAGS_ATTACHED", 1).otherwise(-1).alias("delta"))


def outbox_lag(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the latest number, the latest relayed one and the time of the oldest row not yet relayed (``seq, at, relayed``)."""
    sent = F.coalesce(F.col("relayed"), F.lit(False))
    return log.groupBy(*keys).agg(F.max("seq").alias("latest_seq"), F.max(F.when(sent, F.col("seq"))).alias("relayed_seq"), F.min(F.when(~sent, F.col("at"))).alias("oldest_unrelayed"))


def prune_relayed(log: DataFrame, now: Column, keep: str) -> DataFrame:
    """The outbox without relayed rows older than ``keep``; rows not relayed stay whatever their age, as do undated ones."""
    old = F.col("at") < now - F.expr(f"interval {keep}")
    return log.where(~(F.coalesce(F.col("relayed"), F.lit(False)) & F.coalesce(old, F.lit(False))))


def prune_older(rows: DataFrame, at: str, now: Column, keep: str) -> DataFrame:
    """Idempotency records at least as young as ``keep``."""
    return rows.where(F.col(at) >= now - F.expr(f"interval {keep}"))
