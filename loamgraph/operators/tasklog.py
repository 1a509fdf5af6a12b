"""Task entities over a versioned event log: projections, gaps, permissions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, *values: str) -> DataFrame:
    """``(ari, version, values...)``: the highest version of each entity."""
    best = F.max(F.struct("version", *values)).alias("b")
    return log.groupBy("ari").agg(best).select("ari", "b.version", *[f"b.{v}" for v in values])


def check_writes(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Optimistic versions: ``writes(ari, seq, expected_version)`` -> APPLIED, CONFLICT or NOT_FOUND; the first fitting write wins."""
    out = writes.join(current.select("ari", F.col("version").alias("now")), "ari", "left")
    fits = F.col("now") == F.col("expected_version")
    first = F.min(F.when(fits, F.col("seq"))).over(Window.partitionBy("ari"))
    return out.select("ari", "seq", F.when(F.col("now").isNull(), "NOT_FOUND").when(F.col("seq") == first, "APPLIED").otherwise("CONFLICT").alias("outcome"))


def consume(log: DataFrame, held: Column | None = None) -> DataFrame:
    """``(ari, version, action)`` for events in order: APPLY the next one, REFETCH over a gap; repeats drop.

    ``held`` is the version that the consumer has, 0 if none.
    """
    held = F.lit(0) if held is None else held
    once = log.dropDuplicates(["ari", "version"]).where(F.col("version") > held)
    before = F.coalesce(F.lag("version").over(Window.partitionBy("ari").orderBy("version")), held)
    return once.select("ari", "version", F.when(F.col("version") == before + 1, "APPLY").otherwise("REFETCH").alias("action"))


def my_tasks(tasks: DataFrame, assignee: str, limit: int) -> DataFrame:
    """One person's tasks by category, due date (none last) and id."""
    return tasks.where(F.col("assignee") == assignee).orderBy("category", F.asc_nulls_last("due"), "ari").limit(limit)


def permitted(placements: DataFrame, grants: DataFrame, principals: list[str]) -> DataFrame:
    """Entities seen through any container: ``placements(ari, container)``, ``grants(container, principal)``.

    Permission is decided once per distinct container.
    """
    open_containers = grants.where(F.col("principal").isin(principals)).select("container").distinct()
    return placements.join(open_containers, "container", "left_semi").select("ari").distinct()


def merge_patches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concurrent patches ``(ari, fields)``: disjoint fields merge, shared ones conflict."""
    both = a.select("ari", F.col("fields").alias("fa")).join(b.select("ari", F.col("fields").alias("fb")), "ari")
    shared = F.array_sort(F.array_intersect("fa", "fb"))
    return both.select("ari", F.when(F.size(shared) > 0, "CONFLICT").otherwise("MERGED").alias("outcome"), F.array_join(shared, ",").alias("shared"))


def lifecycle(placements: DataFrame) -> DataFrame:
    """``(ari, active, deleted)``: soft-deleted once no container is active."""
    n = placements.groupBy("ari").agg(F.count_if(F.col("active")).alias("active"))
    return n.withColumn("deleted", F.col("active") == 0)
