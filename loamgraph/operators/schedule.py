"""Scheduling over a task table: claims, transitions, leases, statistics.

Tasks are ``(task_id, next_run, priority, state, job_type, pinned, version,
unit, amount, lease_until, submitter)``; a null unit means a one-time task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.recurrence import next_after_sql

FAR = 9_223_372_036_854_775_807
LIVE = ("SCHEDULED", "RUNNING", "BLACKLISTED")


def claimable(node: str, types: list[str]) -> Column:
    """Pinned to the node, or pinned to none and of a type it knows."""
    return (F.col("state") == "SCHEDULED") & F.when(F.col("pinned").isNull(), F.col("job_type").isin(types)).otherwise(F.col("pinned") == node)


def claim_due(tasks: DataFrame, node: str, types: list[str], now: Column, limit: int) -> DataFrame:
    """Due tasks by time, higher priority, id: a bounded heap, no full sort."""
    return tasks.where(claimable(node, types) & (F.col("next_run") <= now)).orderBy("next_run", F.desc("priority"), "task_id").limit(limit)


def next_due_ms(tasks: DataFrame, node: str, types: list[str]) -> DataFrame:
    return tasks.where(claimable(node, types)).agg(F.coalesce(F.unix_millis(F.min("next_run").cast("timestamp")), F.lit(FAR)).alias("next_due_ms"))


def finish(tasks: DataFrame, results: DataFrame, now: Column, max_timeouts: int, stopping: bool = False, shared: bool = True) -> DataFrame:
    """``(task_id, outcome_kind, new_state, timeouts, next)`` of finished runs.

    ``results(task_id, version, result, timeouts, removal)``; a result of a
    stale version changes nothing (STALE).
    """
    r = tasks.join(results.withColumnRenamed("version", "r_version"), "task_id")
    timed = F.col("result").isin("TIMED_OUT", "LEASE_EXPIRED")
    once = F.col("unit").isNull()
    n = F.when(once, F.col("timeouts")).when(timed, F.col("timeouts") + 1).otherwise(0)
    pinned = F.col("pinned").isNotNull()
    drop = F.coalesce(F.col("removal"), F.lit(False)) | (F.lit(stopping) & (F.lit(not shared) | pinned)) | ((F.col("result") == "LEASE_EXPIRED") & pinned)
    black = timed & (n >= max_timeouts)
    stale = F.col("version") != F.col("r_version")
    state = F.when(stale, F.col("state")).when(once, "COMPLETED").when(drop, "CANCELLED").when(black, "BLACKLISTED").otherwise("SCHEDULED")
    kind = F.when(stale, "STALE").when(once, F.when(timed, "TIMED_OUT").when(F.col("result") == "FAILED", "FAILED").otherwise("SUCCEEDED")).when(drop, "CANCELLED").when(black, "BLACKLISTED").otherwise("RESCHEDULED")
    nxt = F.when(kind == "RESCHEDULED", next_after_sql(now, F.col("unit"), F.col("amount"))).otherwise(F.col("next_run"))
    return r.select("task_id", kind.alias("outcome_kind"), state.alias("new_state"), n.cast("int").alias("timeouts"), nxt.alias("next"))


def consecutive_timeouts(runs: DataFrame) -> DataFrame:
    """``(task_id, run_no, streak)``: timeouts in a row up to each run (gaps and islands)."""
    w = Window.partitionBy("task_id").orderBy("run_no")
    bad = F.col("outcome") == "TIMED_OUT"
    island = runs.withColumn("g", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    return island.select("task_id", "run_no", F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy("task_id", "g").orderBy("run_no")).cast("int").alias("streak"))


def remove(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """``(task_id, removal)`` for asked ids: CANCELLED, DEFERRED, BLACKLIST_REMOVED or NOT_FOUND."""
    out = ids.select("task_id").distinct().join(tasks.select("task_id", "state"), "task_id", "left")
    kind = F.when(F.col("state") == "SCHEDULED", "CANCELLED").when(F.col("state") == "RUNNING", "DEFERRED").when(F.col("state") == "BLACKLISTED", "BLACKLIST_REMOVED").otherwise("NOT_FOUND")
    return out.select("task_id", kind.alias("removal"))


def expired_leases(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where((F.col("state") == "RUNNING") & (F.col("lease_until") < now)).select("task_id", "version", F.lit("LEASE_EXPIRED").alias("result"))


def reschedule(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """Tasks with the new time where they are scheduled; ``asked(task_id, at)``."""
    out = tasks.join(asked, "task_id")
    ok = F.col("state") == "SCHEDULED"
    return out.select("task_id", ok.alias("moved"), F.when(ok, F.col("at")).otherwise(F.col("next_run")).alias("next_run"))


def counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"))


def admit_submissions(live: DataFrame, asked: DataFrame, capacity: int) -> DataFrame:
    """``(task_id, accepted)`` in order of submission until the store is full.

    The cut is found by counting: only the number of free places travels.
    """
    free = live.agg(F.greatest(F.lit(0), F.lit(capacity) - F.count("*"))).scalar()
    block = F.floor(F.col("task_id") / F.lit(100_000))
    per = asked.groupBy(block.alias("b")).agg(F.count("*").alias("n"))
    before = per.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    placed = asked.select("task_id", block.alias("b")).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("task_id"))).join(before, "b")
    return placed.select("task_id", (F.col("r") + F.col("off") <= free).alias("accepted"))


def check_submission(specs: DataFrame, min_interval: Column) -> DataFrame:
    """``(task_id, verdict)``: timeouts are positive and shorter than the shortest interval."""
    verdict = F.when(F.col("timeout_ms") <= 0, "BAD_TIMEOUT").when(min_interval.isNotNull() & (F.col("timeout_ms") >= min_interval), "TIMEOUT_TOO_LONG").otherwise("OK")
    return specs.select("task_id", verdict.alias("verdict"))


def take_outcomes(outcomes: DataFrame, taken: DataFrame) -> DataFrame:
    """Outcomes not handed out before; each once per submitter."""
    return outcomes.dropDuplicates(["submitter", "task_id", "run_no"]).join(taken, ["submitter", "task_id", "run_no"], "left_anti")


def stats(tasks: DataFrame, runs: DataFrame, capacity: int) -> DataFrame:
    """Gauges of the store and counters of its runs in one row."""
    t = tasks.agg(F.count_if(F.col("state") == "SCHEDULED").alias("pending"), F.count_if(F.col("state") == "RUNNING").alias("running"), F.count_if(F.col("state") == "BLACKLISTED").alias("blacklisted"), F.count_if(F.col("state").isin(*LIVE)).alias("used"))
    r = runs.agg(F.count("*").alias("s"), F.count_if(F.col("outcome") == "SUCCEEDED").alias("c"), F.count_if(F.col("outcome") == "TIMED_OUT").alias("t"), F.count_if(F.col("outcome") == "FAILED").alias("f"))
    return t.select("*", F.lit(capacity).cast("long").alias("capacity"), (F.lit(capacity).cast("long") - F.col("used")).alias("remaining"), r.select("s").scalar().alias("executions"), r.select("c").scalar().alias("completed"), r.select("t").scalar().alias("timed_out"), r.select("f").scalar().alias("failed"))
