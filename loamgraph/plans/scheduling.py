"""Scheduler (s) and task abstraction (a) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.recurrence import min_interval_ms, next_after_sql, next_after_zoned
from loamgraph.operators import schedule as sc
from loamgraph.operators import tasklog as tl
from loamgraph.plans.views import using
from loamgraph.sources import domain
from loamgraph.sources.tables import table

Q: dict = {}
SQL: dict = {}


def _q(sql: str | None = None, views: str = "", recursive: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = using(views, sql, recursive) if views else sql
        return f

    return add


NOW = "(SELECT max(o_orderdate) - INTERVAL 30 DAYS FROM orders)"
_CLAIM = "state = 'SCHEDULED' AND CASE WHEN pinned IS NULL THEN job_type IN ('type1', 'type3') ELSE pinned = 'node1' END"


def _now(s, d):
    return table(s, d, "orders").agg(F.max("o_orderdate") - F.expr("interval 30 days")).scalar()


@_q(f"SELECT task_id, next_run, priority FROM tasks WHERE {_CLAIM} AND next_run <= {NOW} ORDER BY next_run, priority DESC, task_id LIMIT 50", "tasks")
def s01_claim_due(s, d):
    return sc.claim_due(domain.tasks(s, d), "node1", ["type1", "type3"], _now(s, d), 50).select("task_id", "next_run", "priority")


@_q(f"SELECT coalesce(epoch_us(min(next_run)) // 1000, 9223372036854775807) AS next_due_ms FROM tasks WHERE {_CLAIM}", "tasks")
def s02_next_due(s, d):
    return sc.next_due_ms(domain.tasks(s, d), "node1", ["type1", "type3"])


_NEXT = "CASE unit WHEN 'SECOND' THEN {t} + to_seconds(amount) WHEN 'MINUTE' THEN {t} + to_minutes(amount) WHEN 'HOUR' THEN {t} + to_hours(amount) WHEN 'DAILY' THEN {t} + to_days(amount) WHEN 'MONTHLY' THEN {t} + to_months(amount) WHEN 'YEARLY' THEN {t} + to_years(amount) END"
_RESULTS = "res AS (SELECT task_id, task_id % 4 AS version, arg_max(outcome, run_no) AS result, CAST(task_id % 3 AS INTEGER) AS timeouts, task_id % 17 = 0 AS removal FROM runs GROUP BY task_id)"


def _results(s, d) -> DataFrame:
    last = domain.runs(s, d).groupBy("task_id").agg(F.max_by("outcome", "run_no").alias("result"))
    k = F.col("task_id")
    return last.select("task_id", F.when(k % 19 == 0, (k + 1) % 4).otherwise(k % 4).alias("version"), "result", (k % 3).cast("int").alias("timeouts"), (k % 17 == 0).alias("removal"))


@_q(
    f"WITH {_RESULTS}, j AS (SELECT t.*, r.result, r.removal, t.task_id % 19 = 0 AS stale, r.result = 'TIMED_OUT' AS timed, CASE WHEN unit IS NULL THEN r.timeouts WHEN r.result = 'TIMED_OUT' THEN r.timeouts + 1 ELSE 0 END AS n FROM tasks t JOIN res r ON r.task_id = t.task_id), k AS (SELECT *, CASE WHEN stale THEN 'STALE' WHEN unit IS NULL THEN CASE WHEN timed THEN 'TIMED_OUT' WHEN result = 'FAILED' THEN 'FAILED' ELSE 'SUCCEEDED' END WHEN removal THEN 'CANCELLED' WHEN timed AND n >= 3 THEN 'BLACKLISTED' ELSE 'RESCHEDULED' END AS outcome_kind FROM j) SELECT task_id, outcome_kind, CASE outcome_kind WHEN 'STALE' THEN state WHEN 'CANCELLED' THEN 'CANCELLED' WHEN 'BLACKLISTED' THEN 'BLACKLISTED' WHEN 'RESCHEDULED' THEN 'SCHEDULED' ELSE 'COMPLETED' END AS new_state, CAST(n AS INTEGER) AS timeouts, CASE WHEN outcome_kind = 'RESCHEDULED' THEN {_NEXT.format(t=NOW)} ELSE next_run END AS next FROM k",
    "tasks runs",
)
def s03_finish(s, d):
    return sc.finish(domain.tasks(s, d), _results(s, d), _now(s, d), 3)


@_q("WITH g AS (SELECT *, sum(CASE WHEN outcome = 'TIMED_OUT' THEN 0 ELSE 1 END) OVER (PARTITION BY task_id ORDER BY run_no) AS g FROM runs) SELECT task_id, run_no, CAST(sum(CASE WHEN outcome = 'TIMED_OUT' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, g ORDER BY run_no) AS INTEGER) AS streak FROM g", "runs")
def s03_timeout_streaks(s, d):
    return sc.consecutive_timeouts(domain.runs(s, d))


@_q("SELECT i.id AS task_id, CASE state WHEN 'SCHEDULED' THEN 'CANCELLED' WHEN 'RUNNING' THEN 'DEFERRED' ELSE 'NOT_FOUND' END AS removal FROM (SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem) i LEFT JOIN tasks t ON t.task_id = i.id", "tasks")
def s04_remove(s, d):
    ids = table(s, d, "lineitem").select((F.col("l_orderkey") * 2).alias("task_id"))
    return sc.remove(domain.tasks(s, d), ids)


@_q(f"SELECT task_id, version, 'LEASE_EXPIRED' AS result FROM tasks WHERE state = 'RUNNING' AND lease_until < {NOW}", "tasks")
def s05_expired_leases(s, d):
    return sc.expired_leases(domain.tasks(s, d), _now(s, d))


@_q("SELECT task_id, task_id % 19 <> 0 AS fits FROM tasks WHERE task_id IN (SELECT task_id FROM runs)", "tasks runs")
def s06_fencing(s, d):
    r = _results(s, d).select("task_id", F.col("version").alias("r"))
    return domain.tasks(s, d).join(r, "task_id").select("task_id", (F.col("version") == F.col("r")).alias("fits"))


@_q(f"SELECT task_id, state = 'SCHEDULED' AS moved, CASE WHEN state = 'SCHEDULED' THEN {NOW} ELSE next_run END AS next_run FROM tasks", "tasks")
def s07_reschedule(s, d):
    t = domain.tasks(s, d)
    return sc.reschedule(t, t.select("task_id", _now(s, d).alias("at")))


@_q("SELECT state, count(*) AS n FROM tasks GROUP BY state", "tasks")
def s08_counts(s, d):
    return sc.counts(domain.tasks(s, d))


@_q("WITH live AS (SELECT count(*) AS n FROM tasks WHERE state IN ('SCHEDULED', 'RUNNING') AND task_id % 2 = 0), asked AS (SELECT task_id, row_number() OVER (ORDER BY task_id) AS r FROM tasks WHERE task_id % 2 = 1) SELECT task_id, r <= greatest(0, n + 100 - n) AS accepted FROM asked, live", "tasks")
def s09_capacity(s, d):
    t = domain.tasks(s, d)
    live = t.where("state in ('SCHEDULED', 'RUNNING') and task_id % 2 = 0")
    return sc.admit_submissions(live, t.where("task_id % 2 = 1"), live.count() + 100)


@_q("SELECT t.submitter, r.task_id, r.run_no, r.outcome FROM runs r JOIN tasks t ON t.task_id = r.task_id WHERE r.run_no % 3 <> 0", "tasks runs")
def s10_take_outcomes(s, d):
    out = domain.runs(s, d).join(domain.tasks(s, d).select("task_id", "submitter"), "task_id").select("submitter", "task_id", "run_no", "outcome")
    return sc.take_outcomes(out.union(out), out.where("run_no % 3 = 0").select("submitter", "task_id", "run_no"))


@_q(f"SELECT task_id, {_NEXT.format(t='next_run')} AS next FROM tasks", "tasks")
def s11_recurrence(s, d):
    return domain.tasks(s, d).select("task_id", next_after_sql(F.col("next_run"), F.col("unit"), F.col("amount")).alias("next"))


@_q()
def s11_recurrence_zoned(s, d):
    t = domain.tasks(s, d)
    zone = F.element_at(F.array(F.lit("UTC"), F.lit("Europe/Berlin"), F.lit("America/New_York")), (F.col("task_id") % 3 + 1).cast("int"))
    return t.select("task_id", next_after_zoned(F.unix_millis(F.col("next_run").cast("timestamp")), F.col("unit"), F.col("amount"), zone).alias("next_ms"))


_MS = "CASE unit WHEN 'SECOND' THEN 1000 WHEN 'MINUTE' THEN 60000 WHEN 'HOUR' THEN 3600000 WHEN 'DAILY' THEN 86400000 WHEN 'MONTHLY' THEN 2419200000 WHEN 'YEARLY' THEN 31536000000 END * amount"


@_q(f"SELECT task_id, CAST({_MS} AS BIGINT) AS min_ms FROM tasks", "tasks")
def s12_min_interval(s, d):
    return domain.tasks(s, d).select("task_id", min_interval_ms(F.col("unit"), F.col("amount")).alias("min_ms"))


@_q("SELECT (SELECT count(*) FROM tasks WHERE state = 'SCHEDULED') AS pending, (SELECT count(*) FROM tasks WHERE state = 'RUNNING') AS running, 0 AS blacklisted, (SELECT count(*) FROM tasks WHERE state IN ('SCHEDULED', 'RUNNING')) AS used, 1000000 AS capacity, 1000000 - (SELECT count(*) FROM tasks WHERE state IN ('SCHEDULED', 'RUNNING')) AS remaining, count(*) AS executions, count(*) FILTER (outcome = 'SUCCEEDED') AS completed, count(*) FILTER (outcome = 'TIMED_OUT') AS timed_out, count(*) FILTER (outcome = 'FAILED') AS failed FROM runs", "tasks runs")
def s13_stats(s, d):
    return sc.stats(domain.tasks(s, d), domain.runs(s, d), 1_000_000)


@_q("SELECT t.task_id, t.state, r.runs, r.last, t.lease_until FROM tasks t LEFT JOIN (SELECT task_id, count(*) AS runs, arg_max(outcome, run_no) AS last FROM runs GROUP BY task_id) r ON r.task_id = t.task_id", "tasks runs")
def s15_records(s, d):
    r = domain.runs(s, d).groupBy("task_id").agg(F.count("*").alias("runs"), F.max_by("outcome", "run_no").alias("last"))
    return domain.tasks(s, d).join(r, "task_id", "left").select("task_id", "state", "runs", "last", "lease_until")


@_q(f"SELECT task_id, CASE WHEN (task_id % 1000 - 10) * 1000 <= 0 THEN 'BAD_TIMEOUT' WHEN unit IS NOT NULL AND (task_id % 1000 - 10) * 1000 >= {_MS} THEN 'TIMEOUT_TOO_LONG' ELSE 'OK' END AS verdict FROM tasks", "tasks")
def s16_submissions(s, d):
    specs = domain.tasks(s, d).withColumn("timeout_ms", (F.col("task_id") % 1000 - 10) * 1000)
    return sc.check_submission(specs, min_interval_ms(F.col("unit"), F.col("amount")))


# --- task abstraction -----------------------------------------------------


@_q("SELECT ari, max(version) AS version, arg_max(event_type, version) AS event_type FROM task_events GROUP BY ari", "task_events")
def a01_latest(s, d):
    return tl.latest(domain.task_events(s, d), "event_type")


@_q("WITH cur AS (SELECT ari, max(version) AS version FROM task_events GROUP BY ari), w AS (SELECT c.ari, k AS seq, c.version - k % 2 AS expected_version, c.version FROM cur c, (SELECT unnest([1, 2, 3, 4]) AS k)) SELECT ari, seq, CASE WHEN seq = 2 THEN 'APPLIED' ELSE 'CONFLICT' END AS outcome FROM w", "task_events")
def a01_version_check(s, d):
    cur = tl.latest(domain.task_events(s, d))
    writes = cur.select("ari", "version", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("seq")).select("ari", "seq", (F.col("version") - F.col("seq") % 2).alias("expected_version"))
    return tl.check_writes(writes, cur)


@_q("WITH once AS (SELECT DISTINCT ari, version FROM task_events) SELECT ari, version, CASE WHEN version = coalesce(lag(version) OVER (PARTITION BY ari ORDER BY version), 0) + 1 THEN 'APPLY' ELSE 'REFETCH' END AS action FROM once", "task_events")
def a02_consumer(s, d):
    return tl.consume(domain.task_events(s, d))


@_q("SELECT o_orderkey AS ari, o_orderpriority AS category, o_orderdate AS due FROM orders WHERE 'u' || o_custkey % 50 = 'u7' ORDER BY category, due, ari LIMIT 40")
def a03_my_tasks(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("ari"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("due"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("assignee"))
    return tl.my_tasks(o, "u7", 40).select("ari", "category", "due")


@_q("SELECT DISTINCT l_orderkey AS ari FROM lineitem WHERE l_suppkey % 10 = 3")
def a04_permitted(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("ari"), F.col("l_suppkey").alias("container"))
    grants = table(s, d, "supplier").select(F.col("s_suppkey").alias("container"), F.concat(F.lit("g"), F.col("s_suppkey") % 10).alias("principal"))
    return tl.permitted(li, grants, ["g3", "g77"])


@_q("SELECT user_id AS ari, CASE WHEN user_id % 3 = 0 THEN 'CONFLICT' ELSE 'MERGED' END AS outcome, CASE WHEN user_id % 3 = 0 THEN 'due' ELSE '' END AS shared FROM events GROUP BY user_id")
def a05_merge(s, d):
    u = table(s, d, "events").select(F.col("user_id").alias("ari")).distinct()
    a = u.select("ari", F.array(F.lit("title"), F.lit("due")).alias("fields"))
    b = u.select("ari", F.when(F.col("ari") % 3 == 0, F.array(F.lit("due"), F.lit("state"))).otherwise(F.array(F.lit("state"))).alias("fields"))
    return tl.merge_patches(a, b)


@_q("SELECT l_orderkey AS ari, count(*) FILTER (l_returnflag <> 'R') AS active, count(*) FILTER (l_returnflag <> 'R') = 0 AS deleted FROM lineitem GROUP BY l_orderkey")
def a06_lifecycle(s, d):
    return tl.lifecycle(table(s, d, "lineitem").select(F.col("l_orderkey").alias("ari"), (F.col("l_returnflag") != "R").alias("active")))


QUERIES = Q
