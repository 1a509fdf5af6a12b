"""Tag queries: search, lists, changes and trending (t)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import tagsearch as ts
from loamgraph.operators import trending as tr
from loamgraph.plans.views import rendezvous_sql, using
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


# The terms of the searches: the busiest tenant's busiest tags, largest first.
_TERMS = """busiest AS (SELECT tenant_id FROM assignments GROUP BY 1 ORDER BY count(*) DESC, tenant_id LIMIT 1),
terms AS (SELECT tag_id, row_number() OVER (ORDER BY count(*) DESC, tag_id) AS k FROM assignments WHERE tenant_id = (SELECT tenant_id FROM busiest) GROUP BY 1 QUALIFY k <= 5),
mine AS (SELECT * FROM assignments WHERE tenant_id = (SELECT tenant_id FROM busiest)),
ent AS (SELECT tenant_id, entity_type, entity_id, min(entity_seq) AS entity_seq, list(tag_id) AS held FROM mine GROUP BY ALL)"""


def _terms(s: SparkSession, d: str) -> tuple[str, list[int]]:
    a = domain.assignments(s, d)
    tenant = a.groupBy("tenant_id").count().orderBy(F.desc("count"), "tenant_id").first()[0]
    rows = a.where(F.col("tenant_id") == tenant).groupBy("tag_id").count().orderBy(F.desc("count"), "tag_id").limit(5).collect()
    return tenant, [r[0] for r in rows]


def _mine(s, d) -> tuple[DataFrame, list[int]]:
    tenant, ids = _terms(s, d)
    return domain.assignments(s, d).where(F.col("tenant_id") == tenant), ids


def _t(k: int) -> str:
    return f"list_contains(held, (SELECT tag_id FROM terms WHERE k = {k}))"


_COLS = "tenant_id, entity_type, entity_id, min(entity_seq) AS entity_seq"


@_q("SELECT tenant_id, tag_id, name_norm, deleted FROM tag_current WHERE (tenant_id, tag_id) IN (SELECT (tenant_id, tag_id) FROM assignments)", "tag_current assignments")
def t01_find_tags(s, d):
    """By id a deleted tag is seen, by name only a live one; here the ids of all tags in use."""
    ids = domain.assignments(s, d).select("tenant_id", "tag_id").distinct()
    return domain.tag_current(s, d).join(ids, ["tenant_id", "tag_id"], "left_semi").select("tenant_id", "tag_id", "name_norm", "deleted")


@_q(f"WITH {_TERMS} SELECT tag_id, name_norm FROM tag_current WHERE tenant_id = (SELECT tenant_id FROM busiest) AND NOT deleted AND starts_with(name_norm, 'm') AND name_norm > 'mb' ORDER BY name_norm, tag_id LIMIT 21", "assignments tag_current")
def t02_autocomplete(s, d):
    return ts.autocomplete(domain.tag_current(s, d), _terms(s, d)[0], "m", "mb", 20)


@_q("SELECT tenant_id, count(*) AS live_tags FROM tag_current WHERE NOT deleted GROUP BY tenant_id", "tag_current")
def t03_live_tags(s, d):
    return ts.live(domain.tag_current(s, d)).groupBy("tenant_id").agg(F.count("*").alias("live_tags"))


@_q("SELECT t.tenant_id, t.tag_id, count(a.entity_id) AS usage FROM tag_current t LEFT JOIN assignments a ON a.tenant_id = t.tenant_id AND a.tag_id = t.tag_id GROUP BY ALL", "tag_current assignments")
def t04_usage(s, d):
    return ts.usage(domain.assignments(s, d), domain.tag_current(s, d))


@_q("SELECT a.tenant_id, entity_type, entity_id, string_agg(name_norm, '|' ORDER BY name_norm, a.tag_id) AS tags FROM assignments a JOIN tag_current t ON t.tenant_id = a.tenant_id AND t.tag_id = a.tag_id WHERE NOT deleted GROUP BY ALL", "assignments tag_current")
def t05_tags_of_entities(s, d):
    live = ts.with_live_tags(domain.assignments(s, d), domain.tag_current(s, d))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("name_norm", "tag_id"))), lambda x: x["name_norm"])
    return live.groupBy(*ts.ENTITY).agg(F.array_join(ordered, "|").alias("tags"))


@_q(f"WITH {_TERMS} SELECT entity_type, entity_id, entity_seq FROM mine WHERE tag_id = (SELECT tag_id FROM terms WHERE k = 1) AND entity_seq > 20 ORDER BY entity_seq, entity_type, entity_id LIMIT 51", "assignments")
def t06_entities_of(s, d):
    mine, ids = _mine(s, d)
    return ts.page(mine.where((F.col("tag_id") == ids[0]) & (F.col("entity_seq") > 20)).select("entity_type", "entity_id", "entity_seq"), ["entity_seq", "entity_type", "entity_id"], ts.page_size(None))


@_q(f"WITH {_TERMS} SELECT tenant_id, entity_type, entity_id, entity_seq FROM (SELECT tenant_id, entity_type, entity_id, (SELECT min(m.entity_seq) FROM mine m WHERE m.entity_type = e.entity_type AND m.entity_id = e.entity_id AND m.tag_id IN (SELECT tag_id FROM terms WHERE k <= 4)) AS entity_seq FROM ent e WHERE {_t(1)} AND ({_t(2)} OR {_t(3)}) AND NOT {_t(4)})", "assignments")
def t07_search(s, d):
    mine, t = _mine(s, d)
    return ts.search(mine, ts.TagQuery(all={t[0]}, any={t[1], t[2]}, none={t[3]}))


@_q(f"WITH {_TERMS} SELECT tenant_id, entity_type, entity_id FROM ent WHERE {_t(1)} AND {_t(2)}", "assignments")
def t07_search_all(s, d):
    mine, t = _mine(s, d)
    return ts.search_semi(mine, ts.TagQuery(all={t[0], t[1]})).select(*ts.ENTITY)


@_q(f"WITH {_TERMS}, alive AS (SELECT tag_id FROM tag_current WHERE NOT deleted AND tenant_id = (SELECT tenant_id FROM busiest)) SELECT tenant_id, entity_type, entity_id FROM ent WHERE {_t(1)} AND (SELECT tag_id FROM terms WHERE k = 1) IN (SELECT tag_id FROM alive) AND NOT EXISTS (SELECT 1 FROM terms WHERE k = 2 AND tag_id IN (SELECT tag_id FROM alive) AND list_contains(held, terms.tag_id))", "assignments tag_current")
def t08_search_service(s, d):
    mine, t = _mine(s, d)
    tenant = _terms(s, d)[0]
    named = [t[0], t[1], -5]
    live_ids = {r[0] for r in ts.live(domain.tag_current(s, d)).where((F.col("tenant_id") == tenant) & F.col("tag_id").isin(named)).select("tag_id").collect()}
    q = ts.resolve_terms(ts.TagQuery(all={t[0]}, none={t[1], -5}), live_ids)
    out = mine.select(*ts.ENTITY).where("false") if q is None else ts.search(mine, q).select(*ts.ENTITY)
    return out


_SHARDED = "sh AS (SELECT source_shard, entity_seq, list(DISTINCT tag_id) AS held FROM entity_tags WHERE tag_id IS NOT NULL AND tenant_id = (SELECT tenant_id FROM busiest) GROUP BY ALL)"


@_q(f"WITH {_TERMS}, {_SHARDED} SELECT (SELECT tenant_id FROM busiest) AS tenant_id, source_shard, CAST(count(*) AS BIGINT) AS total FROM sh WHERE ({_t(1)} OR {_t(2)}) AND NOT {_t(3)} GROUP BY ALL", "assignments")
def t09_search_bitmaps(s, d):
    tenant, t = _terms(s, d)
    rows = table(s, d, "entity_tags").where((F.col("tenant_id") == tenant) & F.col("tag_id").isNotNull())
    return ts.search_bitmaps(ts.postings(rows), ts.TagQuery(any={t[0], t[1]}, none={t[2]}))


@_q("SELECT tenant_id, source_shard, entity_seq, min(entity_type || '/' || entity_id) AS entity FROM entity_tags GROUP BY ALL")
def t10_resolve_entities(s, d):
    rows = table(s, d, "entity_tags")
    asked = rows.select("tenant_id", "source_shard", "entity_seq").distinct()
    named = rows.groupBy("tenant_id", "source_shard", "entity_seq").agg(F.min(F.concat("entity_type", F.lit("/"), "entity_id")).alias("entity"))
    return named.join(asked, ["tenant_id", "source_shard", "entity_seq"], "left_semi")


@_q("SELECT a.tenant_id, a.tag_id, count(*) AS postings FROM assignments a JOIN tag_current t ON t.tenant_id = a.tenant_id AND t.tag_id = a.tag_id WHERE NOT deleted GROUP BY ALL", "assignments tag_current")
def t11_scan_live(s, d):
    return ts.with_live_tags(domain.assignments(s, d), domain.tag_current(s, d)).groupBy("tenant_id", "tag_id").agg(F.count("*").alias("postings"))


@_q(f"WITH {_TERMS} SELECT tenant_id, entity_type, entity_id, entity_seq FROM ent WHERE ({_t(2)} OR {_t(5)}) AND NOT {_t(1)}", "assignments")
def t12_search_sets(s, d):
    mine, t = _mine(s, d)
    return ts.search_sets(mine, ts.TagQuery(any={t[1], t[4]}, none={t[0]}))


@_q("SELECT entity_seq, replace(replace(rtrim(to_base64(CAST('s1:' || entity_seq AS BLOB)), '='), '+', '-'), '/', '_') AS cursor, entity_seq AS back FROM (SELECT DISTINCT entity_seq FROM entity_tags)")
def t13_cursors(s, d):
    rows = table(s, d, "entity_tags").select("entity_seq").distinct().withColumn("cursor", ts.seq_cursor("entity_seq"))
    return rows.withColumn("back", ts.read_seq_cursor("cursor"))


@_q(f"WITH {_TERMS}, ordered AS (SELECT entity_type, entity_id, entity_seq, row_number() OVER (ORDER BY entity_seq, entity_type, entity_id) AS r FROM ent) SELECT entity_type, entity_id, entity_seq, r > 200 AS beyond FROM ordered WHERE r <= 201", "assignments")
def t14_page(s, d):
    mine, _ = _mine(s, d)
    n = ts.page_size(5000)
    rows = ts.page(mine.groupBy("entity_type", "entity_id").agg(F.min("entity_seq").alias("entity_seq")), ["entity_seq", "entity_type", "entity_id"], n)
    from pyspark.sql import Window

    return rows.withColumn("beyond", F.row_number().over(Window.orderBy("entity_seq", "entity_type", "entity_id")) > n)


@_q(r"SELECT DISTINCT name, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS norm FROM tags WHERE name IS NOT NULL")
def t15_normalize(s, d):
    names = table(s, d, "tags").where("name is not null").select("name").distinct()
    return names.withColumn("norm", ts.normalize_sql("name"))


@_q()
def t15_normalize_full(s, d):
    names = table(s, d, "tags").select("name").distinct()
    return names.select("name", ts.normalize_names(F.col("name")).alias("norm"))


_KEYS = ["tenant_id", "entity_type", "entity_id", "tag_id"]


CUT = "2025-01-01"


@_q(f"SELECT tenant_id, entity_type, entity_id, tag_id FROM assignments WHERE first_at >= TIMESTAMP '{CUT}'", "assignments")
def t20_attach(s, d):
    """All assignments attached to the state before the cut: what is really added."""
    a = domain.assignments(s, d)
    return ts.attach(a.where(f"first_at < timestamp_ntz'{CUT}'"), a, _KEYS)


@_q("SELECT tenant_id, entity_type, entity_id, tag_id FROM assignments WHERE (tenant_id, tag_id) IN (SELECT (tenant_id, tag_id) FROM tag_current WHERE deleted)", "assignments tag_current")
def t21_detach(s, d):
    """The assignments of deleted tags, and some that don't exist, detached."""
    a = domain.assignments(s, d)
    dead = domain.tag_current(s, d).where("deleted").select("tenant_id", "tag_id")
    unwanted = a.join(dead, ["tenant_id", "tag_id"], "left_semi").select(*_KEYS)
    return ts.detach(a, unwanted.union(unwanted.withColumn("tag_id", -F.col("tag_id"))), _KEYS)


@_q(
    """WITH want AS (SELECT tenant_id, entity_type, entity_id, tag_id FROM assignments WHERE (tenant_id, tag_id) NOT IN (SELECT (tenant_id, tag_id) FROM tag_current WHERE deleted) UNION SELECT tenant_id, entity_type, entity_id, -entity_seq FROM assignments),
had AS (SELECT tenant_id, entity_type, entity_id, tag_id FROM assignments)
SELECT *, 'ADDED' AS change FROM (SELECT * FROM want EXCEPT SELECT * FROM had) UNION ALL SELECT *, 'REMOVED' FROM (SELECT * FROM had EXCEPT SELECT * FROM want)""",
    "assignments tag_current",
)
def t22_replace(s, d):
    """Every entity's tags replaced by its tags that are not deleted and a new one."""
    a = domain.assignments(s, d)
    want = ts.purge(a, domain.tag_current(s, d)).select(*_KEYS).union(a.select("tenant_id", "entity_type", "entity_id", -F.col("entity_seq")))
    return ts.replace_tags(a, want, ts.ENTITY)


@_q(f"WITH {_TERMS}, e AS (SELECT DISTINCT tenant_id, entity_type, entity_id FROM mine) SELECT e.tenant_id, e.entity_type, e.entity_id, t.tag_id FROM e, (SELECT tag_id FROM terms WHERE k <= 3) t EXCEPT SELECT tenant_id, entity_type, entity_id, tag_id FROM mine", "assignments")
def t23_bulk_attach(s, d):
    mine, ids = _mine(s, d)
    return ts.bulk_attach(mine, mine.select(*ts.ENTITY), ids[:3], _KEYS)


@_q(f"SELECT tenant_id, tag_id, CAST(sum(CASE WHEN first_at >= TIMESTAMP '{CUT}' THEN 1 ELSE -1 END) AS BIGINT) AS delta FROM assignments GROUP BY ALL HAVING sum(CASE WHEN first_at >= TIMESTAMP '{CUT}' THEN 1 ELSE -1 END) <> 0", "assignments")
def t24_usage_deltas(s, d):
    a = domain.assignments(s, d)
    return ts.usage_deltas(a.withColumn("change", F.when(F.col("first_at") >= F.expr(f"timestamp_ntz'{CUT}'"), "ADDED").otherwise("REMOVED")))


@_q(
    """WITH live AS (SELECT tenant_id, name_norm, min(tag_id) AS owner FROM tag_current WHERE NOT coalesce(deleted, false) GROUP BY ALL),
edits AS (SELECT c.tenant_id, c.tag_id, version - CASE WHEN c.tag_id % 7 = 0 THEN 1 ELSE 0 END AS expected_version, CASE WHEN c.tag_id % 3 = 1 THEN (SELECT min(name_norm) FROM live l WHERE l.tenant_id = c.tenant_id) ELSE 'fresh ' || c.tag_id END AS wanted, c.tag_id % 5 = 0 AS remove, version, coalesce(deleted, false) AS dead, name_norm AS had FROM tag_current c),
told AS (SELECT e.*, CASE WHEN dead THEN 'NOT_FOUND' WHEN version <> expected_version THEN 'CONFLICT' WHEN NOT remove AND EXISTS (SELECT 1 FROM tag_current o WHERE o.tenant_id = e.tenant_id AND o.name_norm = e.wanted AND NOT coalesce(o.deleted, false) AND o.tag_id <> e.tag_id) THEN 'NAME_TAKEN' ELSE 'APPLIED' END AS outcome FROM edits e)
SELECT tenant_id, tag_id, outcome, CASE WHEN outcome = 'APPLIED' THEN version + 1 END AS version, CASE WHEN outcome = 'APPLIED' THEN CASE WHEN remove THEN had || '~' || tag_id ELSE wanted END END AS name_norm FROM told""",
    "tag_current",
)
def t25_tag_edits(s, d):
    """Every third tag asks for the first live name of its tenant, which is another's unless it has it itself."""
    tags = domain.tag_current(s, d)
    first = ts.live(tags).groupBy(F.col("tenant_id").alias("f_tenant")).agg(F.min("name_norm").alias("first_name"))
    wanted = F.when(F.col("tag_id") % 3 == 1, F.col("first_name")).otherwise(F.concat(F.lit("fresh "), "tag_id"))
    asked = tags.join(first, F.col("tenant_id") == F.col("f_tenant"), "left")
    edits = asked.select("tenant_id", "tag_id", (F.col("version") - (F.col("tag_id") % 7 == 0).cast("int")).alias("expected_version"), wanted.alias("name_norm"), (F.col("tag_id") % 5 == 0).alias("delete"))
    return ts.apply_tag_edits(tags, edits)


@_q("SELECT tenant_id, count(*) AS kept FROM assignments WHERE (tenant_id, tag_id) NOT IN (SELECT (tenant_id, tag_id) FROM tag_current WHERE deleted) GROUP BY ALL", "assignments tag_current")
def t26_purge(s, d):
    return ts.purge(domain.assignments(s, d), domain.tag_current(s, d)).groupBy("tenant_id").agg(F.count("*").alias("kept"))


_REQ = "req AS (SELECT 'k' || (event_id % 500) AS key, event_id AS seq, event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END AS body FROM events)"


@_q(f"WITH {_REQ}, f AS (SELECT key, min(seq) AS s, arg_min(body, seq) AS b FROM req GROUP BY key) SELECT key, seq, CASE WHEN seq = s THEN 'RUN' WHEN body = b THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM req JOIN f USING (key)")
def t27_idempotency(s, d):
    e = table(s, d, "events")
    return ts.idempotent(e.select(F.concat(F.lit("k"), F.col("event_id") % 500).alias("key"), F.col("event_id").alias("seq"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "").otherwise("x")).alias("body")))


# --- streaming and trending -------------------------------------------------

_ACT = "act AS (SELECT tenant, g AS grain, CAST(floor(epoch(at_time) / g) AS BIGINT) AS bucket, tag, count(*) AS attaches FROM tag_log, (SELECT unnest([3600, 86400]) AS g) WHERE type = 'TAGS_ATTACHED' GROUP BY ALL)"
_WIN = "last AS (SELECT CAST(floor(epoch(max(at_time)) / {g}) AS BIGINT) AS b FROM tag_log), win AS (SELECT tenant, tag, CAST(coalesce(sum(attaches) FILTER (bucket > b - {n}), 0) AS BIGINT) AS cnt, CAST(coalesce(sum(attaches) FILTER (bucket <= b - {n}), 0) AS BIGINT) AS prev FROM act, last WHERE grain = {g} AND bucket > b - 2 * {n} AND bucket <= b GROUP BY ALL)"


def _activity(s, d) -> DataFrame:
    return tr.activity(tr.once(domain.tag_log_redelivered(s, d)))


def _windowed(s, d, window: str) -> DataFrame:
    grain = tr.WINDOWS[window][0]
    last = domain.tag_log(s, d).agg(tr.bucket(F.max("at"), F.lit(grain))).scalar()
    return tr.window_counts(_activity(s, d), window, last)


@_q(
    "WITH kept AS (SELECT seq, min(at_time) AS at_time FROM tag_log WHERE seq % 1000 <> 500 AND seq <> 9877 GROUP BY seq), gaps AS (SELECT seq, at_time, seq - lag(seq) OVER (ORDER BY seq) > 1 AS gap FROM kept), stop AS (SELECT min(seq) AS s FROM gaps WHERE gap AND at_time > (SELECT max(at_time) FROM kept) - INTERVAL 12 HOURS) SELECT seq, s IS NULL OR seq < s AS relayed FROM kept, stop",
    "tag_log",
)
def t30_relay(s, d):
    log = domain.tag_log(s, d).where("seq % 1000 <> 500 and seq <> 9877")
    as_of = log.agg(F.max("at")).scalar()
    return tr.relay_positions(log, as_of, "12 hours").select("seq", "relayed")


@_q("SELECT tenant, shard, count(*) AS events, max(seq) AS last_seq FROM tag_log WHERE seq > 2000 GROUP BY ALL", "tag_log")
def t31_exactly_once(s, d):
    log = domain.tag_log_redelivered(s, d)
    marks = log.select("tenant", "shard").distinct().withColumn("last_seq", F.lit(2000).cast("long"))
    return tr.above_mark(log, marks).groupBy("tenant", "shard").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


@_q(f"WITH {_ACT} SELECT * FROM act", "tag_log")
def t32_bucket_counts(s, d):
    return _activity(s, d)


@_q(f"WITH {_ACT} SELECT * FROM act WHERE NOT (tenant = 't1' AND tag LIKE 'view:%')", "tag_log")
def t33_deleted_tags(s, d):
    gone = domain.tag_log(s, d).where("tenant = 't1' and tag like 'view:%'").select("tenant", "tag").distinct()
    return tr.without_deleted(_activity(s, d), gone)


@_q(f"WITH {_ACT}, {_WIN.format(g=3600, n=24)} SELECT tenant, tag, cnt, prev FROM win WHERE cnt > 0 QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY cnt DESC, tag) <= 10", "tag_log")
def t34_popular(s, d):
    return tr.top(_windowed(s, d, "24h"), "POPULAR", 10).select("tenant", "tag", "cnt", "prev")


@_q(f"WITH {_ACT}, {_WIN.format(g=86400, n=7)} SELECT tenant, tag, cnt, prev FROM win WHERE cnt > prev QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY cnt - prev DESC, cnt DESC, tag) <= 10", "tag_log")
def t35_rising(s, d):
    return tr.top(_windowed(s, d, "7d"), "RISING", 10).select("tenant", "tag", "cnt", "prev")


@_q(f"WITH {_ACT}, {_WIN.format(g=86400, n=7)} SELECT tenant, tag, cnt, prev FROM win", "tag_log")
def t36_windows(s, d):
    return _windowed(s, d, "7d")


@_q(f"WITH {_ACT}, {_WIN.format(g=3600, n=24)} SELECT tenant, tag, cnt FROM win WHERE cnt > 0 AND tag NOT LIKE 'signup:%' QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY cnt DESC, tag) <= 5", "tag_log")
def t37_service_top(s, d):
    live = domain.tag_log(s, d).where("tag not like 'signup:%'").select("tenant", "tag").distinct()
    return tr.top(_windowed(s, d, "24h"), "POPULAR", 5, live).select("tenant", "tag", "cnt")


@_q(f"WITH {_ACT}, cut AS (SELECT max(bucket) - 72 AS b FROM act WHERE grain = 3600) SELECT act.* FROM act, cut WHERE NOT (grain = 3600 AND bucket < b)", "tag_log")
def t38_prune(s, d):
    counts = _activity(s, d)
    return tr.prune(counts, 3600, counts.where("grain = 3600").agg(F.max("bucket") - 72).scalar())


@_q(
    "WITH keyed AS (SELECT tenant, tag, seq % 20 AS entity, seq, type FROM tag_log), ends AS (SELECT tenant, tag, entity, arg_max(type, seq) AS type FROM keyed GROUP BY ALL) SELECT tenant, tag, entity FROM ends WHERE type = 'TAGS_ATTACHED'",
    "tag_log",
)
def t39_index_bootstrap(s, d):
    log = domain.tag_log_redelivered(s, d).withColumn("entity", F.col("seq") % 20)
    at = F.lit(4000)
    snap = log.where("seq <= 4000").groupBy("tenant", "tag", "entity").agg(F.max_by("type", "seq").alias("type")).where("type = 'TAGS_ATTACHED'")
    return tr.fold_log(snap, log, at)


@_q("SELECT tenant_id, entity_type, entity_id, max(entity_seq) AS entity_seq, count(DISTINCT tag_id) AS tags FROM assignments GROUP BY ALL", "assignments")
def t41_versioned(s, d):
    a = domain.assignments(s, d)
    n = a.groupBy(*ts.ENTITY).agg(F.count("*").alias("tags"))
    return tr.newest(a.select(*ts.ENTITY, "entity_seq"), ts.ENTITY, "entity_seq").join(n, ts.ENTITY)


@_q("SELECT tenant, tag, strftime(at_time, '%Y-%m-%d') AS day, CAST(sum(CASE WHEN type = 'TAGS_ATTACHED' THEN 1 ELSE -1 END) AS BIGINT) AS net FROM tag_log GROUP BY ALL", "tag_log")
def t42_daily_rollup(s, d):
    rows = tr.signed_rows(domain.tag_log_redelivered(s, d))
    return rows.groupBy("tenant", "tag", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.sum("delta").alias("net"))


@_q("SELECT tenant_id, tag_id FROM tag_current WHERE NOT deleted AND (tenant_id, tag_id) NOT IN (SELECT (tenant_id, tag_id) FROM assignments)", "tag_current assignments")
def t42_never_used(s, d):
    used = domain.assignments(s, d).select("tenant_id", "tag_id").distinct()
    return ts.live(domain.tag_current(s, d)).select("tenant_id", "tag_id").join(used, ["tenant_id", "tag_id"], "left_anti")


@_q(
    "WITH marks AS (SELECT tenant, CASE tenant WHEN 't0' THEN max(seq) // 2 WHEN 't1' THEN max(seq) // 3 END AS applied, CASE tenant WHEN 't0' THEN max(seq) // 3 ELSE max(seq) // 2 END AS barrier FROM tag_log GROUP BY tenant), seen AS (SELECT l.*, CASE WHEN applied >= barrier THEN 'index' ELSE 'store' END AS by_, applied FROM tag_log l JOIN marks m ON m.tenant = l.tenant) SELECT tenant, tag, arg_max(type, seq) AS type, max(seq) AS seq, max(by_) AS by FROM seen WHERE by_ = 'store' OR seq <= applied GROUP BY tenant, tag",
    "tag_log",
)
def t40_read_barrier(s, d):
    """One tenant's index has passed the caller's barrier, one's is behind it, one has no index."""
    log = domain.tag_log(s, d)
    top = F.max("seq")
    part = lambda n: F.floor(top / n).cast("long")
    marks = log.groupBy("tenant").agg(F.when(F.col("tenant") == "t0", part(2)).when(F.col("tenant") == "t1", part(3)).alias("applied"), F.when(F.col("tenant") == "t0", part(3)).otherwise(part(2)).alias("barrier"))
    return ts.read_at(log.select("tenant", "tag", "type", "seq"), marks)


_SHARDS = [f"shard-{i:04d}" for i in range(8)]


@_q(f"SELECT tenant_id, {rendezvous_sql('tenant_id', _SHARDS)} AS shard FROM (SELECT DISTINCT tenant_id FROM tags) t")
def t43_rendezvous(s, d):
    tenants = table(s, d, "tags").select("tenant_id").distinct()
    return tenants.select("tenant_id", ts.rendezvous(F.col("tenant_id"), _SHARDS).alias("shard"))


@_q(
    "WITH r AS (SELECT *, seq % 10 <> 7 OR seq < (SELECT max(seq) FROM tag_log) // 2 AS relayed FROM tag_log) SELECT tenant, max(seq) AS latest_seq, max(seq) FILTER (relayed) AS relayed_seq, min(at_time) FILTER (NOT relayed) AS oldest_unrelayed FROM r GROUP BY tenant",
    "tag_log",
)
def t45_lag(s, d):
    return tr.outbox_lag(_relayed(s, d), ["tenant"])


@_q(
    "WITH r AS (SELECT *, seq % 10 <> 7 OR seq < (SELECT max(seq) FROM tag_log) // 2 AS relayed FROM tag_log) SELECT tenant, seq FROM r WHERE NOT (relayed AND at_time < (SELECT max(at_time) FROM tag_log) - INTERVAL 3 DAYS)",
    "tag_log",
)
def t45_retention(s, d):
    """Only relayed rows are pruned, however old the others are."""
    log = _relayed(s, d)
    return tr.prune_relayed(log, log.agg(F.max("at")).scalar(), "3 days").select("tenant", "seq")


def _relayed(s, d) -> DataFrame:
    """The outbox with every tenth row of its later half still unrelayed."""
    log = domain.tag_log(s, d)
    half = F.floor(log.agg(F.max("seq")).scalar() / F.lit(2))
    return log.withColumn("relayed", (F.col("seq") % 10 != 7) | (F.col("seq") < half))


QUERIES = Q
