"""Domain views derived from the stored tables: graphs, tasks, pages, logs.

Each has a SQL twin in ``loamgraph.plans.views`` that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.orphans import current
from loamgraph.session import Scratch
from loamgraph.sources.tables import table


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations that supply nations well above the average: ``(src, dst, weight)``; at most a row a pair of nations, written once."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    least = pairs.agg(F.avg("weight")).scalar() * 1.25
    return Scratch(spark, "trade").keep(pairs.where(F.col("weight") > least).select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight"), 1)


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))


def heap_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id >= 1").select(F.col("event_id").alias("id"), F.col("event_id").alias("ord"))


def heap(spark: SparkSession, d: str) -> DataFrame:
    """Every event k >= 2 hangs below k // 2: acyclic, logarithmic depth."""
    return table(spark, d, "events").where("event_id >= 2").select(F.shiftright("event_id", 1).alias("src"), F.col("event_id").alias("dst"))


def fan(spark: SparkSession, d: str) -> DataFrame:
    """Every event k hangs below k // 2, or below k // 3 and k // 4, or below k // 2 and k // 5, by its rest of 3: acyclic, with uneven ways to a vertex."""
    e = table(spark, d, "events").select(F.col("event_id").alias("dst")).where("dst >= 2")
    by = lambda n: F.floor(F.col("dst") / n).cast("long")
    above = F.when(F.col("dst") % 3 == 0, F.array(by(3), by(4))).when(F.col("dst") % 3 == 1, F.array(by(2))).otherwise(F.array(by(2), by(5)))
    return e.select(F.explode(above).alias("src"), "dst").where("src >= 1").distinct()


def heap_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """The heap with links back up in the half below 2, at every 97th event."""
    back = table(spark, d, "events").where("event_id >= 400 and event_id % 97 = 0 and substring(bin(event_id), 2, 1) = '0'").select(F.col("event_id").alias("src"), F.shiftright("event_id", 2).alias("dst"))
    return heap(spark, d).unionByName(back)


def holdings(spark: SparkSession, d: str) -> DataFrame:
    """Orders and the parts (as negative ids) they hold, a row a line item."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    """The same without repeats."""
    return holdings(spark, d).distinct()


def tag_current(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "tags"), ["tenant_id", "tag_id"], "version", "updated_at", "deleted", "name", "name_norm", "color", "created_by", "created_at")


def node_current(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "nodes"), ["tenant_id", "node_id"], "version", "updated_at", "space_id", "parent_id", "path", "depth", "rank", "node_type", "title", "status", "trashed_at", "created_at")


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """Distinct assignments with the entity's dense number and the first time."""
    rows = table(spark, d, "entity_tags").where("tag_id is not null")
    return rows.groupBy("tenant_id", "entity_type", "entity_id", "tag_id").agg(F.min("entity_seq").alias("entity_seq"), F.min("created_at").alias("first_at"))


def tag_log(spark: SparkSession, d: str) -> DataFrame:
    """Tag events from the event stream: ``(seq, shard, tenant, type, tag, at)``."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "TAGS_DETACHED").otherwise("TAGS_ATTACHED")
    return e.select((F.col("event_id") + 1).alias("seq"), F.concat(F.lit("s"), F.col("user_id") % 2).alias("shard"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant"), kind.alias("type"), F.concat("event_type", F.lit(":"), F.col("user_id") % 10).alias("tag"), F.col("ts").alias("at"))


def tag_log_redelivered(spark: SparkSession, d: str) -> DataFrame:
    log = tag_log(spark, d)
    return log.unionByName(log.where("seq % 7 = 0"))


def fetches(spark: SparkSession, d: str) -> DataFrame:
    """Fetch lines in texts: ``(doc_id, host, path, status, bytes)``, one row each."""
    line = r"fetch host=(\S+) path=(\S+) status=(\d+) bytes=([\d,]+)"
    docs = table(spark, d, "documents").where("text is not null")
    hits = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"fetch host=\S+ path=\S+ status=\d+ bytes=[\d,]+"), F.lit(0))).alias("hit"))
    part = lambda i: F.regexp_extract("hit", line, i)
    return hits.select("doc_id", part(1).alias("host"), part(2).alias("path"), part(3).cast("int").alias("status"), F.regexp_replace(part(4), ",", "").cast("long").alias("bytes")).distinct()


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Links of a document: hosts with paths it names, ``(doc_id, pos, host, path, url)``."""
    docs = table(spark, d, "documents").where("text is not null")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+\.[a-z]+\.example(?:/[a-z]+)*"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "raw"))
    return rows.select("doc_id", "pos", F.regexp_extract("raw", r"^([^/]+)", 1).alias("host"), F.regexp_replace("raw", r"^[^/]+", "").alias("path"), F.concat(F.lit("http://"), "raw").alias("url"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Scheduled tasks from orders."""
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SCHEDULED")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("next_run"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), state.alias("state"),
        F.concat(F.lit("type"), F.col("o_custkey") % 5).alias("job_type"), F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("node"), F.col("o_custkey") % 3)).alias("pinned"), (F.col("o_orderkey") % 4).alias("version"),
        F.element_at(F.array(F.lit("SECOND"), F.lit("MINUTE"), F.lit("HOUR"), F.lit("DAILY"), F.lit("MONTHLY"), F.lit("YEARLY"), F.lit(None)), (F.col("o_custkey") % 7 + 1).cast("int")).alias("unit"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("amount"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, 0, cast(o_orderkey % 90 as int), 0)")).alias("lease_until"), F.concat(F.lit("node"), F.col("o_custkey") % 4).alias("submitter"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of task runs from line items, one a run: ``(task_id, run_no, outcome)``."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("run_no")).agg(F.min("l_returnflag").alias("flag"))
    return li.select("task_id", "run_no", F.when(F.col("flag") == "R", "TIMED_OUT").when(F.col("flag") == "A", "FAILED").otherwise("SUCCEEDED").alias("outcome"))


def task_events(spark: SparkSession, d: str) -> DataFrame:
    """A versioned event log per entity with gaps and repeats: ``(ari, version, event_id, event_type, at)``."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    v = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    log = e.select(F.concat(F.lit("task/"), "user_id").alias("ari"), v.alias("version"), "event_id", "event_type", F.col("ts").alias("at"), "value").where("event_id % 13 <> 5")
    return log.unionByName(log.where("event_id % 11 = 0"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as crawled pages: ``(page_id, url, host, dir, hash)``."""
    docs = table(spark, d, "documents")
    k, src = F.col("doc_id"), F.coalesce("source", F.lit("none"))
    host = F.concat(F.lit("h"), k % 20, F.lit(".site"), k % 4, F.lit(".example"))
    folder = F.concat(F.lit("http://"), host, F.lit("/"), src, F.lit("/"))
    return docs.select(k.alias("page_id"), F.concat(folder, k).alias("url"), host.alias("host"), folder.alias("dir"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "fetched_at")


def links(spark: SparkSession, d: str) -> DataFrame:
    """A link for every address a document names, to a page drawn by arithmetic: ``(src, dst, pos)``."""
    top = table(spark, d, "documents").agg(F.max("doc_id") + 1).scalar()
    return mentions(spark, d).select(F.col("doc_id").alias("src"), F.pmod(F.col("doc_id") * 31 + F.col("pos") * 17 + 7, top).alias("dst"), "pos")
