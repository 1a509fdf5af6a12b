"""Crawl analytics over a static corpus of pages and links.

Pages are ``(page_id, url, host, dir, hash)``, links ``(src, dst, pos)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.urls import LEARN_VALUES, MAX_VARIANTS, registrable_domain_sql, without_param_sql
from loamgraph.operators.skew import first_in_order, sized_join, with_places
from loamgraph.session import Scratch

RETRIES, MAX_HOPS = 3, 10


# --- admission and traversal ----------------------------------------------


def admit(asked: DataFrame, seen: DataFrame, remaining: int, order: list[str]) -> DataFrame:
    """``asked`` (key, depth, ...) with ``verdict``: ADMITTED, SHALLOWER, SEEN or OVER_BUDGET.

    Of several requests for one key the first by ``order`` counts.  The budget
    cuts the new keys in that order with a distributed top-k.
    """
    first = asked.groupBy("key").agg(F.min(F.struct(*order, *[c for c in asked.columns if c not in ("key", *order)])).alias("r")).select("key", "r.*")
    known = seen.select("key", F.col("depth").alias("seen_depth"))
    judged = first.join(known, "key", "left")
    fresh = judged.where("seen_depth is null")
    inside = first_in_order(fresh, [*order, "key"], remaining, Scratch(asked.sparkSession, "admit")).select("key", F.lit(True).alias("fits"))
    out = judged.join(inside, "key", "left")
    verdict = F.when(F.col("fits"), "ADMITTED").when(F.col("seen_depth").isNull(), "OVER_BUDGET").when(F.col("depth") < F.col("seen_depth"), "SHALLOWER").otherwise("SEEN")
    return out.withColumn("verdict", verdict).drop("fits", "seen_depth")


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, allowed: Column) -> DataFrame:
    """``(page_id, depth, parent)`` of admitted pages, breadth first.

    ``allowed`` says over page columns what may be followed (scope, traps).
    Within a level pages are admitted by (parent, position); when the budget is
    used up the crawl ends.  Depths are exact, as levels are finished in order.
    """
    scratch = Scratch(pages.sparkSession, "crawl")
    open_ids = pages.where(allowed).select(F.col("page_id").alias("p"))
    arcs = scratch.keep(links.join(open_ids, F.col("dst") == F.col("p"), "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos")))
    start = first_in_order(seeds.select("page_id").distinct(), ["page_id"], max_pages, scratch).select("page_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    seen = scratch.log(start)
    admitted = seen.last.count()
    for depth in range(1, max_depth + 1):
        reached = arcs.join(seen.last.select(F.col("page_id").alias("src")), "src").groupBy(F.col("dst").alias("page_id")).agg(F.min(F.struct("src", "pos")).alias("via"))
        fresh = reached.join(seen.all.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(depth).alias("depth"), F.col("via.src").alias("parent"), F.col("via.pos").alias("pos"))
        level = scratch.keep(fresh)
        n = min(level.count(), max_pages - admitted)
        if not n:
            break
        seen.append(first_in_order(level, ["parent", "pos", "page_id"], n, scratch).drop("pos") if n == max_pages - admitted else level.drop("pos"))
        admitted += n
    return seen.all


def relaxed_depths(links: DataFrame, seeds: DataFrame, weightless: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``(page_id, depth)`` with links costing 1 and redirects or canonical links costing 0.

    Each level is closed over the free links before the next begins.
    """
    scratch = Scratch(links.sparkSession, "relax")
    paid = scratch.keep(links.select("src", "dst").distinct())
    free = scratch.keep(weightless.select("src", "dst").distinct()) if weightless is not None else None
    done = scratch.log(seeds.select("page_id").distinct().withColumn("depth", F.lit(0)))

    def reach(arcs: DataFrame, front: DataFrame, depth: int) -> bool:
        met = arcs.join(front.select(F.col("page_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("page_id")).distinct()
        return done.append(met.join(done.all.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(depth)))

    depth = 0
    while True:
        while free is not None and reach(free, done.last, depth):
            pass
        if max_depth is not None and depth >= max_depth or not reach(paid, done.all.where(F.col("depth") == depth), depth + 1):
            return done.all
        depth += 1


def scope_key(host: Column, scope: str) -> Column:
    return F.lit("*") if scope == "ANY" else registrable_domain_sql(host) if scope == "SAME_DOMAIN" else host


def in_scope(pages: DataFrame, seeds: DataFrame, scope: str) -> DataFrame:
    keys = seeds.select(scope_key(F.col("host"), scope).alias("k")).distinct()
    return pages.withColumn("k", scope_key(F.col("host"), scope)).join(keys, "k", "left_semi").drop("k")


def cap_variants(urls: DataFrame, key: Column, order: str, cap: int = MAX_VARIANTS) -> DataFrame:
    """Query variants of one path beyond the cap marked ``over``; urls without a query have no key."""
    keyed = urls.withColumn("_k", key)
    counted = with_places(keyed.where("_k is not null"), ["_k"], [order], Scratch(urls.sparkSession, "variants")).withColumn("over", F.col("place") >= cap).drop("place")
    return counted.unionByName(keyed.where("_k is null").withColumn("over", F.lit(False))).drop("_k")


def admit_assets(asked: DataFrame, seen: DataFrame, downloaded: list[str], remaining: int) -> DataFrame:
    """Assets ``(key, depth, src, pos, type)``, leaves at their page's depth: ``admit`` with the status of what is admitted.

    Types that are downloaded are QUEUED, all others stay REFERENCED nodes; both
    count against the budget.
    """
    judged = admit(asked, seen, remaining, ["depth", "src", "pos"])
    kind = F.when(F.col("type").isin(downloaded), "QUEUED").otherwise("REFERENCED")
    return judged.withColumn("status", F.when(F.col("verdict") == "ADMITTED", kind))


# --- content ----------------------------------------------------------------


def content_owners(pages: DataFrame) -> DataFrame:
    """Each page with the first claimant of its bytes in its directory; others are DUPLICATE."""
    owner = pages.groupBy("hash", "dir").agg(F.min("page_id").alias("owner"))
    return pages.join(owner, ["hash", "dir"]).select("page_id", "owner", F.when(F.col("page_id") == F.col("owner"), "FETCHED").otherwise("DUPLICATE").alias("status"))


def resolve(nodes: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """``(id, target)``: redirects and duplicates followed to a node with content within ``hops``, else null.

    ``nodes(id, next, has_content)``; a join per hop, stopping when nothing moves.
    """
    scratch = Scratch(nodes.sparkSession, "resolve")
    table = scratch.keep(nodes.select("id", "next", "has_content"))
    step = table.select(F.col("id").alias("k"), F.col("next").alias("k_next"), F.col("has_content").alias("k_has"))
    at = table.select("id", F.col("id").alias("at"), F.col("has_content").alias("ok"), "next")
    for _ in range(hops - 1):
        moving = at.where("not ok and next is not null")
        if moving.isEmpty():
            break
        moved = moving.join(step, F.col("next") == F.col("k"), "left").select("id", F.col("next").alias("at"), F.coalesce("k_has", F.lit(False)).alias("ok"), F.col("k_next").alias("next"))
        at = scratch.keep(at.where("ok or next is null").unionByName(moved))
    return at.select("id", F.when(F.col("ok"), F.col("at")).alias("target"))


def follow_redirects(nodes: DataFrame, max_hops: int = 5) -> DataFrame:
    """``(id, target, outcome)``: FETCHED behind at most ``max_hops`` redirects, TOO_MANY hops, a LOOP back or a target that is GONE.

    ``nodes(id, next)`` with null ``next`` where a page answers itself.
    """
    ends = resolve(nodes.select("id", "next", F.col("next").isNull().alias("has_content")), max_hops + 1)
    # where no page was reached the walk says why: doubling would overshoot a loop, so hops are taken one by one
    step = nodes.select(F.col("id").alias("k"), F.col("next").alias("k_next"))
    lost = ends.where("target is null").select("id").join(nodes.select("id", F.col("next").alias("at")), "id").withColumn("outcome", F.lit(None).cast("string"))
    for _ in range(max_hops):
        moved = lost.join(step, F.col("at") == F.col("k"), "left")
        gone = F.when(F.col("k").isNull(), "GONE").when(F.col("at") == F.col("id"), "LOOP")
        lost = moved.select("id", F.when(F.col("outcome").isNull(), F.col("k_next")).otherwise(F.col("at")).alias("at"), F.coalesce("outcome", gone).alias("outcome"))
    why = lost.select("id", F.coalesce("outcome", F.lit("TOO_MANY")).alias("why"))
    return ends.join(why, "id", "left").select("id", "target", F.coalesce("why", F.lit("FETCHED")).alias("outcome"))


def sitemap_crawl(pages: DataFrame, sitemap: DataFrame, links: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``(page_id, depth, recorded)``: breadth first over the sitemap's links, which are the scope; links in pages are only recorded.

    A page that redirects goes on with its own successors in the sitemap.
    """
    known = pages.select(F.col("page_id").alias("k"))
    arcs = sitemap.join(known, F.col("dst") == F.col("k"), "left_semi")
    depth = relaxed_depths(arcs, roots, max_depth=max_depth)
    n = links.groupBy("src").agg(F.count("*").alias("recorded"))
    return depth.join(n, F.col("page_id") == F.col("src"), "left").select("page_id", "depth", F.coalesce("recorded", F.lit(0)).alias("recorded"))


def graph_catalog(log: DataFrame) -> DataFrame:
    """``(tenant, name, owner, status)`` of named graphs from ``(tenant, name, seq, owner, action)``.

    The first registration owns a name; only its owner's first READY or FAILED
    after it counts; until then the graph is LOADING.
    """
    key = ["tenant", "name"]
    first = log.where("action = 'REGISTER'").groupBy(*key).agg(F.min("seq").alias("reg"), F.min_by("owner", "seq").alias("own"))
    done = log.where("action in ('READY', 'FAILED')").join(first, key).where((F.col("owner") == F.col("own")) & (F.col("seq") > F.col("reg")))
    ended = done.groupBy(*key).agg(F.min_by("action", "seq").alias("status"))
    return first.join(ended, key, "left").select(*key, F.col("own").alias("owner"), F.coalesce("status", F.lit("LOADING")).alias("status"))


def latest_snapshots(fetches: DataFrame, *key: str) -> DataFrame:
    """Newest content per key; at equal times the greatest hash."""
    best = F.max(F.struct("fetched_at", "hash")).alias("b")
    return fetches.groupBy(*key).agg(best).select(*key, "b.fetched_at", "b.hash")


def reuse_plan(pages: DataFrame, snapshots: DataFrame, as_of: Column, max_age: str) -> DataFrame:
    """REUSE a fresh snapshot, ask CONDITIONAL for an old one, FETCH without one."""
    s = snapshots.select(F.col("url").alias("s_url"), F.col("fetched_at").alias("s_at"))
    out = pages.join(s, F.col("url") == F.col("s_url"), "left")
    plan = F.when(F.col("s_at").isNull(), "FETCH").when(F.col("s_at") > as_of - F.expr(f"interval {max_age}"), "REUSE").otherwise("CONDITIONAL")
    return out.withColumn("plan", plan).drop("s_url", "s_at")


def retry_rule(status: Column, attempt: Column, backoff_ms: int) -> Column:
    """Milliseconds to wait before the next attempt, or null where there is none."""
    again = ((status == 0) | (status == 429) | (status >= 500)) & (attempt < RETRIES)
    return F.when(again, (F.lit(backoff_ms) * F.pow(F.lit(2), attempt)).cast("long"))


def frontier_order(tasks: DataFrame, delay_ms: int) -> DataFrame:
    """Earliest start of each task: per host by (depth, seq), one at a time, a delay apart."""
    return with_places(tasks, ["host"], ["depth", "seq"], Scratch(tasks.sparkSession, "frontier"), "turn").withColumn("not_before_ms", (F.col("turn") * delay_ms).cast("long"))


def replayed(tasks: DataFrame, commits: DataFrame, owners: DataFrame, draining: DataFrame) -> DataFrame:
    """Tasks ``(part, off)`` that are delivered again after a change of members, at least once: not committed, in a part that moved, and not being finished by its old owner.

    ``owners(part, before, after)``; a live old owner finishes what it is ``draining``.
    """
    key = ["part", "off"]
    left = tasks.join(commits.select(*key), key, "left_anti").join(draining.select(*key), key, "left_anti")
    moved = owners.where(~F.col("before").eqNullSafe(F.col("after")) & F.col("after").isNotNull())
    return sized_join(left, moved, ["part"], Scratch(tasks.sparkSession, "replay")).select(*key, "before", "after")


def job_outcomes(log: DataFrame, chain: tuple[str, ...] = ("QUEUED", "RUNNING"), terminal: tuple[str, ...] = ("COMPLETED", "FAILED", "CANCELLED")) -> DataFrame:
    """``(job, status, ended)`` after transitions ``(job, seq, from_status, to_status)``, each applied only in the status it names.

    A status is left once, by the first transition from it after it was entered;
    so each job ends at most once, with one terminal event (``ended`` its number).
    """
    out = log.select("job").distinct().withColumns({"status": F.lit(chain[0]), "since": F.lit(None).cast("long"), "ended": F.lit(None).cast("long")})
    for step in chain:
        asked = log.where(F.col("from_status") == step).join(out.where(F.col("status") == step).select("job", "since"), "job").where(F.col("since").isNull() | (F.col("seq") > F.col("since")))
        left = asked.groupBy("job").agg(F.min(F.struct("seq", "to_status")).alias("t"))
        out = out.join(left, "job", "left")
        out = out.select("job", F.coalesce("t.to_status", "status").alias("status"), F.coalesce("t.seq", "since").alias("since"), F.coalesce(F.when(F.col("t.to_status").isin(*terminal), F.col("t.seq")), F.col("ended")).alias("ended"))
    return out.select("job", "status", "ended")


def host_schedule(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("host").agg(F.max("not_before_ms").alias("not_before_ms"))


def close_tasks(tasks: DataFrame, closings: DataFrame) -> DataFrame:
    """Pending tasks per job when each (hash, depth, attempt) closes once, however often it is reported."""
    key = ["job", "hash", "depth", "attempt"]
    done = closings.dropDuplicates(key).select(*key, F.lit(1).alias("closed"))
    return tasks.dropDuplicates(key).join(done, key, "left").groupBy("job").agg(F.count_if(F.col("closed").isNull()).alias("pending"), F.count("closed").alias("closed"))


def job_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nine counters of a job from its nodes (status, type, reused) and edges."""
    n = nodes.agg(
        F.count("*").alias("discovered"), F.count_if(F.col("status") == "QUEUED").alias("pending"), F.count_if((F.col("status") == "FETCHED") & (F.col("type") == "PAGE")).alias("pages"),
        F.count_if((F.col("status") == "FETCHED") & (F.col("type") != "PAGE")).alias("assets"), F.count_if(F.col("reused")).alias("reused"), F.count_if(F.col("status") == "DUPLICATE").alias("duplicates"),
        F.count_if(F.col("status").isin("FAILED", "TOO_LARGE")).alias("failed"),
    )
    return n.withColumn("edges", edges.agg(F.count("*")).scalar())


def out_links(links: DataFrame, crawled: DataFrame) -> DataFrame:
    inside = crawled.select(F.col("page_id").alias("p")).distinct()
    return links.join(inside, F.col("dst") == F.col("p"), "left").withColumn("in_crawl", F.col("p").isNotNull()).drop("p")


# --- parameters -------------------------------------------------------------


def learned_params(votes: DataFrame) -> DataFrame:
    """``(host, param)`` found irrelevant: enough distinct values with equal content and no counter-example.

    ``votes(host, param, value, same)``.
    """
    agg = votes.groupBy("host", F.lower("param").alias("param")).agg(F.countDistinct(F.when(F.col("same"), F.col("value"))).alias("n"), F.bool_or(~F.col("same")).alias("differs"))
    return agg.where((F.col("n") >= LEARN_VALUES) & ~F.col("differs")).select("host", "param")


def param_votes(snapshots: DataFrame, params: list[str]) -> DataFrame:
    """Votes from pages ``(url, host, hash)`` whose URL without one parameter was fetched as well."""
    plain = snapshots.select(F.col("url").alias("o_url"), F.col("hash").alias("o_hash"))
    out = None
    for p in params:
        value = F.regexp_extract("url", rf"(?i)[?&]{p}=([^&]*)", 1)
        mine = snapshots.where(F.col("url").rlike(rf"(?i)[?&]{p}=")).select("host", "hash", value.alias("value"), without_param_sql(F.col("url"), p).alias("bare"))
        one = mine.join(plain, F.col("bare") == F.col("o_url")).select("host", F.lit(p).alias("param"), "value", (F.col("hash") == F.col("o_hash")).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


# --- sitemaps -----------------------------------------------------------------


def sitemap_roots(rows: DataFrame) -> DataFrame:
    """``(sitemap, root)`` from ``(sitemap, src, dst)``; a page without links has a row with null ``dst``.

    The rule goes through a file in order, so a sitemap, which its protocol
    limits to 50,000 pages, is one group; sitemaps run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        pages, linked = set(), set()
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            pages.add(int(a))
            if b is not None and b == b:
                pages.add(int(b))
                out.setdefault(int(a), []).append(int(b))
                if a != b:
                    linked.add(int(b))
        roots, met = [], set()
        for start in [*sorted(pages - linked), *sorted(pages)]:
            if start in met:
                continue
            roots.append(start)
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in met:
                    met.add(x)
                    stack += out.get(x, ())
        return pd.DataFrame({"sitemap": pdf["sitemap"].iloc[0], "root": roots})

    return rows.groupBy("sitemap").applyInPandas(run, "sitemap string, root long")


# --- export -------------------------------------------------------------------


def manifest(nodes: DataFrame) -> DataFrame:
    """``(url, status, file)``: the file that holds each node's bytes; pointers name their owner's.

    ``nodes(id, url, url_hash, status, type, hash, ext, next)``.
    """
    owners = resolve(nodes.select("id", "next", F.col("status").isin("FETCHED", "NOT_MODIFIED").alias("has_content")))
    file = F.when(F.col("type") == "PAGE", F.concat(F.lit("pages/"), "url_hash", F.lit(".html"))).when(F.col("type") == "CSS", F.concat(F.lit("assets/"), "url_hash", F.lit(".css"))).otherwise(F.concat(F.lit("assets/"), "hash", "ext"))
    files = nodes.select(F.col("id").alias("target"), file.alias("file"))
    return nodes.join(owners, "id").join(files, "target", "left").select("url", "status", F.coalesce("file", F.lit("")).alias("file"))


def put_blobs(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Content rows really added, with their two-level key; equal bytes are stored once."""
    fresh = incoming.dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")
    return fresh.withColumn("key", F.concat(F.substring("hash", 1, 2), F.lit("/"), "hash"))
