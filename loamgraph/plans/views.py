"""SQL twins of ``loamgraph.sources.domain``: name -> common table expression."""

VIEWS = {
    "trade": "SELECT src, dst, weight FROM (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) QUALIFY weight > 1.25 * avg(weight) OVER ()",
    "nations": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS ord FROM nation",
    "heap_nodes": "SELECT event_id AS id, event_id AS ord FROM events WHERE event_id >= 1",
    "heap": "SELECT event_id >> 1 AS src, event_id AS dst FROM events WHERE event_id >= 2",
    "fan": "SELECT DISTINCT src, dst FROM (SELECT event_id AS dst, unnest(CASE event_id % 3 WHEN 0 THEN [event_id // 3, event_id // 4] WHEN 1 THEN [event_id // 2] ELSE [event_id // 2, event_id // 5] END) AS src FROM events WHERE event_id >= 2) WHERE src >= 1",
    "heap_cyclic": "SELECT event_id >> 1 AS src, event_id AS dst FROM events WHERE event_id >= 2 UNION ALL SELECT event_id, event_id >> 2 FROM events WHERE event_id >= 400 AND event_id % 97 = 0 AND substring(bin(event_id), 2, 1) = '0'",
    "bipartite": "SELECT DISTINCT l_orderkey AS src, -l_partkey - 1 AS dst FROM lineitem",
    "tag_current": "SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY tenant_id, tag_id ORDER BY version DESC, updated_at DESC, deleted DESC, name DESC, color DESC NULLS LAST) = 1",
    "node_current": "SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY tenant_id, node_id ORDER BY version DESC, updated_at DESC) = 1",
    "assignments": "SELECT tenant_id, entity_type, entity_id, tag_id, min(entity_seq) AS entity_seq, min(created_at) AS first_at FROM entity_tags WHERE tag_id IS NOT NULL GROUP BY ALL",
    "tag_log": "SELECT event_id + 1 AS seq, 's' || (user_id % 2) AS shard, 't' || (user_id % 3) AS tenant, CASE WHEN event_type = 'error' THEN 'TAGS_DETACHED' ELSE 'TAGS_ATTACHED' END AS type, event_type || ':' || (user_id % 10) AS tag, ts AS at_time FROM events",
    "fetches": r"""SELECT DISTINCT doc_id, regexp_extract(hit, 'host=(\S+)', 1) AS host, regexp_extract(hit, 'path=(\S+)', 1) AS path, CAST(regexp_extract(hit, 'status=(\d+)', 1) AS INTEGER) AS status, CAST(replace(regexp_extract(hit, 'bytes=([\d,]+)', 1), ',', '') AS BIGINT) AS bytes
FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'fetch host=\S+ path=\S+ status=\d+ bytes=[\d,]+')) AS hit FROM documents WHERE text IS NOT NULL)""",
    "mentions": r"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, regexp_extract(raw, '^([^/]+)', 1) AS host, regexp_replace(raw, '^[^/]+', '') AS path, 'http://' || raw AS url
FROM (SELECT doc_id, unnest(f) AS raw, generate_subscripts(f, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+\.[a-z]+\.example(?:/[a-z]+)*') AS f FROM documents WHERE text IS NOT NULL))""",
    "pages": "SELECT doc_id AS page_id, 'http://h' || doc_id % 20 || '.site' || doc_id % 4 || '.example/' || coalesce(source, 'none') || '/' || doc_id AS url, 'h' || doc_id % 20 || '.site' || doc_id % 4 || '.example' AS host, 'http://h' || doc_id % 20 || '.site' || doc_id % 4 || '.example/' || coalesce(source, 'none') || '/' AS dir, sha256(coalesce(text, '')) AS hash, fetched_at FROM documents",
    "links": "SELECT doc_id AS src, (doc_id * 31 + pos * 17 + 7) % (SELECT max(doc_id) + 1 FROM documents) AS dst, pos FROM mentions",
    "tasks": """SELECT o_orderkey AS task_id, o_orderdate AS next_run, 6 - CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE 'SCHEDULED' END AS state,
'type' || (o_custkey % 5) AS job_type, CASE WHEN o_orderkey % 6 = 0 THEN 'node' || (o_custkey % 3) END AS pinned, o_orderkey % 4 AS version,
(['SECOND', 'MINUTE', 'HOUR', 'DAILY', 'MONTHLY', 'YEARLY', NULL])[o_custkey % 7 + 1] AS unit, CAST(o_orderkey % 5 + 1 AS INTEGER) AS amount,
CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_minutes(CAST(o_orderkey % 90 AS BIGINT)) END AS lease_until, 'node' || (o_custkey % 4) AS submitter FROM orders""",
    "runs": "SELECT l_orderkey AS task_id, l_linenumber AS run_no, CASE min(l_returnflag) WHEN 'R' THEN 'TIMED_OUT' WHEN 'A' THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome FROM lineitem GROUP BY ALL",
    "task_events": """SELECT * FROM (SELECT 'task/' || user_id AS ari, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_id, event_type, ts AS at_time, value FROM events) WHERE event_id % 13 <> 5
UNION ALL SELECT * FROM (SELECT 'task/' || user_id AS ari, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_id, event_type, ts AS at_time, value FROM events) WHERE event_id % 13 <> 5 AND event_id % 11 = 0""",
}


def using(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views in front; a ``WITH`` of its own continues the list."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    word = "WITH RECURSIVE " if recursive else "WITH "
    rest = body.strip()
    return f"{word}{head}, {rest[5:]}" if rest.startswith("WITH ") else f"{word}{head} {rest}"


def rendezvous_sql(key: str, shards: list[str]) -> str:
    """SQL of ``tagsearch.rendezvous``: FNV-1a over the bytes of key, a zero byte and shard, one mixing round, signed maximum."""
    big = "CAST(18446744073709551616 AS UHUGEINT)"
    code = lambda text: f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substring({text}, i, 1)) AS UHUGEINT))"
    start, factor, mix = (f"CAST({x} AS UHUGEINT)" for x in (14695981039346656037, 1099511628211, 18397679294719823053))
    zero = "[CAST(0 AS UHUGEINT)]"

    def weight(shard: str) -> str:
        codes = f"[{start}] || {code(key)} || {zero} || {code(repr(shard))}"
        h = f"list_reduce({codes}, lambda h, x: (xor(h, x) * {factor}) % {big})"
        h = f"list_reduce([{h}, CAST(0 AS UHUGEINT)], lambda h, x: (xor(h, h >> 33) * {mix}) % {big})"
        h = f"list_reduce([{h}, CAST(0 AS UHUGEINT)], lambda h, x: xor(h, h >> 33))"
        return f"(CASE WHEN {h} >= CAST(9223372036854775808 AS UHUGEINT) THEN CAST({h} AS HUGEINT) - CAST(18446744073709551616 AS HUGEINT) ELSE CAST({h} AS HUGEINT) END)"

    named = sorted(shards)
    return f"(SELECT s FROM (SELECT unnest([{', '.join(map(repr, named))}]) AS s, unnest([{', '.join(map(weight, named))}]) AS w) ORDER BY w DESC, s LIMIT 1)"
