"""Tag search: boolean queries, lists, pages, postings and assignment changes.

Assignments are ``(tenant_id, entity_type, entity_id, entity_seq, tag_id)``, each
once; tags are current rows.  A query carries three sets of tag ids.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.skew import sized_join
from loamgraph.session import Scratch

ENTITY = ["tenant_id", "entity_type", "entity_id"]
MAX_TERMS, DEFAULT_PAGE, MAX_PAGE, MAX_NAME = 32, 50, 200, 64


@dataclass(frozen=True)
class TagQuery:
    """Entities holding every tag of ``all``, some tag of ``any`` (if given) and none of ``none``."""

    all: frozenset = field(default_factory=frozenset)
    any: frozenset = field(default_factory=frozenset)
    none: frozenset = field(default_factory=frozenset)
    entity_type: str | None = None
    after_seq: int = 0
    limit: int = DEFAULT_PAGE

    def __post_init__(self):
        for k in ("all", "any", "none"):
            object.__setattr__(self, k, frozenset(getattr(self, k)))
        if not self.all and not self.any:
            raise ValueError("a query needs a positive term")
        if len(self.all) + len(self.any) + len(self.none) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms")


def page_size(requested: int | None) -> int:
    return DEFAULT_PAGE if requested is None else max(1, min(MAX_PAGE, requested))


def live(tags: DataFrame) -> DataFrame:
    return tags.where("not coalesce(deleted, false)")


def resolve_terms(query: TagQuery, live_ids: set) -> TagQuery | None:
    """Dead tags in ``all`` empty the result, in ``any`` and ``none`` they drop out; only dead ones in ``any`` empty it."""
    if not query.all <= live_ids:
        return None
    some = query.any & live_ids
    if query.any and not some:
        return None
    return TagQuery(query.all, some, query.none & live_ids, query.entity_type, query.after_seq, query.limit)


def search(assignments: DataFrame, q: TagQuery) -> DataFrame:
    """Entities that match, whole result.

    One pass over the rows of the named tags only (the filter reaches the
    scan), one partial aggregate by entity: no join, and a hot tag costs what
    its rows cost to read.
    """
    terms = sorted(q.all | q.any | q.none)
    rows = assignments.where(F.col("tag_id").isin(terms))
    if q.entity_type is not None:
        rows = rows.where(F.col("entity_type") == q.entity_type)
    if q.after_seq:
        rows = rows.where(F.col("entity_seq") > q.after_seq)
    has = lambda ids: F.col("tag_id").isin(sorted(ids))
    grouped = rows.groupBy(*ENTITY).agg(
        F.min("entity_seq").alias("entity_seq"),
        F.countDistinct(F.when(has(q.all), F.col("tag_id"))).alias("_all") if q.all else F.lit(0).alias("_all"),
        F.bool_or(has(q.any)).alias("_any") if q.any else F.lit(True).alias("_any"),
        F.bool_or(has(q.none)).alias("_none") if q.none else F.lit(False).alias("_none"),
    )
    return grouped.where((F.col("_all") == len(q.all)) & F.col("_any") & ~F.col("_none")).select(*ENTITY, "entity_seq")


def search_semi(assignments: DataFrame, q: TagQuery) -> DataFrame:
    """The same by semi and anti joins on the entity; the other formulation for checks."""
    of = lambda ids: assignments.where(F.col("tag_id").isin(sorted(ids))).select(*ENTITY).distinct()
    base = assignments.where(F.col("tag_id").isin(sorted(q.all or q.any)))
    out = base.groupBy(*ENTITY).agg(F.min("entity_seq").alias("entity_seq"), F.countDistinct("tag_id").alias("n"))
    if q.all:
        out = out.where(F.col("n") == len(q.all))
        if q.any:
            out = out.join(of(q.any), ENTITY, "left_semi")
    if q.none:
        out = out.join(of(q.none), ENTITY, "left_anti")
    if q.entity_type is not None:
        out = out.where(F.col("entity_type") == q.entity_type)
    return out.where(F.col("entity_seq") > q.after_seq).select(*ENTITY, "entity_seq")


def search_sets(assignments: DataFrame, q: TagQuery) -> DataFrame:
    """The same on collected sets; reads every tag of every entity."""
    sets = assignments.groupBy(*ENTITY).agg(F.min("entity_seq").alias("entity_seq"), F.collect_set("tag_id").alias("tags"))
    ids = lambda x: F.array(*[F.lit(i).cast("long") for i in sorted(x)])
    cond = F.size(F.array_except(ids(q.all), "tags")) == 0 if q.all else F.lit(True)
    if q.any:
        cond = cond & F.arrays_overlap("tags", ids(q.any))
    if q.none:
        cond = cond & ~F.arrays_overlap("tags", ids(q.none))
    if q.entity_type is not None:
        cond = cond & (F.col("entity_type") == q.entity_type)
    return sets.where(cond & (F.col("entity_seq") > q.after_seq)).select(*ENTITY, "entity_seq")


def page(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """First ``limit`` + 1 rows by key: the extra one says that there is more."""
    return rows.orderBy(*keys).limit(limit + 1)


# --- postings: bitmaps by tag ---------------------------------------------


def postings(assignments: DataFrame) -> DataFrame:
    """``(tenant_id, source, tag_id, bucket, bits)``: bitmaps of entity numbers, 32,768 to a bucket."""
    return assignments.groupBy("tenant_id", "source_shard", "tag_id", F.bitmap_bucket_number("entity_seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("entity_seq")).alias("bits"))


def search_bitmaps(index: DataFrame, q: TagQuery) -> DataFrame:
    """``(tenant_id, source_shard, total)`` from bitmaps: AND, OR and AND NOT per bucket.

    A missing posting of an ``all`` tag empties its bucket.  a AND NOT b is
    counted as |a| - |a AND b|.
    """
    key = ["tenant_id", "source_shard", "bucket"]
    rows = index.where(F.col("tag_id").isin(sorted(q.all | q.any | q.none)))
    has = lambda ids: F.col("tag_id").isin(sorted(ids))
    every = rows.where(has(q.all)).groupBy(*key).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(q.all)).drop("n") if q.all else None
    some = rows.where(has(q.any)).groupBy(*key).agg(F.bitmap_or_agg("bits").alias("bits")) if q.any else None
    both = lambda a, b: a.unionByName(b).groupBy(*key).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where("n = 2").drop("n")
    hit = both(every, some) if q.all and q.any else every if q.all else some
    out = hit.select(*key, F.bitmap_count("bits").alias("n"))
    if q.none:
        not_in = rows.where(has(q.none)).groupBy(*key).agg(F.bitmap_or_agg("bits").alias("bits"))
        cut = both(hit, not_in).select(*key, (-F.bitmap_count("bits")).alias("n"))
        out = out.unionByName(cut)
    return out.groupBy("tenant_id", "source_shard").agg(F.sum("n").alias("total")).where("total > 0")


# --- lists ----------------------------------------------------------------


def autocomplete(tags: DataFrame, tenant: str, prefix: str, after: str | None, limit: int) -> DataFrame:
    """Live tags by normalised name (byte order) behind a key; no escaping of % or _ is needed."""
    rows = live(tags).where((F.col("tenant_id") == tenant) & F.col("name_norm").startswith(prefix))
    if after is not None:
        rows = rows.where(F.col("name_norm") > after)
    return rows.select("tag_id", "name_norm").orderBy("name_norm", "tag_id").limit(limit + 1)


def usage(assignments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(tenant_id, tag_id, usage)``; asked tags without assignments count 0."""
    counted = assignments.groupBy("tenant_id", "tag_id").agg(F.count("*").alias("usage"))
    if ids is None:
        return counted
    return ids.select("tenant_id", "tag_id").distinct().join(counted, ["tenant_id", "tag_id"], "left").select("tenant_id", "tag_id", F.coalesce("usage", F.lit(0)).alias("usage"))


def with_live_tags(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Assignments of live tags with the tag's names (the scan that feeds an index)."""
    return sized_join(assignments, live(tags).select("tenant_id", "tag_id", "name", "name_norm"), ["tenant_id", "tag_id"], Scratch(tags.sparkSession, "live"))


# --- names ----------------------------------------------------------------


def display_name(raw: str | None) -> str | None:
    """NFKC, trimmed, white space collapsed; null where empty, too long or with control characters."""
    if raw is None:
        return None
    text = " ".join(unicodedata.normalize("NFKC", raw).split())
    bad = not text or len(text) > MAX_NAME or any(unicodedata.category(c) == "Cc" for c in text)
    return None if bad else text


def normalize_name(raw: str | None) -> str | None:
    text = display_name(raw)
    return None if text is None else text.lower()


def normalize_names(col: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize_name, na_action="ignore").astype(object)

    return run(col)


def normalize_sql(col: str) -> Column:
    """The part of normalisation that built-in functions cover: all but NFKC."""
    text = F.trim(F.regexp_replace(F.col(col), r"\s+", " "))
    return F.lower(text)


# --- cursors --------------------------------------------------------------


def seq_cursor(col: str) -> Column:
    """Opaque keyset cursor, base64url without padding of ``s1:<seq>``."""
    return F.rtrim(F.translate(F.base64(F.concat(F.lit("s1:"), F.col(col).cast("string")).cast("binary")), "+/", "-_"), F.lit("="))


def read_seq_cursor(col: str) -> Column:
    """The number in a cursor; null where it is none."""
    padded = F.rpad(F.translate(F.col(col), "-_", "+/"), F.ceil(F.length(col) / 4).cast("int") * 4, F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.regexp_extract(text, r"^s1:(\d+)$", 1).try_cast("long")


# --- changes --------------------------------------------------------------


def attach(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows really added: idempotent union."""
    return wanted.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti")


def detach(current: DataFrame, unwanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows really removed."""
    return current.select(*keys).distinct().join(unwanted.select(*keys).distinct(), keys, "left_semi")


def replace_tags(current: DataFrame, desired: DataFrame, entity: list[str], item: str = "tag_id") -> DataFrame:
    """``(entity..., item, change)`` that turns each entity named in ``desired`` into exactly its rows there."""
    keys = [*entity, item]
    named = current.select(*keys).distinct().join(desired.select(*entity).distinct(), entity, "left_semi")
    a, b = named.withColumn("had", F.lit(1)), desired.where(F.col(item).isNotNull()).select(*keys).distinct().withColumn("want", F.lit(1))
    return a.join(b, keys, "full").where("had is null or want is null").select(*keys, F.when(F.col("had").isNull(), "ADDED").otherwise("REMOVED").alias("change"))


def bulk_attach(current: DataFrame, entities: DataFrame, tags: list[int], keys: list[str]) -> DataFrame:
    """Every entity with every tag of a short list (at most 50), less what is there."""
    if len(tags) > 50:
        raise ValueError("at most 50 tags")
    wanted = entities.distinct().select("*", F.explode(F.array(*[F.lit(t).cast("long") for t in tags])).alias("tag_id"))
    return attach(current, wanted, keys)


def usage_deltas(changes: DataFrame, buckets: int = 16) -> DataFrame:
    """Counter deltas per tag over salted buckets: +1 for added, -1 for removed."""
    delta = F.when(F.col("change") == "ADDED", 1).otherwise(-1)
    salted = changes.select("tenant_id", "tag_id", F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).alias("bucket"), delta.alias("delta"))
    return salted.groupBy("tenant_id", "tag_id", "bucket").agg(F.sum("delta").alias("delta")).groupBy("tenant_id", "tag_id").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def apply_tag_edits(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Outcome of edits ``(tenant_id, tag_id, expected_version, name_norm, delete)``, at most one a tag.

    NOT_FOUND, CONFLICT (stale version), NAME_TAKEN (live in the tenant) or
    APPLIED with the next version; a deleted tag's name gets a tombstone suffix
    and is free again.
    """
    t = tags.select("tenant_id", "tag_id", F.col("version").alias("now"), F.col("name_norm").alias("had"), F.coalesce("deleted", F.lit(False)).alias("dead"))
    # dirty data may hold a name live twice, so both ends of its owners are kept
    taken = live(tags).groupBy(F.col("tenant_id").alias("t_tenant"), F.col("name_norm").alias("taken")).agg(F.min("tag_id").alias("first_owner"), F.max("tag_id").alias("last_owner"))
    out = edits.join(t, ["tenant_id", "tag_id"], "left")
    others = (F.col("first_owner") != F.col("tag_id")) | (F.col("last_owner") != F.col("tag_id"))
    clash = (F.col("tenant_id") == F.col("t_tenant")) & (F.col("name_norm") == F.col("taken")) & others
    out = out.join(taken, clash, "left")
    outcome = F.when(F.col("now").isNull() | F.col("dead"), "NOT_FOUND").when(F.col("now") != F.col("expected_version"), "CONFLICT").when(~F.col("delete") & F.col("taken").isNotNull(), "NAME_TAKEN").otherwise("APPLIED")
    ok = outcome == "APPLIED"
    name = F.when(ok & F.col("delete"), F.concat("had", F.lit("~"), F.col("tag_id"))).when(ok, F.coalesce("name_norm", "had"))
    return out.select("tenant_id", "tag_id", outcome.alias("outcome"), F.when(ok, F.col("now") + 1).alias("version"), name.alias("name_norm"))


def read_at(log: DataFrame, marks: DataFrame, level: str = "SESSION") -> DataFrame:
    """``(tenant, tag, type, seq, by)``: the newest event of each tag that a read sees.

    ``marks(tenant, applied, barrier)``: an index that has applied events up to
    ``applied`` answers, with these, if the read asks for no more (EVENTUAL) or the
    index has reached the caller's ``barrier``; else, or where it has no mark, the
    store answers with all events.
    """
    seen = sized_join(log, marks.select("tenant", "applied", "barrier"), ["tenant"], Scratch(log.sparkSession, "read"), "left")
    indexed = F.coalesce(F.col("applied") >= 0, F.lit(False)) & (F.lit(level == "EVENTUAL") | F.coalesce(F.col("applied") >= F.coalesce("barrier", F.lit(0)), F.lit(False)))
    seen = seen.withColumn("by", F.when(indexed, "index").otherwise("store")).where((F.col("by") == "store") | (F.col("seq") <= F.col("applied")))
    return seen.groupBy("tenant", "tag").agg(F.max(F.struct("seq", "type", "by")).alias("m")).select("tenant", "tag", "m.type", "m.seq", "m.by")


def purge(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Assignments left once those of deleted tags are gone."""
    dead = tags.where("coalesce(deleted, false)").select("tenant_id", "tag_id").distinct()
    return sized_join(assignments, dead, ["tenant_id", "tag_id"], Scratch(tags.sparkSession, "dead"), "left_anti")


def idempotent(requests: DataFrame) -> DataFrame:
    """``(key, seq, outcome)`` of requests (key, seq, body): first runs, equal body replays, other body conflicts."""
    first = requests.groupBy("key").agg(F.min_by(F.sha2("body", 256), "seq").alias("h"), F.min("seq").alias("s"))
    out = requests.join(first, "key")
    kind = F.when(~F.col("key").rlike(r"^[A-Za-z0-9._:-]{1,128}$"), "INVALID").when(F.col("seq") == F.col("s"), "RUN").when(F.sha2("body", 256) == F.col("h"), "REPLAY").otherwise("CONFLICT")
    return out.select("key", "seq", kind.alias("outcome"))


# Fixed values of the placement of tenants: 64-bit FNV-1a of tenant, a zero byte and shard, then one mixing round; weights compare as signed.
FNV_START, FNV_FACTOR, MIX_FACTOR, MIX_SHIFT = 0xCBF29CE484222325, 0x100000001B3, 0xFF51AFD7ED558CCD, 33


def placement_weights(keys: list[str], shard: str) -> np.ndarray:
    """Signed weight of each key for one shard, over all keys a byte position at a time."""
    raw = [k.encode() + b"\0" + shard.encode() for k in keys]
    lens = np.array([len(x) for x in raw], np.int64)
    grid = np.frombuffer(b"".join(x.ljust(int(lens.max(initial=0)), b"\0") for x in raw), np.uint8).reshape(len(raw), -1)
    h = np.full(len(raw), FNV_START, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(grid.shape[1]):
            h = np.where(at < lens, (h ^ grid[:, at]) * np.uint64(FNV_FACTOR), h)
        h = (h ^ (h >> np.uint64(MIX_SHIFT))) * np.uint64(MIX_FACTOR)
    return (h ^ (h >> np.uint64(MIX_SHIFT))).view(np.int64)


def rendezvous(col: Column, shards: list[str]) -> Column:
    """The shard of highest weight for a key, of equal ones the first by name; few keys move when shards change."""
    named = sorted(shards)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        keys = s.dropna().unique().tolist()
        best = np.argmax(np.stack([placement_weights(keys, x) for x in named]), axis=0) if keys else []
        return s.map({k: named[i] for k, i in zip(keys, best, strict=True)})

    return run(col)
