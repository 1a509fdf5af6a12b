"""References to records that do not exist (problem 1).

``OrphanState`` keeps, in a shared folder, signed counts per key and moment:
``refs`` of references, ``rows`` and ``live`` of targets.  A batch of changes
becomes deltas: a stored reference counts +1, one that is taken back -1; a new
version of a tag or node takes back what the version before it counted and
counts its own, so an older version that arrives late changes nothing.  Sums
are invertible in every column, times included, as they are part of the key:
a target that is deleted and created anew later has the new time and no other.
Keys with positive references and no existing or live target, or with a
reference before the target's creation, form the current orphan report.

References count by the day of their time, which bounds the state; a key whose
first day lies before its target's creation is a candidate, and the exact times
are compared when its references are brought together.  Partial sums run
map-side: a key holding a third of all references costs a row a day and split.

Defined results:
* a null reference is no reference; a null tenant is a tenant of its own
  (compared null-safe);
* repeated references are reported once, by the earliest ``created_at``;
* of several versions of a target the highest counts, ties by ``updated_at``
  then ``deleted``; a null ``deleted`` means not deleted; null times are
  never late;
* empty inputs give empty outputs; columns other than those named are ignored.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.commits import CommitLog
from loamgraph.operators.skew import sized_join
from loamgraph.session import Scratch
from loamgraph.sources.tables import ID_EPOCH_MS

KEY = ("kind", "tenant_id", "key")


def id_time(col: str) -> Column:
    """Time carried by a time-ordered 64-bit id."""
    return F.expr(f"timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(shiftright({col}, 22) + {ID_EPOCH_MS} as decimal(18, 3)) / 1000)")


def current(df: DataFrame, keys: list[str], version: str, *rest: str) -> DataFrame:
    """The highest version of each key, one row each; ties by the values of ``rest`` in order."""
    rest_cols = [c for c in rest if c not in keys and c != version]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in rest_cols])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"_best.{version}").alias(version), *[F.col(f"_best.{c}").alias(c) for c in rest_cols])


VALUE = ("version", "updated_at", "deleted", "parent_id", "created_at")
CURRENT = "kind string, tenant_id string, id long, now struct<version:long,updated_at:timestamp_ntz,deleted:boolean,parent_id:long,created_at:timestamp_ntz>"
COUNTS = "kind string, tenant_id string, key long, at timestamp_ntz, refs long, rows long, live long"


def tag_versions(tags: DataFrame) -> DataFrame:
    return _versions(tags, "tag", "tag_id", F.col("deleted"), F.lit(None))


def node_versions(nodes: DataFrame) -> DataFrame:
    return _versions(nodes, "node", "node_id", F.lit(False), F.col("parent_id"))


def _versions(df: DataFrame, kind: str, key: str, deleted: Column, parent: Column) -> DataFrame:
    values = F.struct(F.col("version").cast("long").alias("version"), "updated_at", F.coalesce(deleted, F.lit(False)).alias("deleted"), parent.cast("long").alias("parent_id"), "created_at")
    return df.where(F.col(key).isNotNull()).select(F.lit(kind).alias("kind"), "tenant_id", F.col(key).alias("id"), values.alias("now"))


def assignment_refs(entity_tags: DataFrame) -> DataFrame:
    return entity_tags.where("tag_id is not null").select(
        F.lit("entity_tags").alias("ref_table"), F.lit("tag").alias("kind"), "tenant_id",
        F.concat("entity_type", F.lit("/"), "entity_id").alias("row_key"), F.col("tag_id").alias("key"), F.col("created_at").alias("ref_at"),
    )


def content_refs(node_content: DataFrame) -> DataFrame:
    """Bodies have no time of their own; that of their id serves for the report's month only."""
    return node_content.where("node_id is not null").select(
        F.lit("node_content").alias("ref_table"), F.lit("node").alias("kind"), "tenant_id",
        F.col("node_id").cast("string").alias("row_key"), F.col("node_id").alias("key"), id_time("node_id").alias("ref_at"),
    )


def parent_refs(current_rows: DataFrame) -> DataFrame:
    """References of current nodes to their parents, from ``OrphanState.current``."""
    return current_rows.where("kind = 'node' and now.parent_id is not null").select(
        F.lit("nodes").alias("ref_table"), F.lit("node").alias("kind"), "tenant_id",
        F.col("id").cast("string").alias("row_key"), F.col("now.parent_id").alias("key"), F.col("now.created_at").alias("ref_at"),
    )


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of references that appear (+1) or go (-1).  Undated references of node_content can't be late."""
    day = F.when(F.col("ref_table") != "node_content", F.date_trunc("day", "ref_at").cast("timestamp_ntz"))
    return refs.select(*KEY, day.alias("at"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("live"))


def version_deltas(merged: DataFrame) -> DataFrame:
    """Deltas of targets, and of the parents they refer to, from rows ``(kind, tenant_id, id, now, was)``."""
    changed = merged.where(~F.col("was").eqNullSafe(F.col("now")))
    signed = changed.select("kind", "tenant_id", "id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.col("was").alias("v")), F.struct(F.lit(1).cast("long").alias("s"), F.col("now").alias("v")))).alias("d"))
    signed = signed.where("d.v is not null").select("kind", "tenant_id", "id", "d.s", "d.v.*")
    none = F.lit(0).cast("long")
    target = F.struct("kind", "tenant_id", F.col("id").alias("key"), F.col("created_at").alias("at"), none.alias("refs"), F.col("s").alias("rows"), F.when(F.col("deleted"), none).otherwise(F.col("s")).alias("live"))
    parent = F.struct("kind", "tenant_id", F.col("parent_id").alias("key"), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("at"), F.col("s").alias("refs"), none.alias("rows"), none.alias("live"))
    return signed.select(F.explode(F.filter(F.array(target, F.when(F.col("parent_id").isNotNull(), parent)), lambda x: x.isNotNull())).alias("x")).select("x.*")


def apply_deltas(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Counts after ``deltas``; rows whose counts are all zero again leave the state."""
    rows = deltas if state is None else state.select(*deltas.columns).unionByName(deltas)
    summed = rows.groupBy(*KEY, "at").agg(F.sum("refs").alias("refs"), F.sum("rows").alias("rows"), F.sum("live").alias("live"))
    return summed.where("refs <> 0 or rows <> 0 or live <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    """``(kind, tenant_id, key, refs, rows, live, first_ref, target_at)`` of keys that some reference finds missing, deleted or, perhaps, created too late."""
    by_key = state.groupBy(*KEY).agg(
        F.sum("refs").alias("refs"), F.sum("rows").alias("rows"), F.sum("live").alias("live"),
        F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("first_ref"), F.min(F.when(F.col("rows") > 0, F.col("at"))).alias("target_at"),
    )
    return by_key.where("refs > 0 and (rows <= 0 or live <= 0 or first_ref < target_at)")


class OrphanState:
    """Counts and current versions kept in a shared folder, brought forward batch by batch.

    A batch that fails leaves nothing that the next one reads; it is applied
    again.  Of two writers of one batch the first to commit wins.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), CommitLog(spark, folder)

    def _table(self, name: str, schema: str) -> DataFrame:
        done = self.log.numbers()
        return self.spark.read.schema(schema).parquet(self.log.read(done[-1])[name]) if done else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        return self._table("counts", COUNTS)

    def current(self) -> DataFrame:
        """``(kind, tenant_id, id, now)``: the current version of every tag and node."""
        return self._table("current", CURRENT)

    def apply(self, versions: DataFrame, refs: DataFrame, gone: DataFrame | None = None) -> OrphanState:
        """Brings in changed versions of targets and references that appeared or are ``gone``."""
        done = self.log.numbers()
        number = done[-1] + 1 if done else 0
        at = f"{self.folder}/batches/{number}-{self.log.attempt()}"
        both = versions.withColumn("old", F.lit(False))
        if done:
            both = both.unionByName(self.current().withColumn("old", F.lit(True)))
        was = F.max(F.when(F.col("old"), F.col("now"))).alias("was") if done else F.any_value(F.when(F.col("old"), F.col("now"))).alias("was")
        both.groupBy("kind", "tenant_id", "id").agg(F.max("now").alias("now"), was).write.parquet(f"{at}/current")
        merged = self.spark.read.parquet(f"{at}/current")
        deltas = reference_deltas(refs).unionByName(version_deltas(merged))
        if gone is not None:
            deltas = deltas.unionByName(reference_deltas(gone, -1))
        apply_deltas(self.counts() if done else None, deltas).write.parquet(f"{at}/counts")
        self.log.publish(number, {"current": f"{at}/current", "counts": f"{at}/counts"})
        return self


def faults(refs: DataFrame, state: DataFrame) -> DataFrame:
    """One row per reference and reason, with the month of the reference.

    The faulty keys come first, so only references to them are brought
    together.  Few faulty keys are broadcast and the references stay where they
    are; of many, those with a large share of the references still are, so no
    task gathers the references of one hot orphan.
    """
    bad = orphan_keys(state).select(*KEY, "rows", "live", "target_at")
    met = sized_join(refs, bad, list(KEY), Scratch(refs.sparkSession, "orphans"))
    late = (F.col("ref_table") != "node_content") & (F.col("ref_at") < F.col("target_at"))
    met = met.where((F.col("rows") <= 0) | (F.col("live") <= 0) | F.coalesce(late, F.lit(False)))
    hit = met.groupBy("ref_table", "tenant_id", "row_key", "key", "rows", "live", "target_at").agg(F.min("ref_at").alias("ref_at"))
    reasons = F.filter(
        F.array(
            F.when(F.col("rows") <= 0, F.lit("missing")),
            F.when((F.col("rows") > 0) & (F.col("live") <= 0), F.lit("deleted")),
            F.when((F.col("rows") > 0) & (F.col("ref_table") != "node_content") & (F.col("ref_at") < F.col("target_at")), F.lit("late")),
        ),
        lambda x: x.isNotNull(),
    )
    return hit.select("ref_table", "tenant_id", "row_key", F.col("key").alias("ref_id"), F.explode(reasons).alias("reason"), F.date_format("ref_at", "yyyy-MM").alias("month"))


def find_orphans(entity_tags: DataFrame, tags: DataFrame, nodes: DataFrame, node_content: DataFrame, folder: str | None = None, recent_days: int = 30) -> DataFrame:
    """Faults of the stored tables: the state up to ``recent_days`` before the newest assignment, then the changes since, then the report.

    ``folder`` keeps the state for later batches; without one it lives as long as the session.
    """
    spark = entity_tags.sparkSession
    state = OrphanState(spark, folder or Scratch(spark, "orphan-state").base)
    newest = entity_tags.agg(F.max("created_at")).first()[0]
    cut = F.lit(newest and newest - timedelta(days=recent_days)).cast("timestamp_ntz")
    for early in (True, False):
        part = lambda df, at: df.where(F.coalesce(at <= cut, F.lit(True)) if early else F.coalesce(at > cut, F.lit(False)))  # noqa: B023, E731
        versions = tag_versions(part(tags, F.col("updated_at"))).unionByName(node_versions(part(nodes, F.col("updated_at"))))
        state.apply(versions, assignment_refs(part(entity_tags, F.col("created_at"))).unionByName(content_refs(part(node_content, id_time("node_id")))))
    refs = assignment_refs(entity_tags).unionByName(parent_refs(state.current())).unionByName(content_refs(node_content))
    return faults(refs, state.counts())


def orphan_report(found: DataFrame) -> DataFrame:
    """Faulty references and distinct faulty targets per table, month and reason."""
    return found.groupBy("ref_table", "month", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("tenant_id", "ref_id").alias("n_targets"))
