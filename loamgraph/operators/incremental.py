"""Processing only new or changed records (problem 3).

A run rereads from the oldest transaction that was open at the last run and
removes what has been processed before by an anti-join of (key, version) pairs
with a ledger of all pairs ever delivered.  ``open_since`` names that transaction
for each tenant and shard; without it the whole source is compared, so that a
row counts as new however late it comes and whatever its number and time.

A run writes under names of its own attempt and becomes visible through one
commit marker (see ``commits``): a run that fails before that leaves nothing
the next one would read, and an attempt thought lost can't replace what
another has committed.

Against a progress table alone (``changed_since``) the last run's ledger is what
lies at or below its marks.  It is written as the first commit of a run
history; the oldest open transaction is looked up as the oldest row that the
marks have not passed, and a run delivers what the ledger doesn't hold.

Defined results: a null tenant or shard is a value of its own; rows without a
key part named in ``required`` are no records; repeated rows of one version
are one record; a null sequence number or time is not above any mark, so such
a row is new only while its key has no progress row (later, while it is in no
ledger); an empty table or an empty progress table is allowed (everything is
then new); other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.commits import CommitLog
from loamgraph.operators.skew import is_small, sized_join
from loamgraph.session import Scratch

ASSIGNMENT = ("tenant_id", "entity_type", "entity_id", "tag_id")
VERSION = ("source_shard", "entity_seq", "created_at")
SHARD = ("tenant_id", "source_shard")
PAIR = "tenant_id string, entity_type string, entity_id string, tag_id long, source_shard string, entity_seq long, created_at timestamp_ntz"
MARKS = "tenant_id string, source_shard string, last_seq long, updated_at timestamp_ntz"


def governing(progress: DataFrame) -> DataFrame:
    """One row per (tenant, shard): the highest ``last_seq``, among equals the latest ``updated_at``."""
    top = F.max(F.struct("last_seq", "updated_at")).alias("m")
    return progress.groupBy(*SHARD).agg(top).select(*SHARD, "m.last_seq", "m.updated_at", F.lit(True).alias("known"))


def beyond(at: Column) -> Column:
    """True where a row lies beyond its progress row, with the time mark moved to ``at``."""
    return F.coalesce(F.col("known").isNull(), F.lit(False)) | F.coalesce(F.col("entity_seq") > F.col("last_seq"), F.lit(False)) | F.coalesce(F.col("created_at") > at, F.lit(False))


def records(source: DataFrame) -> DataFrame:
    return source.select(*ASSIGNMENT, *VERSION).where("tag_id is not null")


def open_transactions(source: DataFrame, progress: DataFrame) -> DataFrame:
    """``(tenant_id, source_shard, oldest_open)``: the oldest row of each shard with a number the marks have not reached.

    Its transaction began before the last run ended, or after; either way all
    that the run has left out began no earlier.
    """
    marked = sized_join(records(source), governing(progress), list(SHARD), Scratch(source.sparkSession, "open"))
    return marked.where("entity_seq > last_seq").groupBy(*SHARD).agg(F.min("created_at").alias("oldest_open"))


def without_processed(window: DataFrame, ledger: DataFrame) -> DataFrame:
    """Anti-join on key and version, null-safe; each pair once."""
    pairs = ledger.select(*[F.col(c).alias(f"_l_{c}") for c in (*ASSIGNMENT, *VERSION)])
    on = F.lit(True)
    for c in (*ASSIGNMENT, *VERSION):
        on = on & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    return window.join(pairs, on, "left_anti").select(*ASSIGNMENT, *VERSION).distinct()


def changed_since(source: DataFrame, progress: DataFrame) -> DataFrame:
    """New (key, version) pairs against a progress table alone."""
    runs = IncrementalRuns(source.sparkSession, Scratch(source.sparkSession, "runs").base)
    runs.begin(source, progress)
    return runs.run(source, open_transactions(source, progress))


def changed_assignments(source: DataFrame, progress: DataFrame) -> DataFrame:
    return changed_since(source, progress).select(*ASSIGNMENT).distinct()


class IncrementalRuns:
    """Runs over a growing source with state in a shared folder.

    ``batches/N-attempt``: what run N delivered; ``progress/N-attempt``: the marks
    after it; ``ledger/attempt``: the pairs processed before the first run;
    ``commits/N``: the marker that names them and makes them valid.  The ledger of
    a run is that first part and all committed batches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), CommitLog(spark, folder)

    def _read(self, paths: list[str], schema: str = PAIR) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self, source: DataFrame, progress: DataFrame) -> None:
        """The state after an earlier run of which only the marks are known: its ledger are the pairs at or below both."""
        attempt = self.log.attempt()
        at = {"ledger": f"{self.folder}/ledger/{attempt}", "progress": f"{self.folder}/progress/{attempt}"}
        marks = governing(progress)
        marks.select(*SHARD, F.col("last_seq").cast("long"), "updated_at").write.parquet(at["progress"])
        held = self._read([at["progress"]], MARKS).withColumn("known", F.lit(True))
        marked = sized_join(records(source), held, list(SHARD), Scratch(self.spark, "begin"))
        marked.where(~beyond(F.col("updated_at"))).select(*ASSIGNMENT, *VERSION).write.parquet(at["ledger"])
        self.log.publish(0, at)

    def committed(self) -> list[int]:
        return self.log.numbers()

    def delivered(self) -> DataFrame:
        """All rows of committed runs."""
        return self._read([c["batch"] for c in self.log.all() if "batch" in c])

    def run(self, source: DataFrame, open_since: DataFrame | None = None) -> DataFrame:
        """Delivers what is new in ``source``; ``open_since(tenant_id, source_shard, oldest_open)`` bounds what is read again.

        Of a shard the rows from ``oldest_open`` or, if that is earlier, the mark
        on are compared, and those above the marks' number; all rows of a shard
        that no earlier run has seen.
        """
        commits = self.log.all()
        number = self.log.numbers()[-1] + 1 if commits else 0
        ledger = self._read([c[k] for c in commits for k in ("ledger", "batch") if k in c])
        marks = self._read([commits[-1]["progress"]] if commits else [], MARKS)
        rows = records(source)
        if open_since is not None:
            scratch = Scratch(self.spark, "window")
            again = open_since.select(*SHARD, "oldest_open", F.lit(None).cast("long").alias("last_seq"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(False).alias("known"))
            both = marks.select(*SHARD, F.lit(None).cast("timestamp_ntz").alias("oldest_open"), "last_seq", "updated_at", F.lit(True).alias("known")).unionByName(again)
            bounds = scratch.keep(both.groupBy(*SHARD).agg(F.least(F.min("oldest_open"), F.max("updated_at")).alias("since"), F.max("last_seq").alias("last_seq"), F.max("known").alias("known")))
            small = is_small(bounds)
            old = F.col("known") & F.coalesce(F.col("created_at") < F.col("since"), F.lit(False)) & ~F.coalesce(F.col("entity_seq") > F.col("last_seq"), F.lit(False))
            window = lambda df: sized_join(df, bounds, list(SHARD), scratch, "left", small=small).where(~F.coalesce(old, F.lit(False)))
            rows, ledger = window(rows), window(ledger)
        attempt = f"{number}-{self.log.attempt()}"
        at = {"batch": f"{self.folder}/batches/{attempt}", "progress": f"{self.folder}/progress/{attempt}"}
        without_processed(rows, ledger).write.parquet(at["batch"])
        fresh = self._read([at["batch"]])
        seen = fresh.select(*SHARD, F.col("entity_seq").alias("last_seq"), F.col("created_at").alias("updated_at"))
        marks.unionByName(seen).groupBy(*SHARD).agg(F.max("last_seq").alias("last_seq"), F.max("updated_at").alias("updated_at")).write.parquet(at["progress"])
        self.log.publish(number, at)
        return fresh
