"""Session construction and the engine's handling of shared scratch space.

Nothing here relies on a machine-local folder on a cluster: intermediate
tables go to the folder the cluster names in ``spark.checkpoint.dir``.  Only
where that setting is absent and all runs in one process (tests, a laptop) a
local folder is used; a cluster without the setting is refused.

Intermediate tables live until ``release`` or the end of the session; a long
session puts its queries into ``with scratch_scope():``, at whose end the tables
made inside are deleted.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loamgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; explicit ``conf`` wins."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=defaults)
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, wherever they run: a zip in the shared folder, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_loam_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("loamgraph", os.path.relpath(full, here)))
    name = f"{scratch_root(spark)}/loam-package-{uuid.uuid4().hex}/loamgraph.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(name)  # noqa: SLF001
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)  # noqa: SLF001
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(name)
    sc._loam_shipped = True  # noqa: SLF001


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), f"loamgraph-{os.getpid()}")
    os.makedirs(local, exist_ok=True)
    return "file://" + local


_MADE: list[Scratch] = []


def release(since: int = 0) -> None:
    """Deletes the intermediate tables made so far (or since a place in their list); results must have been read or written."""
    while len(_MADE) > since:
        _MADE.pop()._sweep()  # noqa: SLF001


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes at its end the intermediate tables that were made inside."""
    since = len(_MADE)
    try:
        yield
    finally:
        release(since)


class Scratch:
    """Written tables that cut lineage; each can be dropped once a later one replaces it.

    A written table is read again by any executor, so losing executors costs
    only the tasks that ran there.  Unlike an RDD checkpoint it is computed
    once and stays columnar.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/loam-{what}-{uuid.uuid4().hex}"
        self.made = 0
        _MADE.append(self)

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        path = f"{self.base}/{self.made}"
        self.made += 1
        (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loam_path = path  # noqa: SLF001
        return out

    def keep_split(self, df: DataFrame, flag: str) -> tuple[DataFrame | None, DataFrame | None]:
        """The rows where ``flag`` is true and those where it is false, written by one job; None for no rows.

        Whether a part is empty is seen from the folder, without another job.
        """
        path = f"{self.base}/{self.made}"
        self.made += 1
        df.write.mode("overwrite").partitionBy(flag).parquet(path)
        schema = df.drop(flag).schema
        out = []
        for value in ("true", "false"):
            part = f"{path}/{flag}={value}"
            out.append(self.spark.read.schema(schema).parquet(part) if self._exists(part) else None)
            if out[-1] is not None:
                out[-1]._loam_path = part  # noqa: SLF001
        return out[0], out[1]

    def log(self, first: DataFrame) -> Log:
        return Log(self, first)

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)  # noqa: SLF001

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_loam_path", None)
        if path:
            self._delete(path)

    def tidy(self) -> None:
        """Has the driver collect its garbage: until then shuffle files of finished queries stay on the executors' disks."""
        self.spark.sparkContext._jvm.System.gc()  # noqa: SLF001

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001

    def _sweep(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:  # noqa: SLF001
                self._delete(self.base)
        except Exception:  # the context is gone, and with it the means to delete
            pass


class Log:
    """A written table that grows by a folder a round and is read as one scan of them all."""

    def __init__(self, scratch: Scratch, first: DataFrame):
        self.scratch, self.schema, self.paths = scratch, first.schema, []
        self.append(first)

    @property
    def rounds(self) -> int:
        return len(self.paths)

    @property
    def last(self) -> DataFrame:
        return self.scratch.spark.read.schema(self.schema).parquet(self.paths[-1])

    @property
    def all(self) -> DataFrame:
        return self.scratch.spark.read.schema(self.schema).parquet(*self.paths)

    def append(self, rows: DataFrame) -> bool:
        """Writes one more round; False, and nothing kept, where it has no rows."""
        kept = self.scratch.keep(rows)
        if self.paths and kept.isEmpty():
            self.scratch.drop(kept)
            return False
        self.paths.append(kept._loam_path)  # noqa: SLF001
        return True


atexit.register(release)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give Python-heavy stages at least one partition a core.

    A small table may sit in one file; it is then redistributed by ``keys``
    (deterministic, unlike a round robin).  Larger inputs are left as read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2, *keys)
