"""Numbered commits in a shared folder.

A run writes its tables under names of its own attempt and then publishes one
small marker that names them.  The marker appears whole or not at all, and the
first writer of a number wins: an attempt that was thought lost can't replace
what another has committed, nor does anybody read what it wrote.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{name}")  # noqa: SLF001
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    @staticmethod
    def attempt() -> str:
        """A name no other attempt has."""
        return uuid.uuid4().hex

    def numbers(self) -> list[int]:
        path, fs = self._path("")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()) if fs.exists(path) else []

    def read(self, number: int) -> dict:
        path, fs = self._path(str(number))
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def all(self) -> list[dict]:
        return [self.read(n) for n in self.numbers()]

    def publish(self, number: int, info: dict) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway  # noqa: SLF001
        temp, fs = self._path(f"_{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(info).encode()))
        out.close()
        final, _ = self._path(str(number))
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        try:
            context.rename(temp, final, how)  # fails where the number is taken
        except Exception as e:
            fs.delete(temp, False)
            raise RuntimeError(f"run {number} was committed by another writer") from e
