"""Whole tables replaced so that a reader finds the old rows or the new ones, and never half of either.

New rows are written beside the table and counted; then the table's folder is renamed away, the new one takes its name,
and the old one goes. The file system's rename of a folder is one step (on HDFS and local disks; an object store without
such a rename can't give this). A writer that dies leaves folders whose names tell how far it came: `recover` finishes the
swap if the new rows are whole, or puts the old ones back, and `opened` does so before it reads. One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The steps of a swap, in order; a test stops after each.
STEPS = ("written", "checked", "moved_away", "moved_in", "cleared")


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._new(path))

    def rename(self, path: str, to: str) -> None:
        if not self._fs.rename(self._new(path), self._new(to)):
            raise OSError(f"can't rename {path} to {to}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._new(path), True)

    def beside(self, kind: str) -> list[str]:
        """The folders .name.kind-* beside the table."""
        top, name = self.path.rsplit("/", 1)
        found = self._fs.globStatus(self._new(f"{top}/.{name}.{kind}-*"))
        return sorted(s.getPath().toString() for s in found) if found else []

    def aside(self, kind: str, tag: str) -> str:
        top, name = self.path.rsplit("/", 1)
        return f"{top}/.{name}.{kind}-{tag}"


def _after(step: str) -> None:
    """A writer may die here; tests do so."""


def _read(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def replaced(df: DataFrame, path: str, fmt: str = "json") -> int:
    """Write df as the whole table at path, which may hold an older one (df may be read from it). Returns its rows."""
    spark = df.sparkSession
    recover(spark, path)
    folder, tag = _Folder(spark, path), uuid.uuid4().hex
    new, old = folder.aside("new", tag), folder.aside("old", tag)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format(fmt).options(**({"ignoreNullFields": "false"} if fmt == "json" else {})).save(new)
    _after("written")
    n, there = seen.get["n"], _read(spark, new, fmt, df.schema).count()
    if n != there:
        folder.delete(new)
        raise OSError(f"wrote {there} rows of {n}; the table at {path} is as it was")
    ready = folder.aside("ready", tag)
    folder.rename(new, ready)
    _after("checked")
    if folder.exists(folder.path):
        folder.rename(folder.path, old)
    _after("moved_away")
    folder.rename(ready, folder.path)
    _after("moved_in")
    folder.delete(old)
    _after("cleared")
    return there


def recover(spark: SparkSession, path: str) -> str:
    """Bring a table into one of its two states after a writer died: "whole" (nothing to do), "finished" (the new rows
    are in place) or "restored" (the old ones are)."""
    folder, state = _Folder(spark, path), "whole"
    if not folder.exists(folder.path):
        # Rows that were checked are whole; else the table's old rows come back.
        for kind, done in (("ready", "finished"), ("old", "restored")):
            if found := folder.beside(kind):
                folder.rename(found[-1], folder.path)
                state = done
                break
    for kind in ("new", "ready", "old"):
        for left in folder.beside(kind):
            folder.delete(left)
    return state


def opened(spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None) -> DataFrame:
    """The table at path, after a writer's death too."""
    recover(spark, path)
    return _read(spark, path, fmt, schema)
