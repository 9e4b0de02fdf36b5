"""Reading the parquet tables, and cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    held = tempfile.mkdtemp(prefix="ship-")
    atexit.register(shutil.rmtree, held, True)
    archive = f"{held}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs on this machine alone (tests) a
    temporary folder is made, which ends with the process; on a cluster that
    has none, an error says so, since a folder of one machine can't be read by
    the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written intermediate tables of one iterative operator.

    ``cut`` writes a frame as parquet into the shared folder and reads it back,
    so that later stages neither recompute nor depend on any executor's disk.
    ``drop`` removes a table that no later plan reads; what is left goes when
    the process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.seen: dict[str, int] = {}
        self.n = 0
        atexit.register(self.close)

    def cut(self, df: DataFrame, **counted: Column) -> DataFrame:
        """The written frame.  ``counted``: aggregates taken while it is written, found in ``seen``.

        They are collected in the tasks that write, each of which counts once,
        so they cost no job of their own.
        """
        self.n += 1
        path = f"{self.base}/{self.n}"
        if counted:
            told = Observation()
            df.observe(told, *[c.alias(n) for n, c in counted.items()]).write.parquet(path)
            self.seen = {n: told.get.get(n) or 0 for n in counted}
        else:
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._last = out
        return out

    def folder(self) -> str:
        """A folder of its own, for what is written by other means; it ends with the rest."""
        self.n += 1
        return f"{self.base}/{self.n}"

    def drop(self, df: DataFrame | None) -> None:
        path = self.paths.pop(id(df), None) if df is not None else None
        if path:
            self._remove(path)

    def close(self) -> None:
        try:
            self._remove(self.base)
        except Exception:  # the session may be gone; local folders still go
            if self.base.startswith("file:"):
                shutil.rmtree(self.base[5:].replace("//", "/"), True)
            elif os.path.isdir(self.base):
                shutil.rmtree(self.base, True)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
