"""Session set-up and durable cut points."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(master)
        .appName("chainspan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder checkpoints go to.

    Clusters name it in ``spark.checkpoint.dir``. Only a local master may fall back to a folder of its own:
    on a cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Row order and partition boundaries survive, so later passes over the copy see the same runs even when
    executors are lost in between.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


# Folders made and not yet removed, by application; those made inside ``recorded`` belong to whoever opened it.
_WRITTEN: dict[str, list[str]] = {}
_OWNERS = threading.local()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the checkpoint folder, to be removed by ``discard_written`` or the owner of the step."""
    path = f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"
    owners = getattr(_OWNERS, "lists", None)
    (owners[-1] if owners else _WRITTEN.setdefault(spark.sparkContext.applicationId, [])).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a columnar table in the checkpoint folder and continue from it.

    For results several later steps read a few columns each of; row order is not kept, ``durable`` is for that. The table
    stays until ``discard_written``, or until whoever opened ``recorded`` around this call removes it.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that this thread makes inside. Whoever opens it removes them, once what reads them is stored."""
    owners = _OWNERS.__dict__.setdefault("lists", [])
    made: list[str] = []
    owners.append(made)
    try:
        yield made
    finally:
        owners.remove(made)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders in whatever file system they are."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def discard_written(spark: SparkSession) -> int:
    """Remove the folders made in this application that nobody else owns; returns how many.

    For use once the results that read them are stored.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    remove(spark, paths)
    return len(paths)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_chainspan_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "chainspan.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("chainspan", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._chainspan_shipped = True
