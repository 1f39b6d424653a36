"""Session helpers: shipping this package to workers and cutting lineage.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it, so a lost executor loses
nothing that was written.  Only where that setting is missing (tests, local
runs) a temporary folder of the driver takes its place.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of one Arrow batch: a Python worker holds a batch several times over (Arrow, pandas, strings).
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers once per application, and bound Arrow batches where the session has no bound below."""
    sc = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(spark.conf.get(setting)).rstrip("b")
    if given.lstrip("-").isdigit() and not 0 < int(given) <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="pagequarry")), "pagequarry_src.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for batches of a task, with what it has freed given back to the system at its end.

    A worker serves all stages, and allocators keep what the largest batch took, so
    stages that need no Python would have less memory beside it.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagequarry-checkpoint"))
        folder = sc.getCheckpointDir()
    return folder


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder whose files go when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts lineage without depending on any one executor and keeps column
    pruning for later reads.  The files go when the driver's JVM ends.
    """
    path = temporary_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are sorted, never broadcast.

    Rows of scanned tables take a few bytes each in Parquet and many times that in
    memory, so a table whose files are below the bound for broadcasts may not fit the
    driver.  The hint holds for whatever is selected, filtered or grouped from ``df``.
    """
    return df.hint("merge")


def stage_rows(df: DataFrame, name: str) -> DataFrame:
    """:func:`stage` for a table that grows with the corpus: joins sort it, whatever the size of its files."""
    return sorted_join(stage(df, name))


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stage`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_folder(spark)
    # a folder of ``stage`` is a child of the shared one; nothing else is ever deleted
    own = {os.path.dirname(f) for f in df.inputFiles()}
    for folder in (f for f in own if os.path.basename(os.path.dirname(f)) == os.path.basename(base.rstrip("/"))):
        jpath = jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
