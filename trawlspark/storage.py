"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a local master that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="trawl-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Folders of checkpoints that the innermost open ``scratch`` block of this thread will remove.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lost executors cost no recomputation, lineage ends here."""
    checkpoint_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    folders = _scratch.get()
    if folders is not None:
        file = held._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            folders.append(file.get())
    return held


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark can reach; one that is gone is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is removed at the end: for work whose result is written by then, as what is read lazily later
    would miss its input. What other threads cut meanwhile stays."""
    folders: list[str] = []
    before = _scratch.set(folders)
    try:
        yield
    finally:
        _scratch.reset(before)
        for folder in folders:
            remove(spark, folder)
