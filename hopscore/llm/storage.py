"""Shared folders for written steps: every executor reads and writes them, and they outlive a lost executor."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from hopscore.session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below ``spark.checkpoint.dir``; local sessions without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in a shared folder and read it back: what follows never replays what came before, so that its shuffle files
    are removed at once and not when the driver next collects garbage."""
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of saved frames that nothing will read again."""
    for frame in frames:
        for folder in {path.rpartition("/")[0] for path in frame.inputFiles()}:
            system, path = fs.FileSystem.from_uri(folder)
            if system.get_file_info(path).type == fs.FileType.Directory:
                system.delete_dir(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path on it, for files that are no tables."""
    return fs.FileSystem.from_uri(uri)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a partition, after which the worker gives the memory it no longer uses back to the system: workers stay
    for later tasks, several to an executor, and what they keep would count against the executor."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Free memory of Python, Arrow and the C library."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
