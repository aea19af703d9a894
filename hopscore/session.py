"""Session helpers: local sessions for tests and benches, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A single-machine session for tests and benches. On a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hopscore")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; a temporary folder is chosen only for local masters."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hopscore-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that a lost executor never replays what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


FEW_BYTES = 32 << 20  # most measured bytes of a table that is broadcast


def broadcast_if_small(table: DataFrame, *texts: str) -> DataFrame:
    """``table``, marked for a broadcast if the bytes of its text columns, measured by a small job, allow it; else as it is, so that joins with
    it shuffle."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64))
    measured = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(table) if measured <= FEW_BYTES else table


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the checkpoint folder, for tables that are written on the way to a result."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind; else they stay until the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: like ``cut_lineage``, and the plan knows nothing of what came before."""
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored frames; no frame made of them may be used afterwards."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            place.getFileSystem(conf).delete(place, True)
