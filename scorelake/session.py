"""Session helpers: a local builder for tests and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scorelake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Wiring for tests, the bench and the entry points: where a local session has no checkpoint
    folder it gets one, and its Python workers find this package. On a cluster both come with the
    job (``spark.checkpoint.dir``; a wheel, or ``--py-files``)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # replies repeat keys; the last value counts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows are whole documents
    context = spark.sparkContext
    if context.master.startswith("local"):
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        known = context.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's checkpoint folder. A job without
    either stops here: a driver-local folder would be invisible to the executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over the session's shuffle partitions: for rows that cost far more to work on than to
    move, and come from a few scan tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not collect on the driver. A scan is judged by the size of its files and
    an exploded scan no differently, so rows that compress well would be broadcast however many they are."""
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside frees its shuffles as soon as it is complete; else they fill the executors' disks until the
    driver happens to collect its garbage. Not for ``toLocalIterator``, which reads its last shuffle later."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What ``materialise`` writes inside is removed when the block ends: for a step whose results are written elsewhere.
    A path taken off the list that is given stays."""
    token = _written.set(paths := [])
    try:
        yield paths
    finally:
        _written.reset(token)
        for path in paths:
            remove(spark, path)


def parts(df: DataFrame, *keys: Column | str, n: int = 4) -> list[DataFrame]:
    """``df`` in ``n`` parts by the hash of ``keys``, for rows that are shuffled and written one part after the other with
    ``freed``: only one part of them is in shuffles at a time."""
    return [df.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) for i in range(n)]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives
    executor loss, and the way to read an expensive input more than once."""
    path = f"{shared_folder(df.sparkSession)}/scorelake-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
