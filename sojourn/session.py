"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; everything that depends on the cluster's size is left to the cluster.
RUNTIME = {
    # naive timestamps are compared with dates and formatted, so the zone must not vary
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where a later aggregate would then need one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller made."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and for bench.py."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sojourn")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_OWN: list[tempfile.TemporaryDirectory] = []  # of a local session; removed when Python ends
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for written tables: the one in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="sojourn-"))
    return _OWN[0].name


def scratch_path(spark: SparkSession, suffix: str) -> str:
    """A new path in the shared folder; :func:`release` removes what is written there."""
    path = f"{shared_dir(spark)}/sojourn-{uuid.uuid4().hex}{suffix}"
    _WRITTEN.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Remove all tables the library wrote; for when the results that read them have been used."""
    for path in list(_WRITTEN):
        _remove(spark, path)


#: Remove an execution's shuffle files at its end, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in the block leave no shuffle files behind.

    For tables that are written once and read as files from then on: nothing reads the shuffles again. Spark would
    repeat their stages if something did.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def write_once(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and go on from there.

    Used where later steps read the same rows several times and must see the same ones each time,
    also after an executor was lost. The size of the files then tells Spark what it may broadcast.
    """
    path = scratch_path(df.sparkSession, ".parquet")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`write_once` for a table that nothing reads after the block; it is removed there."""
    path = scratch_path(df.sparkSession, ".parquet")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _remove(df.sparkSession, path)
