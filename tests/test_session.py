"""Tables written once, and what is left on disk of them."""

import glob
import os

from pyspark.sql import functions as F

from sojourn.session import SHUFFLE_CLEANUP, release, stored, write_once


def _shuffles(spark) -> set[str]:
    root = spark.conf.get("spark.local.dir", "/tmp")
    return set(glob.glob(f"{root}/blockmgr-*/*/shuffle_*"))


def _there(file: str) -> bool:
    return os.path.exists(file.removeprefix("file://"))


def _counted(spark):
    return spark.range(20_000).groupBy((F.col("id") * 7 % 1009).alias("k")).agg(F.count("*").alias("n"))


def test_written_tables_leave_no_shuffle_files(spark):
    before, setting = _shuffles(spark), spark.conf.get(SHUFFLE_CLEANUP)
    table = write_once(_counted(spark))
    with stored(_counted(spark).orderBy("k")) as again:
        assert again.exceptAll(table).count() == 0
        gone, kept = again.inputFiles(), table.inputFiles()
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert gone and kept and not any(map(_there, gone)) and all(map(_there, kept))
    release(spark)
    assert not any(map(_there, kept))
    reading = _shuffles(spark) - before  # of exceptAll and count only
    write_once(_counted(spark))
    assert _shuffles(spark) - before <= reading
    release(spark)


def test_a_table_that_was_used_before_it_is_written(spark):
    counted = _counted(spark)
    rows = sorted(counted.collect())
    assert sorted(write_once(counted).collect()) == rows == sorted(counted.collect())
    release(spark)
