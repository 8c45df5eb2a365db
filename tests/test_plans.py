"""What Spark makes of the operators on skewed rows."""

import contextlib

import pytest
from pyspark.sql import functions as F

from sojourn.functions.nulls import ascending
from sojourn.operators.cohort import only_in, restrict_to
from sojourn.operators.dedupe import dedupe_first
from sojourn.operators.joins import label_codes, lookup, person_weights
from sojourn.operators.topk import top_n_with_ties
from sojourn.plans import custody


@contextlib.contextmanager
def settings(spark, **values):
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A third of the rows have one key; eight files, so that there are several map tasks."""
    path = str(tmp_path_factory.mktemp("hot") / "rows.parquet")
    key = F.when(F.col("i") % 3 == 0, F.lit(7)).otherwise(F.col("i"))
    rows = spark.range(240_000).select(F.col("id").alias("i")).withColumn("k", key.cast("string"))
    rows.withColumn("text", F.sha2(F.col("i").cast("string"), 256)).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(200_000).select(F.col("id").cast("string").alias("k"))


@pytest.mark.parametrize("joined", ["semi", "weights", "lookup", "label"])
def test_hot_join_keys_are_split(spark, hot, keys, joined):
    """Also where the other side has just been aggregated by the same key."""
    small = dict(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="100KB",
    )
    named = keys.withColumn("name", F.col("k"))
    with settings(spark, **small):
        if joined == "semi":
            df = restrict_to(hot, keys, "k")
        elif joined == "weights":
            stints = hot.select(F.col("k").alias("unique_identifier"), "text", F.lit(False).alias("likely_duplicate"))
            df = custody.arrested_stints(stints, keys.withColumnRenamed("k", "unique_identifier"))
        elif joined == "lookup":
            df = lookup(hot, named, "k")
        else:
            df = label_codes(hot, named.groupBy(F.col("k").alias("code")).agg(F.min("name").alias("name")), "k", "label")
        assert "skew=true" in plan_of(df)


def test_keys_are_counted_before_the_shuffle(spark, hot):
    for df in (person_weights(hot, "k"), only_in(hot, hot.limit(0), "k")):
        plan = plan_of(df)
        assert plan.rindex("HashAggregate") > plan.rindex("Exchange hashpartitioning")


def test_first_rows_are_chosen_before_the_shuffle(spark, hot):
    plan = plan_of(dedupe_first(hot, ["k"], ascending("i")))
    assert "row_number(), 1, Partial" in plan


def test_ties_need_no_global_window(spark, hot):
    plan = plan_of(top_n_with_ties(person_weights(hot, "k", "n"), "n", 3))
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
