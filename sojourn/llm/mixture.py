"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import prepare
from sojourn.session import write_once

#: Seed of the draws and of the order.
SEED = 1
#: Without given weights, a source's share follows the power of its size: 1 keeps the shares, 0 makes them equal.
TEMPERATURE = 0.5


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_docs, rate) of each source; rate is how often a document of it is wanted on average.

    `weights` has source and weight (0 or more, in any unit). A source it doesn't list has weight 0. The
    expected number of documents is that of the input. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))))
    else:
        given = weights.groupBy(F.col("source").alias("wanted")).agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(given, F.expr("source <=> wanted"), "left").drop("wanted").na.fill(0.0, ["weight"])
    weighted = write_once(weighted)
    docs_in_all, weights_in_all = weighted.agg(F.sum("n_docs"), F.sum("weight")).first()
    if not weights_in_all:
        return weighted.select("source", "n_docs", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / weights_in_all * docs_in_all / F.col("n_docs")
    return weighted.select("source", "n_docs", rate.alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, steps): P(X <= k) for k = 0, 1, ... of each source's Poisson distribution.

    The steps go up to where a double can tell them from 1; a source with rate 0 has none. They are running sums over
    a row per step, so their number costs in proportion, and they are added in the order of k on every machine.
    """
    rate, k = F.col("rate"), F.col("k")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    rows = rates.where(rate > 0).select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = F.sum(F.when(k == 0, -rate).otherwise(F.log(rate / F.nullif(k, F.lit(0))))).over(so_far)
    sums = rows.withColumn("log_p", log_p).withColumn("p", F.sum(F.exp("log_p")).over(so_far))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda step: step["p"])
    return sums.groupBy("source").agg(steps.alias("steps"))


def uniform(seed: int, doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from 52 bits of the md5 of seed and id."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, temperature: float = TEMPERATURE
) -> DataFrame:
    """Each row of `docs` as often as its Poisson draw says, all in a random order.

    The draw of a document inverts the distribution with its source's rate at a hash of seed and id, so rows
    of one id are drawn alike and a lost executor repeats the same draws. The copies of a row are spread over
    the partitions by a hash of all its columns (but for maps, which Spark doesn't hash), so rows without an id or
    under one id are spread as well. Other columns are passed on, whatever their names. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    rates = source_rates(docs.select("source"), weights, temperature)
    # written, so that its size is known when Spark chooses between broadcast and shuffle
    steps = write_once(poisson_steps(rates))
    hashed = [c for c, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))]
    rows = docs.select(
        F.struct("*").alias("row"), F.col("source").alias("name"), uniform(seed).alias("draw"),
        F.xxhash64(F.lit(seed), F.lit("order"), *hashed).alias("content"),
    )
    copies = F.size(F.filter("steps", lambda p: p <= F.col("draw")))
    drawn = rows.join(steps, F.expr("source <=> name")).select("row", "content", copies.alias("copies"))
    return (
        drawn.where("copies > 0")
        .select("row", "content", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row", F.xxhash64("content", "copy").alias("order"))
        .repartition("order")
        .sortWithinPartitions("order")
        .select("row.*")
    )
