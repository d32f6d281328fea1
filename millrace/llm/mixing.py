"""Mixing sources to target weights by Poisson replication.

Every source has a rate: the mean number of times that a document of it is to appear. A document's own count
inverts the Poisson distribution with that mean at a point that a hash of its id and the seed gives. Documents
are exploded by their counts and shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import hash_long, uniform, without
from millrace.session import Scratch

#: Up to so many sources, the table of rates is broadcast; beyond, it is joined by the source.
BROADCAST_SOURCES = 20_000
OUT = ("copy", "n_copies", "shuffle_key")


def poisson_cdf(rate: Column) -> Column:
    """The array of P(X <= k), k = 0, 1, ... up to where it is 1 to double precision; null for a rate of 0."""
    top = F.ceil(rate + F.lit(12) * F.sqrt(rate) + F.lit(25)).cast("int")
    first = F.struct((-rate).alias("lp"), F.array(F.exp(-rate)).alias("cdf"))

    def add(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(lp.alias("lp"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + F.exp(lp))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), first, add, lambda s: s["cdf"]))


def source_rates(
    sizes: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0
) -> DataFrame:
    """(source, size) to (source, rate): rate = weight / sum of weights * epochs * total size / size.

    `weights` has the target share of each source; a source without one gets 0. Without `weights`, the shares
    are size ** temperature. A source with no characters gets rate 0 under either.
    """
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError("weights must not be negative, nor all 0")
        weight = F.lit(0.0)
        for name, w in sorted(weights.items()):
            weight = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(weight)
    weighted = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    totals = weighted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    return weighted.crossJoin(F.broadcast(totals)).select(  # one row
        "source",
        F.when((F.col("size") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * F.lit(float(epochs)) * F.col("sizes") / F.col("size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix(
    docs: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = "mix-v1",
) -> DataFrame:
    """`docs` with each row repeated by its Poisson count, in a random global order.

    Adds copy (from 1), n_copies and shuffle_key. A source's size is its characters; a null source is a source
    by itself, which only the tempered shares reach. A null id hashes as an empty string; repeated rows of one
    id get the same count each, as the count is a function of the id. Rows with count 0 go, and so do those of
    a source with rate 0. An empty table gives an empty result. Input columns named as output ones are replaced.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")).alias("size"))
    rates = Scratch(spark, "mix").cut(source_rates(sizes, weights=weights, temperature=temperature, epochs=epochs), "rates")
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.where("rate > 0").select(F.col("source").alias("__mr_source"), poisson_cdf(F.col("rate")).alias("__mr_cdf"))
    side = F.broadcast(rates) if few else rates
    u = F.col("__mr_u")
    return (
        without(docs, *OUT)
        .withColumn("__mr_u", uniform(seed + ":count", F.col(id_col)))
        .withColumn("__mr_spread", F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
        .join(side, F.col(source_col).eqNullSafe(F.col("__mr_source")))
        .withColumn("n_copies", F.size(F.filter("__mr_cdf", lambda c: c < u)))
        .where("n_copies > 0")
        .drop("__mr_source", "__mr_cdf", "__mr_u")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", hash_long(seed + ":order", F.col(id_col), F.col("copy")))
        # Rows with one id share their keys; their texts, and for rows without an id where they are read, spread them.
        .repartition("shuffle_key", F.xxhash64(text_col), "__mr_spread")
        .drop("__mr_spread")
        .sortWithinPartitions("shuffle_key")
    )
