"""Sampling by the order of hashes: reproducible, and independent of how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def bottom_k(df: DataFrame, key: str, k: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """The k rows with the least hashes, of each group of `by` if given."""
    hashed = df.withColumn("__h", hash_order(seed, F.col(key)))
    if not by:
        return hashed.orderBy("__h", key).limit(k).drop("__h")
    w = Window.partitionBy(*by).orderBy("__h", key)
    return hashed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__h", "__r")


def two_waves(frame: DataFrame, order: str, strata: int, seed: str) -> DataFrame:
    """Shards by rank into equal strata, two of each drawn in hash order: adds stratum, wave, probability.

    Row j of n is in stratum floor(((j + 1) * strata - 1) / n).
    """
    whole = Window.partitionBy(F.lit(1))
    ranked = frame.withColumn("__j", F.row_number().over(whole.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    staged = ranked.withColumn("stratum", F.floor(((F.col("__j") + 1) * strata - 1) / F.col("__n")).cast("int"))
    stratum = Window.partitionBy("stratum")
    drawn = staged.withColumn("wave", F.row_number().over(stratum.orderBy(hash_order(seed, F.col(order)), order))).withColumn("__m", F.count(F.lit(1)).over(stratum))
    return drawn.where("wave <= 2").withColumn("probability", F.least(F.lit(2), F.col("__m")) / F.col("__m")).drop("__j", "__n", "__m")


def even_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """Rows i * n // k, i < k, in the order; all rows if there are k or fewer."""
    whole = Window.partitionBy(F.lit(1))
    ranked = df.withColumn("__j", F.row_number().over(whole.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    i = F.ceil(F.col("__j") * F.lit(k) / F.col("__n"))
    return ranked.where((F.col("__n") <= k) | ((F.floor(i * F.col("__n") / F.lit(k)) == F.col("__j")) & (i < k))).drop("__j", "__n")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows taken in turns over the strata, each in hash order: adds turn."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", stratum).limit(n)


def balanced(df: DataFrame, group: str, kind: str, key: str, seed: str) -> DataFrame:
    """Of each group as many rows of every kind as its rarest kind has."""
    w = Window.partitionBy(group, kind).orderBy(hash_order(seed, F.col(key)), key)
    fewest = df.groupBy(group, kind).count().groupBy(group).agg(F.min("count").alias("__least"))
    return df.withColumn("__r", F.row_number().over(w)).join(fewest, group).where(F.col("__r") <= F.col("__least")).drop("__r", "__least")


def weighted(df: DataFrame, weight: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement, by weight: the largest log(u) / weight with u from the hash."""
    u = (F.conv(F.substring(hash_order(seed, F.col(key)), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return df.where(F.col(weight) > 0).withColumn("__x", F.log(u) / F.col(weight)).orderBy(F.desc("__x"), key).limit(k).drop("__x")


def two_stage(df: DataFrame, group: str, key: str, groups: int, rows: int, seed: str) -> DataFrame:
    """`groups` groups in hash order, then `rows` rows of each: adds probability, the product of both stages' shares."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    drawn = sizes.orderBy(hash_order(seed, F.col(group)), group).limit(groups)
    total = sizes.agg(F.count(F.lit(1)).alias("__g"))
    staged = df.join(drawn, group).crossJoin(F.broadcast(total))  # one row
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key))
    share = F.least(F.lit(groups), F.col("__g")) / F.col("__g") * F.least(F.lit(rows), F.col("__n")) / F.col("__n")
    return staged.withColumn("__r", rank).where(F.col("__r") <= rows).withColumn("probability", share).drop("__n", "__g", "__r")


def balanced_turns(df: DataFrame, group: str, teacher: str, key: str, k: int, seed: str) -> DataFrame:
    """Up to k rows of each group, taken in turns over its teachers, each teacher's in hash order: adds turn."""
    turn = F.row_number().over(Window.partitionBy(group, teacher).orderBy(hash_order(seed, F.col(key)), key))
    staged = df.withColumn("turn", turn).where(F.col("turn") <= k)
    return staged.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("turn", teacher))).where(F.col("__r") <= k).drop("__r")


def slice_of(df: DataFrame, tool: str, kind: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows in turns over all (tool, kind), each in hash order."""
    turn = F.row_number().over(Window.partitionBy(tool, kind).orderBy(hash_order(seed, F.col(key)), key))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", tool, kind).limit(n)


def char_budget(df: DataFrame, source: str, key: str, chars: str, weights: dict[str, float], budget: int, seed: str) -> DataFrame:
    """Rows of each source in hash order until they reach its share of the budget by weight; the row that passes it is kept."""
    total = sum(weights.values())
    share = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(budget) * w / total)])[F.col(source)]
    w = Window.partitionBy(source).orderBy(hash_order(seed, F.col(key)), key).rowsBetween(Window.unboundedPreceding, -1)
    staged = df.where(F.col(source).isin(list(weights))).withColumn("chars_before", F.coalesce(F.sum(chars).over(w), F.lit(0)))
    return staged.where(F.col("chars_before") < share)
