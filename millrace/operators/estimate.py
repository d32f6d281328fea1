"""Design-weighted estimates, distributions and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_totals(sample: DataFrame, probability: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Horvitz-Thompson: estimated rows, and total and weighted mean of each value."""
    w = F.lit(1.0) / F.col(probability)
    aggs = [F.sum(w).alias("rows_estimate")]
    for v in values:
        aggs += [F.sum(w * F.col(v)).alias(f"{v}_total"), (F.sum(w * F.col(v)) / F.sum(w)).alias(f"{v}_mean")]
    return sample.groupBy(*(by or [])).agg(*aggs)


def distribution(df: DataFrame, axis: Column, weight: Column, by: list[str] | None = None) -> DataFrame:
    """(by, value, share): shares of weight, of each group of `by` if given."""
    named = df.select(*(by or []), F.coalesce(axis.cast("string"), F.lit("unknown")).alias("value"), weight.alias("__w"))
    sums = named.groupBy(*(by or []), "value").agg(F.sum("__w").alias("__w"))
    return sums.withColumn("share", F.col("__w") / F.sum("__w").over(Window.partitionBy(*(by or [F.lit(1)])))).drop("__w")


def total_variation(left: DataFrame, right: DataFrame) -> DataFrame:
    """(distance) of two (value, share) tables: half the sum of differences."""
    a, b = left.select("value", F.col("share").alias("x")), right.select("value", F.col("share").alias("y"))
    joined = a.join(b, "value", "full")
    return joined.agg((F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))) / 2).alias("distance"))


def percentiles(df: DataFrame, value: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, fraction, nearest_rank, lower_index): values at ranks ceil(n f) - 1 and floor(f (n - 1)), from 0."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = df.where(F.col(value).isNotNull()).select(*(by or []), value, (F.row_number().over(w.orderBy(value)) - 1).alias("__j"), F.count(F.lit(1)).over(w).alias("__n"))
    asked = ranked.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    near = F.greatest(F.lit(0), F.ceil(F.col("__n") * F.col("fraction")) - 1)
    low = F.floor(F.col("fraction") * (F.col("__n") - 1))
    return asked.groupBy(*(by or []), "fraction").agg(F.max(F.when(F.col("__j") == near, F.col(value))).alias("nearest_rank"), F.max(F.when(F.col("__j") == low, F.col(value))).alias("lower_index"))


def matrix(df: DataFrame, rows: str, columns: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by (rows, columns), by each alone, and in all; `level` names the grouping."""
    named = df.select(F.col(rows).alias("r"), F.col(columns).alias("c"), *[m.alias(k) for k, m in measures.items()])
    cube = named.cube("r", "c").agg(F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("records"), *[F.sum(k).alias(k) for k in measures])
    level = F.element_at(F.array(F.lit("both"), F.lit("rows"), F.lit("columns"), F.lit("all")), F.col("__g").cast("int") + 1)
    return cube.withColumn("level", level).drop("__g")


def metric_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, before, after, delta, direction) of two (metric, value) tables; equal within 1e-12."""
    a, b = left.select("metric", F.col("value").alias("before")), right.select("metric", F.col("value").alias("after"))
    delta = F.col("after") - F.col("before")
    direction = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.abs(delta) <= 1e-12, "equal").when(delta > 0, "up").otherwise("down")
    return a.join(b, "metric", "full").select("metric", "before", "after", delta.alias("delta"), direction.alias("direction"))
