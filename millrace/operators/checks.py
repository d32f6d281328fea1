"""Checks of tables as a clerk would: required, unique, range, choice, product; and gates on what they find.

Each check gives (row_id, check, detail); a missing column fails at once. 0 is a value, blank text is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _issues(df: DataFrame, bad: Column, row_id: str, name: str, detail: Column) -> DataFrame:
    return df.where(bad).select(F.col(row_id).alias("row_id"), F.lit(name).alias("check"), detail.cast("string").alias("detail"))


def required(df: DataFrame, row_id: str, column: str) -> DataFrame:
    return _issues(df, blank(column), row_id, f"required:{column}", F.lit(""))


def unique(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Later rows with a value that an earlier one has; the detail is the first such row."""
    w = Window.partitionBy(column).orderBy(row_id)
    marked = df.where(~blank(column)).withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first(row_id).over(w))
    return _issues(marked, F.col("__n") > 1, row_id, f"unique:{column}", F.col("__first"))


def in_range(df: DataFrame, row_id: str, column: str, low: float, high: float) -> DataFrame:
    """Values that are no number, or out of bounds."""
    x = F.expr(f"try_cast(`{column}` as double)")
    return _issues(df, ~blank(column) & (x.isNull() | (x < low) | (x > high)), row_id, f"range:{column}", F.col(column))


def one_of(df: DataFrame, row_id: str, column: str, choices: list[str]) -> DataFrame:
    return _issues(df, ~blank(column) & ~F.col(column).isin(choices), row_id, f"choice:{column}", F.col(column))


def product(df: DataFrame, row_id: str, factors: tuple[str, str], result: str, tolerance: float = 0.01) -> DataFrame:
    """Rows where the product of two columns is not the third, all three given."""
    a, b = factors
    given = ~blank(a) & ~blank(b) & ~blank(result)
    off = F.abs(F.col(a) * F.col(b) - F.col(result)) > tolerance
    return _issues(df, given & off, row_id, f"product:{result}", F.col(result))


def all_issues(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def summary(df: DataFrame, issues: DataFrame, blocking: list[str]) -> DataFrame:
    """(rows, issues, status): incomplete without rows, blocked by some checks, warning by others, else passed."""
    kinds = issues.agg(F.count(F.lit(1)).alias("issues"), F.coalesce(F.bool_or(F.split("check", ":")[0].isin(blocking)), F.lit(False)).alias("stop"))
    joined = df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(kinds)  # two single rows
    status = F.when(F.col("rows") == 0, "incomplete").when(F.col("stop"), "blocked").when(F.col("issues") > 0, "warning").otherwise("passed")
    return joined.select("rows", "issues", status.alias("status"))


def invalid_ratio(df: DataFrame, valid: Column, most: float) -> DataFrame:
    """(rows, invalid, ratio, passed); no rows don't pass."""
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
    ratio = F.when(F.col("rows") > 0, F.col("invalid") / F.col("rows"))
    return out.withColumn("ratio", ratio).withColumn("passed", F.coalesce(ratio <= most, F.lit(False)))


def policy(df: DataFrame, rules: DataFrame, role: str) -> DataFrame:
    """Adds verdict: no_policy, licence, review or allowed. rules (role, licences array, needs_review)."""
    j = df.join(rules.withColumnRenamed("role", "__role"), F.col(role) == F.col("__role"), "left")
    verdict = F.when(F.col("__role").isNull(), "no_policy").when(~F.array_contains("licences", F.col("licence")), "licence").when(F.col("needs_review") & ~F.col("reviewed"), "review").otherwise("allowed")
    return j.withColumn("verdict", verdict).drop("__role", "licences", "needs_review")


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_only, right_only): rows that only one of two tables has, counted with their repeats."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.agg(F.count(F.lit(1)).alias("left_only")).crossJoin(right.agg(F.count(F.lit(1)).alias("right_only")))


def catalogue_diff(local: DataFrame, upstream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): same, different, local_only or upstream_only."""
    j = local.select(key, F.col(value).alias("__a"), F.lit(True).alias("__l")).join(upstream.select(key, F.col(value).alias("__b"), F.lit(True).alias("__u")), key, "full")
    status = F.when(F.col("__u").isNull(), "local_only").when(F.col("__l").isNull(), "upstream_only").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("different")
    return j.select(key, status.alias("status"))
