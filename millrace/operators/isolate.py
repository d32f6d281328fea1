"""Keeping held-out and benchmark text apart from training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import all_grams, char_grams


def exclude_seen(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger does not have; rows without a key stay."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")


def lines(text: Column, least: int) -> Column:
    """Trimmed lines of a text with at least so many code points."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def line_overlap(docs: DataFrame, evaluation: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8) -> DataFrame:
    """(id, lines): documents with a line that evaluation text has, and how many different ones."""
    known = evaluation.select(F.explode(lines(F.col(text_col), least)).alias("line")).distinct()
    found = docs.select(id_col, F.explode(lines(F.col(text_col), least)).alias("line")).distinct().join(known, "line", "left_semi")
    return found.groupBy(id_col).agg(F.count(F.lit(1)).alias("lines"))


def gram_overlap(docs: DataFrame, evaluation: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, grams): documents that share character n-grams with evaluation text, and how many different ones.

    The join keeps few rows, so that what is counted is small; evaluation text is small by its nature, and Spark
    broadcasts its grams if they are.
    """
    known = evaluation.select(F.explode(char_grams(F.col(text_col), n, "none")).alias("gram")).distinct()
    grams = docs.select(id_col, F.explode(all_grams(F.col(text_col), n)).alias("gram"))
    found = grams.join(known, "gram", "left_semi").distinct()
    return found.groupBy(id_col).agg(F.count(F.lit(1)).alias("grams"))


def substring_leaks(docs: DataFrame, strings: DataFrame, id_col: str = "doc_id", text_col: str = "text", string_col: str = "leak", key: int = 8) -> DataFrame:
    """(id, leak): documents that contain one of the strings of at least `key` code points.

    The first `key` code points of a string join with those of every place in a document; only then are the
    strings compared in full, at that place.
    """
    known = strings.where(F.length(string_col) >= key).select(F.col(string_col).alias("leak"), F.substring(string_col, 1, key).alias("k")).distinct()
    places = docs.select(id_col, F.posexplode(all_grams(F.col(text_col), key)).alias("i", "k"))
    met = places.join(known, "k").select(id_col, "i", "leak")
    return met.join(docs.select(id_col, text_col), id_col).where(F.substring(F.col(text_col), F.col("i") + 1, F.length("leak")) == F.col("leak")).select(id_col, "leak").distinct()


def heldout_turns(conversations: DataFrame, heldout: DataFrame, key: Column, conv_col: str = "conv_id", least: int = 8) -> DataFrame:
    """Conversations of which no turn, by its key of at least so many code points, is in the held-out ones."""
    known = heldout.select(key.alias("k")).where(F.length("k") >= least).distinct()
    tainted = conversations.select(conv_col, key.alias("k")).join(known, "k", "left_semi").select(conv_col).distinct()
    return conversations.join(tainted, conv_col, "left_anti")


def group_leaks(df: DataFrame, axes: list[str], split_col: str = "split") -> DataFrame:
    """(axis, value, splits): values of an axis that are in more than one split."""
    melted = df.select(split_col, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])).alias("x")).where("x.value is not null")
    found = melted.groupBy("x.axis", "x.value").agg(F.array_join(F.sort_array(F.collect_set(split_col)), ",").alias("splits"), F.count_distinct(split_col).alias("n"))
    return found.where("n > 1").drop("n")


def isolation_receipt(df: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """(left_split, right_split, shared): different keys that two splits share, for each two that share any."""
    one = df.select(F.col(key).alias("k"), F.col(split_col).alias("s")).distinct()
    pairs = one.alias("a").join(one.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.s") < F.col("b.s")))
    return pairs.groupBy(F.col("a.s").alias("left_split"), F.col("b.s").alias("right_split")).agg(F.count(F.lit(1)).alias("shared"))
