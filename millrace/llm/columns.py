"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and words as the contracts define them: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A double in (0, 1) from the MD5 of seed and keys; a null key counts as an empty string."""
    parts = [F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_long(seed: str, *keys: Column) -> Column:
    """A non-negative long under 2**60 from the MD5 of seed and keys."""
    parts = [F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops the columns whose names, in any case, an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
