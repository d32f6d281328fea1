"""Splits and identities from hashes: the same row always lands in the same place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import hex_bucket


def bucket(seed: str, group: Column, digits: int = 12, modulus: int = 10_000) -> Column:
    return hex_bucket(F.sha2(F.concat_ws(":", F.lit(seed), group), 256), digits) % modulus


def split_of(seed: str, group: Column) -> Column:
    """test under 50 of 10000, calibration under 100, dev under 200, else train."""
    b = bucket(f"{seed}:split", group)
    return F.when(b < 50, "test").when(b < 100, "calib").when(b < 200, "dev").otherwise("train")


def phase_of(seed: str, group: Column) -> Column:
    """1, 2 or 3 with shares of 5, 5 and 4 in 14."""
    b = bucket(f"{seed}:phase", group, 12, 14)
    return F.when(b < 5, 1).when(b < 10, 2).otherwise(3)


def priority_of(seed: str, key: Column) -> Column:
    return hex_bucket(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 15)


def weighted_split(seed: str, key: Column, shares: list[tuple[str, float]]) -> Column:
    """By cumulative shares of the first 8 hex digits over 0xFFFFFFFF; the last name takes the rest."""
    x = hex_bucket(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 8) / F.lit(float(0xFFFFFFFF))
    out, upto = F.lit(shares[-1][0]), sum(s for _, s in shares)
    for name, share in reversed(shares[:-1]):
        upto = sum(s for _, s in shares[: [n for n, _ in shares].index(name) + 1])
        out = F.when(x < upto, F.lit(name)).otherwise(out)
    return out


def group_key(*candidates: Column) -> Column:
    """The first identity that a row has, in order of priority."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])


def with_forced(chosen: Column, key: Column, forced: dict[str, list[str]]) -> Column:
    """A split by hash, but for keys that are listed for one."""
    out = chosen
    for name, keys in forced.items():
        out = F.when(F.coalesce(key.isin(keys), F.lit(False)), name).otherwise(out)
    return out


def text_valid(text: Column, share: float = 0.05) -> Column:
    """valid or train by the first 8 hex digits of the text's SHA-256, modulo 10000."""
    return F.when(hex_bucket(F.sha2(text, 256), 8) % 10_000 < max(1, int(share * 10_000)), "valid").otherwise("train")


def fifth_dev(seed: str, key: Column) -> Column:
    """dev for one in five, train for the others."""
    return F.when(hex_bucket(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 12) % 5 == 0, "dev").otherwise("train")


def salted_valid(salt: str, key: Column) -> Column:
    """valid where the first byte of the salted hash is 0 or 1."""
    return F.when(hex_bucket(F.sha2(F.concat(F.lit(salt), key), 256), 2) < 2, "valid").otherwise("train")


def reserved(seed: str, key: Column) -> Column:
    """train, or for one in ten dev or test by the parity of the next digits."""
    b = hex_bucket(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 12)
    return F.when(b % 10 != 0, "train").when(F.floor(b / 10) % 2 == 0, "dev").otherwise("test")


def agreed(df: DataFrame, key: str, registry: DataFrame, axes: list[str]) -> DataFrame:
    """(key, split, status) by what registry (axis, value, split) says of a row's values: agreed, none, unknown or conflict.

    Null values say nothing; a value that isn't registered makes the row unknown.
    """
    values = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes]))
    said = df.select(key, values.alias("x")).select(key, "x.*").join(registry, ["axis", "value"], "left")
    out = said.groupBy(key).agg(F.count("value").alias("n"), F.count_if(F.col("value").isNotNull() & F.col("split").isNull()).alias("odd"), F.count_distinct("split").alias("splits"), F.min("split").alias("one"))
    status = F.when(F.col("n") == 0, "none").when(F.col("odd") > 0, "unknown").when(F.col("splits") > 1, "conflict").otherwise("agreed")
    return out.select(key, F.when(status == "agreed", F.col("one")).alias("split"), status.alias("status"))
