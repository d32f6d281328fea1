"""Sharding through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. Shards take turns; each
claims the first slot in its order that is still free. A row's hash picks a slot, the slot names the shard.
When a shard comes or goes, few slots change hands. All rows are placed by DataFrame functions; the table has a
fixed number of slots, so its broadcast is bounded whatever the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.columns import hash_long, without

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard number of every slot. `weights` gives a shard that many claims in each round, 1 by default."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be one or more different names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, and no smaller than the number of shards")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or max(turns) == 0:
        raise ValueError("weights must not be negative, nor all 0")
    start, step = [], []
    for s in shards:
        d = hashlib.md5(s.encode()).digest()
        start.append(int.from_bytes(d[:8], "big") % size)
        step.append(int.from_bytes(d[8:], "big") % (size - 1) + 1)
    table, at, left = [-1] * size, list(start), size
    while True:
        for k, claims in enumerate(turns):
            for _ in range(claims):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % size
                table[at[k]] = k
                left -= 1
                if not left:
                    return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """The table as rows (slot, shard), parsed from one literal in the JVM."""
    listed = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard"))


def place(
    df: DataFrame,
    shards: list[str],
    *,
    key_cols: tuple[str, ...] = ("doc_id",),
    size: int = TABLE_SIZE,
    weights: dict[str, int] | None = None,
    seed: str = "shard-v1",
) -> DataFrame:
    """Adds slot, shard (number) and shard_name to every row.

    No shuffle: one broadcast join with `size` rows. Rows with equal keys go to one shard; a null key counts as
    an empty string, and repeated rows stay. An empty table gives an empty result. Input columns named as
    output columns are replaced.
    """
    spark = df.sparkSession
    # Bounded: `size` rows of two integers, set by the caller and not by the data.
    table = F.broadcast(
        table_frame(spark, lookup_table(shards, size, weights)).select(
            F.col("slot").alias("__mr_slot"), F.col("shard").cast("int").alias("shard"), F.element_at(F.array(*map(F.lit, shards)), F.col("shard") + 1).alias("shard_name")
        )
    )
    slotted = df.withColumn("__mr_at", F.pmod(hash_long(seed, *[F.col(c) for c in key_cols]), F.lit(size)).cast("int"))
    return (
        without(slotted, "slot", "shard", "shard_name")
        .join(table, F.col("__mr_at") == F.col("__mr_slot"))
        .withColumnRenamed("__mr_slot", "slot")
        .drop("__mr_at")
    )
