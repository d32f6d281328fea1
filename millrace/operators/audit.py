"""Audits: receipts, Merkle roots, corpus statistics, censuses, retention and exposure gates."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merkle_root(artifacts: DataFrame) -> DataFrame:
    """(root) over (name, sha256, bytes): binary, by name, an odd level repeats its last node. Names are files, not rows.

    Levels are folded with array functions: one row holds 32 bytes for each artifact.
    """
    zero, leaf = F.unhex(F.lit("00")), F.encode(F.lit("leaf"), "utf-8")
    node = F.unhex(F.lit(b"node\0".hex()))
    digest = F.unhex(F.sha2(F.concat(leaf, zero, F.encode("name", "utf-8"), zero, F.encode("sha256", "utf-8"), zero, F.encode(F.col("bytes").cast("string"), "utf-8")), 256))
    level = artifacts.agg(F.transform(F.sort_array(F.collect_list(F.struct("name", digest.alias("d")))), lambda x: x["d"]).alias("level"))

    def fold(nodes: Column) -> Column:
        n = F.size(nodes)
        pair = lambda i: F.unhex(F.sha2(F.concat(node, F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.get(nodes, i))), 256))
        return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), pair)).otherwise(nodes)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.col("level"), lambda nodes, _: F.get(F.transform(F.array(nodes), fold), F.lit(0)))
    empty = hashlib.sha256(b"empty-merkle-v1").hexdigest()
    return level.select(F.when(F.size("level") == 0, F.lit(empty)).otherwise(F.lower(F.hex(F.get(folded, F.lit(0))))).alias("root"))


def corpus_stats(docs: DataFrame, text: Column, tokens: Column, source: str) -> DataFrame:
    """(n_docs, n_tokens, n_sources, fingerprint): the fingerprint is a sum of hashes, so that no order matters and none is sorted."""
    each = docs.select(F.sha2(text, 256).alias("h"), tokens.alias("t"), F.col(source).alias("s"))
    part = lambda a: F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)")
    return each.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").cast("long").alias("n_tokens"), F.count_distinct("s").alias("n_sources"), F.concat_ws(":", F.sum(part(1)).cast("string"), F.sum(part(16)).cast("string")).alias("fingerprint"))


def leak_strings(df: DataFrame, fields: list[str], least: int = 1) -> DataFrame:
    """(value): the different trimmed values of the fields, of `least` characters or more."""
    values = F.explode(F.array(*[F.trim(F.col(f).cast("string")) for f in fields]))
    return df.select(values.alias("value")).where(F.length("value") >= least).distinct()


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n): the k most frequent values, ties by value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def retained(checkpoints: DataFrame, keep: int, run: str, step: str, milestone: str) -> DataFrame:
    """Adds retained: the last `keep` checkpoints of each run, and its milestones."""
    late = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step))) <= keep
    return checkpoints.withColumn("retained", late | F.coalesce(F.col(milestone), F.lit(False)))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows with their source and its place in the order given; columns that a source lacks are null."""
    out = None
    for i, (name, df) in enumerate(sources.items()):
        part = df.withColumn("source_name", F.lit(name)).withColumn("source_order", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def low_loss(windows: DataFrame, role: str, loss: str, threshold: float = 0.1, limit: float = 0.5, least: int = 20) -> DataFrame:
    """(role, windows, below_rate, status, reason): a role whose windows have losses under the threshold at the limit's rate
    has collapsed on templates; one with fewer than `least` windows can't pass either."""
    out = windows.groupBy(F.col(role).alias("role")).agg(F.count(F.lit(1)).alias("windows"), F.avg((F.col(loss) < threshold).cast("double")).alias("below_rate"))
    reason = F.when(F.col("windows") < least, "insufficient_source_windows").when(F.col("below_rate") >= limit, "source_loss_template_collapse")
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "passed").otherwise("degraded"))


def overlap(df: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b, shared): different keys that two groups share, for each two groups that share some.

    Groups are splits or sources, which are few: a key gives a row for each two of its groups.
    """
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    pairs = sets.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("n", F.posexplode("g").alias("i", "a"), "g")
    return pairs.select("n", "a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b")).groupBy("a", "b").agg(F.sum("n").cast("long").alias("shared"))


def table_inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_null, n_blank, n_numeric, n_distinct) of each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    numeric = F.rlike(F.trim("value"), F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?$"))
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.trim("value") == "").alias("n_blank"), F.count_if(numeric).alias("n_numeric"), F.count_distinct("value").alias("n_distinct"))


def turn_histogram(turns: DataFrame, conversation: str) -> DataFrame:
    """(n_turns, conversations, share)."""
    per = turns.groupBy(conversation).agg(F.count(F.lit(1)).alias("n_turns")).groupBy("n_turns").agg(F.count(F.lit(1)).alias("conversations"))
    total = per.agg(F.sum("conversations").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("n_turns", "conversations", (F.col("conversations") / F.col("total")).alias("share"))  # one row


def shared_turns(turns: DataFrame, conversation: str, text: str, least: int = 8) -> DataFrame:
    """(text_sha256, conversations, turns): turns of `least` characters or more that several conversations have."""
    kept = turns.where(F.length(text) >= least).select(conversation, F.sha2(text, 256).alias("text_sha256"))
    return kept.groupBy("text_sha256").agg(F.count_distinct(conversation).alias("conversations"), F.count(F.lit(1)).alias("turns")).where("conversations > 1")


def review_packet(df: DataFrame, source: str, key: str, text: str, k: int, seed: str) -> DataFrame:
    """Up to k rows of each source for blind review: one of equal texts, in hash order, named by a hash instead of the source."""
    first = df.withColumn("__o", F.row_number().over(Window.partitionBy(source, F.sha2(text, 256)).orderBy(key))).where("__o = 1")
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    drawn = first.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy(order, key))).where(F.col("__r") <= k)
    return drawn.select(F.substring(order, 1, 16).alias("review_id"), key, source)
