"""Quotas, prefix-sum selection, offsets and exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allocate(cells: DataFrame, target: int, key: str = "cell", capacity: str = "capacity", by: list[str] | None = None) -> DataFrame:
    """Adds quota: `target` by largest remainder over capacities, ties by key; all of it where that is too little.

    Shares are integers: floor(target * capacity / total), and the largest remainders of that division get one more.
    """
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    total = F.sum(F.col(capacity).cast("decimal(38,0)")).over(whole)
    product = F.col(capacity).cast("decimal(38,0)") * F.lit(target).cast("decimal(38,0)")
    staged = cells.withColumn("__t", total).withColumn("__p", product)
    staged = staged.withColumn("__f", F.when(F.col("__t") > 0, F.expr("__p div __t")).otherwise(F.lit(0)).cast("long"))
    staged = staged.withColumn("__r", F.col("__p") - F.col("__f").cast("decimal(38,0)") * F.col("__t"))
    left = F.lit(target) - F.sum("__f").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("__r"), key))
    quota = F.when(F.col("__t") <= target, F.col(capacity)).otherwise(F.col("__f") + F.when(rank <= left, 1).otherwise(0))
    return staged.withColumn("quota", quota.cast("long")).drop("__t", "__p", "__f", "__r")


def plan_mix(roles: DataFrame, target: int) -> DataFrame:
    """Adds quota, remaining, shortage, status to (role, capacity, consumed, fraction).

    Quotas are target * fraction, rounded half to even; the last role in order takes what rounding leaves.
    """
    whole = Window.partitionBy(F.lit(1))
    last = F.row_number().over(whole.orderBy(F.desc("role"))) == 1
    staged = roles.withColumn("__q", F.bround(F.col("fraction") * F.lit(float(target))).cast("long")).withColumn("__last", last)
    rest = F.lit(target) - F.sum(F.when(F.col("__last"), 0).otherwise(F.col("__q"))).over(whole)
    out = staged.withColumn("quota", F.when(F.col("__last"), rest).otherwise(F.col("__q"))).withColumn("remaining", F.col("capacity") - F.col("consumed"))
    out = out.withColumn("shortage", F.greatest(F.lit(0), F.col("quota") - F.col("remaining")))
    blocked = F.max("shortage").over(whole) > 0
    return out.withColumn("status", F.when(blocked, "blocked_insufficient_pool").otherwise("ready")).drop("__q", "__last")


def prefix_select(df: DataFrame, cell: list[str], order: list[Column | str], tokens: str, target: Column) -> DataFrame:
    """Rows of each cell in order until their tokens reach the target; the row that passes it is kept."""
    before = F.sum(tokens).over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("tokens_before", F.coalesce(before, F.lit(0))).where(F.col("tokens_before") < target)


def offsets(df: DataFrame, cell: list[str], order: list[Column | str], tokens: str) -> DataFrame:
    """Adds token_offset: the tokens of earlier rows of the cell."""
    before = F.sum(tokens).over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("token_offset", F.coalesce(before, F.lit(0)).cast("long"))


def broken_offsets(df: DataFrame, cell: list[str], order: list[Column | str], tokens: str) -> DataFrame:
    """Rows whose offset is not where the row before ends."""
    w = Window.partitionBy(*cell).orderBy(*order)
    return df.withColumn("expected", F.coalesce(F.lag(F.col("token_offset") + F.col(tokens)).over(w), F.lit(0))).where("token_offset <> expected")


def exposure_schedule(docs: DataFrame, source: str, key: str, tokens: str, prior: str, quota: int, rounds: int) -> DataFrame:
    """(source, key, round, take): documents with least prior exposure first, again in rounds, until the quota.

    The last take is cut to what the quota leaves.
    """
    repeated = docs.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("exposure", F.col(prior) + F.col("round"))
    w = Window.partitionBy(source).orderBy("exposure", key).rowsBetween(Window.unboundedPreceding, -1)
    staged = repeated.withColumn("before", F.coalesce(F.sum(tokens).over(w), F.lit(0))).where(F.col("before") < quota)
    return staged.withColumn("take", F.least(F.col(tokens), F.lit(quota) - F.col("before"))).select(source, key, "round", "exposure", F.col("take").cast("long").alias("take"))


def counter_diff(logs: DataFrame, order: str, counters: list[str], value: str) -> DataFrame:
    """(order, source, value): rows since whose predecessor exactly one of the counters grew, with its name."""
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    grew = [(c, F.coalesce(F.col(c) > F.lag(c).over(w), F.lit(False))) for c in counters]
    staged = logs.select(order, value, F.filter(F.array(*[F.when(g, F.lit(c)) for c, g in grew]), lambda x: x.isNotNull()).alias("grown"))
    return staged.where(F.size("grown") == 1).select(order, F.get("grown", F.lit(0)).alias("source"), value)


def stage_lookup(points: DataFrame, stages: DataFrame, point: str) -> DataFrame:
    """Each point with the first stage that stops after it; null past the last. stages (stage, stop_at).

    Stages are few; their stops go into one sorted array that every row searches.
    """
    table = stages.agg(F.array_sort(F.collect_list(F.struct("stop_at", "stage"))).alias("__stages"))
    found = F.get(F.filter("__stages", lambda s: s["stop_at"] > F.col(point)), F.lit(0))
    return points.crossJoin(F.broadcast(table)).withColumn("stage", found["stage"]).drop("__stages")  # one row


def window_counts(docs: DataFrame, source: str, tokens: str, seq: int) -> DataFrame:
    """(source, tokens, windows, padding): windows of seq + 1 tokens at stride seq over each source's stream."""
    total = docs.groupBy(source).agg(F.sum(tokens).cast("long").alias("tokens"))
    n = F.greatest(F.lit(0), F.ceil((F.col("tokens") - 1) / F.lit(seq))).cast("long")
    return total.withColumn("windows", n).withColumn("padding", F.greatest(F.lit(0), n * seq + 1 - F.col("tokens")).cast("long"))


def window_plan(quotas: DataFrame, seq: int, seed: str) -> DataFrame:
    """(source, n, place): a window for each `seq` tokens of a source's quota, the last one part full, in one hash order."""
    n = F.ceil(F.greatest(F.lit(0), F.col("quota")) / F.lit(seq)).cast("int")
    each = quotas.select("source", n.alias("windows")).where("windows > 0").select("source", F.explode(F.sequence(F.lit(1), F.col("windows"))).alias("n"))
    return each.withColumn("place", F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "source", F.col("n").cast("string")), 256), 1, 15), 16, 10).cast("long"))


def windows(docs: DataFrame, source: str, order: list[str], tokens: str, seq: int, pad: int = 0) -> DataFrame:
    """(source, window, x, y, mask): windows of seq + 1 tokens at stride seq over a source's documents in order.

    A token's place in its source's stream is known from prefix sums, so windows are made of tokens that are grouped by
    (source, window), not of whole streams. The token at a window's end begins the next one too. The last window is
    filled with `pad`, which the mask leaves out.
    """
    sized = offsets(docs.withColumn("__n", F.size(tokens)), [source], order, "__n")
    each = sized.select(source, "token_offset", F.posexplode(tokens).alias("__i", "token")).select(source, (F.col("token_offset") + F.col("__i")).alias("p"), "token")
    total = docs.groupBy(source).agg(F.sum(F.size(tokens)).cast("long").alias("__total"))
    at = F.floor(F.col("p") / F.lit(seq))
    homes = F.when((F.col("p") % seq == 0) & (F.col("p") > 0), F.array(at - 1, at)).otherwise(F.array(at))
    placed = each.join(total, source).select(source, "p", "token", "__total", F.explode(homes).alias("window"))
    placed = placed.where((F.col("window") * seq < F.col("__total") - 1) | ((F.col("window") == 0) & (F.col("__total") == 1)))
    chunk = F.transform(F.sort_array(F.collect_list(F.struct("p", "token"))), lambda x: x["token"])
    filled = F.concat("c", F.array_repeat(F.lit(pad).cast("int"), F.lit(seq + 1) - F.size("c")))
    out = placed.groupBy(source, "window").agg(chunk.cast("array<int>").alias("c")).select(source, "window", filled.alias("c"))
    out = out.select(source, "window", F.slice("c", 1, seq).alias("x"), F.slice("c", 2, seq).alias("y"))
    return out.withColumn("mask", F.transform("y", lambda t: F.when(t == pad, 0.0).otherwise(1.0)))


def fraction_grid(total: int, fractions: list[float], spark) -> DataFrame:
    """(fraction, synthetic, natural): rows of each candidate share of synthetic rows, rounded half to even."""
    rows = spark.createDataFrame([(float(f),) for f in fractions], "fraction double")
    return rows.withColumn("synthetic", F.bround(F.col("fraction") * F.lit(float(total))).cast("long")).withColumn("natural", F.lit(total) - F.col("synthetic"))


def reserve(domains: DataFrame, target: int) -> DataFrame:
    """Adds reserved to (domain, capacity): floor of the proportional share of the target, what is left goes to the largest domain."""
    whole = Window.partitionBy(F.lit(1))  # a row a domain
    total = F.sum("capacity").over(whole)
    share = F.when(total > 0, F.floor(F.lit(float(target)) * F.col("capacity") / total)).otherwise(F.lit(0)).cast("long")
    staged = domains.withColumn("__s", share).withColumn("__first", F.row_number().over(whole.orderBy(F.desc("capacity"), "domain")) == 1)
    rest = F.lit(target) - F.sum("__s").over(whole)
    return staged.withColumn("reserved", (F.col("__s") + F.when(F.col("__first"), rest).otherwise(F.lit(0))).cast("long")).drop("__s", "__first")
