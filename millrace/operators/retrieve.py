"""Vector and lexical retrieval against small catalogues, and their batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import token_set
from millrace.session import Scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """The vector at length one; null if it has length zero or a component that is null or not finite."""
    norm = F.sqrt(dot(v, v))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & (norm > 0) & (norm < float("inf"))
    return F.when(good, F.transform(v, lambda x: x.cast("double") / norm))


def cosine_top_k(queries: DataFrame, catalogue: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): of each query the k nearest catalogue rows, ties by id.

    For a stated query set against a catalogue that fits a task in blocks; large searches are op4's work.
    """
    q = queries.select(F.col(id_col).alias("query_id"), l2_normalized(F.col(vector_col)).alias("q"))
    c = catalogue.select(F.col(id_col).alias("id"), l2_normalized(F.col(vector_col)).alias("c"))
    scored = q.crossJoin(c).where("query_id <> id and q is not null and c is not null").select("query_id", "id", dot(F.col("q"), F.col("c")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def lexical_top_k(queries: DataFrame, catalogue: DataFrame, k: int, query_id: str, query_text: str, id_col: str, text_col: str) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest Jaccard similarity of token sets, ties by id.

    Only rows that share a token with the query are scored, through a join on tokens.
    """
    q = queries.select(F.col(query_id).alias("query_id"), token_set(F.col(query_text)).alias("t")).withColumn("nq", F.size("t"))
    c = catalogue.select(F.col(id_col).alias("id"), token_set(F.col(text_col)).alias("t")).withColumn("nc", F.size("t"))
    a, b = q.select("query_id", "nq", F.explode("t").alias("w")), c.select("id", "nc", F.explode("t").alias("w"))
    both = a.join(b, "w").groupBy("query_id", "id", "nq", "nc").agg(F.count(F.lit(1)).alias("n"))
    scored = both.select("query_id", "id", (F.col("n") / (F.col("nq") + F.col("nc") - F.col("n"))).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _subsets(words: Column) -> Column:
    """Every subset of a sorted array, in order, as a text."""
    return F.transform(F.aggregate(words, F.array(F.array().cast("array<string>")), lambda a, w: F.concat(a, F.transform(a, lambda s: F.concat(s, F.array(w))))), lambda s: F.array_join(s, " "))


def _least(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each group the k rows with the least ids; sorted partitions are cut to k rows a group before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__n") <= k).drop("__n")


def hard_negatives(items: DataFrame, k: int, id_col: str, family_col: str, name_col: str, long_name: int = 8) -> DataFrame:
    """(id, rank, negative, score): of each item the k others with the highest score, ties by id.

    The score is 100 for the same family and one for each word that both names have; ids are unique. Items with
    one family and one set of words are a class, and rank all others alike. An item that shares the words S with a
    class can be among its first only if it is among the k + 1 least ids of those that hold S (in the family, if it
    is of the same one), as the others score no less and come before it. So these lists are all that is met. Sets
    of over `long_name` words, which have too many subsets, are met through joins on family and on words instead,
    from and to each class, of which again the k + 1 least ids are enough; no other pairs are made.
    """
    split = F.split(F.lower(F.col(name_col)), "[^a-z0-9]+")
    words = F.array_sort(F.array_distinct(F.filter(F.coalesce(split, F.array().cast("array<string>")), lambda w: w != "")))
    t = items.select(F.col(id_col).alias("id"), F.col(family_col).alias("f"), words.alias("w")).where("id is not null")
    few = _least(t, ["f", "w"], k + 1)
    classes = few.select("f", "w").distinct()

    def keyed(df: DataFrame) -> DataFrame:
        each = df.where(F.size("w") <= long_name).withColumn("s", F.explode(_subsets(F.col("w"))))
        return each.withColumn("g", F.explode(F.array("f", F.lit(None)))).where("g is not null or s <> ''").distinct()

    listed = _least(keyed(few), ["g", "s"], k + 1)
    as_other = lambda df: df.withColumnsRenamed({"f": "nf", "w": "nw"})
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    pair = ["a.f", "a.w", "b.id", "b.nf", "b.nw"]
    met = keyed(classes).alias("a").join(as_other(listed).alias("b"), same("g") & same("s")).select(*pair)
    long = lambda c: F.size(c) > long_name
    for a, b in ((classes.where(long("w")), few), (classes.where(~long("w")), few.where(long("w")))):
        b = as_other(b)
        met = met.unionByName(a.alias("a").join(b.alias("b"), F.col("a.f") == F.col("b.nf")).select(*pair))
        met = met.unionByName(a.withColumn("x", F.explode("w")).alias("a").join(b.withColumn("x", F.explode("nw")).alias("b"), "x").select(*pair))
    score = F.when(F.col("f") == F.col("nf"), 100).otherwise(0) + F.size(F.array_intersect("w", "nw"))
    ranked = F.array_sort(F.collect_set(F.struct((-score.cast("long")).alias("s"), F.col("id").alias("negative"))))
    best = met.groupBy("f", "w").agg(F.slice(ranked, 1, k + 1).alias("best"))
    own = t.alias("a").join(best.alias("b"), same("f") & same("w")).select("a.id", F.slice(F.filter("best", lambda x: x["negative"] != F.col("a.id")), 1, k).alias("best"))
    return own.select("id", F.posexplode("best").alias("p", "x")).select("id", F.col("x.negative").alias("negative"), (-F.col("x.s")).alias("score"), (F.col("p") + 1).alias("rank"))


def batch_plan(ranked: DataFrame, gate: float, size: int = 5) -> DataFrame:
    """Adds batch to (query_id, rank, id, score): ranks in fives, of rows that pass the gate."""
    return ranked.where(F.col("score") >= gate).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int"))


def batch_until(batches: DataFrame, gold: DataFrame, limit: int) -> DataFrame:
    """(query_id, batches, reason): batches scanned until the gold row; found, no_match, exhausted or limit.

    batches (query_id, batch, id), gold (query_id, id; null where no row is right).
    """
    last = batches.groupBy("query_id").agg((F.max("batch") + 1).alias("all"))
    hit = batches.join(gold.where("id is not null"), ["query_id", "id"]).groupBy("query_id").agg((F.min("batch") + 1).alias("at"))
    joined = gold.join(last, "query_id", "left").join(hit, "query_id", "left")
    reason = F.when((F.col("at") <= limit), "found").when(F.col("all").isNull(), "no_match").when(F.col("all") <= limit, "exhausted").otherwise("limit")
    return joined.select("query_id", F.least(F.coalesce("at", "all", F.lit(0)), F.lit(limit)).alias("batches"), reason.alias("reason"))


def next_in_ring(items: DataFrame, k: int) -> DataFrame:
    """(id, rank, negative): of each row the k rows that follow in order of id, the first ones after the last.

    Rows are numbered without one task that holds all: ids are dealt by ranges, ranges are numbered by their counts, of which
    there is one for each partition, and rows within their range. The numbers are cut, as ranges come from a sample. Rows then meet
    by number.
    """
    scratch = Scratch(items.sparkSession, "ring")
    dealt = scratch.cut(items.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("part")), "dealt")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    numbered = dealt.withColumn("at", number).join(F.broadcast(parts), "part").select("id", (F.col("at") + F.col("before")).alias("at"))
    rows = scratch.cut(numbered, "numbered")
    size = rows.agg(F.count(F.lit(1)).alias("m"))
    asked = rows.crossJoin(F.broadcast(size)).select("id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"), "at", "m")
    asked = asked.select("id", "rank", F.pmod(F.col("at") + F.col("rank"), F.col("m")).alias("at"))
    return asked.join(rows.withColumnRenamed("id", "negative"), "at").select("id", "rank", "negative")


def rotated(ranked: DataFrame, variants: int, count: int = 4, window: int = 48) -> DataFrame:
    """(id, variant, place, negative): the closest negative, and count - 1 that rotate through the next `window`.

    ranked has (id, rank, negative), ranks from 1. Steps of 7 over a window that they share no factor with, else of the
    next smaller prime, so that a variant's negatives differ. Items with fewer than `count` negatives have none.
    """
    sizes = ranked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)
    w = F.least(F.lit(window), F.col("n") - 1)
    step = F.lit(1)
    for s in (2, 3, 5, 7):  # the last that applies wins
        step = F.when(w % s != 0, F.lit(s)).otherwise(step)
    plan = sizes.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    rank = F.when(F.col("place") == 0, F.lit(1)).otherwise(F.lit(2) + (F.col("variant") * 11 + (F.col("place") - 1) * step) % w)
    return plan.withColumn("rank", rank.cast("int")).join(ranked.select("id", "rank", "negative"), ["id", "rank"]).select("id", "variant", "place", "negative")


def with_gold(rotated_: DataFrame, count: int = 4) -> DataFrame:
    """(id, variant, listed): a variant's negatives with the item itself at place variant modulo count + 1."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "negative"))), lambda x: x["negative"])
    out = rotated_.groupBy("id", "variant").agg(listed.alias("l"))
    at = F.col("variant") % F.lit(count + 1)
    return out.select("id", "variant", F.concat(F.slice("l", F.lit(1), at), F.array("id"), F.slice("l", at + 1, F.lit(count))).alias("listed"))
