"""Ranking, classification, calibration and trajectory metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bijection(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(gold_rows, prediction_rows, missing, extra, duplicates, is_bijection) of two tables on a key."""
    a = gold.groupBy(key).agg(F.count(F.lit(1)).alias("g"))
    b = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("p"))
    j = a.join(b, key, "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    out = j.agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("gold_rows"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("prediction_rows"),
        F.count_if(F.col("p") == 0).alias("missing"),
        F.count_if(F.col("g") == 0).alias("extra"),
        F.count_if((F.col("g") > 1) | (F.col("p") > 1)).alias("duplicates"),
    )
    return out.withColumn("is_bijection", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0))


def ranking(ranked: DataFrame, gold: Column, listed: Column, by: list[str] | None = None) -> DataFrame:
    """recall@1, recall@5, reciprocal rank and NDCG@5, of lists with one right item each."""
    at = F.coalesce(F.array_position(listed, gold), F.lit(0))
    staged = ranked.select(*(by or []), at.alias("at"))
    hit = lambda k: F.avg(F.when(F.col("at").between(1, k), 1.0).otherwise(0.0))
    return staged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), hit(1).alias("recall_1"), hit(5).alias("recall_5"),
        F.avg(F.when(F.col("at") > 0, 1.0 / F.col("at")).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(F.col("at").between(1, 5), 1.0 / F.log2(F.col("at") + 1.0)).otherwise(0.0)).alias("ndcg_5"),
    )


def classification(df: DataFrame, label: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(class, support, tp, fp, fn, precision, recall, f1) of each class of `classes` (class); undefined ratios are 0."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("y").eqNullSafe(F.col("p"))
    truth = pairs.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("tp"))
    said = pairs.groupBy(F.col("p").alias("class")).agg(F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("fp"))
    j = classes.join(truth, "class", "left").join(said, "class", "left").fillna(0, ["support", "tp", "fp"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    j = j.withColumn("fn", F.col("support") - F.col("tp"))
    j = j.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return j.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(positives, negatives, auroc) by average ranks: pairs with equal scores count one half.

    Scores are counted first, so the ranks run over different scores and not over rows.
    """
    s = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    before = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy(F.lit(1)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = s.withColumn("won", F.col("p") * (before + (F.col("n") - F.col("p")) / 2.0))
    sums = won.agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), F.sum("won").alias("won"))
    return sums.select("positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("won") / (F.col("positives") * F.col("negatives"))).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """(average_precision) over rows by falling score, ties by the column `tie`."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(score), tie)
    r = df.select(F.col(label).cast("long").alias("y"), F.row_number().over(w).alias("k"), F.sum(F.col(label).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    return r.agg((F.sum(F.when(F.col("y") == 1, F.col("hits") / F.col("k")).otherwise(0.0)) / F.nullif(F.sum("y"), F.lit(0))).alias("average_precision"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap): bin i has scores from i / bins up to below (i + 1) / bins, 1 in the last."""
    at = F.lit(0)
    for i in range(1, bins):
        at = F.when(F.col(score) >= F.lit(i / bins), F.lit(i)).otherwise(at)
    binned = df.withColumn("bin", at)
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_summary(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """(n, ece, brier)."""
    ece = calibration(df, label, score, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    d = F.col(score) - F.col(label).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("brier")).crossJoin(ece)  # two single rows


def trajectories(steps: DataFrame, trajectory: str, correct: str) -> DataFrame:
    """(length, trajectories, success): trajectories count as successes if every step is correct."""
    each = steps.groupBy(trajectory).agg(F.count(F.lit(1)).alias("length"), F.bool_and(correct).alias("ok"))
    return each.groupBy("length").agg(F.count(F.lit(1)).alias("trajectories"), F.avg(F.col("ok").cast("double")).alias("success"))


def gates(values: DataFrame, limits: DataFrame) -> DataFrame:
    """(gate, value, low, high, passed): a missing value blocks. values (gate, value), limits (gate, low, high)."""
    j = limits.join(values, "gate", "left")
    ok = F.coalesce((F.col("value") >= F.coalesce("low", "value")) & (F.col("value") <= F.coalesce("high", "value")), F.lit(False))
    return j.select("gate", "value", "low", "high", ok.alias("passed"))


def class_coverage(df: DataFrame, label: str, split: str, floor: int) -> DataFrame:
    """(class, split, n, covered) for every class with every split, whether seen together or not."""
    spine = df.select(F.col(label).alias("class")).distinct().crossJoin(df.select(F.col(split).alias("split")).distinct())
    counts = df.groupBy(F.col(label).alias("class"), F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["class", "split"], "left").fillna(0, ["n"]).withColumn("covered", F.col("n") >= floor)


def token_loss(df: DataFrame, nll: str, tokens: str, n_bytes: str, by: list[str] | None = None) -> DataFrame:
    """(by, tokens, loss, nats_per_byte, bits_per_byte): sums over sums, so that each token weighs alike."""
    total = F.sum(nll)
    return df.groupBy(*(by or [])).agg(F.sum(tokens).cast("long").alias("tokens"), (total / F.sum(tokens)).alias("loss"), (total / F.sum(n_bytes)).alias("nats_per_byte"), (total / F.sum(n_bytes) / F.lit(math.log(2))).alias("bits_per_byte"))


def full_call(df: DataFrame) -> DataFrame:
    """One row of rates over (kind, variant, name, args, gold_name, gold_args): kind is execute or refuse, variant what was
    predicted: call, refuse or anything else, an error."""
    execute, call, refused = F.col("kind") == "execute", F.col("variant") == "call", F.col("variant") == "refuse"
    of = lambda cond, base: F.count_if(F.coalesce(base & cond, F.lit(False))) / F.nullif(F.count_if(base), F.lit(0))
    named = call & (F.col("name") == F.col("gold_name"))
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(execute).alias("execute_n"), F.count_if(~execute).alias("refuse_n"),
        of(call, execute).alias("execute_detection_accuracy"), of(named, execute).alias("execute_tool_name_exact"),
        of(named & F.col("args").eqNullSafe(F.col("gold_args")), execute).alias("execute_arguments_exact"),
        of(refused, ~execute).alias("refusal_accuracy"), of(refused, execute).alias("false_refuse_rate"), of(call, ~execute).alias("false_execute_rate"),
        (F.count_if(~F.coalesce(call | refused, F.lit(False))) / F.count(F.lit(1))).alias("error_rate"),
    )
    return out.withColumn("balanced_accuracy", (F.col("execute_detection_accuracy") + F.col("refusal_accuracy")) / 2)


def recovery_gate(before: DataFrame, after: DataFrame, weights: DataFrame, role_tolerance: float, whole_tolerance: float, numeric: float = 1e-9) -> DataFrame:
    """(check, value, passed) of two evaluations (role, loss): each role by its own tolerance, the weighted mean by another,
    and whether the mean improved. weights (role, weight). A role that either lacks doesn't pass."""
    j = weights.join(before.select("role", F.col("loss").alias("b")), "role", "left").join(after.select("role", F.col("loss").alias("a")), "role", "left")
    good = lambda c: F.coalesce(c, F.lit(False))
    roles = j.select(F.col("role").alias("check"), (F.col("a") / F.col("b") - 1).alias("value"), good(F.col("a") <= F.col("b") * (1 + role_tolerance) + numeric).alias("passed"))
    complete = F.count("a") + F.count("b") == 2 * F.count(F.lit(1))
    means = j.agg(F.sum(F.col("weight") * F.col("b")).alias("b"), F.sum(F.col("weight") * F.col("a")).alias("a"), complete.alias("complete"))
    whole = means.select(F.lit("quota_weighted_valid").alias("check"), F.col("a").alias("value"), good(F.col("complete") & (F.col("a") <= F.col("b") * (1 + whole_tolerance) + numeric)).alias("passed"))
    better = means.select(F.lit("measured_improvement").alias("check"), (F.col("a") - F.col("b")).alias("value"), good(F.col("complete") & (F.col("a") < F.col("b") - numeric)).alias("passed"))
    return roles.unionByName(whole).unionByName(better)


def risk_coverage(df: DataFrame, correct: str, score: str, levels: int = 10) -> DataFrame:
    """(coverage, n, risk): the share of wrong rows among those with the highest scores, for each level of coverage.

    Scores are counted first; rows with one score are covered together.
    """
    s = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col(correct)).cast("long")).alias("wrong"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("s"))  # a row a score
    run = s.select(F.sum("n").over(w).alias("n"), F.sum("wrong").over(w).alias("wrong"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    each = run.select("*", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")).where(F.col("n") * levels >= F.col("level") * F.col("total"))
    best = each.groupBy("level").agg(F.min(F.struct("n", "wrong")).alias("x"))
    return best.select((F.col("level") / F.lit(float(levels))).alias("coverage"), F.col("x.n").alias("n"), (F.col("x.wrong") / F.col("x.n")).alias("risk"))


def platt(df: DataFrame, label: str, score: str, rounds: int = 100, l2: float = 1e-6, tolerance: float = 1e-10) -> tuple[float, float]:
    """(scale, bias) of 1 / (1 + exp(-(scale * score + bias))) by Newton's method, both classes with equal weight in all.

    A step is one aggregation to six numbers. Raises ValueError without both classes.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    n, positives = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not positives or positives == n:
        raise ValueError("both classes are needed")
    weight = F.when(F.col("y") == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))
    scale, bias = 1.0, math.log((positives + 1.0) / (n - positives + 1.0))
    for _ in range(rounds):
        p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("s") * scale + bias)))))
        error, curve = weight * (p - F.col("y")), weight * p * (F.lit(1.0) - p)
        g = rows.agg(F.sum(error * F.col("s")), F.sum(error), F.sum(curve * F.col("s") * F.col("s")), F.sum(curve * F.col("s")), F.sum(curve)).first()
        gs, gb, ss, sb, bb = g[0] + l2 * scale, g[1] + l2 * bias, g[2] + l2, g[3], g[4] + l2
        det = ss * bb - sb * sb
        if det <= 0:
            break
        step = ((bb * gs - sb * gb) / det, (ss * gb - sb * gs) / det)
        scale, bias = scale - step[0], bias - step[1]
        if max(map(abs, step)) < tolerance:
            break
    return scale, bias


def threshold(df: DataFrame, max_recall_drop: float, max_false_selection: float) -> DataFrame:
    """(threshold, recall, false_selection) of the largest threshold that both limits allow, over (id, relevance, is_gold, has_gold).

    recall is the share of ids with a gold row whose gold reaches the threshold, false_selection that of ids without one where any
    row does. Candidates are 0, 1 and all relevances; they are counted, and running sums give both rates at each.
    """
    ids = df.select("id", "has_gold").distinct().agg(F.count_if("has_gold").alias("golds"), F.count_if(~F.col("has_gold")).alias("others"))
    gold = df.where("is_gold").groupBy("id").agg(F.max("relevance").alias("t")).select("t", F.lit(1).alias("g"), F.lit(0).alias("o"))
    other = df.where(~F.col("has_gold")).groupBy("id").agg(F.max("relevance").alias("t")).select("t", F.lit(0).alias("g"), F.lit(1).alias("o"))
    grid = df.select(F.col("relevance").alias("t")).where("t between 0 and 1").distinct().unionByName(df.sparkSession.createDataFrame([(0.0,), (1.0,)], "t double")).select("t", F.lit(0).alias("g"), F.lit(0).alias("o"))
    at = gold.unionByName(other).unionByName(grid).groupBy("t").agg(F.sum("g").alias("g"), F.sum("o").alias("o"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("t"))  # a row a relevance
    rates = at.select("t", F.sum("g").over(w).alias("g"), F.sum("o").over(w).alias("o")).crossJoin(F.broadcast(ids)).select("t", (F.col("g") / F.nullif("golds", F.lit(0))).alias("recall"), (F.col("o") / F.nullif("others", F.lit(0))).alias("false_selection"))
    base = rates.where("t = 0").select(F.col("recall").alias("base"))
    ok = rates.crossJoin(F.broadcast(base)).where((F.col("base") - F.col("recall") <= max_recall_drop) & (F.col("false_selection") <= max_false_selection) & F.col("t").between(0, 1))
    return ok.orderBy(F.desc("t")).limit(1).select(F.col("t").alias("threshold"), "recall", "false_selection")
