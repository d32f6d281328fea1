"""Graphs as edge tables: connected components, and dependency graphs of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (u, v), longs; the component is its least node.

    Each round is one large-star and one small-star step, written to the shared folder; rounds end when a round
    changes nothing, after about log(n) ** 2 at most. No row holds more than one link, so a component may
    have any size.
    """
    state = scratch.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark, k = sign(state), 0
    while mark[0]:
        k += 1
        new = scratch.cut(small_star(large_star(state)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state, last, mark = new, mark, sign(new)
        if mark == last:
            break
    # At the end every edge is (node, least node).
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def task_depths(edges: DataFrame, tasks: DataFrame, deepest: int = 64) -> DataFrame:
    """(task, depth, cyclic, unknown): the longest chain of dependencies below each task.

    edges (task, after), tasks (task). A task is cyclic if a chain from it is longer than there are steps to
    take, `deepest`; unknown if it depends on a task that is not listed.
    """
    spark = tasks.sparkSession
    names = {"edges": edges, "tasks": tasks}
    walked = spark.sql(
        f"""
        WITH RECURSIVE walk(task, at, depth) AS (
            SELECT task, task, 0 FROM {{tasks}}
            UNION ALL
            SELECT w.task, e.after, w.depth + 1 FROM walk w JOIN {{edges}} e ON e.task = w.at WHERE w.depth < {deepest}
        )
        SELECT task, max(depth) AS depth FROM walk GROUP BY task
        """,
        **names,
    )
    unknown = edges.join(tasks.select(F.col("task").alias("after")), "after", "left_anti").select("task", F.lit(True).alias("unknown")).distinct()
    return walked.join(unknown, "task", "left").select("task", "depth", (F.col("depth") >= deepest).alias("cyclic"), F.coalesce("unknown", F.lit(False)).alias("unknown"))


def ready_tasks(edges: DataFrame, states: DataFrame, done: str = "done") -> DataFrame:
    """(task, ready): tasks that are not done and depend on done ones only. states (task, state)."""
    below = edges.join(states.select(F.col("task").alias("after"), F.col("state").alias("below")), "after", "left")
    met = below.groupBy("task").agg(F.bool_and(F.coalesce(F.col("below") == done, F.lit(False))).alias("met"))
    return states.join(met, "task", "left").select("task", ((F.col("state") != done) & F.coalesce("met", F.lit(True))).alias("ready"))
