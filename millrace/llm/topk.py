"""Exact top-k by inner product, with norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets of similar length. A query's k-th best score so far, over
the query's length and the bucket's largest, is the cosine that a vector of the bucket must reach. Above 1 the
bucket is skipped. If that cosine is high, two coordinates of the query with the largest shares bound where
a vector's own coordinates can lie (coordinate pruning); else the vectors that are long enough are taken (length
pruning). What is left is verified by exact products. Buckets come in descending length, so thresholds rise early.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import Scratch

#: Vectors in a bucket, in a chunk of buckets that one task reads, and queries in a group that it reads.
BUCKET, CHUNK, GROUP = 2_048, 65_536, 8_192
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.7
#: Slack for rounding in bounds, which are in double precision; products are exact integers.
SLACK = 1e-9


def clean_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that have no null or non-finite component."""
    e = F.col(vector_col)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & e.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(table), -1) if len(flat) else np.zeros((len(table), 1), np.int64)


def _products(q: np.ndarray, c: np.ndarray, fits: bool) -> np.ndarray:
    """Exact: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if fits else q @ c.T


def search(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, reached: list[tuple[int, int] | None] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) with the k best candidates for each query; ties go to the smaller id.

    reached: for each query the k-th best (score, id) that is known from elsewhere, or None; only better ones are returned.
    """
    qn, cn = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((c.astype(np.float64) ** 2).sum(1))
    if float(qn.max(initial=0)) * float(cn.max(initial=0)) * (1 + SLACK) >= 2.0**63:
        raise OverflowError("inner products may pass 64 bits")
    order = np.lexsort((ids, -cn))
    ids, c, cn = ids[order], c[order], cn[order]
    fits = float(qn.max(initial=0)) * float(cn.max(initial=0)) < 2.0**52
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(len(q))]
    theta = np.full(len(q), -np.inf)
    known = [r if r else (None, None) for r in (reached or [None] * len(q))]
    for j, (score, _) in enumerate(known):
        if score is not None:
            theta[j] = score

    def offer(j: int, got: np.ndarray, scores: np.ndarray) -> None:
        got, scores = np.concatenate([best[j][0], got]), np.concatenate([best[j][1], scores])
        top = np.lexsort((got, -scores))[:k]
        best[j] = got[top], scores[top]
        if len(top) == k:
            theta[j] = max(theta[j], scores[top[-1]])

    unit_q = q / np.where(qn > 0, qn, 1)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :2]
    for at in range(0, len(c), BUCKET):
        b_ids, b, bn = ids[at : at + BUCKET], c[at : at + BUCKET], cn[at : at + BUCKET]
        reach = qn * bn[0]
        # A bound of 0 on every product: only a threshold up to 0 lets the bucket in.
        local = np.where(reach > 0, theta / np.where(reach > 0, reach, 1), np.where(theta > 0, np.inf, -np.inf))
        alive = local <= 1 + SLACK
        by_coordinate = alive & (local >= COORDINATE_FROM) & (bn[-1] > 0)
        if by_coordinate.any():
            unit_b = b / bn[:, None]
            for j in np.flatnonzero(by_coordinate):
                # On the unit sphere, a vector within the cosine of q has its coordinate f in this interval.
                t, ok = min(1.0, local[j]), np.ones(len(b), dtype=bool)
                for f in focus[j]:
                    x = unit_q[j, f]
                    wide = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t))) + SLACK
                    low = -np.inf if x <= -t else x * t - wide
                    high = np.inf if x >= t else x * t + wide
                    ok &= (unit_b[:, f] >= low) & (unit_b[:, f] <= high)
                hit = np.flatnonzero(ok)
                if len(hit):
                    scores = _products(q[j : j + 1], b[hit], fits)[0]
                    good = (scores >= theta[j]) & (b_ids[hit] != query_ids[j])
                    if good.any():
                        offer(j, b_ids[hit[good]], scores[good])
        rest = np.flatnonzero(alive & ~by_coordinate)
        if len(rest):
            # Length pruning: the longest vectors up to where none of these queries can reach its threshold.
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((theta[rest] > 0) & (qn[rest] > 0), theta[rest] / np.where(qn[rest] > 0, qn[rest], 1), -np.inf)
            upto = int(np.searchsorted(-bn, -(need.min() * (1 - SLACK)), side="right"))
            scores = _products(q[rest], b[:upto], fits)
            for r, j in enumerate(rest):
                good = np.flatnonzero((scores[r] >= theta[j]) & (b_ids[:upto] != query_ids[j]))
                if len(good) > 4 * k + 64:  # more than can stay: the k best and all their ties are enough
                    edge = np.partition(scores[r][good], len(good) - k)[len(good) - k]
                    good = good[scores[r][good] >= edge]
                if len(good):
                    offer(j, b_ids[good], scores[r][good])
    for j, (got, scores) in enumerate(best):
        least, tie = known[j]
        if least is not None:
            better = (scores > least) | ((scores == least) & (got < tie))
            got, scores = got[better], scores[better]
        if len(got):
            yield int(query_ids[j]), got, scores


def top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) with the k best of `vectors` for each of `queries`, exactly.

    Scores are integer inner products of floor(scale * component). A query's own id is no candidate for it.
    Vectors that are null or hold null or non-finite components, and null ids, take no part; vectors meet only
    those of their own dimension. Repeated rows of one candidate each count; of repeated queries one counts.
    Ties go to the smaller id. Fewer than k candidates are all returned; an empty side gives an empty result.

    A grid of (chunk of candidates, group of queries) is dealt over the cluster: each task reads at most about
    CHUNK vectors and GROUP queries, whatever the input, and returns k rows a query. The chunk of the longest vectors comes
    first; others see only queries that they may still have a better vector for, and return only better ones. Raises
    OverflowError where a product could pass 64 bits.
    """
    base = clean_vectors(vectors, id_col, vector_col, scale)
    asked = clean_vectors(queries, id_col, vector_col, scale).dropDuplicates(["vec_id"])
    n, m = base.count(), asked.count()
    chunks, groups = max(1, -(-n // CHUNK)), max(1, -(-m // GROUP))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dim = F.size("v").alias("dim")
    ranged = base.withColumn("n2", norm).repartitionByRange(chunks, F.desc("n2"), "vec_id")
    # Written, as the bounds of range partitions are sampled and may differ when computed again.
    scratch = Scratch(vectors.sparkSession, "topk")
    chunked = scratch.cut(ranged.select("vec_id", "v", dim, "n2", F.spark_partition_id().alias("chunk")), "chunks")
    chunks = (chunked.agg(F.max("chunk")).first()[0] or 0) + 1
    asked = scratch.cut(asked.select("vec_id", "v", dim, norm.alias("n2"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("grp")), "queries")
    # Chunks are in descending length. The longest chunk gives each query a k-th best; a query goes on only to chunks
    # with a vector that is long enough to pass it, which are the next ones up to a point, and brings it along.
    tops = {r["chunk"]: math.sqrt(r["top"]) for r in chunked.groupBy("chunk").agg(F.max("n2").alias("top")).collect()}  # a row for CHUNK vectors
    tops = [max([t for c, t in tops.items() if c >= k], default=-1.0) for k in range(chunks)]
    none = F.lit(None).cast("long")
    start = asked.select("vec_id", "v", "dim", "grp", F.lit(0).alias("chunk"), none.alias("least"), none.alias("tie"))
    out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not len(qs) or not len(cs):
            return out_schema.empty_table()
        reached = [None if a is None else (a, b) for a, b in zip(qs.column("least").to_pylist(), qs.column("tie").to_pylist(), strict=True)]
        found = list(search(qs.column("vec_id").to_numpy(), _matrix(qs), cs.column("vec_id").to_numpy(), _matrix(cs), k, reached))
        if not found:
            return out_schema.empty_table()
        return pa.table(
            [np.concatenate([np.full(len(g), i, np.int64) for i, g, _ in found]), np.concatenate([g for _, g, _ in found]), np.concatenate([s for _, _, s in found])],
            schema=out_schema,
        )

    def grid(queries_: DataFrame, candidates: DataFrame) -> DataFrame:
        keys = ("chunk", "grp", "dim")
        wide = candidates.select("vec_id", "v", "dim", "chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
        return queries_.groupBy(*keys).cogroup(wide.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")

    found = scratch.cut(grid(start, chunked.where("chunk = 0")), "first")
    if chunks > 1:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        edge = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"), F.col("vec_id").alias("tie"))
        more = asked.join(edge, "vec_id", "left")
        # |q| * |c| is a bound of the product: chunks whose longest vector is under least / |q| hold nothing better.
        need = F.when(F.col("least") > 0, F.col("least") / F.sqrt("n2") * F.lit(1 - SLACK)).otherwise(F.lit(0.0))
        upto = F.size(F.filter(F.array(*[F.lit(float(t)) for t in tops]), lambda t: t >= F.coalesce(need, F.lit(0.0)))) - 1
        more = more.select("vec_id", "v", "dim", "grp", "least", "tie", upto.alias("upto")).where("upto >= 1")
        more = more.select("vec_id", "v", "dim", "grp", F.explode(F.sequence(F.lit(1), F.col("upto"))).alias("chunk"), "least", "tie")
        found = found.unionByName(grid(more, chunked.where("chunk > 0")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
