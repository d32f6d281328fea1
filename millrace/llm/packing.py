"""Packing into optimal length buckets.

The lengths of all rows are counted in one global histogram. Dynamic programming over it picks the bucket
boundaries that minimise padding. Inside each bucket, rows fill batches of a fixed token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.columns import hash_long, without, word_count

#: Lengths up to 2**(PRECISION + 1) = 65,536 have a histogram bin of their own, longer ones 2**PRECISION bins an octave,
#: where bounds are within a 32,768th of the best ones. So the histogram, which goes to the driver, has a row for each
#: length that occurs up to there, and 2**PRECISION more for each octave of longer ones, whatever the input.
PRECISION = 15
OUT = ("n_tokens", "bucket", "bucket_len", "slot", "batch", "batch_row")


def length_bin(length: Column) -> Column:
    """The upper end of the bin that a length falls in."""
    shift = F.greatest(F.lit(0), F.length(F.bin(length)) - F.lit(PRECISION + 1))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.ceil(length / step).cast("long") * step


def histogram(lengths: DataFrame, length: str) -> list[tuple[int, int, int]]:
    """(largest length, rows, sum of lengths) of every bin, by length."""
    got = (
        lengths.groupBy(length_bin(F.col(length)).alias("bin"))
        .agg(F.max(length).alias("top"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("total"))
        .collect()
    )
    return sorted((r["top"], r["n"], r["total"]) for r in got)


def boundaries(hist: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets with the least padding in all.

    best[j] is the least padding of bins up to j; a bucket over bins i..j costs top[j] * rows(i..j) - tokens(i..j). For a
    fixed i that is a line in top[j], whose slope falls as i grows, while top[j] rises: the lower hull of the lines gives
    each minimum in constant time, and a pass for a bucket takes O(bins). Ties go to the earlier boundary. An empty
    histogram gives no bucket.
    """
    if not hist:
        return []
    n = len(hist)
    top = [h[0] for h in hist]
    rows, tokens = [0], [0]
    for _, r, t in hist:
        rows.append(rows[-1] + r)
        tokens.append(tokens[-1] + t)
    best: list[int | None] = [0, *[top[j] * rows[j + 1] - tokens[j + 1] for j in range(n)]]
    cuts = []
    for _ in range(min(buckets, n) - 1):
        nxt, cut = list(best), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i), the best of which moves to the end as top rises
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            line = (-rows[i], best[i] + tokens[i], i)
            # Integers all along, so comparisons are exact.
            while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            at = min(at, len(hull) - 1)
            x = top[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            slope, intercept, i = hull[at]
            nxt[j], cut[j] = slope * x + intercept + x * rows[j] - tokens[j], i
        cuts.append(cut)
        best = nxt
    j, out = n, []
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(top[j - 1]))
        j = int(cut[j])
    if j:
        out.append(int(top[j - 1]))
    return sorted(out)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = 16,
    token_budget: int = 65_536,
    slot_rows: int = 20_000,
    seed: str = "pack-v1",
) -> DataFrame:
    """Adds n_tokens, bucket (from 0), bucket_len, slot, batch and batch_row to every row of `docs`.

    A batch is (bucket, slot, batch): at most max(1, token_budget // bucket_len) rows, each padded to
    bucket_len. A bucket's rows are dealt by hash over slots of about `slot_rows` rows, so a bucket with most
    of the rows is no single task's work; each slot has one batch that may be part full. A row longer than the
    budget is a batch by itself. `length` defaults to the number of words and one end token.

    Null and blank texts have length 1, null lengths count as 0; repeated rows are packed as often as they
    come, ties in the hash order are broken by the id, nulls first; an empty table gives an empty result. Input
    columns with the names of output columns are replaced.
    """
    length = word_count(F.col(text_col)) + F.lit(1) if length is None else length
    # Rows with one id, or without any, are spread by their texts' hash, equal rows without an id by where they are read.
    spread = F.concat_ws(":", F.xxhash64(text_col) if text_col in docs.columns else F.lit(""), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    named = docs.withColumn("__mr_len", F.greatest(F.lit(0), F.coalesce(length.cast("long"), F.lit(0))))
    hist = histogram(named.select("__mr_len"), "__mr_len")
    edges = boundaries(hist, buckets)
    slots, i = [], 0
    for e in edges:
        n = 0
        while i < len(hist) and hist[i][0] <= e:
            n, i = n + hist[i][1], i + 1
        slots.append(max(1, -(-n // slot_rows)))
    edges, slots = edges or [0], slots or [1]

    def pick(values: list[int], kind: str) -> Column:
        out = F.lit(values[-1])
        for e, v in reversed(list(zip(edges[:-1], values[:-1], strict=True))):
            out = F.when(F.col("__mr_len") <= F.lit(e), F.lit(v)).otherwise(out)
        return out.cast(kind)

    placed = without(named, *OUT).select(
        "*",
        F.col("__mr_len").alias("n_tokens"),
        pick(list(range(len(edges))), "int").alias("bucket"),
        pick(edges, "long").alias("bucket_len"),
        hash_long(seed, F.col(id_col), spread).alias("__mr_order"),
    )
    placed = placed.withColumn("slot", F.pmod(F.col("__mr_order"), pick(slots, "long")).cast("int"))
    rank = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("__mr_order", id_col)) - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("int")
    return (
        placed.withColumn("__mr_rank", rank)
        .withColumn("batch", F.floor(F.col("__mr_rank") / capacity).cast("int"))
        .withColumn("batch_row", F.pmod(F.col("__mr_rank"), capacity).cast("int"))
        .drop("__mr_len", "__mr_order", "__mr_rank")
    )
