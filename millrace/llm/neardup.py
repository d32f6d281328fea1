"""Near-duplicate documents by MinHash.

1. A text's set of word shingles gives a signature: the minima of many universal hashes. Equal sets are one class.
2. Bands of the signature are bucketed. With BANDS bands of ROWS minima, two sets with a similarity of 0.75 miss
   each other in every band with a probability under 1e-7.
3. In a bucket not all pairs are compared. The class that shares most buckets with others is compared with each; it
   tends to be what the others are copies of. Pairs are verified on signatures, which drops those far from the
   threshold, then on the full sets. Components grow by alternating large-star and small-star steps.
4. Where a bucket still has classes of different components, these may be linked too. Such classes are gathered in
   blocks; tasks compare blocks of full sets by a product of matrices and return no more links than join components,
   so that no pairs are emitted and no link that joins components is lost.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shingles import PLACES, Words, minima, mixed, shingle_sets, universal
from millrace.operators.graph import components
from millrace.session import Scratch

BANDS, ROWS, SEED = 32, 3, 20_240_501
#: Of the minima, the share that must agree for the full sets to be compared: at a similarity of 0.75, less than
#: 0.45 is 6.7 standard deviations away.
AGREE = 0.45
#: Classes in a block, and columns of a block's matrix that are multiplied at a time.
BLOCK, COLUMNS = 256, 2_048
#: Bytes of text handled at a time in a worker.
PART = 1 << 20


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in portions of about PART bytes."""
    part: list[bytes] = []
    held, first = 0, 0
    for k, t in enumerate(texts):
        part.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        held += len(part[-1])
        if held >= PART:
            yield first, part
            part, held, first = [], 0, k + 1
    if part:
        yield first, part


def _signature_rows(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, family = Words(), universal(BANDS * ROWS, SEED)
        for batch in batches:
            for first, part in _parts(batch.column(2)):
                n, s1, s2, sigs = [], [], [], []
                for s in shingle_sets(part, words, shingle):
                    a, b = struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    n.append(len(s))
                    s1.append(a)
                    s2.append(b)
                    sigs.append(minima(s, family).tobytes() if len(s) else None)
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sigs, pa.binary())], schema=schema)

    return run, "doc_id long, th long, n long, s1 long, s2 long, sig binary"


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("cid", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]) * PLACES[4]
            for j in range(ROWS):
                key = mixed(key + sig[:, :, j] * PLACES[j])
            cid = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(cid, BANDS))], schema=schema)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for k in (2, 3))
        ok = pa.array((x == y).mean(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], schema=schema)


def _set_rows(shingle: int):
    schema = pa.schema([("cid", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for first, part in _parts(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(part, words, shingle)]
                yield pa.RecordBatch.from_arrays([batch.slice(first, len(part)).column(0), pa.array(sets, pa.binary())], schema=schema)

    return run, "cid long, shingles binary"


def _linked(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], schema=schema)

    return run


def joining_links(cids: list[int], parts: list[int], sets: list[np.ndarray], first: list[bool], second: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between classes of the first and of the second block, as many as join their components.

    first and second tell which block a class is in (both, where a block meets itself).
    """
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    uses = np.bincount(column)
    often = np.flatnonzero(uses > 1)
    place = np.full(len(uses), -1)
    place[often] = np.arange(len(often))
    keep = place[column] >= 0
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    one, two = np.flatnonzero(first), np.flatnonzero(second)
    both = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(often), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[row[a:b], column[a:b] - at] = 1
        both += grid[one] @ grid[two].T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[one][:, None] + size[two][None, :] - both
    part = np.array(parts)
    linked = (100.0 * both >= percent * union) & (part[one][:, None] != part[two][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(linked).tolist():
        x, y = find(parts[one[i]]), find(parts[two[j]])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((cids[one[i]], cids[two[j]]))
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; a text's set has its
    distinct `shingle`-word shingles, or its whole sequence if it has fewer words. Two texts are linked if
    100 * intersection >= percent * union. component_id is the least id that links lead to, kept says whether it is
    the row's own. Texts that are null or without words have an empty set and no link. Repeated rows have equal
    sets and so one component; a null id is no candidate for component_id, and its row is kept only if no row of its
    component has an id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    run, schema = _signature_rows(shingle)
    signed = scratch.cut(given.mapInArrow(run, schema), "signed")

    classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "one", "least", "n", "sig"), "classes")

    bands = classes.select("cid", "sig").mapInArrow(_band_rows, "key long, cid long")
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = scratch.cut(bands.join(full, "key"), "members")
    # Bands of a group of copies have the same classes; one of equal buckets is enough.
    same = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("x1"), F.sum(F.hash("cid").cast("long")).alias("x2"))
    one_of = same.groupBy("c", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    degree = members.groupBy("cid").agg(F.sum("c").alias("degree"))
    buckets = scratch.cut(members.join(one_of, "key", "left_semi").join(degree, "cid").select("key", "cid", "degree"), "buckets")

    chosen = members.select("cid").distinct().join(classes.select("cid", "one"), "cid")
    texts = given.join(chosen, given["doc_id"].eqNullSafe(F.col("one.doc_id")) & (given["th"] == F.col("one.th")))
    run, schema = _set_rows(shingle)
    sets = texts.select("cid", "text").mapInArrow(run, schema)
    sets = scratch.cut(sets.dropDuplicates(["cid"]), "sets")  # repeated rows give a set more than once
    signatures = classes.select("cid", "n", "sig")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b)."""
        with_sig = pairs
        for side in ("a", "b"):
            with_sig = with_sig.join(signatures.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        near = with_sig.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a long, b long")
        near = scratch.cut(near, f"near-{name}")
        for side in ("a", "b"):
            near = near.join(sets.select(F.col("cid").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        return scratch.cut(near.select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long"), f"links-{name}")

    pivot = buckets.groupBy("key").agg(F.max(F.struct("degree", "cid"))["cid"].alias("pivot"))
    pairs = buckets.join(pivot, "key").where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    links = verified(pairs, "pivots")
    as_edges = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(as_edges(links), scratch, "components")

    labelled = buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("component"))
    unsettled = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("cid").alias("first")).where("low <> high").select("key", "first")
    unsettled = scratch.cut(labelled.join(unsettled, "key").select("cid", "component", "first"), "unsettled")
    groups = components(unsettled.select(F.col("cid").alias("u"), F.col("first").alias("v")), scratch, "groups")
    rows = unsettled.select("cid", "component").distinct().join(groups.select(F.col("node").alias("cid"), F.col("component").alias("grp")), "cid")
    # A component with many classes in a group has blocks of its own, as it needs no comparison with itself; others share
    # blocks. Sets of a link differ in size by percent at most, so blocks have sets of similar sizes, and meet only
    # blocks of the same sizes or the next. Classes are dealt by hash within counted blocks, so that no task numbers a group.
    rows = rows.join(classes.select("cid", F.floor(F.log("n") / F.lit(max(1e-9, -math.log(percent / 100)) * (1 + 1e-9))).cast("int").alias("sizes")), "cid")
    kinds = rows.groupBy("grp", "sizes", "component").agg(F.count(F.lit(1)).alias("n"))
    own = kinds.where(F.col("n") >= BLOCK).select("grp", "sizes", "component", F.ceil(F.col("n") / BLOCK).cast("long").alias("own"))
    few = kinds.where(F.col("n") < BLOCK).groupBy("grp", "sizes").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("few"))
    placed = rows.join(own, ["grp", "sizes", "component"], "left").join(few, ["grp", "sizes"], "left")
    turn = F.pmod(F.xxhash64("cid"), F.coalesce("own", "few"))
    owner = F.when(F.col("own").isNotNull(), F.col("component")).otherwise(F.lit(-1))
    rows = scratch.cut(placed.select("cid", "component", "grp", "sizes", F.concat_ws(":", owner.cast("string"), "sizes", turn.cast("string")).alias("block")), "blocks")
    blocks = rows.groupBy("grp", "sizes", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left, right = (blocks.select("grp", *[F.col(c).alias(f"{c}_{side}") for c in ("sizes", "block", "low", "high")]) for side in ("1", "2"))
    ordered = "(sizes_2 = sizes_1 + 1 or (sizes_1 = sizes_2 and block_1 <= block_2))"
    meet = left.join(right, "grp").where(f"{ordered} and not (low_1 = high_2 and low_2 = high_1)").select("grp", F.col("block_1").alias("one"), F.col("block_2").alias("two"))
    meet = meet.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    dealt = rows.join(sets, "cid").join(meet, ["grp", "block"])
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        block, one, two = (t.column(c).to_pylist() for c in ("block", "one", "two"))
        found = joining_links(
            t.column("cid").to_pylist(), t.column("component").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")], [b == o for b, o in zip(block, one, strict=True)], [b == o for b, o in zip(block, two, strict=True)], percent
        )
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=out_schema)

    more = scratch.cut(dealt.select("grp", "one", "two", "block", "cid", "component", "shingles").groupBy("grp", "one", "two").applyInArrow(compare, "a long, b long"), "links-blocks")
    # A component is a link from each member to its least one, so the second round only adds to the first.
    grown = labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = components(grown.unionByName(as_edges(more)), scratch, "all-components")

    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("s1", "s2", "least", F.coalesce("component", "cid").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = scratch.cut(named.join(least, "component").select("s1", "s2", "component_id"), "of-set")
    out = signed.join(of_set, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
