"""Removal of repeated passages with suffix arrays.

Every byte that a string of `length` bytes covers which also starts elsewhere goes. The way there, exact
whatever the hashes do:

1. Texts that are equal are taken once, with their count.
2. Content-defined contexts: the anchor of a string of `length` bytes is the least hash of a gram of ANCHOR bytes in
   it. Equal strings have equal anchors. A context is what strings with one anchor cover that start next to each
   other; it starts and ends where their content says. Only contexts with an anchor that another one has too, or
   that holds it twice itself, can have repeats.
3. Equal contexts are repeats as they are, from end to end. Others are dealt to shards by ranges of their anchors;
   which shard has an anchor is a binary search over the ranges' bounds. As all contexts of an anchor meet in
   a shard, the shards' suffix arrays need no further merge.
4. A shard builds the suffix array of its contexts by Larsson-Sadakane refinement, the longest common prefixes
   by Kasai's recurrence, and marks strings that start at two or more places.
5. An anchor with more bytes of contexts than a task should hold is dealt over many shards. Each builds its suffix
   array as before and passes on one row for each different string of `length` bytes: its digest, and where it starts
   first and last. These rows are merged across shards by their digests; copies in one shard meet before the merge,
   so that a passage of a third of all rows is a row for each shard, not for each copy.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Scratch

#: Bytes in an anchor; bytes of contexts in one suffix array; bytes of contexts beyond which an anchor takes step 5;
#: strings that one context may hold.
ANCHOR, BLOCK, HOT, STRINGS = 64, 900_000, 1_100_000, 50_000
#: The same for every text, as anchors must be.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as the longest text so far needs."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 12)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(1 << (n - 1).bit_length())
        return self.up[:n], self.down[:n]


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` values in a row, in time that doesn't grow with width."""
    n = len(values)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if pick is np.minimum else np.uint64(0)
    grid = np.full(-(-n // width) * width, fill, np.uint64)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def contexts_of(data: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, anchor, twice) of the contexts of a text of `length` bytes or more.

    twice: the anchor's gram is in the context at two places, as in text that repeats itself.
    """
    n = len(data)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = length - ANCHOR + 1
    least = _slide(h, width, np.minimum)
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    tails = np.concatenate([heads[1:], [len(least)]])
    # Where the grams with the anchor's hash are: the first and the last in the context.
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    again = at[1:][h[at[1:]] == h[at[:-1]]]
    prior = at[:-1][h[at[1:]] == h[at[:-1]]]
    run = np.searchsorted(heads, np.minimum(prior, len(least) - 1), side="right") - 1
    twice = np.zeros(len(heads), bool)
    for step in (0, 1):  # the context of a gram is the one around the string that starts with it, or one before
        k = np.maximum(run - step, 0)
        ok = (least[heads[k]] == h[prior]) & (again < tails[k] + width - 1)
        twice[k[ok]] = True
    twice |= tails - heads > width
    if (tails - heads).max() > STRINGS:
        cuts = [np.arange(a, b, STRINGS) for a, b in zip(heads, tails, strict=True)]
        which = np.repeat(np.arange(len(heads)), [len(c) for c in cuts])
        starts = np.concatenate(cuts)
        return starts, np.minimum(starts + STRINGS, tails[which]) - starts + length - 1, least[heads][which], twice[which]
    return heads, tails - heads + length - 1, least[heads], twice


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(order, key, chars, bits): all suffixes by their first `depth` bytes or more, and the keys of positions.

    Larsson-Sadakane: sort by the first h bytes, then refine only groups that are not single yet by the ranks h
    bytes on, doubling h. A position's key has its first `chars` bytes, coded in `bits` each so that as many as
    can be share a 64-bit number with the position; plain sorts of such numbers do the work.
    """
    n = len(data)
    code = np.cumsum(np.bincount(data, minlength=256) > 0).astype(np.uint64)
    bits, room = int(code[-1]).bit_length(), max(1, (n - 1).bit_length())
    chars = (64 - room) // bits
    padded = np.zeros(n + chars, np.uint64)
    padded[:n] = code[data]
    key = padded[:n].copy()
    for j in range(1, chars):
        key <<= np.uint64(bits)
        key |= padded[j : j + n]
    room_u, mask = np.uint64(room), np.uint64((1 << room) - 1)
    packed = np.sort((key << room_u) | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    packed >>= room_u
    first = np.concatenate([[True], packed[1:] != packed[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    h, fits = chars, 3 * room + 1 <= 64
    while len(slots) and h < depth:
        at = order[slots]
        ahead = at + h
        # Past the end is before all; suffixes that end differ in their keys, so no two such are left here.
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        own = rank[at]
        if fits:
            both = (own << (room + 1)) | then
            packed = np.sort((both.astype(np.uint64) << room_u) | np.arange(len(slots), dtype=np.uint64))
            at = at[(packed & mask).astype(np.int64)]
            packed >>= room_u
            first = np.concatenate([[True], packed[1:] != packed[:-1]])
        else:
            move = np.lexsort((then, own))
            at, own, then = at[move], own[move], then[move]
            first = np.concatenate([[True], (own[1:] != own[:-1]) | (then[1:] != then[:-1])])
        order[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return order, key, chars, bits


def common_prefixes(data: np.ndarray, order: np.ndarray, key: np.ndarray, chars: int, bits: int) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before.

    Kasai's recurrence in text order: where a suffix and the one before it in order are each one byte on from such
    a pair, and the bytes before them are equal, they share one byte less than that pair. The others are compared.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (before[1:] - 1 == before[:-1])
    at = np.flatnonzero(carried)
    carried[at] = data[at - 1] == data[before[at] - 1]
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(~carried & (before >= 0))
    while len(live):
        a, b = live + shared[live], before[live] + shared[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        diff = key[a] ^ key[b]
        high = np.frexp((diff >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        low = np.frexp((diff & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.int64)
        equal = (chars * bits - np.where(high > 0, 32 + high, low)) // bits
        left = n - np.maximum(a, b)
        shared[live] += np.minimum(equal, left)
        live = live[(equal == chars) & (left > chars)]
    i = np.arange(n)
    source = np.maximum.accumulate(np.where(carried, 0, i))
    return (shared[source] + source - i)[order]


@dataclass
class Sorted:
    """The suffix array of contexts: for each suffix in order whether it begins a group of equal first `length` bytes,
    whether it has so many, the context and the position in it where it starts, and its place in its text."""

    data: bytes
    order: np.ndarray
    new: np.ndarray
    whole: np.ndarray
    owner: np.ndarray
    inner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, contexts: list[bytes], places: list[tuple[int, int]], length: int) -> Sorted:
        """places: the text and the position in it where each context starts, as contexts may overlap in a text."""
        sizes = np.array([len(c) for c in contexts])
        ends = np.cumsum(sizes)
        joined = b"".join(contexts)
        data = np.frombuffer(joined, np.uint8)
        order, key, chars, bits = suffix_array(data, length)
        new = common_prefixes(data, order, key, chars, bits) < length
        owner = np.repeat(np.arange(len(contexts)), sizes)
        inner = np.arange(len(data)) - (ends - sizes)[owner]
        whole = (sizes[owner] - inner) >= length
        names = {t: k for k, t in enumerate(dict.fromkeys(t for t, _ in places))}
        start = np.array([(names[t] << 40) + p for t, p in places], np.int64)
        return cls(joined, order, new, whole[order], owner[order], inner[order], (start[owner] + inner)[order])


def repeats(contexts: list[bytes], places: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each context the spans in it of strings of `length` bytes that start at two places or more."""
    s = Sorted.of(contexts, places, length)
    heads = np.flatnonzero(s.new)
    low = np.minimum.reduceat(np.where(s.whole, s.place, np.iinfo(np.int64).max), heads)
    high = np.maximum.reduceat(np.where(s.whole, s.place, -1), heads)
    twice = np.flatnonzero((low < high)[np.cumsum(s.new) - 1] & s.whole)
    by = np.lexsort((s.inner[twice], s.owner[twice]))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for k, x in zip(s.owner[twice][by].tolist(), s.inner[twice][by].tolist(), strict=True):
        spans = out[k]
        if spans and x <= spans[-1][1]:
            spans[-1] = (spans[-1][0], x + length)
        else:
            spans.append((x, x + length))
    return out


def _digest(context: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(context, digest_size=16).digest())


def _anchor_rows(length: int):
    """A text to its contexts: start, size, anchor, a hash of the context, and whether it has the anchor twice."""
    schema = pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in schema]
                for tid, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    start, size, h, twice = contexts_of(np.frombuffer(raw, np.uint8), length, powers)
                    start, size = start.tolist(), size.tolist()
                    sums = [_digest(raw[a : a + n]) for a, n in zip(start, size, strict=True)]
                    for column, values in zip(columns, ([tid] * len(start), start, size, h.view(np.int64).tolist(), [x for x, _ in sums], [y for _, y in sums], twice.tolist()), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run, "tid long, start long, size int, h long, c1 long, c2 long, twice boolean"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text with the list of its contexts that are needed, to a row for each with its bytes."""
    schema = pa.schema([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("context", pa.binary())])
    for batch in batches:
        for k in range(batch.num_rows):
            raw = batch.column(1)[k].as_py().encode("utf-8", "surrogatepass")
            tid, asked = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
            for at in range(0, len(asked), 2048):
                part = asked[at : at + 2048]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["h"] for a in part], pa.int64()), pa.array([a["c1"] for a in part], pa.int64()), pa.array([a["c2"] for a in part], pa.int64()), pa.array([tid] * len(part), pa.int64()), pa.array([a["start"] for a in part], pa.int64()), pa.array([raw[a["start"] : a["start"] + a["size"]] for a in part], pa.binary())],
                    schema=schema,
                )


SPAN_SCHEMA = "h long, c1 long, c2 long, spans array<struct<a:int,b:int>>"


def _shard(length: int, block: int):
    """Suffix arrays over contexts that come sorted by anchor; a portion ends with an anchor, so none is split."""
    schema = pa.schema([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([r[5] for r in rows], [(r[3], r[4]) for r in rows], length)
        hit = [(r, s) for r, s in zip(rows, found, strict=True) if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r, _ in hit], pa.int64()) for j in range(3)] + [pa.array([[{"a": a, "b": b} for a, b in s] for _, s in hit], schema.field("spans").type)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _portions(batches, block, True):
            yield answer(rows)

    return run


def _portions(batches: Iterator[pa.RecordBatch], block: int, whole_anchors: bool) -> Iterator[list[tuple]]:
    """Rows of contexts, sorted by anchor, in portions of about `block` bytes; with whole_anchors, none splits an anchor."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held >= block and not (whole_anchors and row[0] == rows[-1][0]):
                yield rows
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
    if rows:
        yield rows


MEMBER = pa.struct([("c", pa.int32()), ("at", pa.int32())])
KEY = pa.struct([("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])
GRAM_SCHEMA = "shard string, keys array<struct<h:long,c1:long,c2:long>>, g1 long, g2 long, t1 long, p1 long, t2 long, p2 long, members array<struct<c:int,at:int>>"


def _gram_rows(length: int, block: int):
    """Contexts of crowded anchors to rows for their different strings: the digest, the least and the greatest place (text
    and position), and members (context, position in it). A shard has one more row, with the keys of its contexts."""
    names = ["shard", "keys", "g1", "g2", "t1", "p1", "t2", "p2", "members"]
    types = [pa.string(), pa.list_(KEY), *[pa.int64()] * 6, pa.list_(MEMBER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _portions(batches, block, False):
            shard = uuid.uuid4().hex
            s = Sorted.of([r[5] for r in rows], [(r[3], r[4]) for r in rows], length)
            # Only strings of whole length; those of one group are side by side.
            at = np.flatnonzero(s.whole)
            group = (np.cumsum(s.new) - 1)[at]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else at
            tids = np.array([r[3] for r in rows], np.int64)[s.owner[at]]
            starts = np.array([r[4] for r in rows], np.int64)[s.owner[at]] + s.inner[at]
            by = np.lexsort((starts, tids, group))
            ends = np.concatenate([heads[1:], [len(at)]]) - 1 if len(at) else at
            first, last = by[heads], by[ends]
            sums = [_digest(s.data[p : p + length]) for p in s.order[at[heads]].tolist()]
            members = pa.StructArray.from_arrays([pa.array(s.owner[at].astype(np.int32)), pa.array(s.inner[at].astype(np.int32))], fields=list(MEMBER))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([shard], [[{"h": r[0], "c1": r[1], "c2": r[2]} for r in rows]], *[[None]] * 7), types, strict=True)], names=names)
            for a in range(0, len(heads), 4096):
                b = min(a + 4096, len(heads))
                upto = int(heads[b]) if b < len(heads) else len(at)
                offsets = pa.array(np.concatenate([heads[a:b], [upto]]).astype(np.int32) - np.int32(heads[a]))
                part = [pa.array([shard] * (b - a)), pa.nulls(b - a, types[1]), pa.array([g for g, _ in sums[a:b]], pa.int64()), pa.array([g for _, g in sums[a:b]], pa.int64())]
                part += [pa.array(x) for x in (tids[first[a:b]], starts[first[a:b]], tids[last[a:b]], starts[last[a:b]])]
                yield pa.RecordBatch.from_arrays([*part, pa.ListArray.from_arrays(offsets, members.slice(int(heads[a]), upto - int(heads[a])))], schema=pa.schema(list(zip(names, types, strict=True))))

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with the starts of strings that are repeats, to contexts with spans; strings overlap, spans don't."""
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in _merge([(x["a"], x["b"]) for x in s])] for s in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["h", "c1", "c2", "spans"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text with its removed spans, to what is left of it."""
    schema = pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for batch in batches:
        for sha, text, given in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            raw, at, left = text.encode("utf-8", "surrogatepass"), 0, []
            spans = _merge([(s["a"], s["b"]) for s in given])
            for a, b in spans:
                left.append(raw[at:a])
                at = b
            kept = b"".join([*left, raw[at:]])
            yield pa.RecordBatch.from_arrays([pa.array([sha]), pa.array([len(raw) - len(kept)], pa.int64()), pa.array([len(spans)], pa.int64()), pa.array([kept], pa.binary())], schema=schema)


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = 400, block: int = BLOCK, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows of `docs` without the text, with sha, n_bytes and n_copies; (sha, n_removed, n_spans, kept) of texts that lose bytes).

    Texts are UTF-8 bytes, null ones empty; matches never cross texts. A row without a partner in the second
    table loses nothing. kept has the bytes that remain, which may split characters. Repeated rows are copies of
    one text and so go whole if they have `length` bytes. An empty table gives two empty results.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__mr_text", text).withColumns({"__mr_sha": F.sha2("__mr_text", 256), "__mr_bytes": F.octet_length("__mr_text").cast("long")})
    texts = (
        keyed.where(F.col("__mr_bytes") >= length)
        .groupBy(F.col("__mr_sha").alias("sha"))
        .agg(F.first("__mr_text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .select("sha", "copies", "text", F.monotonically_increasing_id().alias("tid"))
    )
    texts = scratch.cut(texts, "texts")
    run, schema = _anchor_rows(length)
    found = scratch.cut(texts.select("tid", "text").mapInArrow(run, schema), "anchors")

    same = ["h", "c1", "c2"]
    one = F.min(F.struct("tid", "start", "size")).alias("one")
    contexts = found.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), one)
    shared = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("places"), F.sum("one.size").alias("bytes"), F.max("twice").alias("inner"))
    shared = shared.where("places > 1 or inner").select("h", "contexts", "bytes")
    shared = scratch.cut(contexts.join(shared, "h").select(*same, "n", "twice", "contexts", "bytes", "one.*"), "shared")

    # Contexts found twice are repeats as they are, from end to end.
    plain = shared.where("n > 1").select(*same, F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("spans"))
    wanted = shared.where("contexts > 1 or (twice and n = 1)")

    # From here on, only texts with an anchor that is found twice.
    some = found.select("tid", "h").join(shared.select("h").distinct(), "h", "left_semi").select("tid").distinct()
    texts_some = scratch.cut(texts.join(some, "tid", "left_semi"), "texts-some")
    asked = wanted.groupBy("tid").agg(F.collect_list(F.struct(*same, "start", "size")).alias("asked"))
    bytes_of = texts_some.select("tid", "text").join(asked, "tid").select("tid", "text", "asked").mapInArrow(_context_rows, "h long, c1 long, c2 long, tid long, start long, context binary")
    bytes_of = scratch.cut(bytes_of, "contexts")
    crowded = wanted.where(F.col("bytes") > hot).select("h").distinct()
    few = bytes_of.join(crowded, "h", "left_anti").repartitionByRange("h").sortWithinPartitions("h").select(*same, "tid", "start", "context")
    few = few.mapInArrow(_shard(length, block), SPAN_SCHEMA)
    dealt = bytes_of.join(crowded, "h", "left_semi").repartitionByRange("h", "c1").sortWithinPartitions("h", "c1").select(*same, "tid", "start", "context")
    grams = scratch.cut(dealt.mapInArrow(_gram_rows(length, block), GRAM_SCHEMA), "grams")
    strings = grams.where("keys is null")
    twice = strings.groupBy("g1", "g2").agg(F.min(F.struct("t1", "p1")).alias("low"), F.max(F.struct("t2", "p2")).alias("high")).where("low < high").select("g1", "g2")
    hit = strings.join(twice, ["g1", "g2"], "left_semi").select("shard", F.explode("members").alias("m")).groupBy("shard", "m.c").agg(F.collect_list("m.at").alias("at"))
    keyed_by = grams.where("keys is not null").select("shard", F.posexplode("keys").alias("c", "key"))
    many = hit.join(keyed_by, ["shard", "c"]).select("key.*", F.transform("at", lambda a: F.struct(a.alias("a"), (a + length).alias("b"))).alias("spans"))
    many = many.select(*same, "spans").mapInArrow(_merged_rows, SPAN_SCHEMA)
    spans = scratch.cut(plain.unionByName(few).unionByName(many), "spans")

    by_text = (
        found.join(spans, same)
        .select("tid", "start", F.explode("spans").alias("s"))
        .select("tid", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))
        .groupBy("tid", "a")  # contexts overlap: of spans with one start, the longest
        .agg(F.max("b").alias("b"))
        .groupBy("tid")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    single = texts_some.where("copies = 1").select("tid", "sha", "text").join(by_text, "tid").select("sha", "text", "spans")
    kept = scratch.cut(single.mapInArrow(_cut_rows, "sha string, n_removed long, n_spans long, kept binary"), "kept")
    gone = texts.where("copies > 1").select("sha", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    rows = keyed.drop(text_col, "__mr_text")
    return rows, kept.unionByName(gone)
