"""Distinct n-grams of code points that groups of texts share, without shuffling a row for every place.

The anchor of a gram is the least hash of ANCHOR code points in it, so that equal grams have equal anchors. Grams with one
anchor that start next to each other make a context, some 30 grams in a row of numbers. An anchor with one context, which
has the anchor once, has no gram that is anywhere else: its grams are counted as they are. Of all others the contexts' own texts
are fetched by a second pass over the table, meet by their anchors, and their grams are compared.
Contexts and grams are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Scratch

#: Code points in an anchor, in what is hashed at once, and in a portion of contexts; grams in a context; contexts that a task
#: remembers as sent; anchors in a file.
ANCHOR, PIECE, BLOCK, RUN, SENT, FILE = 16, 1 << 19, 1_000_000, 512, 500_000, 4_000_000
#: Fixed values, as anchors and grams must be the same for every text.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Sources of a portion that fit one number.
BITS = 62


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Hashes:
    """Hashes of all strings in code points, by running sums of powers modulo 2**64."""

    def __init__(self) -> None:
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def sums(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each base the running sums before each place, and what takes a place's power away again."""
        n = len(data) + 1
        if not self.powers or len(self.powers[0][0]) < n:
            self.powers = []
            for base in BASES:
                up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
                up[0] = down[0] = 1
                self.powers.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))
        out = []
        for k, (up, down) in enumerate(self.powers):
            s = np.zeros(n, np.uint64)
            np.cumsum(_mixed(data.astype(np.uint64) + np.uint64(1 + (k << 40))) * up[: n - 1], out=s[1:])
            out.append((s, down))
        return out


def _of(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s, down = sums
    return _mixed((s[end] - s[start]) * down[start])


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` values in a row."""
    n = len(values)
    grid = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF) if pick is np.minimum else np.uint64(0), np.uint64)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    return pick(pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[: n - width + 1], pick.accumulate(grid, axis=1).ravel()[width - 1 : n])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def contexts_of(joined: str, sizes: np.ndarray, n: int, hashes: Hashes):
    """(text, start, grams, anchor, two hashes, twice) of the contexts of texts that follow each other, each of n or more.

    twice: the context may have a gram at two places.
    """
    data, width = _points(joined), n - ANCHOR + 1
    sums = hashes.sums(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = _of(sums[0], at, at + ANCHOR)
    least = _slide(h, width, np.minimum)
    ends = np.cumsum(sizes)
    valid = np.ones(len(least), bool)
    for k in range(1, n):  # grams that pass a text's end
        p = ends[:-1] - k
        valid[p[p < len(least)]] = False
    grams = np.flatnonzero(valid)
    value = least[grams]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (grams[1:] != grams[:-1] + 1)])
    heads = np.flatnonzero(new)
    runs = np.diff(np.concatenate([heads, [len(grams)]]))
    if runs.max() > RUN:
        heads = np.concatenate([np.arange(a, a + m, RUN) for a, m in zip(heads.tolist(), runs.tolist(), strict=True)])
        runs = np.diff(np.concatenate([heads, [len(grams)]]))
    # Grams that may hold their anchor's hash at two places; longer runs may repeat without.
    edge = np.zeros(width - 1, np.uint64)
    hit = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    x, y = hit[:-1], hit[1:]
    pair = (h[x] == h[y]) & (y - x < width)
    cover = np.zeros(len(least) + 1, np.int64)
    np.add.at(cover, np.minimum(np.maximum(y[pair] - width + 1, 0), len(least)), 1)
    np.add.at(cover, np.minimum(x[pair] + 1, len(least)), -1)
    twice = (np.add.reduceat((np.cumsum(cover)[grams] > 0).astype(np.int64), heads) > 0) | (runs > width)
    start = grams[heads]
    end = start + runs + n - 1
    anchor = value[heads].view(np.int64)
    # The parts of a run that was cut count as contexts of one anchor, which then has more than one.
    return np.searchsorted(ends, start, side="right"), start, runs, anchor, _of(sums[0], start, end).view(np.int64), _of(sums[1], start, end).view(np.int64), twice


def _pieces(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list[str], list[str]]]:
    """Sources and texts of about PIECE code points; of longer texts parts, which overlap by n - 1, so that each gram is in one."""
    sources: list[str] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for source, text in zip(batch.column(0), batch.column(1), strict=True):
            source, text = source.as_py(), text.as_py()
            for a in range(0, len(text) - n + 1, PIECE):
                sources.append(source)
                texts.append(text[a : a + PIECE + n - 1])
                held += len(texts[-1])
                if held >= PIECE:
                    yield sources, texts
                    sources, texts, held = [], [], 0
    if texts:
        yield sources, texts


def _found(batches: Iterator[pa.RecordBatch], n: int, wanted) -> Iterator[tuple]:
    """(source, context, grams, anchor, two hashes, twice) of the contexts with anchors that `wanted` marks, few of them again."""
    hashes, sent = Hashes(), set()
    for sources, texts in _pieces(batches, n):
        joined = "".join(texts)
        found = contexts_of(joined, np.array([len(t) for t in texts]), n, hashes)
        keep = np.flatnonzero(wanted(found[3]))
        rows = []
        for t, a, k, h, c1, c2, twice in zip(*[x[keep].tolist() for x in found], strict=True):
            key = (c1, c2, sources[t])
            if key not in sent:
                sent.add(key)
                rows.append((sources[t], joined[a : a + k + n - 1], k, h, c1, c2, twice))
        if len(sent) > SENT:
            sent.clear()
        if rows:
            yield tuple(zip(*rows, strict=True))


def _context_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, _, k, h, c1, c2, twice in _found(batches, n, lambda h: np.ones(len(h), bool)):
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(k, pa.int32()), pa.array(twice), pa.array(source)], names=["h", "c1", "c2", "n", "twice", "source"])

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, to the anchors whose grams must be compared; and of others, how many grams each set of sources has."""
    columns = ["h", "c1", "c2", "n", "twice"]

    def answer(x: dict[str, np.ndarray], source: pa.DictionaryArray, last: bool) -> tuple[pa.RecordBatch, np.ndarray]:
        """What anchors have; unless `last`, rows of the last one, which may go on, are left for the next batch."""
        code, listed = source.indices.to_numpy(), source.dictionary.to_pylist()
        new = np.concatenate([[True], x["h"][1:] != x["h"][:-1]])
        heads = np.flatnonzero(new)
        contexts = new | np.concatenate([[True], (x["c1"][1:] != x["c1"][:-1]) | (x["c2"][1:] != x["c2"][:-1])])
        shared = np.add.reduceat(contexts.astype(np.int64), heads) + np.maximum.reduceat(x["twice"].astype(np.int64), heads) > 1
        left = np.empty(0, np.int64)
        if not last:
            # Of an anchor that is known to be shared one row does, of others one with each source.
            tail = np.arange(heads[-1], len(code))
            if shared[-1]:
                left, x["twice"] = tail[:1], x["twice"].copy()
                x["twice"][tail[0]] = True
            else:
                left = tail[np.unique(code[tail], return_index=True)[1]]
            heads, shared, upto = heads[:-1], shared[:-1], int(heads[-1])
        else:
            upto = len(code)
        sets: dict[tuple[str, ...], int] = {}
        ends = np.concatenate([heads[1:], [upto]]) if len(heads) else heads
        one = np.flatnonzero(~shared & (ends - heads == 1))
        for k, n in enumerate(np.bincount(code[heads[one]], x["n"][heads[one]], len(listed)).tolist()):
            if n:
                sets[(listed[k],)] = int(n)
        for k in np.flatnonzero(~shared & (ends - heads > 1)).tolist():
            s = tuple(sorted({listed[c] for c in code[heads[k] : ends[k]].tolist()}))
            sets[s] = sets.get(s, 0) + int(x["n"][heads[k]])
        h = x["h"][heads[shared]]
        rows = [pa.array([*h.tolist(), *[None] * len(sets)], pa.int64()), pa.array([*[None] * len(h), *map(list, sets)], pa.list_(pa.string())), pa.array([*[None] * len(h), *sets.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(rows, names=["h", "s", "n"]), left

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        x = {c: t.column(c).to_numpy() for c in columns}
        out, left = answer(x, t.column("source").combine_chunks().dictionary_encode(), False)
        held = t.take(left).set_column(t.schema.get_field_index("twice"), "twice", pa.array(x["twice"][left]))
        yield out
    if held is not None:
        yield answer({c: held.column(c).to_numpy() for c in columns}, held.column("source").combine_chunks().dictionary_encode(), True)[0]


def _text_rows(n: int, root: str, files: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [_mapped(root, f"anchors-{k}") for k in range(files)]

        def wanted(h: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h), bool)
            file = file_of(h, files)
            for k in np.unique(file).tolist():
                i = np.flatnonzero(file == k)
                if len(anchors[k]):
                    out[i] = anchors[k][np.minimum(np.searchsorted(anchors[k], h[i]), len(anchors[k]) - 1)] == h[i]
            return out

        for source, context, _, h, *_ in _found(batches, n, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(source), pa.array([c.encode("utf-8", "surrogatepass") for c in context], pa.binary())], names=["h", "source", "context"])

    return run


def file_of(h: np.ndarray, files: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype(np.int64)


def _write_anchors(root: str):
    """A file of anchors in order; whole or not at all."""

    def run(t: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(path)
        k = t.column("file")[0].as_py()
        part = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(np.sort(t.column("h").to_numpy()).astype("<i8").tobytes())
        store.move(part, f"{path}/anchors-{k}")
        return pa.table({"file": pa.array([k], pa.int64())})

    return run


def _mapped(root: str, name: str) -> np.ndarray:
    """The file in memory, mapped; nothing if it isn't there. From a store that is no local path, by way of a temporary file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return np.empty(0, np.int64)
    if isinstance(store, fs.LocalFileSystem):
        return np.asarray(np.memmap(f"{path}/{name}", "<i8", "r"))
    with store.open_input_stream(f"{path}/{name}") as f, tempfile.NamedTemporaryFile(delete=False) as out:
        while block := f.read(1 << 20):
            out.write(block)
    mapped = np.asarray(np.memmap(out.name, "<i8", "r"))
    os.unlink(out.name)
    return mapped


def _compare(n: int, block: int):
    """Contexts sorted by anchor, to how many different grams each set of sources has; of anchors that are split over portions, and
    where sources are many, to the grams themselves."""
    names = ["s", "n", "g1", "g2", "source"]
    types = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    hashes = Hashes()

    def answer(rows: list[tuple[str, str]], split: bool) -> pa.RecordBatch:
        rows = list(dict.fromkeys(rows))
        sizes = np.array([len(c) for _, c in rows])
        code = {s: k for k, s in enumerate(dict.fromkeys(s for s, _ in rows))}
        sums = hashes.sums(_points("".join(c for _, c in rows)))
        start = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(sizes - n + 1) - (sizes - n + 1)), sizes - n + 1) + np.arange(int((sizes - n + 1).sum()))
        source = np.repeat(np.array([code[s] for s, _ in rows]), sizes - n + 1)
        g1, g2 = (_of(s, start, start + n) for s in sums)
        by = np.lexsort((source, g2, g1))
        g1, g2, source = g1[by], g2[by], source[by]
        new = np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
        listed = list(code)
        if split or len(code) > BITS:
            first = np.flatnonzero(new | np.concatenate([[True], source[1:] != source[:-1]]))
            columns = [pa.nulls(len(first), types[0]), pa.nulls(len(first), types[1]), pa.array(g1[first].view(np.int64)), pa.array(g2[first].view(np.int64)), pa.array(np.array(listed, object)[source[first]], pa.string())]
        else:
            masks, counts = np.unique(np.bitwise_or.reduceat(np.int64(1) << source, np.flatnonzero(new)), return_counts=True)
            sets = [sorted(s for k, s in enumerate(listed) if m >> k & 1) for m in masks.tolist()]
            columns = [pa.array(sets, types[0]), pa.array(counts, types[1]), *[pa.nulls(len(sets), t) for t in types[2:]]]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(names, types, strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, str]] = []  # of anchors before, whole
        open_: list[tuple[str, str]] = []  # of this anchor
        anchor, split, held, size = None, False, 0, 0
        for batch in batches:
            for h, source, context in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if h != anchor:
                    if split:
                        yield answer(open_, True)
                    else:
                        done += open_
                        held += size
                    anchor, open_, split, size = h, [], False, 0
                    if held >= block:
                        yield answer(done, False)
                        done, held = [], 0
                elif size >= block:
                    yield answer(open_, True)
                    open_, split, size = [], True, 0
                open_.append((source, context.decode("utf-8", "surrogatepass")))
                size += len(open_[-1][1])
        if split:
            yield answer(open_, True)
        else:
            done += open_
        if done:
            yield answer(done, False)

    return run


def source_sets(docs: DataFrame, n: int, *, source_col: str = "source", text_col: str = "text", block: int = BLOCK, per_file: int = FILE) -> DataFrame:
    """(s, n): sets of sources, sorted, and how many different n-grams of code points just the sources of the set have.

    Rows without a source or text, and shorter texts, have none. n must be over ANCHOR. `block` and `per_file` change no result.
    """
    if n <= ANCHOR:
        raise ValueError(f"n must be over {ANCHOR}")
    scratch = Scratch(docs.sparkSession, "grams")
    root = scratch.path("index")
    root = root if "://" in root else "file://" + root.removeprefix("file:")
    d = docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("text")).where(F.col("source").isNotNull() & (F.length("text") >= n))
    found = d.mapInArrow(_context_rows(n), "h long, c1 long, c2 long, n int, twice boolean, source string").repartition("h")
    one = scratch.cut(found.sortWithinPartitions("h", "c1", "c2").mapInArrow(_anchors, "h long, s array<string>, n long"), "anchors")

    shared = one.where("h is not null").select("h")
    files = max(1, -(-shared.count() // per_file))
    file = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(files).cast("long"), 32)
    scratch.cut(shared.select(file.alias("file"), "h").groupBy("file").applyInArrow(_write_anchors(root), "file long"), "files")
    again = d.mapInArrow(_text_rows(n, root, files), "h long, source string, context binary").repartition("h").sortWithinPartitions("h")
    compared = scratch.cut(again.mapInArrow(_compare(n, block), "s array<string>, n long, g1 long, g2 long, source string"), "compared")
    grams = compared.where("s is null").groupBy("g1", "g2").agg(F.array_sort(F.collect_set("source")).alias("s")).select("s", F.lit(1).cast("long").alias("n"))
    parts = one.where("h is null").select("s", "n").unionByName(compared.where("s is not null").select("s", "n")).unionByName(grams)
    return scratch.cut(parts.groupBy("s").agg(F.sum("n").alias("n")), "sets")
