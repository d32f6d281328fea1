"""An n-gram language model in an Elias-Fano trie, built and asked in one exchange a level.

Level 1 has the words: their hashes, ascending, and the running sums of their counts, both monotone and in
Elias-Fano code; a word's id is its rank. Level 2 has the word pairs: contexts, pointers, monotone, to where each
context's children begin, and the children's ids, made monotone by adding to each the last sum of the context before
it. Level 3 has the same for words after two words, whose ids side by side are the context. Probabilities are quantised
to a byte. All levels are cut into shards of bounded size, files in the shared folder that their owners map into memory.
Looking up a child is a successor search relative to its context's sum, on the mapped bits.

Texts are cut into portions. A portion sends each of its words and n-grams once, with how often its training texts have
it, to the shard that owns it. The shard adds up, writes its part of the trie, answers from it what every portion asked, and
the answers return to the portions. So each n-gram travels twice, and work grows with the texts, not with texts times model.

The probability of a word w after u is max(c(uw) - D, 0) / c(u) + r(u) * p(w), where p(w) = (c(w) + 1) / (N + V + 1)
and r(u) is what makes the sum over all w one; after t and u it is max(c(tuw) - D, 0) / c(tu) + r(tu) * p(w after u).
Pairs and triples seen less often than `least` count as unseen. A text's first word has only the end before it.

A context that may have more than CROWDED tokens has its children in several shards. These keep numerators, and what the
shards together have of a context comes from a second exchange, by contexts.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.elias_fano import Sequence, encode, whole
from millrace.llm.shingles import Words, mixed
from millrace.session import Scratch

#: Portions' words in a shard of level 1, and tokens whose pairs and triples share a shard of levels 2 and 3.
WORDS, PAIRS = 1_000_000, 750_000
#: A context that may have more tokens than this has its children in several shards, by the word.
CROWDED = 100_000
DISCOUNT = 0.75
#: The hash of the end token. That of a word is it with a probability of 2**-64.
END = np.uint64(0x5EED0FE4D0F7E575)
#: Bytes of texts that are hashed at once, and of texts in a portion; a longer text is a portion by itself.
BATCH, PORTION = 1 << 20, 6 << 20
#: Values in a codebook, and how many of them are quantiles; the others are spread evenly over the logarithms.
BOOK, QUANTILES = 256, 160
IDS = 1 << 32


def tokens_of(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens of each text): its words, then the end. Hashed by portions of BATCH bytes."""
    out, sizes, at = [], [], 0
    while at < len(texts):
        held, first = 0, at
        while at < len(texts) and (held == 0 or held + len(texts[at]) < BATCH):
            held += len(texts[at]) + 1
            at += 1
        h, upto = words.of(texts[first:at])
        ends = upto + np.arange(at - first)
        part = np.empty(len(h) + at - first, np.uint64)
        is_end = np.zeros(len(part), bool)
        is_end[ends] = True
        part[is_end] = END
        part[~is_end] = h
        out.append(part)
        sizes.append(np.diff(np.concatenate([[-1], ends])))
    return np.concatenate(out), np.concatenate(sizes)


# --- numbers as bytes -----------------------------------------------------------------------------------------


def pack(x: np.ndarray, size: int) -> bytes:
    """Numbers of `size` bytes, by bytes of equal weight, which compress well where high ones are mostly 0."""
    flat = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T)
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def unpack(data: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(f"<u{size}").ravel()


def pack_rising(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers, as differences."""
    return pack(np.diff(x, prepend=np.uint64(0)), 8)


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 8), dtype=np.uint64)


def pack_few(codes: np.ndarray, values: np.ndarray) -> bytes:
    """values[codes], as those of the values that occur, and which of them each is: BOOK + 1 at most."""
    used, code = np.unique(codes, return_inverse=True)
    return len(used).to_bytes(2, "little") + values[used].astype("<f4").tobytes() + pack(code, 2 if len(used) > 256 else 1)


def unpack_few(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:2], "little")
    return np.frombuffer(data[2 : 2 + 4 * n], "<f4").astype(np.float64)[unpack(data[2 + 4 * n :], 2 if n > 256 else 1)]


# --- files in the shared folder -------------------------------------------------------------------------------


def write_file(root: str, name: str, data: bytes) -> None:
    """Whole or not at all, so that a task that runs twice does no harm."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def map_file(root: str, name: str) -> np.ndarray:
    """The file in memory, mapped; from a store that is no local path, by way of a temporary file without a name."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    with store.open_input_stream(f"{path}/{name}") as f, tempfile.NamedTemporaryFile(delete=False) as out:
        while block := f.read(1 << 20):
            out.write(block)
    mapped = np.memmap(out.name, np.uint8, "r")
    os.unlink(out.name)
    return mapped


# --- portions -------------------------------------------------------------------------------------------------


def _portions(limit: int):
    """Rows (key, held out, text) to portions: keys, which are held out, their sizes, kinds of tokens, and tokens as kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(), TaskContext.get().partitionId() << 33

        def portion(ids: list[pa.Array], held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            h, sizes = tokens_of(texts, words)
            kinds, tokens = np.unique(h, return_inverse=True)
            number += 1
            values = pa.concat_arrays(ids)
            row = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([pack(np.array(held), 1)], pa.binary()), pa.array([pack(sizes, 4)], pa.binary())]
            row += [pa.array([len(kinds)]), pa.array([pack_rising(kinds)], pa.binary()), pa.array([pack(tokens, 4)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["portion", "ids", "held", "sizes", "n_kinds", "kinds", "tokens"])

        ids: list[pa.Array] = []
        held: list[bool] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            first = 0
            out = batch.column(1).to_pylist()
            for k, t in enumerate(batch.column(2)):
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                held.append(out[k])
                size += len(texts[-1]) + 1
                if size >= limit:
                    ids.append(batch.column(0).slice(first, k + 1 - first))
                    yield portion(ids, held, texts)
                    ids, held, texts, size, first = [], [], [], 0, k + 1
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
        if texts:
            yield portion(ids, held, texts)

    return run


def _binary_rows(names: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _weights(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, 1 for each token to learn from and 0 for held-out ones)."""
    sizes = unpack(row["sizes"], 4).astype(np.int64)
    return sizes, np.repeat(1 - unpack(row["held"], 1).astype(np.int64), sizes)


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes, so that a shard's ids follow those of the shard before."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


WORD_ASK = [("shard", pa.int64()), ("portion", pa.int64()), ("kinds", pa.binary()), ("counts", pa.binary())]


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds = unpack_rising(row["kinds"])
                counts = np.bincount(unpack(row["tokens"], 4), _weights(row)[1], len(kinds)).astype(np.uint64)
                cuts = np.searchsorted(word_shard(kinds, shards), np.arange(shards + 1))
                yield _binary_rows(WORD_ASK, [(s, row["portion"], pack_rising(kinds[cuts[s] : cuts[s + 1]]), pack(counts[cuts[s] : cuts[s + 1]], 8)) for s in np.flatnonzero(np.diff(cuts)).tolist()])

    return run


# --- level 1 --------------------------------------------------------------------------------------------------

WORD_ANSWER = "shard long, portion long, n long, total long, ranks binary, counts binary"


def _level_1(root: str):
    """A shard's words: adds up, writes its file, and answers each portion with ranks, -1 if unknown, and counts.

    One row without a portion has the shard's number of words and tokens.
    """

    def run(t: pa.Table) -> pa.Table:
        shard, rows = t.column("shard")[0].as_py(), t.select(["portion", "kinds", "counts"]).to_pylist()
        asked = [unpack_rising(r["kinds"]) for r in rows]
        h, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([unpack(r["counts"], 8) for r in rows]).astype(np.float64)).astype(np.int64)
        h, c = h[c > 0], c[c > 0]
        write_file(root, f"words-{shard}", encode(h) + encode(np.cumsum(c)))
        data = map_file(root, f"words-{shard}")
        words = Sequence(data)
        sums = Sequence(data, words.end)
        out = [(shard, None, len(h), int(c.sum()), None, None)]
        for r, kinds in zip(rows, asked, strict=True):
            at, known = words.successors(kinds)
            ranks, counts = np.full(len(kinds), 0xFFFFFFFF, np.uint64), np.zeros(len(kinds), np.uint64)
            k = at[known]
            ranks[known] = k
            if len(k):
                upto, before = sums[k], sums[np.maximum(k - 1, 0)]
                counts[known] = upto - np.where(k > 0, before, np.uint64(0))
            out.append((shard, r["portion"], None, None, pack(ranks, 4), pack(counts, 8)))
        return pa.table(_binary_rows([("shard", pa.int64()), ("portion", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("ranks", pa.binary()), ("counts", pa.binary())], out).columns, names=["shard", "portion", "n", "total", "ranks", "counts"])

    return run


def _named(starts: dict[int, int]):
    """Portions with their answers of level 1, to portions with the ids and counts of their kinds."""
    fields = ("portion", "ids", "held", "sizes", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            ids, counts, end = [], [], []
            for kinds, answers in zip(batch.column(names.index("kinds")), batch.column(names.index("answers")), strict=True):
                answers = sorted(answers.as_py(), key=lambda a: a["shard"])
                ranks = [(unpack(a["ranks"], 4).astype(np.int64), starts[a["shard"]]) for a in answers]
                # An id is stored plus one, so that 0 is an unknown word.
                ids.append(pack(np.concatenate([np.where(r == 0xFFFFFFFF, 0, r + s + 1) for r, s in ranks]).astype(np.uint64), 8))
                counts.append(pack(np.concatenate([unpack(a["counts"], 8) for a in answers]), 8))
                end.append(int(np.searchsorted(unpack_rising(kinds.as_py()), END)))
            kept = [batch.column(names.index(f)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(end, pa.int64())], names=[*fields, "words", "counts", "end"])

    return run


# --- what a portion asks of levels 2 and 3 --------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How n-grams are dealt over `shards`. Pairs are numbered u * n_words + w.

    A context's place follows its first word's id, so that a portion's contexts in a shard lie close together. As ids
    follow hashes, words with few tokens spread evenly over the shards; those with more than `crowded` go on into the
    shards behind theirs, level 3 contexts by their second word, and children of one context by a hash of the child.
    """

    shards: int
    n_words: int
    order: int
    crowded: int

    def pair(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return u.astype(np.uint64) * np.uint64(self.n_words) + w.astype(np.uint64)

    def parts(self, room: np.ndarray) -> np.ndarray:
        """Shards that something with `room` tokens goes to."""
        return np.maximum(1, -(-room // self.crowded))

    def shard_of(self, first: np.ndarray, second: np.ndarray | None, c_first: np.ndarray, w: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Where child w of the context of one word, or of two, is kept; the context may have `room` tokens."""
        at = first.astype(np.int64) * self.shards // self.n_words
        if second is not None:
            at += second.astype(np.int64) * np.minimum(self.parts(c_first), self.shards) // self.n_words
        at += (mixed(w.astype(np.uint64) + np.uint64(7)) % self.parts(room).astype(np.uint64)).astype(np.int64)
        return at % self.shards


def by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """A stable order by shard; small numbers are sorted by radix."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


@dataclass
class Asked:
    """A level's different (context, word) of a portion, by shard, context and word; `of` has each of `at` tokens' place.

    runs: (first entries of runs with one shard and context, their sizes). words and counts are only there for asking.
    """

    at: np.ndarray
    of: np.ndarray
    shard: np.ndarray
    runs: tuple[np.ndarray, np.ndarray]
    contexts: np.ndarray
    crowded: np.ndarray
    words: np.ndarray | None
    counts: np.ndarray | None

    @classmethod
    def from_keys(cls, at: np.ndarray, of: np.ndarray, context: np.ndarray, word: np.ndarray, shard: np.ndarray, room: np.ndarray, weight: np.ndarray | None, to: Layout) -> Asked:
        """Entries by context and word, and which of them each token has; `room` is how many tokens their contexts may have."""
        counts = None if weight is None else np.bincount(of, weight, len(context)).astype(np.uint32)
        by = by_shard(shard, to.shards)
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        shard, context = shard[by], context[by]
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (shard[1:] != shard[:-1])])) if len(by) else by
        runs = first, np.diff(np.concatenate([first, [len(by)]]))
        crowded = room[by[first]] > to.crowded
        asking = weight is not None
        return cls(at.astype(np.int32), place[of], shard if asking else shard[:0], runs, context[first], crowded, word[by] if asking else None, counts[by] if asking else None)


@dataclass
class Portion:
    """Tokens of a portion with their counts, and what it asks of levels 2 and 3, always in one order."""

    sizes: np.ndarray
    counts: np.ndarray
    levels: dict[int, Asked]

    @classmethod
    def of(cls, row: dict, to: Layout, levels: tuple[int, ...], asking: bool) -> Portion:
        """levels: 0 for level 2, 1 for level 3."""
        sizes, weight = _weights(row)
        kind = unpack(row["tokens"], 4)
        ids, c = unpack(row["words"], 8).astype(np.int64) - 1, unpack(row["counts"], 8).astype(np.int64)
        end, end_count = ids[row["end"]], c[row["end"]]
        w, c_w = ids[kind], c[kind]
        del kind
        # Texts follow each other, so before a first token stands an end.
        u = np.concatenate([[end], w[:-1]])
        # A context must be known; an unknown word asks for its context's remainder by way of word 0.
        word = np.maximum(w, 0).astype(np.uint64)
        weight = np.where(w >= 0, weight, 0).astype(np.int8) if asking else None
        heavy = lambda at: None if weight is None else weight[at]
        at = np.flatnonzero(u >= 0)
        pair, of = np.unique(to.pair(u[at], word[at]), return_inverse=True)
        del u
        one, two = np.divmod(pair, np.uint64(to.n_words))
        room, next_room = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        room[of], next_room[of] = np.concatenate([[end_count], c_w[:-1]])[at], c_w[at]
        out = {}
        if 0 in levels:
            out[0] = Asked.from_keys(at, of, one, two, to.shard_of(one, None, room, two, room), room, heavy(at), to)
        if 1 in levels:
            # The pair before a token is its context; unless the token is its text's first one, or a part is unknown.
            pair_of = np.full(len(w), -1, np.int32)
            pair_of[at] = of
            before = np.concatenate([[-1], np.where(w >= 0, pair_of, -1)[:-1]])
            before[np.cumsum(sizes)[:-1]] = -1
            del pair_of, of
            at = np.flatnonzero(before >= 0)
            key, of = np.unique((before[at].astype(np.uint64) << np.uint64(32)) | word[at], return_inverse=True)
            del before, word
            rank, third = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
            del key
            both = np.minimum(room, next_room)[rank]
            out[1] = Asked.from_keys(at, of, pair[rank], third, to.shard_of(one[rank], two[rank], room[rank], third, both), both, heavy(at), to)
        return cls(sizes, c_w, out)


GRAM_ASK = [("shard", pa.int64()), ("portion", pa.int64()), ("contexts", pa.binary()), ("crowded", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]
GRAM_ASK_SCHEMA = "shard long, portion long, contexts binary, crowded binary, sizes binary, words binary, counts binary"


def _ask_grams(to: Layout, level: int):
    """Portions to a row for each shard that owns some of their n-grams. Shards of level 3 have numbers from `shards` on.

    Crowded contexts are asked for with rows of their owners' numbers, from 2 * shards on, which have no words.
    """
    shards = to.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                asked = Portion.of(row, to, (level,), True).levels[level]
                first, sizes = asked.runs
                cuts, run_cuts = (np.searchsorted(s, np.arange(shards + 1)) for s in (asked.shard, asked.shard[first]))
                rows = []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    f, g = run_cuts[s], run_cuts[s + 1]
                    rows.append((s + level * shards, row["portion"], pack_rising(asked.contexts[f:g]), pack(asked.crowded[f:g], 1), pack(sizes[f:g], 4), pack(asked.words[a:b], 4), pack(asked.counts[a:b], 4)))
                context = np.unique(asked.contexts[asked.crowded])
                rows += [(k + (level + 2) * shards, row["portion"], pack_rising(context[i]), None, None, None, None) for k, i in _by_owner(context, shards)]
                if rows:
                    yield _binary_rows(GRAM_ASK, rows)

    return run


# --- levels 2 and 3 -------------------------------------------------------------------------------------------


def codebook(values: np.ndarray) -> np.ndarray:
    """Up to BOOK of the values, ascending, the least among them: quantiles, and values next to an even grid."""
    values = np.sort(values)
    kinds = values[np.concatenate([[True], values[1:] != values[:-1]])]
    if len(kinds) <= BOOK:
        return kinds
    picks = values[(np.linspace(0, 1, QUANTILES) * (len(values) - 1)).astype(np.int64)]
    grid = kinds[np.minimum(np.searchsorted(kinds, np.linspace(kinds[0], kinds[-1], BOOK - QUANTILES)), len(kinds) - 1)]
    return np.unique(np.concatenate([picks, grid]))


class Shard:
    """A file of level 2 or 3, mapped: contexts less the least of them, pointers to their children, children, and quantised values."""

    def __init__(self, root: str, shard: int):
        data = map_file(root, f"grams-{shard}")
        self.least = data[:8].view("<u8")[0]
        self.contexts = Sequence(data, 8)
        self.starts = Sequence(data, self.contexts.end)
        self.children = Sequence(data, self.starts.end)
        n, at = self.children.n, self.children.end
        self.book = np.exp(data[at : at + 8 * BOOK].view("<f8"))
        self.codes = np.asarray(data[at + 8 * BOOK : at + 8 * BOOK + n])

    @staticmethod
    def write(root: str, shard: int, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Children by context and word; returns their values as quantised, rounded down."""
        starts = np.cumsum(sizes) - sizes
        # Children become monotone over all contexts: each context adds the last sum of the one before.
        last = words[starts + sizes - 1] + np.uint64(1)
        base = np.cumsum(last, dtype=np.uint64) - last
        book = codebook(logs)
        codes = (np.searchsorted(book, logs, side="right") - 1).astype(np.uint8)
        filled = np.concatenate([book, np.full(BOOK - len(book), book[-1])])
        write_file(root, f"grams-{shard}", b"".join([contexts[:1].astype("<u8").tobytes(), encode(contexts - contexts[0]), encode(starts.astype(np.uint64)), encode(words + np.repeat(base, sizes)), filled.astype("<f8").tobytes(), whole(codes.tobytes())]))
        return np.exp(book)[codes]

    def find(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """One more than the codes of words after contexts, 0 for unseen ones; each context is looked up once for its `sizes` words."""
        out = np.zeros(len(words), np.int64)
        if not self.contexts.n:
            return out
        at, known = self.contexts.successors(np.maximum(contexts, self.least) - self.least)
        known &= contexts >= self.least
        rows, at, sizes = np.flatnonzero(np.repeat(known, sizes)), at[known], sizes[known]
        start = self.starts[at].astype(np.int64)
        upto = np.where(at + 1 < self.contexts.n, self.starts[np.minimum(at + 1, self.contexts.n - 1)].astype(np.int64), self.children.n)
        # The sum that a context's children start from ends the context before it, plus one.
        base = np.where(start > 0, self.children[np.maximum(start - 1, 0)] + np.uint64(1), np.uint64(0))
        k, equal = self.children.successors(words[rows].astype(np.uint64) + np.repeat(base, sizes))
        hit = equal & (k >= np.repeat(start, sizes)) & (k < np.repeat(upto, sizes))
        out[rows[hit]] = self.codes[k[hit]] + np.int64(1)
        return out


#: shares and rests answer a portion; owner, contexts, given and totals are what a shard has of crowded contexts, or
#: contexts that a portion asks an owner for.
GRAM_ANSWER = "shard long, portion long, shares binary, rests binary, owner long, contexts binary, given binary, totals binary"
GRAM_FIELDS = [("shard", pa.int64()), ("portion", pa.int64()), ("shares", pa.binary()), ("rests", pa.binary()), ("owner", pa.int64()), ("contexts", pa.binary()), ("given", pa.binary()), ("totals", pa.binary())]


def owner_of(context: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(context ^ np.uint64(0xA5A5)) % np.uint64(shards)).astype(np.int64)


def _by_owner(context: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    owner = owner_of(context, shards)
    by = by_shard(owner, shards)
    cuts = np.searchsorted(owner[by], np.arange(shards + 1))
    return [(k, by[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _levels_2_3(root: str, shards: int, least: int):
    """A shard's n-grams: adds up, writes its file, and answers each portion with values and what contexts have left."""

    def run(t: pa.Table) -> pa.Table:
        shard, rows = t.column("shard")[0].as_py(), t.drop_columns(["shard"]).to_pylist()
        if shard >= 2 * shards:  # what portions ask owners of crowded contexts is only passed on
            out = [(shard, r["portion"], None, None, shard - 2 * shards, r["contexts"], None, None) for r in rows]
            return pa.table(_binary_rows(GRAM_FIELDS, out).columns, names=[n for n, _ in GRAM_FIELDS])
        contexts = [unpack_rising(r["contexts"]) for r in rows]
        sizes = [unpack(r["sizes"], 4).astype(np.int64) for r in rows]
        kinds, rank = np.unique(np.concatenate(contexts), return_inverse=True)
        crowded = np.zeros(len(kinds), bool)
        crowded[rank[np.concatenate([unpack(r["crowded"], 1) for r in rows]) > 0]] = True
        words = np.concatenate([unpack(r["words"], 4) for r in rows]).astype(np.uint64)
        key, inverse = np.unique((np.repeat(rank, np.concatenate(sizes)).astype(np.uint64) << np.uint64(32)) | words, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([unpack(r["counts"], 4) for r in rows]).astype(np.float64))
        of, words = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
        total = np.bincount(of, n, len(kinds))
        seen = np.flatnonzero(n >= max(1, least))
        given = np.zeros(len(kinds))
        if len(seen):
            have, have_sizes = np.unique(of[seen], return_counts=True)
            # Of crowded contexts, this shard doesn't have all; it keeps numerators.
            logs = np.log((n[seen] - DISCOUNT) / np.where(crowded, 1.0, total)[of[seen]])
            given[have] = np.add.reduceat(Shard.write(root, shard, kinds[have], have_sizes, words[seen], logs), np.cumsum(have_sizes) - have_sizes)
            mapped = Shard(root, shard)
            found, values = mapped.find(kinds, np.bincount(of, minlength=len(kinds)), words), np.concatenate([[0.0], mapped.book])
        else:
            found, values = np.zeros(len(key), np.int64), np.zeros(1)
        rest = np.floor(np.clip(1.0 - given, 0, 1) * 65_535)
        codes = found[inverse]
        out, a, f = [], 0, 0
        for r, c, s in zip(rows, contexts, sizes, strict=True):
            b, g = a + int(s.sum()), f + len(c)
            out.append((shard, r["portion"], pack_few(codes[a:b], values), pack(rest[rank[f:g]], 2), None, None, None, None))
            a, f = b, g
        some = np.flatnonzero(crowded & (total > 0))
        first = shards if shard >= shards else 0
        for k, i in _by_owner(kinds[some], shards):
            i = some[i]
            out.append((shard, None, None, None, first + k, pack_rising(kinds[i]), given[i].astype("<f8").tobytes(), total[i].astype("<f8").tobytes()))
        return pa.table(_binary_rows(GRAM_FIELDS, out).columns, names=[n for n, _ in GRAM_FIELDS])

    return run


REST_ANSWER = "owner long, portion long, totals binary, rests binary"


def _rests(root: str):
    """An owner's crowded contexts: adds up what shards have, keeps it in a file, and answers portions with totals and rests."""

    def run(t: pa.Table) -> pa.Table:
        owner, rows = t.column("owner")[0].as_py(), t.drop_columns(["owner"]).to_pylist()
        parts = [r for r in rows if r["portion"] is None]
        parted = np.concatenate([np.empty(0, np.uint64), *[unpack_rising(r["contexts"]) for r in parts]])
        kinds, of = np.unique(parted, return_inverse=True)
        given, total = (np.bincount(of, np.concatenate([np.empty(0), *[np.frombuffer(r[c], "<f8") for r in parts]]), len(kinds)) for c in ("given", "totals"))
        rest = np.floor(np.clip(1.0 - given / np.maximum(total, 1), 0, 1) * 65_535)
        write_file(root, f"rests-{owner}", encode(kinds) + total.astype("<f8").tobytes() + rest.astype("<u2").tobytes())
        data = map_file(root, f"rests-{owner}")
        held = Sequence(data)
        total = data[held.end : held.end + 8 * held.n].view("<f8")
        rest = data[held.end + 8 * held.n :].view("<u2")
        out = []
        for r in rows:
            if r["portion"] is not None:
                asked = unpack_rising(r["contexts"])
                at, known = held.successors(asked)
                totals, rests = np.ones(len(asked)), np.full(len(asked), 65_535, np.uint64)
                totals[known], rests[known] = total[at[known]], rest[at[known]]
                out.append((owner, r["portion"], totals.astype("<f8").tobytes(), pack(rests, 2)))
        names = [("owner", pa.int64()), ("portion", pa.int64()), ("totals", pa.binary()), ("rests", pa.binary())]
        return pa.table(_binary_rows(names, out).columns, names=[n for n, _ in names])

    return run


# --- scoring --------------------------------------------------------------------------------------------------


def _score(total: int, n_words: int, to: Layout):
    """Portions with their answers to a row for each text."""
    shards, order = to.shards, to.order
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def answered(asked: Asked, level: int, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """(share, rest) of each entry."""
        mine = lambda answers, field: sorted((a for a in answers or [] if level * shards <= a[field] < (level + 1) * shards), key=lambda a: a[field])
        got = mine(row["answers"], "shard")
        share = np.concatenate([np.empty(0), *[unpack_few(a["shares"]) for a in got]])
        left = np.concatenate([np.empty(0), *[unpack(a["rests"], 2) / 65_535.0 for a in got]])
        if asked.crowded.any():
            context = np.unique(asked.contexts[asked.crowded])
            order_ = np.concatenate([i for _, i in _by_owner(context, shards)])
            totals, rests = np.empty(len(context)), np.empty(len(context))
            got = mine(row["rests"], "owner")
            totals[order_] = np.concatenate([np.frombuffer(a["totals"], "<f8") for a in got])
            rests[order_] = np.concatenate([unpack(a["rests"], 2) / 65_535.0 for a in got])
            k = np.searchsorted(context, asked.contexts[asked.crowded])
            share[np.repeat(asked.crowded, asked.runs[1])] /= np.repeat(totals[k], asked.runs[1][asked.crowded])
            left[asked.crowded] = rests[k]
        return share, np.repeat(left, asked.runs[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).drop_columns(["ids"]).to_pylist()[0]
                # One level after the other, as each has arrays of the portion's size.
                for level in range(order - 1):
                    p = Portion.of(row, to, (level,), False)
                    known = p.counts > 0
                    if level == 0:
                        plain = (p.counts + 1.0) / (total + n_words + 1.0)
                        model = plain.copy()
                    asked = p.levels[level]
                    share, rest = answered(asked, level, row)
                    model[asked.at] = np.where(known[asked.at], share[asked.of], 0.0) + rest[asked.of] * model[asked.at]
                    del asked, share, rest
                    p.levels.clear()
                starts = np.cumsum(p.sizes) - p.sizes
                add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids[k].values, pa.array(unpack(row["held"], 1) > 0), pa.array(p.sizes), pa.array(add(known.astype(np.int64))), pa.array(add(np.log10(plain))), pa.array(add(np.log10(model)))],
                    names=names,
                )

    return run


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


def _returned(portions: DataFrame, answers: DataFrame, name: str, *fields: str) -> DataFrame:
    """`portions` with the array of their answers."""
    got = answers.where("portion is not null").groupBy("portion").agg(F.collect_list(F.struct(*fields)).alias(name))
    return portions.join(got, "portion", "left")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, least: int = 2, portion: int = PORTION, words: int = WORDS, pairs: int = PAIRS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Tokens are words without space and U+0009 to U+000D, A-Z lower-cased, then one end; a null or blank text has the
    end only. Rows whose crc32 of the id as text leaves 2 modulo 7 are held out, all others are trained on; a null id
    counts as empty text, which is trained on. base_score is the sum of log10((c + 1) / (N + V + 1)), score the
    model's log10 probability, of `order` 2 or 3 from pairs and triples seen `least` times or more. Repeated rows count
    as often as they come; an id may have any type. An empty table gives an empty result. Words may number 2**32 at most.
    A task holds a portion of about `portion` bytes of text, or one longer text, or the n-grams of a shard. `words`,
    `pairs` and `crowded` are the sizes of shards and what a context may have to be kept in one; they change no result.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    root = scratch.path("trie")
    if not re.match(r"\w+://", root):
        root = "file://" + root.removeprefix("file:")
    id_type = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    given = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))

    schema = f"portion long, ids array<{id_type.simpleString()}>, held binary, sizes binary, n_kinds long, kinds binary, tokens binary"
    portions = scratch.cut(given.mapInArrow(_portions(portion), schema), "portions")
    asked = portions.agg(F.sum("n_kinds")).first()[0] or 0
    asks = portions.mapInArrow(_ask_words(max(1, -(-asked // words))), "shard long, portion long, kinds binary, counts binary")
    answers = scratch.cut(asks.groupBy("shard").applyInArrow(_level_1(root), WORD_ANSWER), "words")
    sizes = sorted((r["shard"], r["n"], r["total"]) for r in answers.where("portion is null").select("shard", "n", "total").collect())  # a row a shard
    n_words, total = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    if n_words >= IDS:
        raise ValueError(f"{n_words} words; ids have 32 bits")
    starts = dict(zip([s[0] for s in sizes], np.concatenate([[0], np.cumsum([s[1] for s in sizes])]).astype(int).tolist(), strict=False))
    named_schema = f"portion long, ids array<{id_type.simpleString()}>, held binary, sizes binary, tokens binary, words binary, counts binary, end long"
    named = scratch.cut(_returned(portions, answers, "answers", "shard", "ranks", "counts").mapInArrow(_named(starts), named_schema), "named")
    scratch.drop("portions", "words")

    shards = max(1, -(-total // pairs))
    to = Layout(shards, max(1, n_words), order, crowded)
    answers = None
    for level in range(order - 1):  # one after the other, as what portions ask of a level takes more room than the level
        asks = named.drop("ids").mapInArrow(_ask_grams(to, level), GRAM_ASK_SCHEMA)
        part = scratch.cut(asks.groupBy("shard").applyInArrow(_levels_2_3(root, shards, least), GRAM_ANSWER), f"grams-{level + 2}")
        answers = part if answers is None else answers.unionByName(part)
    crowds = answers.where("owner is not null").select("owner", "portion", "contexts", "given", "totals")
    rests = scratch.cut(crowds.groupBy("owner").applyInArrow(_rests(root), REST_ANSWER), "rests")
    answers = answers.where("owner is null")

    ready = _returned(_returned(named, answers, "answers", "shard", "shares", "rests"), rests, "rests", "owner", "totals", "rests")
    scored = ready.mapInArrow(_score(total, n_words, to), f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

