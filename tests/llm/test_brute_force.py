"""Each operator against a brute-force version, on texts with nulls, blanks, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import elias_fano, html_text, mixing, neardup, ngram_lm, packing, pii, quality, sharding, shingles, suffix_dedup, topk

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, blanks, nulls and a repeated row."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(160))
    base = [" ".join(word() for _ in range(rng.randint(1, 220))) for _ in range(n // 3)]
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        t = rng.choice(base)
        if i % 3 == 1:
            w = t.split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        if i % 5 == 2:
            t = f"{t}\n{passage} {word()}"
        if i % 11 == 3:
            t = t.upper()
        out.append((i, t))
    run = "of " * 400
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, run), (n + 6, "x" + run), out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "src", 7, "kept") for i, t in corpus(1)], "doc_id long, text string, source string, N_WORDS int, batch string").repartition(5)


def word_list(t):
    return WORD.findall((t or "").encode().lower())


def test_packing(spark, docs):
    out = packing.pack(docs, buckets=4, token_budget=600, slot_rows=20)
    rows = out.collect()
    assert len(rows) == docs.count() and len([c for c in out.columns if c.lower() == "batch"]) == 1
    lengths = sorted(len(word_list(r.text)) + 1 for r in rows)
    assert sorted(r.n_tokens for r in rows) == lengths
    # The least padding over all ways to cut the distinct lengths in at most four.
    distinct = sorted(set(lengths))
    pad = lambda edges: sum(next(e for e in edges if e >= n) - n for n in lengths)
    best = min(pad([*cut, distinct[-1]]) for k in range(4) for cut in itertools.combinations(distinct[:-1], k)) if len(distinct) < 40 else None
    hist = [(d, lengths.count(d), d * lengths.count(d)) for d in distinct]
    edges = packing.boundaries(hist, 4)
    assert best is None or pad(edges) == best
    assert sum(r.bucket_len - r.n_tokens for r in rows) == pad(edges)
    for (_, _, _), g in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.slot, r.batch)), key=lambda r: (r.bucket, r.slot, r.batch)):
        g = list(g)
        assert len(g) <= max(1, 600 // g[0].bucket_len) and sorted(r.batch_row for r in g) == list(range(len(g)))
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_is_optimal():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(1, 30))]
        d = sorted(set(lengths))
        k = rng.randint(1, 5)
        pad = lambda edges: sum(next(e for e in edges if e >= n) - n for n in lengths)  # noqa: E731, B023
        best = min(pad([*cut, d[-1]]) for j in range(min(k, len(d))) for cut in itertools.combinations(d[:-1], j))
        assert pad(packing.boundaries([(x, lengths.count(x), x * lengths.count(x)) for x in d], k)) == best


def test_sharding(spark, docs):
    names = [f"s{i}" for i in range(7)]
    size = 101
    table = sharding.lookup_table(names, size)
    # Again, as a round of turns over whole lists of preference.
    prefs = []
    for s in names:
        d = hashlib.md5(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        prefs.append(iter([(a + i * b) % size for i in range(size)]))
    want = {}
    for k in itertools.cycle(range(7)):
        slot = next((x for x in prefs[k] if x not in want), None)
        if slot is not None:
            want[slot] = k
        if len(want) == size:
            break
    assert table == [want[i] for i in range(size)]
    counts = collections.Counter(sharding.lookup_table(names))
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(names[a] != names[b] for a, b in zip(sharding.lookup_table(names), sharding.lookup_table(names[:-1]), strict=True))
    assert moved < 2.2 * sharding.TABLE_SIZE / 7
    rows = sharding.place(docs, names, size=size).collect()
    assert len(rows) == docs.count() and all(r.shard == table[r.slot] and r.shard_name == names[r.shard] for r in rows)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_html():
    tree = html_text.train()
    page = (
        "<html><head><title>t</title><style>p{}</style><script>x='<p>no</p>'</script></head><body><header><p>site head</p></header><nav><a href='/'>home</a></nav>"
        "<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>er&nbsp;text\n here<p>Hi.<!-- <p>gone</p> --><aside>side note</aside>"
        "<div class='share-buttons sharing'>share it</div><p title=\"a > b\">Last &lt;one&gt; &am</p><section id='comments'><p>nice post by a reader with many words in it</p></section></article>"
        "<div class='cookie-notice'>we use cookies</div><form><p>your name</p></form><footer>foot</footer>"
    )
    assert html_text.main_text(page, tree) == "Title & more\nFirst bolder text here\nHi.\nLast <one> &am"
    plain = "<div><a href=1>a</a> <a href=2>b</a></div><div><h2>Head</h2><p>" + "word " * 80 + "</p><p>short</p></div><p><a href=3>next page</a></p>"
    assert html_text.main_text(plain, tree) == "Head\n" + ("word " * 80).strip() + "\nshort"
    for odd in (None, "", "no tags", "<", "<p", "<p title='", "</p></div>", "<script>", "<!--", "<a b='>'>x", "<div>" * 2000, "<a \"" * 500):
        html_text.main_text(odd, tree)


def test_html_tree_uses_neighbours_and_holds_on_unseen_pages():
    tree = html_text.train()
    used = set()

    def walk(t):
        if not isinstance(t, bool):
            used.add(html_text.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert {"words", "link_density", "previous_words", "next_words", "previous_link_density", "next_link_density"} <= used
    for seed in (101, 102, 103):
        table = html_text.labelled_table(150, seed)
        assert sum(html_text.decide(tree, r) == y for r, y in table) >= 0.985 * len(table)
        # Without any mark, where only words and links of blocks and neighbours tell.
        plain = [(r, y) for r, y in table if not r[html_text.FEATURES.index("page_has_article")] and not r[html_text.FEATURES.index("in_boilerplate")]]
        assert len(plain) > 300 and sum(html_text.decide(tree, r) == y for r, y in plain) >= 0.97 * len(plain)


def test_html_features_match_their_definition():
    for page, _ in html_text.labelled_pages(40, 5):
        found = html_text.blocks(page)
        for i, (b, row) in enumerate(zip(found, html_text.block_features(found), strict=True)):
            near = [o for j, o in enumerate(found) if j != i and abs(j - i) <= html_text.NEAR]
            words, linked = sum(o.words for o in near), sum(o.words * o.link_density for o in near)
            p, q = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
            want = (b.words, b.link_density, p.words if p else 0, p.link_density if p else 0, q.words if q else 0, q.link_density if q else 0, words - linked, linked / words if words else 0)
            assert row[:8] == pytest.approx(want)


def test_html_of_given_pages_is_their_article(spark):
    rows = html_text.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("a.b", F.lit(1)).withColumn("raw", F.col("html"))).collect()
    assert rows and {"a.b", "raw"} <= set(rows[0].asDict())
    for r in rows:
        page = r.raw or ""
        if "</article>" in page:
            article = page[page.index("<article>") : page.index("</article>")]
            assert r.text == "\n".join(b.text for b in html_text.blocks(article)) and r.n_chars == len(r.text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", "t", 9), (2, None, None, "t", 9), (1, "u", "<article><p>x</p></article>", "t", 9)], "page_id long, url string, html string, TEXT string, other int")
    rows = sorted((r.page_id, r.text, r.n_chars, r.other) for r in html_text.extract(pages).collect())
    assert rows == [(1, "x", 1, 9), (1, "x", 1, 9), (2, "", 0, 9)]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])]) for i in range(150)]
    vectors += [(150, vectors[3][1]), (151, vectors[3][1]), (152, [0.0] * 6), (153, None), (154, [1.0, None] + [0.0] * 4), (155, [math.nan] * 6), (156, [1.0, 2.0]), (None, [1.0] * 6), (20, [1.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0 and vec_id <> 20"), k=7).collect()}
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for qi, q in clean:
        if qi % 20 == 0 and qi != 20:
            best = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), i) for i, c in clean if i != qi and len(c) == len(q)))[:7]
            assert [got[qi, k + 1] for k in range(len(best))] == [(i, -s) for s, i in best]
    assert topk.top_k(df.where("false"), df, k=3).count() == 0


def test_top_k_prunes_without_loss():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=12)
    c = np.floor(64 * (centre * rng.uniform(0.5, 3, (9000, 1)) + 0.15 * rng.normal(size=(9000, 12)))).astype(np.int64)
    q = np.concatenate([c[:20], -c[20:25], np.zeros((1, 12), np.int64)])
    found = {i: (g, s) for i, g, s in topk.search(np.arange(len(q)) + 10**6, q, np.arange(len(c)), c, 20)}
    for j in range(len(q)):
        s = c @ q[j]
        order = np.lexsort((np.arange(len(c)), -s))[:20]
        assert found[10**6 + j][0].tolist() == order.tolist() and found[10**6 + j][1].tolist() == s[order].tolist()


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(6, 90) + [(None, "one"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, N_SHINGLES int")
    sets = {}
    for i, t in rows:
        w = word_list(t)
        sets[i, t] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k in keys:
        if k[0] is not None:
            least[find(k)] = min(least.get(find(k), 10**9), k[0])
    want = collections.Counter()
    for i, t in rows:
        component = (least.get(find((i, t))) if sets[i, t] else i)
        want[i, len(sets[i, t]), component, i == component] += 1
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == want


def test_pii_finds_contexts(spark):
    text = [f"write to u{i}@mail.com now, call me at +1 (201) 555-01{i:02d} or not" for i in range(12)]
    text += ["call me at 201-555-0199-7 today", "the number 201-555-0188-7 is none", None, "", "x " * 3000 + "a@b.co", "1.2.3.4 1.2.3.256x 4111 1111 1111 1111"]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").withColumn("N_EMAIL", F.lit("x"))
    rows = {r.doc_id: r for r in pii.detect(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", pii.listed("base_spans").alias("base"), pii.listed("all_spans").alias("all")).collect()}
    assert rows[0].base == "email:9:20,phone:37:54" == rows[0].all
    assert rows[12].base == "" and rows[12].all == "phone:11:25" and rows[13].all == "" and rows[14].all == "" == rows[15].all
    assert rows[16].base == "email:6000:6006" and rows[17].base == "ip:0:7,card:19:38"
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "write to <EMAIL> now, call me at <PHONE> or not" and clean[12] == "call me at <PHONE> today" and clean[14] is None and clean[17] == "<IP> 1.2.3.256x <CARD>"


def test_pii_long_runs(spark):
    texts = ["1 " * 5000, "a" * 200_000, "1" * 200_000, "a.b" * 50_000, "1." * 30_000, "x@y" + ".z" * 20_000, "+1" + " 2" * 3000, "@" * 50_000]
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), carry_text=False).select("doc_id", pii.listed("base_spans").alias("s")).collect()
    got = {r.doc_id: r.s for r in rows}
    assert got[5] == "email:0:40003" and got[1] == got[2] == got[0] == got[6] == got[7] == ""


def test_language_model(spark):
    rows = [(i, t) for i, t in corpus(9, 120)] + [(None, "a b")]
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    seq = lambda t: [*word_list(t), b" end"]
    c, pairs = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not out(i):
            c.update(seq(t))
            pairs.update(zip([b" end", *seq(t)[:-1]], seq(t), strict=True))
    n, v = sum(c.values()), len(c)
    given = collections.Counter()
    for (u, _), k in pairs.items():
        given[u] += k - 0.75 if k > 1 else 0
    plain = lambda w: (c[w] + 1) / (n + v + 1)
    model = lambda u, w: (pairs[u, w] - 0.75 if pairs[u, w] > 1 else 0) / max(1, c[u]) + (1 - given[u] / max(1, c[u])) * plain(w)
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        r, w = by[i][0], seq(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(plain(x)) for x in w))
        # Quantised to a byte, so near the exact value.
        assert r.score == pytest.approx(sum(math.log10(model(a, b)) for a, b in zip([b" end", *w[:-1]], w, strict=True)), abs=0.02 * len(w) + 1e-9)
    assert ngram_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(9,2)"])
def test_language_model_takes_ids_of_any_type(spark, kind):
    rows = [(i, "a b c a b") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = ngram_lm.score(docs, order=3, least=1)
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())


def test_words_of_two_letters_dont_collide():
    # The word of Thue and Morse and its complement are equal under any polynomial modulo 2**64.
    word = lambda n, a, b: "".join(a if i.bit_count() % 2 == 0 else b for i in range(n)).encode()
    for n in (512, 1024, 8192):
        one, two = shingles.Words().of([word(n, "a", "b"), word(n, "b", "a")])[0]
        assert one != two


def test_near_duplicates_keep_long_words_apart(spark):
    word = lambda a, b: "".join(a if i.bit_count() % 2 == 0 else b for i in range(1024))
    rows = neardup.near_duplicates(spark.createDataFrame([(1, word("a", "b")), (2, word("b", "a"))], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (2, 2, True)]


def test_successor_search():
    rng = np.random.default_rng(5)
    for values in (np.array([0, 2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**64 - 1, 3000, np.uint64)), np.cumsum(rng.integers(0, 3, 5000)).astype(np.uint64), np.concatenate([np.arange(700), np.arange(700) + 2**40]).astype(np.uint64)):
        s = elias_fano.Sequence(np.frombuffer(elias_fano.encode(values), np.uint8))
        queries = np.concatenate([values, values + np.uint64(1), values - np.uint64(1), rng.integers(0, 2**64 - 1, 300, np.uint64)])
        at, equal = s.successors(queries)
        assert np.array_equal(at, np.searchsorted(values, queries)) and np.array_equal(equal, np.isin(queries, values))


def test_trie_shard_looks_up_each_context_once(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    contexts = np.sort(rng.choice(10**6, 200, replace=False)).astype(np.uint64)
    sizes = rng.integers(1, 60, 200)
    words = np.concatenate([np.sort(rng.choice(500, n, replace=False)) for n in sizes]).astype(np.uint64)
    logs = -rng.random(len(words))
    root = f"file://{tmp_path}"
    values = ngram_lm.Shard.write(root, 0, contexts, sizes, words, logs)
    shard = ngram_lm.Shard(root, 0)
    asked = []
    plain = elias_fano.Sequence.successors
    monkeypatch.setattr(elias_fano.Sequence, "successors", lambda self, q: (asked.append((self is shard.contexts, len(q))), plain(self, q))[1])
    # Every other context is unknown, and so is every word from 500 on.
    every = np.unique(np.concatenate([contexts, contexts + np.uint64(1), np.array([0, 2 * 10**6], np.uint64)]))
    known = dict(zip(contexts.tolist(), np.split(np.arange(len(words)), np.cumsum(sizes)[:-1]), strict=True))
    ask = [np.concatenate([words[known[c]], [np.uint64(500)]]) if c in known else np.arange(5, dtype=np.uint64) for c in every.tolist()]
    got = shard.find(every, np.array([len(a) for a in ask]), np.concatenate(ask))
    want = np.concatenate([np.concatenate([values[known[c]], [0.0]]) if c in known else np.zeros(5) for c in every.tolist()])
    assert np.array_equal(np.concatenate([[0.0], shard.book])[got], want)
    assert asked[0] == (True, len(every)) and len(asked) == 2


def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for values in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([2**63], np.uint64), np.sort(rng.integers(0, 2**64 - 1, 5000, np.uint64)), np.repeat(np.arange(50, dtype=np.uint64), 7)):
        data = np.frombuffer(elias_fano.encode(values) + b"rest", np.uint8)
        assert elias_fano.size_of(data) == len(data) - 4 and np.array_equal(elias_fano.decode(data), values)


def test_mixing(spark, docs):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise(None).alias("source"), F.lit(1).alias("COPY"))
    rows = mixing.mix(many, weights={"a": 3.0, "b": 1.0}).collect()
    got = collections.Counter(r.source for r in rows)
    assert set(got) == {"a", "b"} and abs(got["a"] - 3000) < 200 and abs(got["b"] - 1000) < 120
    # Counts invert the distribution at the hash.
    copies = {r.doc_id: r.n_copies for r in rows}
    for i in range(0, 400, 4):
        u = (int(hashlib.md5(f"mix-v1:count:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, total = 0, math.exp(-3.0), 0.0
        while total + p < u:
            total, k = total + p, k + 1
            p *= 3.0 / k
        assert copies.get(i, 0) == k
    again = mixing.mix(many.repartition(9), weights={"a": 3.0, "b": 1.0}).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(docs).count() > 0 and mixing.mix(docs.where("false")).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = lambda: "\n".join(" ".join(word() for _ in range(14)) + "." for _ in range(6))
    texts = [good() for _ in range(150)] + [good().replace(" ", "### ") for _ in range(12)] + [good().upper().replace(" ", "!! ") for _ in range(12)]
    texts += ["a a a " * 30, "short", None, "", "w1 w2 w3 x w1 w2 w3\nw1\nw1\n \n \nz # $"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("KEPT", F.lit(1))
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in WORD.findall((t or "").encode())]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert all(rows[i].kept for i in range(150)) and not any(rows[i].kept for i in range(150, len(texts)))


@pytest.mark.parametrize(("hot", "block"), [(10**9, 5_000), (0, 900_000), (0, 3_000)], ids=["ranges", "crowded", "crowded shards"])
def test_suffix_dedup(spark, hot, block):
    rows = corpus(12, 45)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("SHA", F.lit(1))
    raw = [(t or "").encode() for _, t in rows]
    length = 90
    starts = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    want = collections.Counter()
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, kept] += 1
    left, kept = suffix_dedup.remove_repeats(docs, length=length, hot=hot, block=block)
    got = collections.Counter()
    texts = dict(rows)
    for r in left.join(kept.withColumnRenamed("sha", "of"), F.col("__mr_sha") == F.col("of"), "left").collect():
        got[r.doc_id, r["__mr_bytes"], r.n_removed or 0, r.n_spans or 0, bytes(r.kept) if r.kept is not None else (texts[r.doc_id] or "").encode()] += 1
    assert got == want and sum(k[2] for k in want) > 0


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for t in range(60):
        d = np.array([rng.choice([97, 98] if t % 2 else [0, 1, 255]) for _ in range(rng.randint(1, 150))], np.uint8)
        d = np.tile(d[: max(1, len(d) // 4)], 5) if t % 5 == 0 else d
        order, key, chars, bits = suffix_dedup.suffix_array(d, 10**6)
        b = bytes(d)
        want = sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        assert order.tolist() == want
        shared = [0] + [next((m for m in range(len(b)) if b[i + m : i + m + 1] != b[j + m : j + m + 1] or not b[i + m : i + m + 1]), len(b)) for i, j in zip(want, want[1:], strict=False)]
        assert suffix_dedup.common_prefixes(d, order, key, chars, bits).tolist() == shared


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in corpus(21, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "text", "bucket", "batch"} <= set(out.columns)
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


@pytest.mark.parametrize("sizes", [{}, {"portion": 3000, "words": 40, "pairs": 700, "crowded": 5}], ids=["usual", "crowded"])
def test_language_model_of_triples_seen_once(spark, sizes):
    rows = corpus(9, 120)
    got = {r.doc_id: r.score for r in ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=3, least=1, **sizes).collect()}
    seq = lambda t: [*word_list(t), b" end"]
    c, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [b" end", *seq(t)]
            c.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
            triples.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c.values()), len(c)

    def left(counts):
        kinds, total = collections.Counter(k[:-1] for k in counts), collections.Counter()
        for k, x in counts.items():
            total[k[:-1]] += x
        return kinds, total

    (k2, t2), (k3, t3) = left(pairs), left(triples)

    def mixed(counts, kinds, total, key, lower):
        t = total[key[:-1]]
        return lower if not t else max(counts[key] - 0.75, 0) / t + 0.75 * kinds[key[:-1]] / t * lower

    def model(t, u, w):
        p = mixed(pairs, k2, t2, (u, w), (c[w] + 1) / (n + v + 1))
        return p if t is None else mixed(triples, k3, t3, (t, u, w), p)

    assert sum(x == 1 for x in pairs.values()) and sum(x == 1 for x in triples.values())
    for i, t in rows:
        w = [None, b" end", *seq(t)]
        want = sum(math.log10(model(*x)) for x in zip(w, w[1:], w[2:], strict=False))
        assert got[i] == pytest.approx(want, abs=0.02 * len(w) + 1e-9)


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def base_spans(t):
    """The contract's base matches, by plain matchers."""
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in pattern.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if name == "email" or (name == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (name == "card" and 14 <= len(d) <= 19 and luhn) or (name == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base_matches_plain_matchers(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "@", ".", "1.2.3.4", "256.1.1.1", "+1 (201) 555-0199", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", " ", "-", "+", "x", "7", "00", "\n", "j.d@x-y.org.uk", "(", ")", "9807915762804490"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["1.2.3.4," * 700, "1.2.3.4 " * 700, "4111111111111111 a@b.co\n" * 300, None, ""]
    got = {r.doc_id: r.s for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), carry_text=False).select("doc_id", pii.listed("base_spans").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_spans(t) for t in texts]


def test_pii_graph_matches_plain_scores(spark):
    rng = random.Random(6)
    rows = []
    for rid in range(80):
        items = {kind: [(10 * i, rng.randrange(2), 10 * i + 5, f"v{rng.randrange(30)}{'s' if kind else 'c'}" if rng.random() < 0.8 else f"v{rng.randrange(9)}", f"p{rng.randrange(6)} q{rng.randrange(3)}") for i in range(rng.randint(0, 4))] for kind in (1, 0)}
        rows.append((rid, items[1], items[0]))
    schema = "rid long, base array<struct<s:int,k:int,e:int,m:string,l:string>>, candidates array<struct<s:int,k:int,e:int,m:string,l:string>>"
    from millrace.session import Scratch

    got = {r.rid: sorted(map(tuple, r.extra)) for r in pii.discovered(spark.createDataFrame(rows, schema), Scratch(spark, "graph"), confidence=0.5).collect()}
    n, seed = collections.Counter(), collections.defaultdict(bool)
    for _, base, candidates in rows:
        for kind, items in ((True, base), (False, candidates)):
            for _, k, _, m, p in items:
                p = re.sub("[0-9]+", "0", p)
                n[k, p, m] += 1
                seed[k, p, m] |= kind
    value = collections.defaultdict(float)
    for k, p, m in n:
        value[k, m] = max(value[k, m], float(seed[k, p, m]))
    seeded = {k: v == 1.0 for k, v in value.items()}
    for turn in range(3):
        sure = {}
        for k, p in {(k, p) for k, p, _ in n}:
            edges = [e for e in n if e[:2] == (k, p)]
            if sum(seed[e] for e in edges) >= 3:
                sure[k, p] = sum(n[e] * value[k, e[2]] for e in edges) / sum(n[e] for e in edges)
        if turn < 2:
            for k, m in list(value):
                doubt = math.prod(1 - min(sure.get((k, p), 0.0), 0.999) for kk, p, mm in n if (kk, mm) == (k, m))
                value[k, m] = 1.0 if seeded[k, m] else 1 - doubt
    want = {}
    for rid, _, candidates in rows:
        hit = sorted({(s, k, e) for s, k, e, _, p in candidates if sure.get((k, re.sub("[0-9]+", "0", p)), 0) >= 0.5})
        if hit:
            want[rid] = hit
    assert want and got == want


def test_pii_candidates_of_all_forms(spark):
    long = "j" * 90
    text = [f"write to u{i}@mail.com now, call me at +1 (201) 555-01{i:02d} or not" for i in range(12)] + [f"Line 2 phone: +1 (301) 555-01{i:02d} x" for i in range(12)]
    text += ["write to jane(at)example.org", "call me at (555) 123-4567 today", "call me at 020 7946 0958", f"write to {long}(at)example.org", "Line 2 phone: 301-555-0199", "1@" + "@" * 30_000 + "1", "1 (2 " * 3000]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detect(docs).select("doc_id", pii.listed("all_spans").alias("s")).collect()}
    assert [got[i] for i in range(24, 31)] == ["email:9:28", "phone:11:25", "phone:11:24", "email:9:114", "phone:14:26", "", ""]
