"""Operators on small fixtures, against hand-computed values and plain Python models."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import audit, checks, convo, dedup, estimate, graph, isolate, metrics, quota, records, retrieve, sample


def one(df):
    return [tuple(r) for r in df.collect()]


def test_text_functions(spark):
    df = spark.createDataFrame([(" a　b \n c ", "ｆｏｏ　ＢＡＲ！", "Call 12 at https://x.y/z id-77 0123456789abcdef0 ABC123")], "a string, b string, c string")
    row = df.select(tx.normalize_space("a"), tx.compact(F.col("b")), tx.template_signature(F.col("c")), tx.query_signature(F.lit("Straße 12.5!"))).first()
    assert tuple(row) == ("a b c", "foobar", "call <num> at <url> id-<num> <hash> <id>", "strasse<n>")
    grams = spark.createDataFrame([("𠀀bcb",), ("x",), ("",), (None,)], "t string").select(tx.all_grams(F.col("t"), 2), tx.char_grams(F.col("t"), 3)).collect()
    assert [r[0] for r in grams] == [["𠀀b", "bc", "cb"], [], [], []]
    assert [r[1] for r in grams][:3] == [["𠀀bc", "bcb"], ["x"], []]


def test_near_pairs_match_all_pairs(spark):
    rng = random.Random(3)
    base = [sorted(rng.sample("abcdefghijklmnop", 10)) for _ in range(8)]
    rows = [(i, sorted(set(rng.choice(base)) ^ set(rng.sample("abcdefghijklmnop", rng.randint(0, 2))))) for i in range(60)] + [(99, [])]
    got = {(a, b) for a, b, _ in one(dedup.near_pairs(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s", 0.8))}
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    assert got == want and want


def _fetched(sets, tmp_path, monkeypatch, spark, run):
    """What `run` gives, and the ids whose sets it fetched for a comparison."""
    monkeypatch.setattr("millrace.session.shared_root", lambda _: str(tmp_path))
    got = one(run(spark.createDataFrame(sets, "id long, s array<string>")))
    return got, {r.id for p in tmp_path.glob("near-*/fetched") for r in spark.read.parquet(str(p)).collect()}


def test_near_pairs_fetch_only_sets_that_can_be_near(spark, tmp_path, monkeypatch):
    sets = [(i, [f"w{i}-{k}" for k in range(29)] + [f"shared{i // 2}"]) for i in range(40)]  # each two meet in a rare word
    sets += [(100 + i, [f"near{k}" for k in range(30)] + [f"x{i}"] * (i > 2)) for i in range(5)]  # three copies and two near ones
    got, fetched = _fetched(sets, tmp_path, monkeypatch, spark, lambda df: dedup.near_pairs(df, "id", "s", 0.8))
    assert sorted((a, b) for a, b, _ in got) == [(a, b) for a in range(100, 105) for b in range(a + 1, 105)]
    assert fetched == {100, 103, 104}


def test_near_pairs_of_sizes_match_all_pairs(spark):
    rng = random.Random(11)
    sets = []
    for i in range(90):
        old = set(rng.choice(sets)[1]) if i > 9 else {f"v{rng.randint(0, 400)}" for _ in range(rng.choice((1, 3, 9, 40, 160)))}
        sets.append((i, sorted(old ^ {f"v{rng.randint(0, 400)}" for _ in range(rng.randint(0, 1 + len(old) // 9))})))
    want = {(i, j) for i, a in sets for j, b in sets if i < j and a and b and 10 * len(set(a) & set(b)) >= 8 * len(set(a) | set(b))}
    assert {r[:2] for r in one(dedup.near_pairs(spark.createDataFrame(sets, "id long, s array<string>"), "id", "s", 0.8))} == want and len(want) > 20


def test_greedy_two_keys_is_a_scan(spark):
    assert sorted(r[0] for r in one(dedup.greedy_two_keys(spark.createDataFrame([(1, "k1", "p1"), (2, "k1", "p2"), (3, "k3", "p2")], "id long, k string, p string"), "id", "k", "p"))) == [1, 3]
    rng = random.Random(5)
    rows = [(i, str(rng.randint(0, 15)), str(rng.randint(0, 15))) for i in range(80)]
    ks, ps, want = set(), set(), []
    for i, k, p in rows:
        if k not in ks and p not in ps:
            ks.add(k), ps.add(p), want.append(i)
    assert sorted(r[0] for r in one(dedup.greedy_two_keys(spark.createDataFrame(rows, "id long, k string, p string"), "id", "k", "p"))) == want


def test_allocate_and_plan(spark):
    cells = spark.createDataFrame([("a", 3), ("b", 7), ("c", 0)], "cell string, capacity long")
    assert sorted((r.cell, r.quota) for r in quota.allocate(cells, 8).collect()) == [("a", 2), ("b", 6), ("c", 0)]
    assert sum(r.quota for r in quota.allocate(cells, 50).collect()) == 10
    roles = spark.createDataFrame([("x", 100, 10, 0.5), ("y", 10, 0, 0.5)], "role string, capacity long, consumed long, fraction double")
    assert {(r.role, r.quota, r.shortage, r.status) for r in quota.plan_mix(roles, 101).collect()} == {("x", 50, 0, "blocked_insufficient_pool"), ("y", 51, 41, "blocked_insufficient_pool")}


def test_prefix_select_and_offsets(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 5)], "c string, i long, t long")
    assert [r.i for r in quota.prefix_select(df, ["c"], ["i"], "t", F.lit(6)).orderBy("i").collect()] == [1, 2]
    good = quota.offsets(df, ["c"], ["i"], "t")
    assert quota.broken_offsets(good, ["c"], ["i"], "t").count() == 0
    assert quota.broken_offsets(good.withColumn("token_offset", F.col("token_offset") + (F.col("i") == 2).cast("int")), ["c"], ["i"], "t").count() == 2


def test_isolation(spark):
    docs = spark.createDataFrame([(1, "x\n the quick fox \ny"), (2, "nothing"), (3, None)], "doc_id long, text string")
    ev = spark.createDataFrame([(1, "the quick fox\nshort")], "item_id long, text string")
    assert one(isolate.line_overlap(docs, ev)) == [(1, 1)]
    leaks = spark.createDataFrame([("quick fox",), ("fox",)], "leak string")
    assert one(isolate.substring_leaks(docs, leaks)) == [(1, "quick fox")]
    assert one(isolate.gram_overlap(docs, ev, 10)) == [(1, 4)]
    leak = isolate.group_leaks(spark.createDataFrame([("a", "g1"), ("b", "g1"), ("a", "g2")], "split string, g string"), ["g"])
    assert one(leak) == [("g", "g1", "a,b")]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.2), (4, 0, 0.1)], "i long, y int, s double")
    assert metrics.auroc(df, "y", "s").first().auroc == pytest.approx(0.625)
    assert metrics.average_precision(df, "y", "s", "i").first()[0] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.auroc(df.where("y = 1"), "y", "s").first().auroc is None
    assert metrics.bijection(df, df.where("i > 1"), "i").first().missing == 1
    bins = {r.bin: r.n for r in metrics.calibration(df, "y", "s").collect()}
    assert bins == {9: 2, 2: 1, 1: 1}
    gate = metrics.gates(spark.createDataFrame([("a", 1.0)], "gate string, value double"), spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 1.0)], "gate string, low double, high double"))
    assert {(r.gate, r.passed) for r in gate.collect()} == {("a", True), ("b", False)}


def test_checks_on_a_sheet(spark):
    sheet = spark.createDataFrame([(2, "A1", "3", 2.0, 6.0, "ok"), (3, "A1", "0", 2.0, 0.0, "ok"), (4, " ", "x", 1.5, 9.0, "odd"), (5, "A2", "4", 2.0, 9.0, None)], "row long, id string, n string, price double, total double, state string")
    found = checks.all_issues([checks.required(sheet, "row", "id"), checks.unique(sheet, "row", "id"), checks.in_range(sheet, "row", "n", 1, 1000), checks.one_of(sheet, "row", "state", ["ok"])])
    assert sorted((r.row_id, r.check, r.detail) for r in found.collect()) == [(3, "range:n", "0"), (3, "unique:id", "2"), (4, "choice:state", "odd"), (4, "range:n", "x"), (4, "required:id", "")]
    assert checks.summary(sheet, found, ["required"]).first().status == "blocked"
    assert checks.summary(sheet.where("false"), found.where("false"), []).first().status == "incomplete"
    with pytest.raises(Exception, match="gone"):
        checks.required(sheet, "row", "gone").count()


def test_sampling_ignores_how_rows_are_dealt(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    assert {tuple(r) for r in one(sample.bottom_k(df, "id", 5, "s", ["g"]))} == {tuple(r) for r in one(sample.bottom_k(df.repartition(7), "id", 5, "s", ["g"]))}
    waves = sample.two_waves(df, "id", 10, "s").collect()
    assert len(waves) == 20 and {r.wave for r in waves} == {1, 2} and all(r.probability == 0.1 for r in waves)
    assert [r.id for r in sample.even_spaced(df, "id", 7).orderBy("id").collect()] == [i * 200 // 7 for i in range(7)]


def test_conversations(spark):
    t = spark.createDataFrame([(1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert sorted(one(convo.next_reply(t, "user", "assistant").select("conv_id", "turn", "reply"))) == [(1, 1, "a1"), (1, 3, None), (2, 1, None)]
    assert sorted(one(convo.prefix_history(t, "assistant"))) == [(1, 2, 1, "q1")]
    reason = spark.createDataFrame([(["你好吗朋友", "好好好好好好"],), (["你好吗", "我很好"],), (["x"],)], "t array<string>").select(convo.quality_reason(F.col("t")))
    assert [r[0] for r in reason.collect()] == ["repetition", None, "turn_count"]
    calls = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "conv_id long, turn long, call_id string")
    results = spark.createDataFrame([(1, 3, "a"), (1, 4, None)], "conv_id long, turn long, call_id string")
    assert {(r.turn, r.call_id) for r in convo.link_results(calls, results).collect()} == {(3, "a"), (4, "b")}


def test_records(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 3}}, "odd": 1}
    df = spark.createDataFrame([('{"a": 5}',), ('{"a": true}',), ("{}",), ("no",), (None,)], "t string")
    got = [r[0] for r in df.select(records.validated(F.col("t"), schema)["errors"]).collect()]
    assert got == [["$.a: maximum"], ["$.a: type"], ["$.a: required"], ["$: json"], ["$: json"]]
    assert one(df.select(records.canonical_json(F.lit('{"b": [1, 2], "a": "é"}'))).limit(1)) == [('{"a":"é","b":[1,2]}',)]
    texts = spark.createDataFrame([("one two\nthree four five six",), ("",), (None,)], "t string")
    spans = [r[0] for r in texts.select(records.span_windows(F.col("t"), 10, 3)).collect()]
    assert [(s.start, s.end) for s in spans[0]][0][0] == 0 and all(a.end == b.start for a, b in zip(spans[0], spans[0][1:], strict=False)) and spans[0][-1].end == 27
    assert all(s.end - s.overlap_start <= 10 for s in spans[0]) and spans[1:] == [[], []]


def test_schema_errors_keep_json_kinds_apart():
    check = lambda value, schema: records.schema_errors(value, schema)
    assert check(True, {"enum": [1]})[0] == ["$: enum"] and check(1.0, {"enum": [1]})[0] == [] and check(1, {"const": True})[0] == ["$: const"]
    assert check(0.3, {"multipleOf": 0.1})[0] == [] and check(0.35, {"multipleOf": 0.1})[0] == ["$: multipleOf"]
    assert check("x", {"pattern": "["}) == ([], ["$:pattern"]) and check(1.0, {"type": "integer"})[0] == [] and check(True, {"type": "number"})[0] == ["$: type"]
    assert check({"a": 1}, {"properties": {"a": False}})[0] == ["$.a: false"] and check({"b": "x"}, {"additionalProperties": {"type": "integer"}})[0] == ["$.b: type"]
    assert check({"b": 1}, {"additionalProperties": False})[0] == ["$.b: additional"] and check("2024-02-30", {"format": "date"})[0] == ["$: format"]
    assert check([1, "x"], {"items": {"type": "integer"}, "maxItems": 1})[0] == ["$: items", "$[1]: type"] and check(1, {"type": "odd"}) == ([], ["$:type"])


def test_parse_call_matches_plain_reading(spark):
    texts = ['search(query="a b", limit=3)', "f(x)", 'tool.run(args=[1, {"k": None}])', "f(a=g())", "no call", None, "f()", "f(**{})"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", records.parse_call("t").alias("c")).orderBy("i").collect()
    assert [r.c.status for r in rows] == ["parsed", "not_a_call", "parsed", "not_literal", "not_a_call", "not_a_call", "parsed", "not_a_call"]
    assert rows[0].c.arguments == '{"limit":3,"query":"a b"}' and rows[2].c.name == "tool.run" and rows[6].c.arguments == "{}"


def test_greedy_near_is_a_scan(spark):
    rng = random.Random(8)
    sets = [(i, sorted(rng.sample(range(9), rng.randint(0, 6)))) for i in range(120)]
    kept = []
    for i, s in sets:
        if not s or all(len(set(s) & set(o)) / len(set(s) | set(o)) < 0.6 for _, o in kept if o):
            kept.append((i, s))
    got = dedup.greedy_near(spark.createDataFrame(sets, "id long, s array<int>"), "id", "s", 0.6)
    assert sorted(r.id for r in got.collect()) == [i for i, _ in kept]


def test_greedy_near_fetches_only_sets_that_can_be_near(spark, tmp_path, monkeypatch):
    sets = [(i, [f"w{i}-{k}" for k in range(29)] + [f"shared{i // 2}"]) for i in range(20)] + [(100 + i, [f"near{k}" for k in range(30)] + [f"x{i}"]) for i in range(3)]
    got, fetched = _fetched(sets, tmp_path, monkeypatch, spark, lambda df: dedup.greedy_near(df, "id", "s", 0.8))
    assert sorted(r[0] for r in got) == [*range(20), 100] and fetched == {100, 101, 102}


def test_merkle_root_matches_plain_hashing(spark):
    sha = lambda b: hashlib.sha256(b).digest()
    for n in (0, 1, 2, 3, 7):
        files = [(f"n{i}", hashlib.sha256(str(i).encode()).hexdigest(), i * 7) for i in range(n)]
        level = [sha(b"leaf\0" + a.encode() + b"\0" + h.encode() + b"\0" + str(k).encode()) for a, h, k in sorted(files)]
        while len(level) > 1:
            level = [sha(b"node\0" + level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        want = level[0].hex() if level else hashlib.sha256(b"empty-merkle-v1").hexdigest()
        assert audit.merkle_root(spark.createDataFrame(files, "name string, sha256 string, bytes long")).first()[0] == want


def test_platt_finds_the_least_loss(spark):
    rng = random.Random(3)
    rows = [(x, int(rng.random() < 1 / (1 + math.exp(-(2 * x - 1))))) for x in (rng.gauss(0, 2) for _ in range(400))]
    scale, bias = metrics.platt(spark.createDataFrame(rows, "s double, y int"), "y", "s")
    pos = sum(y for _, y in rows)

    def loss(a, b):
        return sum((len(rows) / (2 * pos) if y else len(rows) / (2 * (len(rows) - pos))) * math.log1p(math.exp(-(a * s + b) * (1 if y else -1))) for s, y in rows)

    assert all(loss(scale, bias) <= loss(scale + da, bias + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    with pytest.raises(ValueError, match="both classes"):
        metrics.platt(spark.createDataFrame([(1.0, 1)], "s double, y int"), "y", "s")


def test_windows_are_those_of_a_stream(spark):
    docs = [("a", 1, [1, 2, 3, 4, 5]), ("a", 2, [6, 7]), ("b", 1, [9]), ("c", 1, [1, 2, 3, 4, 5]), ("d", 1, [])]
    got = sorted((r.source, r.window, r.x, r.y, r.mask) for r in quota.windows(spark.createDataFrame(docs, "source string, k int, t array<int>"), "source", ["k"], "t", 4).collect())
    assert got == [("a", 0, [1, 2, 3, 4], [2, 3, 4, 5], [1.0] * 4), ("a", 1, [5, 6, 7, 0], [6, 7, 0, 0], [1.0, 1.0, 0.0, 0.0]), ("b", 0, [9, 0, 0, 0], [0] * 4, [0.0] * 4), ("c", 0, [1, 2, 3, 4], [2, 3, 4, 5], [1.0] * 4)]


def test_graphs_and_estimates(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "task string, after string")
    states = spark.createDataFrame([("a", "done"), ("b", "open"), ("c", "open")], "task string, state string")
    assert {(r.task, r.ready) for r in graph.ready_tasks(edges, states).collect()} == {("a", False), ("b", True), ("c", False)}
    d = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "value string, share double")
    assert estimate.total_variation(d, d.where("value = 'x'")).first()[0] == pytest.approx(0.25)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.id) for r in retrieve.cosine_top_k(v, v, 1).collect()] == [(1, 2), (2, 1)]


def test_hard_negatives_match_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = "abcdefghijklm"
    rows = [(i, rng.choice(["f1", "f2", None]), None if i == 7 else " ".join(rng.sample(vocabulary, rng.choice([0, 1, 2, 2, 3, 10])))) for i in range(90)]
    held = {i: (f, set((n or "").split())) for i, f, n in rows}
    want = set()
    for i, (f, w) in held.items():
        scores = [(100 * (f is not None and f == g) + len(w & v), j) for j, (g, v) in held.items() if j != i]
        first = sorted((-s, j) for s, j in scores if s > 0)[:4]
        want |= {(i, j, -s, r) for r, (s, j) in enumerate(first, 1)}
    df = spark.createDataFrame(rows, "id long, f string, n string")
    got = retrieve.hard_negatives(df, 4, "id", "f", "n").select("id", "negative", "score", "rank")
    assert sorted(one(got)) == sorted(want)
    # 400 items with one name are one class.
    alike = retrieve.hard_negatives(spark.range(400).selectExpr("id", "'f' f", "'hot gear' n"), 5, "id", "f", "n")
    assert alike.count() == 2000 and alike.where("id = 0").orderBy("rank").first()[1] == 1


def test_next_in_ring_meets_rows_by_number(spark):
    ids = random.Random(4).sample(range(1000), 83)
    ring = sorted(ids)
    got = retrieve.next_in_ring(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), 20)
    assert sorted(one(got)) == sorted((v, r, ring[(at + r) % 83]) for at, v in enumerate(ring) for r in range(1, 21))
    assert {r[2] for r in one(retrieve.next_in_ring(spark.createDataFrame([(5,)], "id long"), 3))} == {5}


def test_rotated_negatives_gather_no_catalogue(spark, tmp_path):
    from millrace.plans.more_queries import q96_rotated_negatives

    spark.range(1, 60).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    plan = q96_rotated_negatives(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and "collect_list(id" not in plan


@pytest.mark.parametrize(("block", "per_file"), [(10**6, 10**6), (300, 40)], ids=["usual", "split"])
def test_source_sets_of_grams(spark, monkeypatch, block, per_file):
    import collections
    import random

    from millrace.operators import grams

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abc é😀") for _ in range(n))
    base = [text(rng.randint(20, 400)) for _ in range(25)]
    rows = [(rng.choice(["s1", "s2", "s3", None]), rng.choice(base)[rng.randint(0, 9) :] + rng.choice(["", text(50), base[0]])) for _ in range(120)]
    # Periods shorter, as long as and longer than a gram and its anchors, and runs longer than a context.
    rows += [("s1", "z" * 3000), ("s2", "z" * 41), ("s3", "xy" * 700), ("s1", text(30) * 9), ("s2", text(26) * 5), ("s3", text(40) * 3), ("s4", text(41) * 4), ("s4", None), (None, "z" * 60), ("s4", "z" * 39)]
    n = 40
    want = collections.defaultdict(set)
    for s, t in rows:
        for i in range(len(t or "") - n + 1):
            want[t[i : i + n]].add(s)
    sets = collections.Counter(tuple(sorted(x - {None})) for x in want.values())
    del sets[()]
    docs = spark.createDataFrame(rows, "source string, text string").repartition(5)
    got = {tuple(r.s): r.n for r in grams.source_sets(docs, n, block=block, per_file=per_file).collect()}
    assert got == sets and len(sets) > 5


def test_grams_send_no_row_for_each_place(spark):
    import random

    import pyarrow as pa

    from millrace.operators import grams

    rng = random.Random(6)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(4)]
    rows = sum(b.num_rows for b in grams._context_rows(80)(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b", "a", "b"]), pa.array([*text[:3], text[2]])], names=["source", "text"])])))
    assert rows < sum(map(len, text)) / 25


def test_anchors_over_batches():
    import pyarrow as pa

    from millrace.operators import grams

    rows = [(1, 1, 1, 9, False, "b"), (1, 1, 1, 9, False, "a"), (1, 1, 1, 9, False, "b"), (2, 1, 1, 4, False, "a"), (2, 1, 2, 5, False, "a"), (2, 1, 2, 5, False, "c"), (3, 7, 7, 6, True, "a"), (4, 1, 1, 3, False, "a"), (5, 1, 1, 8, False, "a")]
    for size in (1, 2, 3, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], names=["h", "c1", "c2", "n", "twice", "source"]) for k in range(0, len(rows), size)]
        got = [r for b in grams._anchors(iter(batches)) for r in b.to_pylist()]
        sets = {}
        for r in got:
            if r["s"]:
                sets[tuple(r["s"])] = sets.get(tuple(r["s"]), 0) + r["n"]
        assert [r["h"] for r in got if r["h"]] == [2, 3] and sets == {("a", "b"): 9, ("a",): 11}
