"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SLOW = {"q09_eval_16gram", "q13_shingle_overlap"}  # SQL that lists every gram


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("q") and n not in SLOW))
def test_query_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    from millrace.streaming import windows

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"), events.schema), "1 day", "60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.start), r.event_type, r.n)
    assert sorted(map(key, spark.table("days").collect())) == sorted(map(key, windows.tumbling(events, "1 day").collect()))


def test_readers(spark, tmp_path):
    from millrace.sources import readers

    (tmp_path / "a.jsonl").write_text('{"content": "x"}\n{bad\n\n')
    assert sorted((r.line, r.valid) for r in readers.lenient_lines(spark, str(tmp_path / "a.jsonl")).collect()) == [('{"content": "x"}', True), ("{bad", False)]
    (tmp_path / "b.jsonl").write_text('{"text": " ", "content": "y"}\n')
    assert readers.with_text(readers.jsonl(spark, str(tmp_path / "b.jsonl"))).first().text == "y"
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "content string").collect()
    (tmp_path / "c.slt").write_text("one\n1\n\ntwo\n")
    assert [r.text for r in readers.blank_line_records(spark, str(tmp_path / "c.slt")).orderBy("position").collect()] == ["one\n1", "two"]
    (tmp_path / "d.yaml").write_text("a: 1\n---\nb: 2\n")
    assert readers.yaml_records(spark, str(tmp_path / "d.yaml")).count() == 2
    import zipfile

    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x/a.txt", "hello")
        z.writestr("x/b.bin", b"\xff\xfe")
    assert [(r.member, r.text) for r in readers.zip_members(spark, str(tmp_path / "e.zip")).collect()] == [("x/a.txt", "hello")]
    out = str(tmp_path / "once")
    readers.write_once(spark.range(3).withColumn("split", readers.F.lit("train")), out, by=["split"])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        readers.write_once(spark.range(3), out)


@pytest.mark.parametrize("name", ["q44_check_issues", "q44_check_summary"])
def test_checks_read_the_whole_table(spark, duck, name):
    whole = entry.oracle_sql()[name]
    assert "%" not in whole
    got, want = entry.queries()[name](spark, SF), duck.sql(whole)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(want.fetchall(), want.columns)


def test_hard_negatives_read_the_whole_table(spark, duck):
    whole = entry.oracle_sql()["q34_hard_negatives"]
    assert "%" not in whole
    got, want = entry.queries()["q34_hard_negatives"](spark, SF), duck.sql(whole)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(want.fetchall(), want.columns)


def test_best_version_keeps_texts_that_only_open_alike(spark, tmp_path):
    texts = [(i, "One opening of forty characters or more, " + t) for i, t in enumerate(["and a tale", "and a letter", "And  a tale", "and a tale   "])]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "cast(length(text) as long) n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in entry.queries()["q07_best_version"](spark, str(tmp_path)).collect()) == [1, 3]


def test_cascade_has_the_rule_for_runs(spark, tmp_path):
    rows = [(1, 1, "你好吗朋友"), (1, 2, "好好好好好好"), (2, 1, "你好吗朋友"), (2, 2, "我很好")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {tuple(r) for r in entry.queries()["q03_reason_cascade"](spark, str(tmp_path)).collect()} == {("repetition", 1), ("kept", 1)}
