"""Queries over the provided tables. QUERIES has them by name, ORACLES the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import checks, convo, dedup, estimate, grams, graph, isolate, metrics, quota, records, retrieve, sample, split
from millrace.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Normalised text in DuckDB; `tx.normalize_space` has the same characters.
NORM = "regexp_replace(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, lang, source, {NORM} AS t FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY sha256(t) ORDER BY doc_id) AS occurrence FROM d)
SELECT doc_id, lang, source, sha256(t) AS text_sha256, CAST(length(t) AS BIGINT) AS n_chars FROM k WHERE occurrence = 1
""")
def q01_norm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.normalize_space(F.col("text")).alias("t"))
    d = d.select("doc_id", "lang", "source", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))
    return dedup.exact(d, ["text_sha256"], ["doc_id"])


@query(f"""
WITH d AS (SELECT doc_id, lang, text AS raw, {NORM} AS t, n_chars FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY sha256(t) ORDER BY doc_id) AS o FROM d),
l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, trim(unnest(string_split(raw, chr(10)))) AS line FROM k WHERE o = 1)
      WHERE length(line) >= 8 AND line IN (SELECT trim(unnest(string_split(text, chr(10)))) FROM benchmark)),
s AS (SELECT lang, n_chars, CASE WHEN x % 10000 < 50 THEN 'test' WHEN x % 10000 < 100 THEN 'calib' WHEN x % 10000 < 200 THEN 'dev' ELSE 'train' END AS split
      FROM (SELECT *, CAST('0x' || substr(sha256('v1:split:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS x FROM k WHERE o = 1 AND doc_id NOT IN (SELECT doc_id FROM l)))
SELECT lang, split, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM s GROUP BY lang, split
""")
def q00_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, deduplicate, drop documents with benchmark lines, split by hash, count."""
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2(tx.normalize_space(F.col("text")), 256))
    kept = dedup.exact(d, ["h"], ["doc_id"])
    clean = isolate.exclude_seen(kept, isolate.line_overlap(d, table(spark, sf_dir, "benchmark")), "doc_id")
    placed = clean.select("lang", split.split_of("v1", F.col("doc_id").cast("string")).alias("split"), "n_chars")
    return placed.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


#: Fixed values as in `tx.TEMPLATE_MARKS`, where RE2's word boundaries and digits are those of ASCII.
TEMPLATE = "lower(text)"
for _pattern, _mark in tx.TEMPLATE_MARKS:
    TEMPLATE = f"regexp_replace({TEMPLATE}, '{_pattern}', '{_mark}', 'g')"


@query(f"""
WITH d AS (SELECT source, sha256(text) AS h, sha256({NORM.replace('text', TEMPLATE, 1)}) AS s FROM documents),
g AS (SELECT source, s, count(*) AS n FROM d GROUP BY source, s),
t AS (SELECT source, max(n) AS largest FROM g GROUP BY source)
SELECT d.source, count(*) AS n_rows, count(DISTINCT h) AS distinct_texts, count(DISTINCT s) AS distinct_templates,
       CAST(max(largest) AS BIGINT) AS largest_template
FROM d JOIN t USING (source) GROUP BY d.source
""")
def q02_template_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"), F.sha2(tx.template_signature(F.col("text")), 256).alias("s"))
    by_template = d.groupBy("source", "s").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("_"))
    texts = d.groupBy("source").agg(F.count_distinct("h").alias("distinct_texts"))
    out = by_template.groupBy("source").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_templates"), F.max("n").alias("largest_template"))
    return out.join(texts, "source").select("source", "n_rows", "distinct_texts", "distinct_templates", "largest_template")


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, turns, array_to_string(turns, chr(10)) AS whole FROM c),
r AS (SELECT CASE
    WHEN len(turns) NOT BETWEEN 2 AND 16 THEN 'turn_count'
    WHEN len(list_filter(turns, lambda t: length(t) NOT BETWEEN 2 AND 600)) > 0 THEN 'turn_length'
    WHEN length(regexp_replace(whole, '[^\\x{3400}-\\x{9FFF}]+', '', 'g')) < 0.65 * greatest(1, length(whole)) THEN 'low_chinese_fraction'
    WHEN regexp_matches(whole, '(?i)https?://|www\\.|<\\||EVAL[-_]|(?:微信|QQ|加群|代购|返利|刷单).{0,8}[0-9]|1[3-9][0-9]{9}|[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}') THEN 'contact_url_or_marker'
    WHEN len(list_filter(range(1, length(whole) - 4), lambda i: substr(whole, i, 6) = repeat(substr(whole, i, 1), 6) AND substr(whole, i, 1) <> chr(10))) > 0 THEN 'repetition'
    WHEN len(list_distinct(list_transform(turns, lambda t: lower(regexp_replace(t, '[^\\p{L}\\p{N}]+', '', 'g'))))) < len(turns) THEN 'repeated_turn'
    ELSE 'kept' END AS reason FROM w)
SELECT reason, count(*) AS n FROM r GROUP BY reason
""")
def q03_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade. The SQL leaves out NFKC, which changes no turn's equality here."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return c.select(F.coalesce(convo.quality_reason(F.col("turns")), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), 'unknown') AS host, length(html) AS n FROM pages)
SELECT host, CASE WHEN n <= 128 THEN 'le_128' WHEN n <= 512 THEN 'le_512' WHEN n <= 2048 THEN 'le_2048' WHEN n <= 8192 THEN 'le_8192'
    WHEN n <= 32768 THEN 'le_32768' ELSE 'gt_32768' END AS size_bin, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars FROM p GROUP BY ALL
""")
def q04_url_host_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.lit("")), F.lit("unknown"))
    p = table(spark, sf_dir, "pages").select(host.alias("host"), F.length("html").alias("n"))
    return p.groupBy("host", tx.length_bin(F.col("n")).alias("size_bin")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").cast("long").alias("n_chars"))


@query("""
SELECT source AS r, lang AS c, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
       CASE grouping(source, lang) WHEN 0 THEN 'both' WHEN 1 THEN 'rows' WHEN 2 THEN 'columns' ELSE 'all' END AS level
FROM documents GROUP BY CUBE (source, lang)
""")
def q05_domain_lang_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return estimate.matrix(d, "source", "lang", {"chars": F.length("text").cast("long"), "bytes": F.octet_length("text").cast("long")})


@query("""
WITH d AS (SELECT source, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS o FROM documents)
SELECT source, count(*) AS n_rows, count(*) FILTER (o = 1) AS kept, CAST(sum(n_chars) AS BIGINT) AS gross_tokens,
       CAST(coalesce(sum(n_chars) FILTER (o = 1), 0) AS BIGINT) AS unique_tokens, CAST(coalesce(sum(n_chars) FILTER (o > 1), 0) AS BIGINT) AS duplicate_tokens
FROM d GROUP BY source
""")
def q06_cross_pool_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256)).select("doc_id", "source", "n_chars", "h")
    return dedup.cross_pool(d, "h", ["source", "doc_id"], "n_chars", "source")


@query("""
SELECT doc_id, work, n_chars FROM (
    SELECT doc_id, work, n_chars, row_number() OVER (PARTITION BY work ORDER BY n_chars DESC, doc_id) AS o
    FROM (SELECT doc_id, n_chars, sha256(""" + NORM.replace("text", "lower(text)", 1) + """) AS work FROM documents)
) WHERE o = 1
""")
def q07_best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work is a whole text, but for case and spaces."""
    work = F.sha2(tx.normalize_space(F.lower("text")), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", work.alias("work"), "n_chars")
    return dedup.best_version(d, "work", [F.desc("n_chars"), "doc_id"])


LINES = "(SELECT {id}, trim(unnest(string_split(text, chr(10)))) AS line FROM {table})"


@query(f"""
WITH d AS {LINES.format(id='doc_id', table='documents')}, b AS {LINES.format(id='item_id', table='benchmark')}
SELECT doc_id, count(DISTINCT line) AS lines FROM d WHERE length(line) >= 8 AND line IN (SELECT line FROM b WHERE length(line) >= 8) GROUP BY doc_id
""")
def q08_eval_line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.line_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


GRAMS = "(SELECT {id}, substr(text, i, 16) AS gram FROM {table}, generate_series(1, length(text) - 15) AS s(i) WHERE length(text) >= 16)"


@query(f"""
WITH b AS (SELECT DISTINCT gram FROM {GRAMS.format(id='item_id', table='benchmark')})
SELECT doc_id, count(DISTINCT gram) AS grams FROM {GRAMS.format(id='doc_id', table='documents')} JOIN b USING (gram) GROUP BY doc_id
""")
def q09_eval_16gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolate.gram_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 16)


@query("SELECT DISTINCT doc_id, b.text AS leak FROM documents d JOIN benchmark b ON length(b.text) >= 8 AND contains(d.text, b.text)")
def q10_substring_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = table(spark, sf_dir, "benchmark").select(F.col("text").alias("leak"))
    return isolate.substring_leaks(table(spark, sf_dir, "documents"), strings)


@query("""
WITH k AS (SELECT *, lower(regexp_replace(text, '[^\\pL\\pN]+', '', 'g')) AS k FROM conversations),
bad AS (SELECT DISTINCT conv_id FROM k WHERE k IN (SELECT k FROM k WHERE conv_id % 10 = 0 AND length(k) >= 8))
SELECT conv_id, count(*) AS n_turns FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad) GROUP BY conv_id
""")
def q11_heldout_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with an id divisible by 10 are held out; those that share a turn with them go, and they too."""
    c = table(spark, sf_dir, "conversations")
    kept = isolate.heldout_turns(c, c.where("conv_id % 10 = 0"), tx.compact(F.col("text"), fold=False))
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


@query("""
WITH t AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 9) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8
""")
def q12_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.lower(w)))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("s"))
    return dedup.near_pairs(d, "doc_id", "s", 0.8).withColumn("similarity", F.round("similarity", 9))


@query("""
WITH g AS (SELECT DISTINCT source, substr(text, i, 80) AS g FROM documents, generate_series(1, length(text) - 79) AS s(i) WHERE length(text) >= 80),
n AS (SELECT source, count(*) AS n FROM g GROUP BY source),
p AS (SELECT a.source AS a, b.source AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.source < b.source GROUP BY ALL)
SELECT a, b, shared, round(shared / least(x.n, y.n), 9) AS overlap FROM p JOIN n x ON x.source = a JOIN n y ON y.source = b
""")
def q13_shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 80-character shingles that sources share, over the smaller number of theirs."""
    # Few different sets of sources hold all shingles; sizes and pairs are made of those sets, with their counts.
    sets = grams.source_sets(table(spark, sf_dir, "documents"), 80).select("s", F.col("n").alias("c"))
    sizes = sets.select("c", F.explode("s").alias("source")).groupBy("source").agg(F.sum("c").alias("n"))
    pairs = sets.where(F.size("s") > 1).select("c", "s", F.explode("s").alias("a")).select("c", "a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("c").alias("shared"))
    x, y = (sizes.select(F.col("source").alias(k), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "shared", F.round(F.col("shared") / F.least("n_a", "n_b"), 9).alias("overlap"))


HEX = "CAST('0x' || substr(sha256({key}), 1, {n}) AS BIGINT)"
B_SPLIT = HEX.format(key="'v1:split:' || CAST(doc_id AS VARCHAR)", n=12)
B_PHASE = HEX.format(key="'v1:phase:' || CAST(doc_id AS VARCHAR)", n=12)
B_PRIO = HEX.format(key="'v1:' || CAST(doc_id AS VARCHAR)", n=15)


@query(f"""
SELECT doc_id, CASE WHEN {B_SPLIT} % 10000 < 50 THEN 'test' WHEN {B_SPLIT} % 10000 < 100 THEN 'calib' WHEN {B_SPLIT} % 10000 < 200 THEN 'dev' ELSE 'train' END AS split,
       CASE WHEN {B_PHASE} % 14 < 5 THEN 1 WHEN {B_PHASE} % 14 < 10 THEN 2 ELSE 3 END AS phase, {B_PRIO} AS priority FROM documents
""")
def q14_split_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", split.split_of("v1", g).alias("split"), split.phase_of("v1", g).alias("phase"), split.priority_of("v1", g).alias("priority"))


B_W = HEX.format(key="'w:' || CAST(conv_id AS VARCHAR)", n=8)


@query(f"""
WITH c AS (SELECT DISTINCT conv_id, {B_W} / 4294967295.0 AS x, 'conv_' || substr(sha256('conv|' || CAST(conv_id AS VARCHAR)), 1, 24) AS stable_id FROM conversations)
SELECT conv_id, stable_id, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.82 THEN 'dev' WHEN x < 0.91 THEN 'test' ELSE 'calib' END AS split FROM c
""")
def q15_weighted_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id").cast("string")
    shares = [("train", 0.7), ("dev", 0.12), ("test", 0.09), ("calib", 0.09)]
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select("conv_id", tx.stable_id("conv_", F.lit("conv"), key).alias("stable_id"), split.weighted_split("w", key, shares).alias("split"))


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'valid' ELSE 'train' END AS split, sha256(text) AS text_hash, string_split(text, chr(10))[1] AS opening FROM documents),
m AS (SELECT split, 'text_hash' AS axis, text_hash AS value FROM d UNION ALL SELECT split, 'opening', opening FROM d)
SELECT axis, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m WHERE value IS NOT NULL GROUP BY axis, value HAVING count(DISTINCT split) > 1
""")
def q16_group_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 == 0, "valid").otherwise("train").alias("split"), F.sha2("text", 256).alias("text_hash"), F.split("text", "\n")[0].alias("opening"))
    return isolate.group_leaks(d, ["text_hash", "opening"])


@query("""
WITH s AS (SELECT lang AS role, CAST(sum(n_chars) AS BIGINT) AS capacity, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN n_chars ELSE 0 END) AS BIGINT) AS consumed,
              CASE lang WHEN 'en' THEN 0.55 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.2 ELSE 0.1 END::DOUBLE AS fraction FROM documents GROUP BY lang),
q AS (SELECT *, CAST(round_even(fraction * 1000001.0, 0) AS BIGINT) AS q, row_number() OVER (ORDER BY role DESC) = 1 AS last FROM s),
o AS (SELECT role, capacity, consumed, fraction, CASE WHEN last THEN 1000001 - (SELECT sum(q) FROM q WHERE NOT last) ELSE q END AS quota, capacity - consumed AS remaining FROM q)
SELECT role, capacity, consumed, fraction, CAST(quota AS BIGINT) AS quota, remaining, CAST(greatest(0, quota - remaining) AS BIGINT) AS shortage,
       CASE WHEN max(greatest(0, quota - remaining)) OVER () > 0 THEN 'blocked_insufficient_pool' ELSE 'ready' END AS status FROM o
""")
def q17_plan_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("lang") == "en", 0.55).when(F.col("lang") == "de", 0.15).when(F.col("lang") == "fr", 0.2).otherwise(0.1)
    roles = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("capacity"), F.sum(F.when(F.col("doc_id") % 10 == 0, F.col("n_chars")).otherwise(0)).alias("consumed"))
    return quota.plan_mix(roles.select(F.col("lang").alias("role"), "capacity", "consumed", share.alias("fraction")), 1_000_001)


@query("""
WITH c AS (SELECT source || ':' || lang AS cell, CAST(sum(n_chars) AS HUGEINT) AS capacity FROM documents GROUP BY ALL),
f AS (SELECT cell, capacity, 777777 * capacity // (SELECT sum(capacity) FROM c) AS f, 777777 * capacity % (SELECT sum(capacity) FROM c) AS r FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY r DESC, cell) AS k, 777777 - sum(f) OVER () AS left_over FROM f)
SELECT cell, CAST(capacity AS BIGINT) AS capacity, CAST(CASE WHEN (SELECT sum(capacity) FROM c) <= 777777 THEN capacity ELSE f + (CASE WHEN k <= left_over THEN 1 ELSE 0 END) END AS BIGINT) AS quota FROM k
""")
def q18_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "documents").groupBy(F.concat_ws(":", "source", "lang").alias("cell")).agg(F.sum("n_chars").alias("capacity"))
    return quota.allocate(cells, 777_777)


@query(f"""
WITH p AS (SELECT doc_id, source, n_chars, {B_PRIO} AS priority FROM documents),
b AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY priority, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM p)
SELECT doc_id, source, n_chars, CAST(t AS BIGINT) AS tokens_before FROM b WHERE t < 50000
""")
def q19_prefix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", split.priority_of("v1", F.col("doc_id").cast("string")).alias("priority"))
    return quota.prefix_select(p, ["source"], ["priority", "doc_id"], "n_chars", F.lit(50_000)).drop("priority")


@query("""
SELECT doc_id, source, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset FROM documents
""")
def q20_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return quota.offsets(d, ["source"], ["doc_id"], "n_chars")


@query("""
WITH r AS (SELECT source, doc_id, n_chars, i AS round, doc_id % 3 + i AS exposure FROM documents, generate_series(0, 2) AS s(i)),
b AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY exposure, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM r)
SELECT source, doc_id, CAST(round AS INTEGER) AS round, exposure, CAST(least(n_chars, 200000 - t) AS BIGINT) AS take FROM b WHERE t < 200000
""")
def q21_exposure_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("doc_id") % 3).alias("prior"))
    return quota.exposure_schedule(d, "source", "doc_id", "n_chars", "prior", 200_000, 3)


@query("""
WITH l AS (SELECT event_id, value, user_id % 5 AS a, user_id % 3 AS b FROM events WHERE event_id IS NOT NULL),
g AS (SELECT event_id, value, a > lag(a) OVER (ORDER BY event_id) AS ga, b > lag(b) OVER (ORDER BY event_id) AS gb FROM l)
SELECT event_id, CASE WHEN coalesce(ga, false) THEN 'a' ELSE 'b' END AS source, value FROM g WHERE coalesce(ga, false) <> coalesce(gb, false)
""")
def q22_counter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 5).alias("a"), (F.col("user_id") % 3).alias("b"))
    return quota.counter_diff(e, "event_id", ["a", "b"], "value")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' WHEN o_totalprice < 400000 THEN 'large' END AS stage FROM orders
""")
def q23_stage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = spark.sql("SELECT * FROM VALUES ('large', 400000D), ('small', 50000D), ('middle', 200000D) AS t(stage, stop_at)")
    return quota.stage_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), stages, "o_totalprice").drop("o_totalprice")


@query("""
WITH t AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY source)
SELECT source, tokens, CAST(greatest(0, ceil((tokens - 1) / 2048)) AS BIGINT) AS windows,
       CAST(greatest(0, CAST(greatest(0, ceil((tokens - 1) / 2048)) AS BIGINT) * 2048 + 1 - tokens) AS BIGINT) AS padding FROM t
""")
def q24_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.window_counts(table(spark, sf_dir, "documents"), "source", "n_chars", 2048)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('k:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 20")
def q25_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 documents of each language."""
    return sample.bottom_k(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 20, "k", ["lang"])


@query("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('r:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS turn FROM part)
SELECT p_partkey, p_brand, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, p_brand LIMIT 60
""")
def q26_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 60, "r")


WAVES = """
WITH j AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS j, count(*) OVER () AS n FROM part),
s AS (SELECT *, CAST(floor(((j + 1) * 16 - 1) / n) AS INTEGER) AS stratum FROM j),
w AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS wave, count(*) OVER (PARTITION BY stratum) AS m FROM s),
d AS (SELECT p_partkey, p_retailprice, stratum, CAST(wave AS INTEGER) AS wave, least(2, m) / m AS probability FROM w WHERE wave <= 2)
"""


@query(WAVES + "SELECT * FROM d")
def q27_two_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.two_waves(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey", 16, "s")


@query("""
WITH j AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS j, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM j WHERE j IN (SELECT i * (SELECT count(*) FROM orders) // 37 FROM generate_series(0, 36) AS s(i))
""")
def q28_even_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.even_spaced(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 37)


@query(WAVES + """
SELECT wave, round(sum(1 / probability), 6) AS rows_estimate, round(sum(p_retailprice / probability), 4) AS p_retailprice_total,
       round(sum(p_retailprice / probability) / sum(1 / probability), 6) AS p_retailprice_mean FROM d GROUP BY wave
""")
def q29_ht_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimate.weighted_totals(q27_two_wave(spark, sf_dir), "probability", ["p_retailprice"], ["wave"])
    return e.select("wave", F.round("rows_estimate", 6).alias("rows_estimate"), F.round("p_retailprice_total", 4).alias("p_retailprice_total"), F.round("p_retailprice_mean", 6).alias("p_retailprice_mean"))


@query("""
WITH a AS (SELECT lang, sum(n_chars) / sum(sum(n_chars)) OVER () AS x FROM documents WHERE doc_id % 2 = 0 GROUP BY lang),
b AS (SELECT lang, sum(n_chars) / sum(sum(n_chars)) OVER () AS y FROM documents WHERE doc_id % 2 = 1 GROUP BY lang)
SELECT round(sum(abs(coalesce(x, 0) - coalesce(y, 0))) / 2, 9) AS distance FROM a FULL JOIN b USING (lang)
""")
def q30_tv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the languages, by characters, of documents with even and with odd ids."""
    d = table(spark, sf_dir, "documents")
    halves = [estimate.distribution(d.where(F.col("doc_id") % 2 == r), F.col("lang"), F.col("n_chars")) for r in (0, 1)]
    return estimate.total_variation(*halves).select(F.round("distance", 9).alias("distance"))


@query("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS j, count(*) OVER (PARTITION BY lang) AS n FROM documents),
a AS (SELECT *, unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS fraction FROM r)
SELECT lang, fraction, max(n_chars) FILTER (j = greatest(0, ceil(n * fraction) - 1)) AS nearest_rank, max(n_chars) FILTER (j = floor(fraction * (n - 1))) AS lower_index FROM a GROUP BY lang, fraction
""")
def q31_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.percentiles(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.9, 0.95, 0.99], ["lang"])


UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
COSINE = f"""
WITH v AS (SELECT vec_id, label, {UNIT} AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s)
"""


@query(COSINE + "SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def q32_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieve.cosine_top_k(v.where("vec_id % 50 = 0"), v, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


LEXICAL = """
WITH q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\x{4E00}-\\x{9FFF}]|[a-z0-9_]+')) AS w FROM benchmark)),
d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\x{4E00}-\\x{9FFF}]|[a-z0-9_]+')) AS w FROM documents)),
nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), nd AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT item_id, doc_id, count(*) AS c FROM q JOIN d USING (w) GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id AS id, c / (nq.n + nd.n - c) AS score FROM p JOIN nq USING (item_id) JOIN nd USING (doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, id, rank, round(score, 9) AS score FROM r WHERE rank <= 5
"""


@query(LEXICAL)
def q33_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.lexical_top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5, "item_id", "text", "doc_id", "text")
    return found.select("query_id", "id", "rank", F.round("score", 9).alias("score"))


@query("""
WITH t AS (SELECT p_partkey AS id, p_brand AS f, p_name FROM part),
w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM t),
p AS (SELECT a.id, b.id AS negative, 100 AS s FROM t a JOIN t b ON a.f = b.f AND a.id <> b.id
      UNION ALL SELECT a.id, b.id, 1 FROM w a JOIN w b ON a.w = b.w AND a.id <> b.id WHERE a.w <> ''),
s AS (SELECT id, negative, CAST(sum(s) AS BIGINT) AS score FROM p GROUP BY ALL)
SELECT id, negative, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, negative) AS INTEGER) AS rank FROM s) WHERE rank <= 5
""")
def q34_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.hard_negatives(table(spark, sf_dir, "part"), 5, "p_partkey", "p_brand", "p_name")


@query(COSINE + "SELECT query_id, id, CAST(floor((rank - 1) / 5) AS INTEGER) AS batch FROM r WHERE rank <= 20 AND score >= 0.3")
def q35_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieve.batch_plan(retrieve.cosine_top_k(v.where("vec_id % 50 = 0"), v, 20), 0.3).select("query_id", "id", "batch")


@query(COSINE + """,
l AS (SELECT r.query_id, q.label AS gold, list(c.label ORDER BY rank) AS listed FROM r JOIN v q ON q.vec_id = r.query_id JOIN v c ON c.vec_id = r.id WHERE rank <= 10 GROUP BY ALL),
a AS (SELECT gold, coalesce(list_position(listed, gold), 0) AS spot FROM l)
SELECT gold, count(*) AS n, round(avg(CASE WHEN spot = 1 THEN 1.0 ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN spot BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 9) AS recall_5,
       round(avg(CASE WHEN spot > 0 THEN 1.0 / spot ELSE 0 END), 9) AS mrr, round(avg(CASE WHEN spot BETWEEN 1 AND 5 THEN 1.0 / log2(spot + 1) ELSE 0 END), 9) AS ndcg_5 FROM a GROUP BY gold
""")
def q36_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon a vector of the query's own label comes."""
    v = table(spark, sf_dir, "embeddings")
    found = retrieve.cosine_top_k(v.where("vec_id % 50 = 0"), v, 10)
    labels = v.select("vec_id", "label")
    named = found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    listed = named.groupBy("query_id", "gold").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("listed"))
    out = metrics.ranking(listed, F.col("gold"), F.col("listed"), ["gold"])
    return out.select("gold", "n", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_5", "mrr", "ndcg_5")])


SCORED = "(SELECT l.doc_id, quality, toxic, least(1.0, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) * 5.0 / greatest(1, length(text)))::DOUBLE AS score FROM labels l JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score for bad quality: five times the share of symbols, at most 1."""
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>]+", ""))
    score = F.least(F.lit(1.0), symbols * F.lit(5.0) / F.greatest(F.lit(1), F.length("text")))
    d = table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("bad", (F.col("quality") == 0).cast("int"))


@query(f"""
WITH s AS (SELECT 1 - quality AS y, CASE WHEN score > 0.1 THEN 1 ELSE 0 END AS p FROM {SCORED}), c(class) AS (VALUES (0), (1), (2)),
m AS (SELECT class, (SELECT count(*) FROM s WHERE y = class) AS support, (SELECT count(*) FROM s WHERE y = class AND p = class) AS tp, (SELECT count(*) FROM s WHERE y <> class AND p = class) AS fp FROM c),
r AS (SELECT *, support - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM m)
SELECT class, support, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM r
""")
def q37_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad quality predicted from symbols; class 2 is absent and scores 0."""
    s = _scored(spark, sf_dir).withColumn("said", (F.col("score") > 0.1).cast("int"))
    classes = spark.range(3).select(F.col("id").cast("int").alias("class"))
    out = metrics.classification(s, "bad", "said", classes)
    return out.select("class", "support", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH s AS (SELECT doc_id, 1 - quality AS y, score FROM {SCORED}),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s),
a AS (SELECT (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auroc,
             count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r),
p AS (SELECT y, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (ORDER BY score DESC, doc_id))
SELECT positives, negatives, round(auroc, 9) AS auroc, (SELECT round(sum(CASE WHEN y = 1 THEN hits / k ELSE 0 END) / sum(y), 9) FROM p) AS average_precision FROM a
""")
def q38_auroc_auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    both = metrics.auroc(s, "bad", "score").crossJoin(metrics.average_precision(s, "bad", "score", "doc_id"))  # two single rows
    return both.select("positives", "negatives", F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


@query(f"""
WITH s AS (SELECT 1 - quality AS y, score, CASE {' '.join(f'WHEN score >= {i}/10::DOUBLE THEN {i}' for i in range(9, 0, -1))} ELSE 0 END AS bin FROM {SCORED}),
b AS (SELECT bin, count(*) AS n, avg(score) AS confidence, avg(y) AS accuracy FROM s GROUP BY bin)
SELECT bin, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy, round(abs(confidence - accuracy), 9) AS gap,
       (SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 9) FROM b) AS ece, (SELECT round(avg((score - y) * (score - y)), 9) FROM s) AS brier FROM b
""")
def q39_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    rows = metrics.calibration(s, "bad", "score").crossJoin(metrics.calibration_summary(s, "bad", "score").drop("n"))  # one row
    return rows.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("confidence", "accuracy", "gap", "ece", "brier")])


@query("""
WITH t AS (SELECT conv_id, count(*) AS length, bool_and(length(text) >= 40) AS ok FROM conversations GROUP BY conv_id)
SELECT length, count(*) AS trajectories, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 9) AS success FROM t GROUP BY length
""")
def q40_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn counts as correct with 40 characters or more."""
    steps = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text") >= 40).alias("ok"))
    return metrics.trajectories(steps, "conv_id", "ok").withColumn("success", F.round("success", 9))


@query("""
WITH j AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM (SELECT doc_id, count(*) AS g FROM documents GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS p FROM labels GROUP BY 1) USING (doc_id))
SELECT CAST(sum(g) AS BIGINT) AS gold_rows, CAST(sum(p) AS BIGINT) AS prediction_rows, count(*) FILTER (p = 0) AS missing, count(*) FILTER (g = 0) AS extra,
       count(*) FILTER (g > 1 OR p > 1) AS duplicates, count(*) FILTER (p = 0 OR g = 0 OR g > 1 OR p > 1) = 0 AS is_bijection FROM j
""")
def q41_bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bijection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH a AS (SELECT source AS metric, avg(n_chars) AS before FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1' GROUP BY 1),
b AS (SELECT source AS metric, avg(n_chars) AS after FROM documents WHERE doc_id % 2 = 1 OR source = 'src1' GROUP BY 1)
SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta,
       CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN abs(after - before) <= 1e-12 THEN 'equal' WHEN after > before THEN 'up' ELSE 'down' END AS direction
FROM a FULL JOIN b USING (metric)
""")
def q42_metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    means = lambda part: part.groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    out = estimate.metric_delta(means(d.where("doc_id % 2 = 0 and source <> 'src1'")), means(d.where("doc_id % 2 = 1 or source = 'src1'")))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")], "direction")


@query("""
WITH v(gate, value) AS (SELECT 'rows', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'mean_discount', round(avg(l_discount), 9) FROM lineitem UNION ALL SELECT 'returned', avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) FROM lineitem),
l(gate, low, high) AS (VALUES ('rows', 1000.0::DOUBLE, NULL::DOUBLE), ('mean_discount', 0.04, 0.06), ('returned', NULL, 0.2), ('missing', 0, 1))
SELECT gate, round(value, 9) AS value, low, high, coalesce(value >= coalesce(low, value) AND value <= coalesce(high, value), false) AS passed FROM l LEFT JOIN v USING (gate)
""")
def q43_sharded_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters are summed in parts by Spark's own partial aggregation; a gate without a value blocks."""
    l = table(spark, sf_dir, "lineitem")
    one = l.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.round(F.avg("l_discount"), 9).alias("mean_discount"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    values = one.unpivot([], ["rows", "mean_discount", "returned"], "gate", "value")
    limits = spark.sql("SELECT * FROM VALUES ('rows', 1000D, CAST(NULL AS DOUBLE)), ('mean_discount', 0.04D, 0.06D), ('returned', CAST(NULL AS DOUBLE), 0.2D), ('missing', 0D, 1D) AS t(gate, low, high)")
    return metrics.gates(values, limits).withColumn("value", F.round("value", 9))


CHECKED = """
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, * FROM lineitem),
i AS (
    SELECT id AS row_id, 'required:l_returnflag' AS "check", '' AS detail FROM t WHERE l_returnflag IS NULL OR trim(l_returnflag) = ''
    UNION ALL SELECT id, 'unique:l_partkey', CAST(f AS VARCHAR) FROM (SELECT id, row_number() OVER w AS n, first_value(id) OVER w AS f FROM t WINDOW w AS (PARTITION BY l_partkey ORDER BY id)) WHERE n > 1
    UNION ALL SELECT id, 'range:l_linenumber', CAST(l_linenumber AS VARCHAR) FROM t WHERE l_linenumber < 1 OR l_linenumber > 3
    UNION ALL SELECT id, 'choice:l_returnflag', l_returnflag FROM t WHERE trim(l_returnflag) <> '' AND l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT id, 'product:due', '' FROM t WHERE abs(l_quantity * l_discount - l_tax) > 1.5
)
"""


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = [
        checks.required(t, "id", "l_returnflag"),
        checks.unique(t, "id", "l_partkey"),
        checks.in_range(t, "id", "l_linenumber", 1, 3),
        checks.one_of(t, "id", "l_returnflag", ["A", "N"]),
        checks.product(t, "id", ("l_quantity", "l_discount"), "l_tax", 1.5).select("row_id", F.lit("product:due").alias("check"), F.lit("").alias("detail")),
    ]
    return t, checks.all_issues(found)


@query(CHECKED + 'SELECT row_id, "check", detail FROM i')
def q44_check_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1]


@query(CHECKED + """SELECT (SELECT count(*) FROM t) AS rows, count(*) AS issues, CASE WHEN (SELECT count(*) FROM t) = 0 THEN 'incomplete'
    WHEN coalesce(bool_or(string_split("check", ':')[1] IN ('required')), false) THEN 'blocked' WHEN count(*) > 0 THEN 'warning' ELSE 'passed' END AS status FROM i""")
def q44_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(*_checked(spark, sf_dir), ["required"])


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'both' AS kind, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'customers_only', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)
UNION ALL SELECT 'suppliers_only', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c)
""")
def q45_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "k")
    return named("both", c.intersect(s)).unionByName(named("customers_only", c.subtract(s))).unionByName(named("suppliers_only", s.subtract(c)))


@query("""
SELECT conv_id, turn, text, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant') AS reply_turn,
       (SELECT arg_min(b.text, b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant') AS reply
FROM conversations a WHERE role = 'user'
""")
def q46_reply_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convo.next_reply(table(spark, sf_dir, "conversations"), "user", "assistant")


@query("""
SELECT conv_id, turn, CAST(len(h) AS INTEGER) AS n_before, coalesce(array_to_string(h, chr(10)), '') AS history FROM (
    SELECT conv_id, turn, role, coalesce(list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM conversations
) WHERE role = 'assistant'
""")
def q47_prefix_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convo.prefix_history(table(spark, sf_dir, "conversations"), "assistant")


@query("""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'mit' ELSE 'cc-by' END AS licence, doc_id % 2 = 0 AS reviewed FROM documents),
v AS (SELECT CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'no_policy' WHEN source = 'src1' AND licence <> 'mit' THEN 'licence'
    WHEN source = 'src2' AND NOT reviewed THEN 'review' ELSE 'allowed' END AS verdict FROM d)
SELECT verdict, count(*) AS n FROM v GROUP BY verdict
""")
def q48_policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "mit").otherwise("cc-by").alias("licence"), (F.col("doc_id") % 2 == 0).alias("reviewed"))
    rules = spark.sql("SELECT * FROM VALUES ('src0', array('mit', 'cc-by'), false), ('src1', array('mit'), false), ('src2', array('mit', 'cc-by'), true) AS t(role, licences, needs_review)")
    return checks.policy(d, rules, "source").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


EDGES = "VALUES ('b', 'a'), ('c', 'b'), ('d', 'b'), ('d', 'c'), ('e', 'x'), ('f', 'g'), ('g', 'f')"


@query(f"""
WITH RECURSIVE e(task, after) AS ({EDGES}), t(task) AS (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g')),
w(task, here, depth) AS (SELECT task, task, 0 FROM t UNION ALL SELECT w.task, e.after, w.depth + 1 FROM w JOIN e ON e.task = w.here WHERE w.depth < 16)
SELECT task, CAST(max(depth) AS INTEGER) AS depth, max(depth) >= 16 AS cyclic, task IN (SELECT task FROM e WHERE after NOT IN (SELECT task FROM t)) AS unknown FROM w GROUP BY task
""")
def q49_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.sql(f"SELECT * FROM {EDGES} AS t(task, after)")
    tasks = spark.sql("SELECT * FROM VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g') AS t(task)")
    return graph.task_depths(edges, tasks, 16)


@query(f"""
WITH s AS (SELECT lang, CASE WHEN {B_SPLIT} % 10000 < 50 THEN 'test' WHEN {B_SPLIT} % 10000 < 100 THEN 'calib' WHEN {B_SPLIT} % 10000 < 200 THEN 'dev' ELSE 'train' END AS split FROM documents)
SELECT l.lang AS class, p.split, count(s.lang) AS n, count(s.lang) >= 5 AS covered FROM (SELECT DISTINCT lang FROM s) l CROSS JOIN (SELECT DISTINCT split FROM s) p LEFT JOIN s ON s.lang = l.lang AND s.split = p.split GROUP BY ALL
""")
def q50_class_split_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", split.split_of("v1", F.col("doc_id").cast("string")).alias("split"))
    return metrics.class_coverage(d, "lang", "split", 5)


@query("""
WITH k AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN 'dev' WHEN doc_id % 5 = 1 THEN 'test' ELSE 'train' END AS s, regexp_replace(lower(text), '[^\\pL\\pN]+', '', 'g') AS k FROM documents)
SELECT a.s AS left_split, b.s AS right_split, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY ALL
""")
def q51_isolation_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 5 == 0, "dev").when(F.col("doc_id") % 5 == 1, "test").otherwise("train")
    d = table(spark, sf_dir, "documents").select(s.alias("split"), F.sha2(F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{N}]+", ""), 256).alias("k"))
    return isolate.isolation_receipt(d, "k")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q52_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((records.field(F.col("props"), "$.k", "bigint") % 10).alias("k"), "value")
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query()
def q53_schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5}}, "additionalProperties": False}
    e = table(spark, sf_dir, "events").select(records.validated(F.col("props"), schema, strict=True)["errors"].alias("errors"))
    return e.select(F.array_join("errors", ";").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


@query()
def q54_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.sql("SELECT * FROM VALUES (1, 'search(query=\"a b\", limit=3)'), (2, 'f(x)'), (3, 'tool.run(args=[1, {\"k\": None}])'), (4, 'f(a=g())'), (5, 'no call'), (6, CAST(NULL AS STRING)) AS t(id, text)")
    return calls.select("id", records.parse_call("text").alias("c")).select("id", "c.name", "c.arguments", "c.status")


@query()
def q55_greedy_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scan by id keeps, if one with 0.8 of its words in common with a kept one goes."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.lower(w)))
    return dedup.greedy_near(table(spark, sf_dir, "documents").select("doc_id", words.alias("s")), "doc_id", "s", 0.8)


@query()
def q56_span_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = convo.flatten(table(spark, sf_dir, "conversations"))
    cut = whole.select("conv_id", F.posexplode(records.span_windows(F.col("text"), 400, 50)).alias("position", "w"))
    return cut.select("conv_id", "position", "w.start", "w.end", "w.overlap_start")


@query("SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY link")
def q57_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.explode(records.links(F.col("html"))).alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q58_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the same function serves streams."""
    return windows.tumbling(table(spark, sf_dir, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 6 HOUR AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, gap ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s
""")
def q59_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), "6 hours")
