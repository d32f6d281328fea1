"""More queries over the provided tables: filters, splits, sampling, windows, evaluation and audits. They register with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import audit, dedup, filters, metrics, quota, retrieve, sample, split
from millrace.plans.queries import NORM, query, table


@query(f"""
WITH r AS (SELECT source, CASE WHEN text IS NULL THEN 'missing' WHEN {NORM} = '' THEN 'empty' WHEN contains(text, chr(0)) THEN 'nul' ELSE 'kept' END AS reason FROM documents)
SELECT source, reason, count(*) AS n FROM r GROUP BY ALL
""")
def q60_text_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.rule_counts(table(spark, sf_dir, "documents"), filters.text_reason(F.col("text")), "source")


#: Rules of the query below, in their order.
RULES = {"mail": "[a-z0-9._-]+@[a-z0-9-]+[.][a-z]+", "address": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "long_number": "[0-9]{14,}", "symbols": "[#*%&$]{3}"}


@query(f"""
WITH r AS (SELECT source, CASE {' '.join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in RULES.items())} ELSE 'kept' END AS reason FROM documents)
SELECT source, reason, count(*) AS n FROM r GROUP BY ALL
""")
def q61_named_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.rule_counts(table(spark, sf_dir, "documents"), filters.named_rules(F.col("text"), RULES), "source")


@query("""
SELECT page_id, CASE WHEN lower(regexp_extract(url, '[^/.](\\.[^./]*)$', 1)) NOT IN ('', '.html', '.com', '.org') THEN 'other_extension'
    WHEN regexp_matches(url, '(?i)/(node_modules|build)/|page/1') THEN 'dependency_or_build_path'
    WHEN regexp_matches(left(html, 2000), '(?i)lang="fr"') THEN 'explicit_generated_header' ELSE 'kept' END AS reason FROM pages
""")
def q62_file_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = filters.file_reason(F.col("url"), F.col("html"), extensions=["", ".html", ".com", ".org"], exclude_path="/(node_modules|build)/|page/1", exclude_header='lang="fr"')
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(reason, F.lit("kept")).alias("reason"))


@query(f"""
WITH q AS (SELECT conv_id, turn, {NORM} AS q FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN length(q) < 4 THEN 'query_too_short' WHEN length(q) > 160 THEN 'query_too_long'
    WHEN regexp_matches(q, '(?i)\\bEVAL[-_][A-Z0-9_-]+\\b') THEN 'eval_marker'
    WHEN regexp_matches(q, '(?i)^[{{\\[]|["'']?query["'']?\\s*[:：]') THEN 'serialized_wrapper_fragment'
    WHEN regexp_matches(q, '请直接，请|请为当前对象，请|，，|。。|？？') THEN 'mechanical_punctuation'
    WHEN len(list_filter(range(1, length(q) - 2), lambda i: substr(q, i, 4) = repeat(substr(q, i, 1), 4))) > 0 THEN 'repeated_character_filler' ELSE 'kept' END AS reason FROM q
""")
def q63_query_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.coalesce(filters.query_reason(F.col("text")), F.lit("kept")).alias("reason"))


@query("""
SELECT doc_id, list_filter(['mit license', '@mail', 'the the', '+1 ('], lambda m: contains(lower(text), m)) AS markers,
       regexp_matches(text, '(?i)编号[口号]?\\s*[0-9]{5,}|\\b[a-z][a-z0-9_-]*[-_][0-9]{6,}\\b') AS padded, regexp_matches(text, '(?i)\\bEVAL[-_][A-Z0-9_-]+\\b') AS evaluation
FROM documents WHERE text IS NOT NULL
""".replace("list_filter(", "array_to_string(list_filter(", 1).replace(", m)) AS markers", ", m)), ',') AS markers", 1))
def q64_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents").where("text is not null"), F.col("text")
    found = F.array_join(filters.markers_found(t, ["MIT license", "@mail", "the the", "+1 ("]), ",")
    return d.select("doc_id", found.alias("markers"), F.rlike(t, F.lit(filters.IDENTIFIER_PADDING)).alias("padded"), F.rlike(t, F.lit(filters.EVAL_MARKER)).alias("evaluation"))


@query("""
WITH r AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 9 = 0 AND text IS NOT NULL)
SELECT doc_id, coalesce(sha256(text) IN (SELECT h FROM r), false) AS revoked FROM documents
""")
def q65_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of revoked texts is that of every ninth id; all documents are held against it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return filters.revoked(d, d.where("doc_id % 9 = 0"), "h").select("doc_id", "revoked")


HEX = "CAST('0x' || substr(sha256({}), 1, {}) AS BIGINT)"


@query(f"""
WITH d AS (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS k FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, {HEX.format("'v1:reserve:' || k", 12)} AS r FROM d)
SELECT doc_id, CASE WHEN {HEX.format('text', 8)} % 10000 < 500 THEN 'valid' ELSE 'train' END AS by_text,
       CASE WHEN {HEX.format("'v1:five:' || k", 12)} % 5 = 0 THEN 'dev' ELSE 'train' END AS by_fifth,
       CASE WHEN {HEX.format("'split-v1' || k", 2)} < 2 THEN 'valid' ELSE 'train' END AS by_salt,
       CASE WHEN r % 10 <> 0 THEN 'train' WHEN (r // 10) % 2 = 0 THEN 'dev' ELSE 'test' END AS by_reserve,
       CASE WHEN k IN ('1', '2') THEN 'test' WHEN k = '3' THEN 'dev' ELSE 'train' END AS forced FROM b
""")
def q66_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", split.text_valid(F.col("text")).alias("by_text"), split.fifth_dev("v1:five", k).alias("by_fifth"), split.salted_valid("split-v1", k).alias("by_salt"),
        split.reserved("v1:reserve", k).alias("by_reserve"), split.with_forced(F.lit("train"), k, {"test": ["1", "2"], "dev": ["3"]}).alias("forced"),
    )


@query("""
WITH r(axis, value, split) AS (VALUES ('source', 'src0', 'train'), ('source', 'src1', 'test'), ('source', 'src2', 'train'), ('lang', 'en', 'train'), ('lang', 'fr', 'test')),
x AS (SELECT doc_id, 'source' AS axis, source AS value FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents),
j AS (SELECT doc_id, count(value) AS n, count(*) FILTER (value IS NOT NULL AND split IS NULL) AS odd, count(DISTINCT split) AS s, min(split) AS one FROM x LEFT JOIN r USING (axis, value) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 AND odd = 0 AND s = 1 THEN one END AS split, CASE WHEN n = 0 THEN 'none' WHEN odd > 0 THEN 'unknown' WHEN s > 1 THEN 'conflict' ELSE 'agreed' END AS status FROM j
""")
def q67_split_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("source", "src0", "train"), ("source", "src1", "test"), ("source", "src2", "train"), ("lang", "en", "train"), ("lang", "fr", "test")], "axis string, value string, split string")
    return split.agreed(table(spark, sf_dir, "documents"), "doc_id", registry, ["source", "lang"])


@query("""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
g AS (SELECT *, row_number() OVER (ORDER BY sha256('two:' || source), source) AS o, count(*) OVER () AS g FROM n),
d AS (SELECT d.doc_id, d.source, g.n, g.g, row_number() OVER (PARTITION BY d.source ORDER BY sha256('two:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents d JOIN g ON d.source = g.source AND o <= 4)
SELECT doc_id, source, round(least(4, g) / g * least(5, n) / n, 9) AS probability FROM d WHERE r <= 5
""")
def q68_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sample.two_stage(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4, 5, "two")
    return drawn.select("doc_id", "source", F.round("probability", 9).alias("probability"))


@query("""
WITH t AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('turns:' || CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, lang) AS r FROM t)
SELECT doc_id, source, lang, CAST(turn AS INTEGER) AS turn FROM r WHERE r <= 6
""")
def q69_balanced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.balanced_turns(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 6, "turns")


@query("""
WITH t AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY sha256('slice:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS turn FROM part)
SELECT p_partkey, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, p_brand, p_type LIMIT 40
""")
def q70_balanced_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.slice_of(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey", 40, "slice").select("p_partkey", "turn")


@query("""
WITH w(source, share) AS (VALUES ('src0', 100000 * 0.5), ('src1', 100000 * 0.3), ('src2', 100000 * 0.2)),
d AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY sha256('chars:' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT doc_id, source, CAST(b AS BIGINT) AS chars_before FROM d JOIN w USING (source) WHERE b < share
""")
def q71_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sample.char_budget(d, "source", "doc_id", "n_chars", {"src0": 0.5, "src1": 0.3, "src2": 0.2}, 100_000, "chars").select("doc_id", "source", "chars_before")


@query("""
WITH q AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS quota FROM documents GROUP BY source), n AS (SELECT source, unnest(generate_series(1, CAST(ceil(quota / 2048) AS BIGINT))) AS n FROM q)
SELECT source, CAST(n AS INTEGER) AS n, CAST('0x' || substr(sha256('plan:' || source || ':' || CAST(n AS VARCHAR)), 1, 15) AS BIGINT) AS place FROM n
""")
def q72_window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("quota"))
    return quota.window_plan(quotas, 2048, "plan")


@query("""
WITH d AS (SELECT lang, conv_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CAST(1 + length(w) AS INTEGER)) AS t, role AS lang FROM conversations),
f AS (SELECT role, unnest(t) AS token, conv_id, turn, generate_subscripts(t, 1) AS i FROM (SELECT role, conv_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CAST(1 + length(w) AS INTEGER)) AS t FROM conversations)),
p AS (SELECT role, token, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, i) - 1 AS p, count(*) OVER (PARTITION BY role) AS total FROM f),
w AS (SELECT role, p // 64 AS w, p, token, total FROM p UNION ALL SELECT role, p // 64 - 1, p, token, total FROM p WHERE p % 64 = 0 AND p > 0),
c AS (SELECT role, w, list(token ORDER BY p) AS c FROM w WHERE w * 64 < total - 1 OR (w = 0 AND total = 1) GROUP BY role, w),
l AS (SELECT role, w, list_resize(c, 65, CAST(0 AS INTEGER)) AS c FROM c)
SELECT role, w AS "window", array_to_string(c[1:64], ' ') AS x, array_to_string(c[2:65], ' ') AS y, CAST(len(list_filter(c[2:65], lambda t: t <> 0)) AS INTEGER) AS unmasked FROM l
""".replace("d AS (SELECT lang, conv_id, turn, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CAST(1 + length(w) AS INTEGER)) AS t, role AS lang FROM conversations),\n", ""))
def q73_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with padding and mask over each role's stream; a word's token is its length plus one."""
    tokens = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w) + 1)
    c = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", tokens.alias("tokens"))
    out = quota.windows(c, "role", ["conv_id", "turn"], "tokens", 64)
    return out.select("role", "window", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"), F.size(F.filter("mask", lambda m: m > 0)).alias("unmasked"))


@query("""
SELECT f AS fraction, CAST(round_even(f * total, 0) AS BIGINT) AS synthetic, total - CAST(round_even(f * total, 0) AS BIGINT) AS natural
FROM (SELECT count(*) AS total FROM documents), (SELECT unnest([0.0, 0.001, 0.01, 0.05, 0.1])::DOUBLE AS f)
""")
def q74_fraction_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.fraction_grid(table(spark, sf_dir, "documents").count(), [0.0, 0.001, 0.01, 0.05, 0.1], spark)


@query("""
WITH c AS (SELECT source AS domain, CAST(sum(n_chars) AS BIGINT) AS capacity FROM documents GROUP BY source),
s AS (SELECT *, CAST(floor(123457.0::DOUBLE * capacity / sum(capacity) OVER ()) AS BIGINT) AS s, row_number() OVER (ORDER BY capacity DESC, domain) AS o FROM c)
SELECT domain, capacity, CAST(s + CASE WHEN o = 1 THEN 123457 - (SELECT sum(s) FROM s) ELSE 0 END AS BIGINT) AS reserved FROM s
""")
def q75_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("domain")).agg(F.sum("n_chars").cast("long").alias("capacity"))
    return quota.reserve(c, 123_457)


@query("""
WITH r AS (SELECT event_type AS role, count(*) AS windows, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0 END) AS below_rate FROM events GROUP BY event_type)
SELECT role, windows, round(below_rate, 9) AS below_rate, CASE WHEN windows < 20 THEN 'insufficient_source_windows' WHEN below_rate >= 0.1 THEN 'source_loss_template_collapse' END AS reason,
       CASE WHEN windows >= 20 AND below_rate < 0.1 THEN 'passed' ELSE 'degraded' END AS status FROM r
""")
def q76_low_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.low_loss(table(spark, sf_dir, "events"), "event_type", "value", 5.0, 0.1).withColumn("below_rate", F.round("below_rate", 9))


@query("""
SELECT event_type, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value) / sum(user_id), 9) AS loss, round(sum(value) / sum(event_id), 9) AS nats_per_byte, round(sum(value) / sum(event_id) / ln(2), 9) AS bits_per_byte FROM events GROUP BY event_type
""")
def q77_token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.token_loss(table(spark, sf_dir, "events"), "value", "user_id", "event_id", ["event_type"])
    return out.select("event_type", "tokens", *[F.round(c, 9).alias(c) for c in ("loss", "nats_per_byte", "bits_per_byte")])


CALLS = """(SELECT CASE WHEN l_returnflag = 'N' THEN 'execute' ELSE 'refuse' END AS kind, CASE WHEN l_linenumber <= 3 THEN 'call' WHEN l_linenumber <= 5 THEN 'refuse' ELSE 'broken' END AS variant,
    l_partkey % 7 AS name, l_suppkey % 3 AS args, l_orderkey % 7 AS gold_name, l_linenumber % 3 AS gold_args FROM lineitem)"""


@query(f"""
WITH e AS (SELECT * FROM {CALLS} t WHERE kind = 'execute'), r AS (SELECT * FROM {CALLS} t WHERE kind = 'refuse'),
x AS (SELECT count(*) AS n, count(*) FILTER (variant = 'call') AS c, count(*) FILTER (variant = 'call' AND name = gold_name) AS nm, count(*) FILTER (variant = 'call' AND name = gold_name AND args = gold_args) AS ar, count(*) FILTER (variant = 'refuse') AS rf, count(*) FILTER (variant = 'broken') AS b FROM e),
y AS (SELECT count(*) AS n, count(*) FILTER (variant = 'refuse') AS rf, count(*) FILTER (variant = 'call') AS c, count(*) FILTER (variant = 'broken') AS b FROM r)
SELECT x.n + y.n AS n, x.n AS execute_n, y.n AS refuse_n, round(x.c / x.n, 9) AS execute_detection_accuracy, round(x.nm / x.n, 9) AS execute_tool_name_exact, round(x.ar / x.n, 9) AS execute_arguments_exact,
       round(y.rf / y.n, 9) AS refusal_accuracy, round(x.rf / x.n, 9) AS false_refuse_rate, round(y.c / y.n, 9) AS false_execute_rate, round((x.b + y.b) / (x.n + y.n), 9) AS error_rate, round((x.c / x.n + y.rf / y.n) / 2, 9) AS balanced_accuracy FROM x, y
""")
def q78_full_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_returnflag = 'N' THEN 'execute' ELSE 'refuse' END AS kind", "CASE WHEN l_linenumber <= 3 THEN 'call' WHEN l_linenumber <= 5 THEN 'refuse' ELSE 'broken' END AS variant", "l_partkey % 7 AS name", "l_suppkey % 3 AS args", "l_orderkey % 7 AS gold_name", "l_linenumber % 3 AS gold_args")
    out = metrics.full_call(li)
    return out.select(*[c if c in ("n", "execute_n", "refuse_n") else F.round(c, 9).alias(c) for c in out.columns])


@query("""
WITH b AS (SELECT lang AS role, avg(n_chars) AS b FROM documents WHERE doc_id % 2 = 0 GROUP BY lang), a AS (SELECT lang AS role, avg(n_chars) AS a FROM documents WHERE doc_id % 2 = 1 GROUP BY lang),
j AS (SELECT role, 0.25 AS weight, b, a FROM b JOIN a USING (role)), m AS (SELECT sum(weight * b) AS b, sum(weight * a) AS a FROM j)
SELECT role AS "check", round(a / b - 1, 9) AS value, a <= b * 1.05 + 1e-9 AS passed FROM j UNION ALL SELECT 'quota_weighted_valid', round(a, 9), a <= b * 1.02 + 1e-9 FROM m UNION ALL SELECT 'measured_improvement', round(a - b, 9), a < b - 1e-9 FROM m
""")
def q79_recovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean lengths of even and odd ids stand in for losses before and after."""
    d = table(spark, sf_dir, "documents")
    half = lambda k: d.where(F.col("doc_id") % 2 == k).groupBy(F.col("lang").alias("role")).agg(F.avg("n_chars").alias("loss"))
    weights = half(0).select("role", F.lit(0.25).alias("weight"))
    return metrics.recovery_gate(half(0), half(1), weights, 0.05, 0.02).withColumn("value", F.round("value", 9))


@query("""
WITH s AS (SELECT round(value, 1) AS s, count(*) AS n, sum(CASE WHEN user_id % 3 <> 0 THEN 1 ELSE 0 END) AS wrong FROM events WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT sum(n) OVER w AS n, sum(wrong) OVER w AS wrong, sum(n) OVER () AS total FROM s WINDOW w AS (ORDER BY s DESC)),
l AS (SELECT level, min(n) AS n FROM r, (SELECT unnest(generate_series(1, 10)) AS level) WHERE n * 10 >= level * total GROUP BY level)
SELECT level / 10.0::DOUBLE AS coverage, CAST(l.n AS BIGINT) AS n, round(wrong / l.n, 9) AS risk FROM l JOIN r ON r.n = l.n
""")
def q80_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.round("value", 1).alias("s"), (F.col("user_id") % 3 == 0).alias("correct"))
    return metrics.risk_coverage(e, "correct", "s").withColumn("risk", F.round("risk", 9))


@query("""
WITH d AS (SELECT user_id AS id, round(value / 1000, 3) AS t, event_type = 'purchase' AND user_id % 2 = 0 AS is_gold FROM events),
h AS (SELECT id, bool_or(is_gold) AS has_gold FROM d GROUP BY id), x AS (SELECT d.*, h.has_gold FROM d JOIN h USING (id)),
c AS (SELECT DISTINCT t FROM x WHERE t BETWEEN 0 AND 1 UNION SELECT 0.0 UNION SELECT 1.0),
g AS (SELECT id, max(t) AS t FROM x WHERE is_gold GROUP BY id), o AS (SELECT id, max(t) AS t FROM x WHERE NOT has_gold GROUP BY id),
r AS (SELECT c.t, (SELECT count(*) FROM g WHERE g.t >= c.t) / (SELECT count(*) FROM g) AS recall, (SELECT count(*) FROM o WHERE o.t >= c.t) / nullif((SELECT count(*) FROM o), 0) AS false_selection FROM c)
SELECT t AS threshold, round(recall, 9) AS recall, round(false_selection, 9) AS false_selection FROM r WHERE (SELECT recall FROM r WHERE t = 0) - recall <= 0.5 AND false_selection <= 0.9 ORDER BY t DESC LIMIT 1
""")
def q81_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.round(F.col("value") / 1000, 3).alias("relevance"), ((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0)).alias("is_gold"))
    marked = e.join(e.groupBy("id").agg(F.bool_or("is_gold").alias("has_gold")), "id")
    return metrics.threshold(marked, 0.5, 0.9).select("threshold", F.round("recall", 9).alias("recall"), F.round("false_selection", 9).alias("false_selection"))


@query()
def q82_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and bias of the share of symbols as a score for bad quality; Newton's method is beyond SQL."""
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")) / F.greatest(F.lit(1), F.length("text"))
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", symbols.alias("score")), "doc_id").where("score is not null")
    scale, bias = metrics.platt(d.withColumn("bad", 1 - F.col("quality")), "bad", "score")
    return spark.createDataFrame([(round(scale, 6), round(bias, 6))], "scale double, bias double")


@query()
def q83_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over sources as artifacts; a test holds it against plain hashing."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.sha2(F.sum(F.xxhash64("text").cast("decimal(38,0)")).cast("string"), 256).alias("sha256"), F.sum("n_chars").cast("long").alias("bytes"))
    return audit.merkle_root(d)


@query("""
SELECT count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_tokens, count(DISTINCT source) AS n_sources,
       CAST(sum(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(sha256(text), 16, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM documents
""")
def q84_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.corpus_stats(table(spark, sf_dir, "documents"), F.col("text"), F.col("n_chars"), "source")


@query("""SELECT DISTINCT v AS value FROM (SELECT trim(unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)])) AS v FROM part) WHERE length(v) >= 2""")
def q85_leak_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.leak_strings(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"], 2)


@query("""
WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents) SELECT w AS value, count(*) AS n FROM w WHERE w <> '' GROUP BY w ORDER BY n DESC, value LIMIT 25
""")
def q86_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return audit.top_values(w, "w", 25)


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3 OR event_type = 'purchase' AS retained FROM events
""")
def q87_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("milestone", F.col("event_type") == "purchase")
    return audit.retained(e, 3, "user_id", "event_id", "milestone").select("event_id", "retained")


@query("""
SELECT 'documents' AS source_name, 0 AS source_order, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', 1, count(*) FROM benchmark UNION ALL SELECT 'conversations', 2, count(*) FROM conversations
""")
def q88_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: table(spark, sf_dir, n) for n in ("documents", "benchmark", "conversations")}
    return audit.union_sources(parts).groupBy("source_name", "source_order").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH k AS (SELECT DISTINCT source, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
SELECT a.source AS a, b.source AS b, count(*) AS shared FROM k a JOIN k b ON a.h = b.h AND a.source < b.source GROUP BY ALL
""")
def q89_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlap(table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h")), "source", "h")


@query("""
WITH l AS (SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part)
SELECT "column", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (trim(v) = '') AS n_blank, count(*) FILTER (regexp_matches(trim(v), '^[+-]?[0-9]+(\\.[0-9]+)?$')) AS n_numeric, count(DISTINCT v) AS n_distinct FROM l GROUP BY 1
""")
def q90_table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.table_inventory(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"])


@query("""
WITH n AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id)
SELECT n_turns, count(*) AS conversations, round(count(*) / (SELECT count(*) FROM n), 9) AS share FROM n GROUP BY n_turns
""")
def q91_turn_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.turn_histogram(table(spark, sf_dir, "conversations"), "conv_id").withColumn("share", F.round("share", 9))


@query("""
SELECT sha256(text) AS text_sha256, count(DISTINCT conv_id) AS conversations, count(*) AS turns FROM conversations WHERE length(text) >= 8 GROUP BY 1 HAVING count(DISTINCT conv_id) > 1
""")
def q92_shared_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.shared_turns(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("""
WITH f AS (SELECT doc_id, source, sha256('review:' || CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS o FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM f WHERE o = 1)
SELECT left(h, 16) AS review_id, doc_id, source FROM r WHERE r <= 7
""")
def q93_review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.review_packet(table(spark, sf_dir, "documents"), "source", "doc_id", "text", 7, "review")


@query("""
SELECT sha256(text) AS "key", array_to_string(list(DISTINCT doc_id ORDER BY doc_id), ',') AS ids, count(*) AS n, count(*) FILTER (source = 'src0') AS designed FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def q94_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("meant", F.col("source") == "src0")
    return dedup.copies(d, F.sha2("text", 256), "doc_id", "meant").select("key", F.array_join("ids", ",").alias("ids"), "n", "designed")


@query(f"""
WITH s AS (SELECT doc_id, regexp_replace(lower({NORM}), '[^\\p{{L}}]+', '', 'g') AS s FROM documents)
SELECT min(doc_id) AS doc_id FROM s GROUP BY s
""")
def q95_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each signature: lower-cased letters."""
    signature = F.regexp_replace(F.lower(tx.normalize_space(F.col("text"))), "[^\\p{L}]+", "")
    return dedup.by_signature(table(spark, sf_dir, "documents").select("doc_id", "text"), signature, "doc_id").select("doc_id")


@query("""
WITH v(i) AS (SELECT unnest(generate_series(0, 4))), p(j) AS (SELECT unnest(generate_series(0, 3))),
t AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS o, count(*) OVER () AS m FROM part),
r AS (SELECT t.id, CAST(k.k AS INTEGER) AS rank, o.id AS negative FROM t, (SELECT unnest(generate_series(1, 20)) AS k) k, t o WHERE o.o = (t.o - 1 + k.k) % t.m + 1),
n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
x AS (SELECT id, i, j, least(48, n - 1) AS w FROM n, v, p WHERE n >= 4),
y AS (SELECT *, CASE WHEN j = 0 THEN 1 ELSE 2 + (i * 11 + (j - 1) * CASE WHEN w % 7 <> 0 THEN 7 WHEN w % 5 <> 0 THEN 5 WHEN w % 3 <> 0 THEN 3 WHEN w % 2 <> 0 THEN 2 ELSE 1 END) % w END AS rank FROM x),
z AS (SELECT y.id, y.i, list(r.negative ORDER BY j) AS l FROM y JOIN r ON r.id = y.id AND r.rank = y.rank GROUP BY y.id, y.i)
SELECT id, CAST(i AS INTEGER) AS variant, array_to_string(list_concat(list_concat(l[1:i % 5], [id]), l[i % 5 + 1:4]), ',') AS listed FROM z
""")
def q96_rotated_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives rotate through each part's next twenty parts, and the part itself is put among them."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    ranked = retrieve.next_in_ring(t, 20)
    return retrieve.with_gold(retrieve.rotated(ranked, 5)).select("id", "variant", F.array_join("listed", ",").alias("listed"))


@query("""
WITH c AS (SELECT doc_id, lower(substr(lang, 1, 2)) AS l, length(regexp_replace(text, '[^\\x{3400}-\\x{9FFF}]+', '', 'g')) AS h, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN l IN ('zh', 'en') THEN l WHEN h + a = 0 THEN 'other' WHEN h >= 0.95 * (h + a) THEN 'zh' WHEN a >= 0.95 * (h + a) THEN 'en' ELSE 'mixed' END AS bucket FROM c
""")
def q97_language_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", tx.language_bucket(F.col("lang"), F.col("text")).alias("bucket"))
