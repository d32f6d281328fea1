"""Personal data by fixed patterns and bootstrapped contexts.

Base matches of four kinds (email, ip, card, phone) are seeds. The two words before a match are its lexical
pattern. Other words with digits or an at sign, and runs of numbers, are candidates of the kind that they look like. Patterns and the values found in
them form a graph: a pattern is as sure as the values in it are known, a value as sure as the patterns around it.
Scores go back and forth over the graph; candidates in patterns that end up sure enough are added. All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import without
from millrace.session import Scratch

# Kinds in their order, and the base patterns. They match what
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+                                  \+[0-9][\x20().0-9-]+[0-9]
# match, but start only where a run of characters starts or the last match ended (\G), and don't backtrack into
# groups, so that they are linear in long runs and need no stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold for a pattern to be tried at all.
NEEDS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]")
WORD = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?(?:[0-9@]|\(at\)|\[at\]))[^\x20\x09-\x0D]++"
#: Numbers of a run are separated by single blanks. The group is possessive, which needs no stack.
RUN = r"(?<![^\x20\x09-\x0D])[+(]?[0-9][0-9()._/-]*+(?:\x20[(]?[0-9][0-9()._/-]*+)++"
#: What a candidate must look like: of mixed or obscured forms that the base patterns miss.
LOOKS = (
    r"^[A-Za-z0-9._%+-]++(?:\(at\)|\[at\]|@)[A-Za-z0-9.-]+$",
    r"^(?:[0-9]{1,3}[.,:_-]){3}[0-9]{1,3}$|^(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}$",
    r"^[0-9](?:[\x20._/-]?[0-9]){13,18}$",
    r"^\+?\(?[0-9](?:[\x20()._/-]{0,3}[0-9]){9,14}$",
)
SPAN = "array<struct<s:int,k:int,e:int,m:string,l:string>>"
#: Code points before a match that its context, the last two words, is read from: a feature of fixed size, as words may
#: be glued to each other without end. And matches in one step of a sum.
BEFORE, STEP = 256, 256


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that don't overlap: start, kind, end, the match, and the BEFORE code points before it.

    The pieces between matches and the matches together are the text, so lengths add up to positions. Sums run in
    steps, each from its own offset, as arrays that grow are copied; a step's width and its end are computed once.
    """
    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def positions(z: Column) -> Column:
        n = F.size(z["m"])
        piece = lambda i: F.concat(F.get(z["p"], i), F.get(z["m"], i))
        within = lambda c: F.sequence(c * STEP, F.least(n, c * STEP + STEP) - 1)
        steps = F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int"))
        one = lambda c: _let(F.array_join(F.transform(within(c), piece), ""), lambda t: F.struct(F.length(t).alias("width"), _end(t).alias("tail")))

        def ahead(a: Column, s: Column) -> Column:
            now = F.struct((a["at"] + s["width"]).alias("at"), _end(F.concat(a["tail"], s["tail"])).alias("tail"))
            return F.struct(now["at"].alias("at"), now["tail"].alias("tail"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), a["tail"].alias("tail")))).alias("out"))

        none = F.array().cast("array<struct<at:int,tail:string>>")
        origin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))
        # Where each step starts; with one step, that is the origin.
        origins = F.when(n > STEP, F.aggregate(F.transform(steps, one), origin, ahead, lambda a: a["out"])).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))))

        def step(c: Column, first: Column) -> Column:
            def add(a: Column, i: Column) -> Column:
                left = _end(F.concat(a["tail"], F.get(z["p"], i)))
                s = a["at"] + F.length(F.get(z["p"], i))
                e = s + F.length(F.get(z["m"], i))
                found = lambda x: F.struct(e.alias("at"), _end(F.concat(x, F.get(z["m"], i))).alias("tail"), F.concat(a["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), F.get(z["m"], i).alias("m"), x.alias("l")))).alias("out"))
                return _let(left, found)

            start = F.struct(first["at"].alias("at"), first["tail"].alias("tail"), F.array().cast(SPAN).alias("out"))
            return F.aggregate(within(c), start, add, lambda a: a["out"])

        stepped = _let(origins, lambda o: F.flatten(F.transform(steps, lambda c: step(c, F.get(o, c)))))
        return F.when(n > 0, stepped).otherwise(F.array().cast(SPAN))

    return _let(both, positions)


def _end(text: Column) -> Column:
    return F.right(text, F.lit(BEFORE))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        return F.rlike(m, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"))
    if kind == 2:
        return _let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == 3:
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _base(text: Column, kind: int) -> Column:
    found = F.filter(_found(text, PATTERNS[kind], kind), lambda x: _valid(kind, x["m"]))
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(SPAN))


def _candidates(text: Column, base: Column) -> Column:
    """Words and runs of numbers that look like one of the kinds and touch no base match, less what encloses them.

    A run that touches a word which is a candidate by itself is none.
    """
    touches = lambda x, spans: F.exists(spans, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))

    def bare(x: Column) -> Column:
        lead = F.regexp_replace(x["m"], r"^[^A-Za-z0-9+(]+", "")
        core = F.regexp_replace(lead, r"(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
        s = x["s"] + F.length(x["m"]) - F.length(lead)
        look = F.lit(-1)
        for k in reversed(range(len(LOOKS))):
            look = F.when(F.rlike(core, F.lit(LOOKS[k])), F.lit(k)).otherwise(look)
        return F.struct(s.alias("s"), look.alias("k"), (s + F.length(core)).alias("e"), core.alias("m"), _end(F.concat(x["l"], F.left(x["m"], s - x["s"]))).alias("l"))

    def free(pattern: str, needs: str) -> Column:
        found = F.filter(F.transform(_found(text, pattern, -1), bare), lambda x: (x["k"] >= 0) & ~touches(x, base))
        return F.when(F.rlike(text, F.lit(needs)), found).otherwise(F.array().cast(SPAN))

    words, runs = free(WORD, r"[0-9@]|\(at\)|\[at\]"), free(RUN, r"[0-9)._/-]\x20[(]?[0-9]")
    return _let(words, lambda w: F.concat(w, F.filter(runs, lambda x: ~touches(x, w))))


def _context(before: Column) -> Column:
    """The last two words, without digits and lower-cased; fewer at the start of a text. Whether a match is among them is all the same."""
    words = F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]+", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), F.lit(2)), " ")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def discovered(found: DataFrame, scratch: Scratch, *, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """(rid, extra): the candidates to add for each row of found (rid, base, candidates).

    The graph has an edge for each (pattern of a kind, value) with the number of times it occurs. A seed's score
    is 1. A pattern's score is the mean score of its values, weighted by occurrences, and 0 with fewer than
    `least_seeds` different seeds; a value's is the chance that one of its patterns is right.
    """
    each = lambda c, seed: found.select("rid", F.explode(c).alias("x"), F.lit(seed).alias("seed"))
    occurrences = each("base", True).unionByName(each("candidates", False)).select("rid", "seed", "x.s", "x.k", "x.e", F.col("x.m").alias("value"), _context(F.col("x.l")).alias("pattern"))
    occurrences = scratch.cut(occurrences.where("pattern <> ''"), "occurrences")
    edges = scratch.cut(occurrences.groupBy("k", "pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "edges")
    values = edges.groupBy("k", "value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for turn in range(rounds):
        scored = edges.join(values, ["k", "value"])
        seeds = F.sum(F.col("seed").cast("int"))
        patterns = scored.groupBy("k", "pattern").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean"), seeds.alias("seeds"))
        patterns = scratch.cut(patterns.where(F.col("seeds") >= least_seeds).select("k", "pattern", F.col("mean").alias("sure")), f"patterns-{turn}")
        if turn + 1 < rounds:
            doubt = F.log(F.lit(1.0) - F.least(F.coalesce("sure", F.lit(0.0)), F.lit(0.999)))
            values = edges.join(patterns, ["k", "pattern"], "left").groupBy("k", "value").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.sum(doubt))).alias("score"))
            values = scratch.cut(values, f"values-{turn}")
    sure = patterns.where(F.col("sure") >= confidence).select("k", "pattern")
    extra = occurrences.where(~F.col("seed")).join(sure, ["k", "pattern"])
    return extra.groupBy("rid").agg(F.collect_set(F.struct("s", "k", "e")).alias("extra"))


def detect(docs: DataFrame, *, text_col: str = "text", carry_text: bool = True, confidence: float = 0.8) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base matches), base_spans, all_spans (arrays of start, kind number, end).

    Positions are code points, ends exclusive; spans are sorted by start, then kind. A null text counts as empty.
    Repeated rows are treated alike, and count as often as they come as evidence; an empty table gives an empty
    result. Input columns with the names of output columns are replaced. Rows are written to the shared folder
    once, as the graph and the result both need them; carry_text=False leaves the text out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    outs = ("base_spans", "all_spans", *(f"n_{k}" for k in KINDS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = without(docs, *outs).withColumn("__mr_text", text)
    read = read.select("*", *[_base(F.col("__mr_text"), k).alias(f"__mr_{k}") for k in range(len(KINDS))])
    read = read.withColumn("__mr_base", F.sort_array(F.concat(*[F.col(f"__mr_{k}") for k in range(len(KINDS))])))
    read = read.withColumn("__mr_candidates", _candidates(F.col("__mr_text"), F.col("__mr_base")))
    read = read.drop("__mr_text", *[f"__mr_{k}" for k in range(len(KINDS))]).withColumn("__mr_rid", F.monotonically_increasing_id())
    read = scratch.cut(read if carry_text else read.drop(text_col), "found")

    found = read.select(F.col("__mr_rid").alias("rid"), F.col("__mr_base").alias("base"), F.col("__mr_candidates").alias("candidates"))
    extra = discovered(found.where("size(base) + size(candidates) > 0"), scratch, confidence=confidence)
    extra = scratch.cut(extra.withColumnRenamed("rid", "__mr_rid").withColumnRenamed("extra", "__mr_extra"), "extra")
    plain = F.transform("__mr_base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    joined = read.join(extra, "__mr_rid", "left").withColumn("base_spans", plain)
    nothing = F.array().cast("array<struct<s:int,k:int,e:int>>")
    joined = joined.withColumn("all_spans", F.sort_array(F.concat("base_spans", F.coalesce("__mr_extra", nothing))))
    of_kind = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == F.lit(k))).cast("long")
    counts = {f"n_{name}": of_kind(k) for k, name in enumerate(KINDS)}
    return joined.withColumns(counts).drop("__mr_rid", "__mr_base", "__mr_candidates", "__mr_extra")


def redact(docs: DataFrame, *, text_col: str = "text", confidence: float = 0.8) -> DataFrame:
    """`docs` with every found span replaced by its kind in angle brackets; overlapping spans become one."""
    found = detect(docs, text_col=text_col, confidence=confidence)

    def add(a: Column, x: Column) -> Column:
        mark = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)), F.lit(">"))
        piece = F.concat(F.substring(F.col(text_col), a["at"] + 1, x["s"] - a["at"]), mark)
        return F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("all_spans", start, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text_col), a["at"] + 1, F.lit(1 << 30))))
    text = F.when(F.size("all_spans") > 0, whole).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
