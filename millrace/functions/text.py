"""Text columns. Regular expressions name their character classes, as \\s and \\w differ between engines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The separators that Python's str.split() knows.
UNICODE_SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
HAN = "\\u3400-\\u9FFF"
#: The narrower range of lexical tokens.
HAN_TOKENS = "\\u4E00-\\u9FFF"


def normalize_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[{UNICODE_SPACE}]+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding; lower() keeps characters such as sharp s."""
    return text.str.casefold()


def clean_turn(text: Column) -> Column:
    """A dialogue turn: NFKC, no blanks beside Han characters, before punctuation or between digits."""
    t = F.regexp_replace(nfkc(text), f"(?<=[{HAN}])[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?=[{HAN}])", "")
    t = F.regexp_replace(t, f"[{UNICODE_SPACE}]+(?=[,.!?;:\\u3002\\uFF0C\\uFF01\\uFF1F\\uFF1B\\uFF1A\\u3001])", "")
    return normalize_space(F.regexp_replace(t, f"(?U)(?<=\\d)[{UNICODE_SPACE}]+(?=\\d)", ""))


def compact(text: Column, fold: bool = True) -> Column:
    """Letters and digits only, lower-cased; with NFKC unless `fold` is false."""
    t = nfkc(text) if fold else text
    return F.lower(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", ""))


def fingerprint(text: Column, fold: bool = True) -> Column:
    """The first 16 bytes of the SHA-256 of the compacted text, in hex."""
    return F.substring(F.sha2(compact(text, fold), 256), 1, 32)


#: What becomes a placeholder, in order. Word boundaries and digits are those of Unicode.
TEMPLATE_MARKS = (
    (r"https?://\S+", "<url>"),
    (r"\b[0-9a-f]{16,}\b", "<hash>"),
    (r"\b\d+(?:\.\d+)?\b", "<num>"),
    (r"[_-]?\b[a-z]*\d+[a-z0-9_-]*\b", "<id>"),
)


def template_signature(text: Column) -> Column:
    """What a text is a template of: links, long hex strings, numbers and ids become placeholders, in that order."""
    t = F.lower(text)
    for pattern, mark in TEMPLATE_MARKS:
        t = F.regexp_replace(t, f"(?U){pattern}", mark)
    return normalize_space(t)


def query_signature(text: Column) -> Column:
    """NFKC, case-folded, numbers as <n>, without punctuation."""
    t = F.regexp_replace(casefold(nfkc(text)), "[0-9]+(?:\\.[0-9]+)?", "<n>")
    return F.regexp_replace(t, "[^\\p{L}\\p{N}<>]+", "")


def visible_signature(text: Column, protected: Column) -> Column:
    """Protected values, longest first, as <slot>; then uuids, hex strings and numbers; then no punctuation."""
    by_length = F.array_sort(protected, lambda a, b: F.length(b) - F.length(a))
    t = F.aggregate(by_length, casefold(text), lambda acc, p: F.replace(acc, F.lower(p), F.lit("<slot>")))
    t = F.regexp_replace(t, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    t = F.regexp_replace(t, "[0-9a-f]{16,}", "<hex>")
    t = F.regexp_replace(t, "[0-9]+(?:\\.[0-9]+)?", "<number>")
    return normalize_space(F.regexp_replace(t, "[^\\p{L}\\p{N}<> ]+", " "))


def han_ratio(text: Column) -> Column:
    """The share of Han characters among those that are no white space; null without any."""
    solid = F.length(F.regexp_replace(text, f"[{UNICODE_SPACE}]+", ""))
    return F.length(F.regexp_replace(text, f"[^{HAN}]+", "")) / F.nullif(solid, F.lit(0))


def script(text: Column, simplified: str, traditional: str) -> Column:
    """en, simplified, traditional or mixed: one of two sets of characters needs 95 % of those in either."""
    count = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    s, t = count(simplified), count(traditional)
    return (
        F.when(F.length(F.regexp_replace(text, f"[^{HAN}]+", "")) == 0, "en")
        .when(s >= F.lit(0.95) * (s + t), "simplified")
        .when(t >= F.lit(0.95) * (s + t), "traditional")
        .otherwise("mixed")
    )


def all_grams(text: Column, n: int) -> Column:
    """The n-grams of code points at every place, in order; none if the text is shorter, or null.

    By way of an array of characters, as finding the i-th code point of a string takes i steps.
    """
    chars = F.split(text, "")
    return F.get(
        F.transform(F.array(chars), lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))),
        F.lit(0),
    )


def char_grams(text: Column, n: int, short: str = "whole") -> Column:
    """Distinct character n-grams. Shorter texts: "whole" gives the text itself, "none" nothing."""
    grams = F.array_distinct(all_grams(text, n))
    if short == "none":
        return grams
    return F.when((F.length(text) > 0) & (F.length(text) < n), F.array(text)).otherwise(grams)


def token_set(text: Column) -> Column:
    """Distinct Han characters and runs of ASCII letters, digits and underscores, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[{HAN_TOKENS}]|[a-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays of distinct values; two empty ones have `empty`."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(empty)).otherwise(both / union)


def length_bin(n: Column) -> Column:
    out = F.lit("gt_32768")
    for edge in (32768, 8192, 2048, 512, 128):
        out = F.when(n <= edge, F.lit(f"le_{edge}")).otherwise(out)
    return out


def head_tail(text: Column, limit: int) -> Column:
    """A text cut to `limit` code points: two thirds from the start, the rest from the end."""
    head = (limit - 1) * 2 // 3
    tail = limit - 1 - head
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(tail))))


def snippets(text: Column, size: int) -> Column:
    """Head, middle and tail, with where they start."""
    n = F.length(text)
    at = F.array(F.lit(0), F.greatest(F.lit(0), F.floor((n - size) / 2).cast("int")), F.greatest(F.lit(0), n - size))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("text")))


def excerpt(text: Column, key: Column, size: int) -> Column:
    """`size` code points from an offset that a hash of the key picks."""
    room = F.greatest(F.lit(1), F.length(text) - size + 1)
    return F.substring(text, F.pmod(hex_bucket(F.sha2(key, 256), 15), room).cast("int") + 1, F.lit(size))


def first_text(*columns: Column) -> Column:
    """The first of the columns that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def between_markers(text: Column, start: str, end: str) -> Column:
    """What stands between two marker patterns, across lines; null if either is missing or nothing is."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?ms){start}(.*?){end}", 1)), F.lit(""))


def hex_bucket(hexes: Column, digits: int) -> Column:
    """The first hex digits, up to 15, as a long."""
    if not 0 < digits <= 15:
        raise ValueError("1 to 15 digits fit a long")
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long")


def stable_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def compact_query_hash(text: Column) -> Column:
    """SHA-256 without white space and case."""
    return F.sha2(F.lower(F.regexp_replace(text, f"[{UNICODE_SPACE}]+", "")), 256)


def without_marks(text: Column) -> Column:
    """NFKC without superscripts, control tokens such as <|x|> and end marks such as <eoh>."""
    return normalize_space(F.regexp_replace(nfkc(text), r"(?s)<sup>.*?</sup>|<\|[^>]+\|>|<eo[hmtrc]>", ""))


def plain_words(text: Column) -> Column:
    """Lower-cased, with hex strings, numbers and punctuation as blanks."""
    t = F.regexp_replace(F.lower(text), r"[0-9a-f]{16,}|[0-9]+(?:\.[0-9]+)?", " ")
    return normalize_space(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def language_bucket(declared: Column, text: Column) -> Column:
    """The declared language if it is zh or en, else zh, en or mixed by which of Han and Latin characters has 95 %; other without any."""
    count = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    han, latin = count(HAN), count("A-Za-z")
    low = F.lower(F.substring(declared, 1, 2))
    return (
        F.when(low.isin("zh", "en"), low)
        .when(han + latin == 0, "other")
        .when(han >= F.lit(0.95) * (han + latin), "zh")
        .when(latin >= F.lit(0.95) * (han + latin), "en")
        .otherwise("mixed")
    )


#: Type names of other notations and their JSON Schema names.
TYPE_ALIASES = {
    "dict": "object", "map": "object", "str": "string", "text": "string", "int": "integer", "long": "integer",
    "float": "number", "double": "number", "bool": "boolean", "list": "array", "tuple": "array", "none": "null",
}


def schema_type(name: Column) -> Column:
    """The JSON Schema name of a type, from its own or another notation; null for unknown ones."""
    low = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for kv in (TYPE_ALIASES | {v: v for v in TYPE_ALIASES.values()}).items() for x in kv])
    return known[low]


def compact_title(title: Column) -> Column:
    """A work's title without chapter and volume ranges, Chinese or English, case, blanks and punctuation."""
    t = F.regexp_replace(F.lower(title), r"\u7B2C?[0-9\u4E00\u4E8C\u4E09\u56DB\u4E94\u516D\u4E03\u516B\u4E5D\u5341\u767E\u5343]+[-~\u81F3\u5230]?[0-9\u4E00\u4E8C\u4E09\u56DB\u4E94\u516D\u4E03\u516B\u4E5D\u5341\u767E\u5343]*[\u7AE0\u56DE\u5377\u8282\u96C6\u90E8]", "")
    t = F.regexp_replace(t, r"\b(?:chapters?|volumes?|vols?\.?|books?|parts?)\s*[0-9ivxlc]+(?:\s*(?:-|to)\s*[0-9ivxlc]+)?\b", "")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")
