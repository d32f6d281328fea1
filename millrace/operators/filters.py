"""Filters that say why a row goes: the first rule that it breaks, null for rows that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalize_space

# Markers of evaluation sets, padded identifiers, and what synthetic queries betray themselves by.
EVAL_MARKER = r"(?i)\bEVAL[-_][A-Z0-9_-]+\b"
IDENTIFIER_PADDING = r"(?i)编号[口号]?\s*[0-9]{5,}|\b[a-z][a-z0-9_-]*[-_][0-9]{6,}\b"
WRAPPER = r"(?i)^[{\[]|[\"']?query[\"']?\s*[:：]"
MECHANICAL = "请直接，请|请为当前对象，请|，，|。。|？？"


def first_rule(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; null conditions don't."""
    out = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out


def text_reason(text: Column) -> Column:
    """missing, empty (white space only) or nul."""
    return first_rule([("missing", text.isNull()), ("empty", normalize_space(text) == ""), ("nul", F.contains(text, F.lit("\0")))])


def named_rules(text: Column, rules: dict[str, str]) -> Column:
    """The first of the named patterns, in any case, that a text has somewhere."""
    return first_rule([(name, F.rlike(text, F.lit(f"(?i){pattern}"))) for name, pattern in rules.items()])


def rule_counts(df: DataFrame, reason: Column, *by: str) -> DataFrame:
    """(by, reason, n), with `kept` for rows without a reason."""
    return df.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def file_reason(path: Column, text: Column, licence: Column | None = None, *, extensions: list[str] | None = None, exclude_path: str | None = None, exclude_header: str | None = None, licences: list[str] | None = None, header: int = 2000) -> Column:
    """Why a source file goes: its extension, its path, generated code by its first `header` characters, its licence."""
    rules: list[tuple[str, Column]] = []
    if extensions:
        rules.append(("other_extension", ~F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)).isin(extensions)))
    if exclude_path:
        rules.append(("dependency_or_build_path", F.rlike(path, F.lit(f"(?i){exclude_path}"))))
    if exclude_header:
        rules.append(("explicit_generated_header", F.rlike(F.left(text, F.lit(header)), F.lit(f"(?i){exclude_header}"))))
    if licences is not None and licence is not None:
        rules.append(("license_not_selected", ~F.coalesce(licence.isin(licences), F.lit(False))))
    return first_rule(rules) if rules else F.lit(None).cast("string")


def query_reason(query: Column) -> Column:
    """Why a generated query goes, by its text alone: length, markers, wrappers, punctuation, a character four times in a row."""
    q = normalize_space(query)
    return first_rule(
        [
            ("query_too_short", F.length(q) < 4),
            ("query_too_long", F.length(q) > 160),
            ("eval_marker", F.rlike(q, F.lit(EVAL_MARKER))),
            ("serialized_wrapper_fragment", F.rlike(q, F.lit(WRAPPER))),
            ("mechanical_punctuation", F.rlike(q, F.lit(MECHANICAL))),
            ("repeated_character_filler", F.rlike(q, F.lit(r"(.)\1{3,}"))),
        ]
    )


def markers_found(text: Column, markers: list[str]) -> Column:
    """Those of the markers that a text holds in any case, in their order."""
    return F.filter(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(F.lower(text), m))


def revoked(df: DataFrame, revocations: DataFrame, key: str) -> DataFrame:
    """Adds revoked: whether a row's hash is among the revoked ones."""
    hashes = revocations.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("__revoked", F.lit(True))
    return df.join(hashes, key, "left").withColumn("revoked", F.coalesce("__revoked", F.lit(False))).drop("__revoked")
