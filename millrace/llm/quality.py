"""Quality rules by weak supervision.

Each rule looks at a document and votes good, bad or abstains. Expectation-maximisation over the counts of the
vote patterns estimates how often each rule casts each vote on good and on bad documents. The posterior
probability of good, not a conjunction of rules, decides. Everything that touches rows is a DataFrame function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import WS, without, words
from millrace.session import Scratch

GOOD, BAD, ABSTAIN = 1, 0, 2
#: What estimation starts from, and what the prior's pseudo-counts (a share of the documents) hold: a rule seldom
#: raises a false alarm, but a bad document sets off only some of the rules. Over (bad, good, abstain).
PRIOR_SHARE, PRIOR_GOOD = 0.05, 0.7
PRIOR_VOTES = ((0.25, 0.60, 0.15), (0.005, 0.85, 0.145))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_bangs")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that are found twice or more. `w` must be a plain column."""
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 3, grams).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """Of word positions that repeated windows cover. Sorting by hash brings equal windows together."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def hits(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    found = F.get(F.transform(F.array(ordered), hits), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(found)


def features(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds the FEATURES columns. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    step = without(docs, *FEATURES).select("*", words(F.col(text_col)).alias("__mr_w"), lines.alias("__mr_l"), count(r"#*$%&|<>").alias("n_symbols"), count(r"\p{Lu}").alias("n_upper"), count(r"\p{L}").alias("n_letters"), count("!").alias("n_bangs"), F.length(F.regexp_replace(text, f"{WS}+", "")).cast("long").alias("word_chars"))
    w, ls = F.col("__mr_w"), F.col("__mr_l")
    step = step.select("*", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), _repeat_words(w).alias("__mr_g")).drop("__mr_w", "__mr_l")
    return step.withColumn("n_repeat_words", _covered(F.col("__mr_g")).cast("long")).drop("__mr_g")


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains; null conditions don't hold."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), F.lit(BAD)).when(F.expr(self.good), F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


RULES = (
    Rule("symbols", "n_symbols > 0.03 * word_chars", "n_symbols < 0.005 * word_chars"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 8 * n_words", "word_chars between 4 * n_words and 7 * n_words"),
    Rule("capitals", "n_upper > 0.35 * n_letters", "n_upper < 0.15 * n_letters"),
    Rule("repeated_lines", "n_dup_lines > 0.25 * n_lines", "n_lines >= 3 and n_dup_lines <= 0.05 * n_lines"),
    Rule("repeated_windows", "n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    # Vocabulary grows with a power of length (Heaps), so its measure holds for texts of any length.
    Rule("vocabulary", "n_distinct < 0.8 * power(n_words, 0.7)", "n_distinct > 1.5 * power(n_words, 0.7)"),
    Rule("letters", "n_letters < 0.6 * word_chars", "n_letters > 0.9 * word_chars"),
    Rule("exclamation", "n_bangs > 0.1 * n_words", "n_bangs < 0.02 * n_words"),
)


@dataclass(frozen=True)
class Model:
    """P(good) and, for each rule, P(vote | bad) and P(vote | good), each over (bad, good, abstain)."""

    good: float
    votes: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]

    def log_odds(self, columns: list[Column]) -> Column:
        out = F.lit(math.log(self.good / (1 - self.good)))
        for c, (bad, good) in zip(columns, self.votes, strict=True):
            weights = [math.log(good[v] / bad[v]) for v in (BAD, GOOD, ABSTAIN)]
            out = out + F.when(c == BAD, weights[BAD]).when(c == GOOD, weights[GOOD]).otherwise(weights[ABSTAIN])
        return out


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over (votes, rows). The prior's counts stand for PRIOR_SHARE of the rows."""
    total = sum(n for _, n in patterns)
    prior = max(1.0, PRIOR_SHARE * total)
    by_class = PRIOR_VOTES
    model = Model(PRIOR_GOOD, tuple(by_class for _ in range(n_rules)))
    for _ in range(rounds):
        mass = [prior * (1 - PRIOR_GOOD), prior * PRIOR_GOOD]
        sums = [[[p * mass[y] for p in by_class[y]] for y in (0, 1)] for _ in range(n_rules)]
        weight = list(mass)
        for votes, n in patterns:
            odds = math.log(model.good / (1 - model.good)) + sum(math.log(model.votes[j][1][v] / model.votes[j][0][v]) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for y, share in ((0, 1 - p), (1, p)):
                weight[y] += n * share
                for j, v in enumerate(votes):
                    sums[j][y][v] += n * share
        # By class, the votes and so the denominators are the same for every rule.
        new = Model(weight[1] / (weight[0] + weight[1]), tuple(tuple(tuple(x / weight[y] for x in sums[j][y]) for y in (0, 1)) for j in range(n_rules)))
        moved = max([abs(new.good - model.good), *(abs(a - b) for r, s in zip(new.votes, model.votes, strict=True) for x, y in zip(r, s, strict=True) for a, b in zip(x, y, strict=True))])
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, carry_text: bool = True) -> DataFrame:
    """Adds the FEATURES columns, base_failed, p_good (posterior probability of good) and kept.

    base_failed: fewer than `min_words` words, or 100 * n_repeat_words > max_repeat_percent * n_words. Those
    documents take no part in fitting and are not kept; of the others, those with p_good >= threshold are. The
    counts of vote patterns, at most 3 ** rules, are all that reaches the driver. The measured rows are written
    to the shared folder once, as both fitting and judging read them; carry_text=False leaves the text out. Null and blank texts have no
    words and so fail; repeated rows each count and are judged alike; an empty table gives an empty result.
    Input columns named as output columns are replaced.
    """
    names = ("base_failed", "p_good", "kept")
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words"))
    measured = features(without(docs, *names), text_col=text_col).withColumn("base_failed", failed)
    votes = [f"__mr_v{j}" for j in range(len(rules))]
    voted = measured.select("*", *[r.vote().alias(v) for r, v in zip(rules, votes, strict=True)])
    voted = Scratch(docs.sparkSession, "quality").cut(voted if carry_text else voted.drop(text_col), "measured")
    got = voted.where(~F.col("base_failed")).groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    model = fit([(tuple(r[v] for v in votes), r["n"]) for r in got], len(rules))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.log_odds([F.col(v) for v in votes])))
    return voted.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*votes)
