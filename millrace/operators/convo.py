"""Conversations: flattening, replies, prefix histories, quality reasons and views."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.text import HAN


def flatten(turns: DataFrame, separator: str = "\n") -> DataFrame:
    """(conv_id, n_turns, text): each conversation's turns in order, joined. A conversation is one row."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), separator).alias("text"))


def next_reply(turns: DataFrame, asks: str, answers: str) -> DataFrame:
    """Turns of role `asks`, with the turn and text of the next turn of role `answers` in the conversation."""
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    reply = F.first(F.when(F.col("role") == answers, F.struct("turn", "text")), ignorenulls=True).over(after)
    return turns.withColumn("__r", reply).where(F.col("role") == asks).select("conv_id", "turn", "text", F.col("__r.turn").alias("reply_turn"), F.col("__r.text").alias("reply"))


def prefix_history(turns: DataFrame, role: str) -> DataFrame:
    """Each turn of a role, with the number and the joined text of the turns before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    staged = turns.withColumn("__h", F.collect_list(F.coalesce("text", F.lit(""))).over(before))
    return staged.where(F.col("role") == role).select("conv_id", "turn", F.size("__h").alias("n_before"), F.array_join("__h", "\n").alias("history"))


def last_query(turns: DataFrame, role: str = "user") -> DataFrame:
    """(conv_id, query, n_history): the last turn of a role, and how many turns came before it."""
    mine = turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("at"), F.max_by("text", "turn").alias("query"))
    return turns.join(mine, "conv_id").groupBy("conv_id", "query").agg(F.count_if(F.col("turn") < F.col("at")).alias("n_history"))


#: What marks a dialogue as holding contacts, links or control tokens, in any case.
CONTACT = r"https?://|www\.|<\||EVAL[-_]|(?:\u5FAE\u4FE1|QQ|\u52A0\u7FA4|\u4EE3\u8D2D|\u8FD4\u5229|\u5237\u5355).{0,8}\d|1[3-9]\d{9}|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"


@F.pandas_udf(T.BooleanType())
def _turn_twice(turns: pd.Series) -> pd.Series:
    """Whether two turns are the same but for compatibility forms, case and what is no letter or digit; NFKC has no built-in."""
    plain = lambda t: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t or "")).lower()
    return turns.map(lambda ts: len({plain(t) for t in ts}) < len(ts), na_action="ignore")


def quality_reason(turns: Column, repeats: bool = True) -> Column:
    """The first rule that a dialogue (array of turns) breaks, or null.

    2 to 16 turns; 2 to 600 characters each; 65 % of all characters Han; no contact, link or marker; no character six
    times in a row (unless `repeats` is false); no turn twice by its fingerprint.
    """
    whole = F.array_join(turns, "\n")
    han = F.length(F.regexp_replace(whole, f"[^{HAN}]+", ""))
    out = (
        F.when(~F.size(turns).between(2, 16), "turn_count")
        .when(F.exists(turns, lambda t: ~F.length(t).between(2, 600)), "turn_length")
        .when(han < F.lit(0.65) * F.greatest(F.lit(1), F.length(whole)), "low_chinese_fraction")
        .when(F.rlike(whole, F.lit(f"(?iU){CONTACT}")), "contact_url_or_marker")
    )
    if repeats:
        out = out.when(F.rlike(whole, F.lit("(.)\\1{5,}")), "repetition")
    return out.when(_turn_twice(turns), "repeated_turn")


def call_names(turns: DataFrame, pattern: str) -> DataFrame:
    """(conv_id, names): sorted different names that a pattern's first group finds in a conversation."""
    found = turns.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return found.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their call: by id, else the only call that is still open before them.

    calls (conv_id, turn, call_id), results (conv_id, turn, call_id or null).
    """
    by_id = results.where("call_id is not null").join(calls.select("conv_id", "call_id", F.col("turn").alias("call_turn")), ["conv_id", "call_id"], "left")
    loose = results.where("call_id is null").select("conv_id", "turn")
    taken = by_id.where("call_turn is not null").select("conv_id", "call_id", F.col("turn").alias("closed"))
    pending = calls.join(taken, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("turn").alias("call_turn"), "closed")
    open_calls = loose.join(pending, "conv_id").where("call_turn < turn and (closed is null or closed > turn)")
    single = open_calls.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("call_id", "call_turn")).alias("one"))
    inferred = loose.join(single.where("n = 1"), ["conv_id", "turn"], "left").select("conv_id", F.col("one.call_id").alias("call_id"), "turn", F.col("one.call_turn").alias("call_turn"))
    return by_id.select("conv_id", "call_id", "turn", "call_turn").unionByName(inferred)


def illegal_transitions(states: DataFrame, allowed: list[tuple[str, str]], key: str, order: str, state: str) -> DataFrame:
    """Rows whose state may not follow the state before them."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    step = states.withColumn("before", before)
    return step.where(F.col("before").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "before", state)))
