"""Quality rules with verdicts on whole hosts (operator 10), in DataFrame functions only.

Each text is measured once. A document fails a rule by its own figures; failures are then counted per host, every
host's rate is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts themselves, and hosts
whose shrunken rate is too high are rejected with all their documents.

Defined results: a null text counts as empty (no words, fails). A null host is a host of its own. Repeated rows are
measured and counted each. An empty table gives an empty result. Texts of any length are read whole. Input columns are
only read by the names given, so further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import WHITE, cut, release, text_or_empty
from cohortloom.operators.member_filter import split_members

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of :data:`MEASURES` in a struct ``m`` after it.

    ``n_repeat_words`` counts the words inside 8-word windows that the text holds twice or more.
    """
    # Each step uses the previous one's arrays several times, which keeps them computed once per row.
    df = df.withColumn("m_t", text_or_empty(text))
    df = df.withColumn("m_w", F.filter(F.split("m_t", WHITE), lambda x: x != ""))
    df = df.withColumn("m_lines", F.filter(F.split("m_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("m_h", F.transform("m_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("m_win", F.when(
        F.size("m_h") >= WINDOW,
        F.transform(F.slice("m_h", F.lit(1), F.size("m_h") - (WINDOW - 1)),
                    lambda x, i: F.xxhash64(x, *[F.get("m_h", i + k) for k in range(1, WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a window that repeats are sorted, to find the places of such windows.
    df = df.withColumn("m_sorted", F.when(
        F.size(F.array_distinct("m_win")) < F.size("m_win"),
        F.sort_array(F.transform("m_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn("m_at", F.sort_array(F.transform(
        F.filter("m_sorted", lambda x, k: (F.get("m_sorted", k - 1)["h"] == x["h"]).eqNullSafe(True)
                 | (F.get("m_sorted", k + 1)["h"] == x["h"]).eqNullSafe(True)), lambda x: x["i"])))
    repeat = F.aggregate(
        F.transform("m_at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("m_at", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    symbols = F.length("m_t") - F.length(F.translate("m_t", "#*$%&|<>", ""))
    # A generated column: a filter on it is not moved below the arrays, where it would compute them per element.
    return df.withColumn("m", F.explode_outer(F.array(F.struct(
        F.size("m_w").cast("long").alias("n_words"),
        F.length(F.array_join("m_w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("m_lines") - F.size(F.array_distinct("m_lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
    )))).drop("m_t", "m_w", "m_lines", "m_h", "m_win", "m_sorted", "m_at")


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * F.col(f"{m}.n_words"))


def rule_failed(m: str = "m") -> Column:
    """The rules whose failures speak against a host: the base rules, many symbols, odd word lengths."""
    words = F.col(f"{m}.n_words")
    return (base_failed(m) | (10 * F.col(f"{m}.n_symbols") > words)
            | (F.col(f"{m}.word_chars") < 2 * words) | (F.col(f"{m}.word_chars") > 20 * words))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """Per host: documents, failures and the shrunken failure rate.

    The prior's mean and strength come from the mean and variance of the rates of all hosts (method of moments). The
    strength is at least one document; hosts that all have the same rate take the largest strength.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rule_failed().cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"))
    strength = F.when(F.col("var") > 0, F.greatest(F.lit(1.0), F.least(
        F.lit(1e6), F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1))).otherwise(F.lit(1e6))
    prior = prior.select("mean", strength.alias("k"))
    # The prior is one row.
    return hosts.join(F.broadcast(prior)).select(
        "host", "n", "n_failed", ((F.col("n_failed") + F.col("mean") * F.col("k")) / (F.col("n") + F.col("k"))).alias("rate"))


def judged(df: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """``df`` without its text, with struct ``m``, ``base_failed``, ``host_rejected`` and ``kept``.

    The measures are written once to the shared folder (a few numbers per document); texts are not shuffled.
    """
    others = [c for c in df.columns if c != text]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("t"), F.col(f"`{host}`").alias("host"))
    measured = cut(measure(rows, "t").select("row", "m", "host"))
    rejected = host_rates(measured, "host").where(F.col("rate") > max_rate).select(
        F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    out = measured.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    failed, bad = base_failed(), F.coalesce("bad", F.lit(False))
    return out.select("row", "m", failed.alias("base_failed"), bad.alias("host_rejected"), (~failed & ~bad).alias("kept"))


def keep_good(df: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns, whose own figures and whose host pass.

    A document's own verdict needs nothing but its row. Rows of hosts that a bit table of the rejected ones does not
    know stay where they lie, however many a host has; only the others meet the list by a join.
    """
    measured = cut(measure(df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{host}`").alias("host")), "t").select("host", "m"))
    rejected = cut(host_rates(measured, "host").where(F.col("rate") > max_rate).select(F.col("host").alias("bad_host"), F.xxhash64("host").alias("h")))
    release(measured)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("t"),
                     F.col(f"`{host}`").alias("host"), F.xxhash64(F.col(f"`{host}`")).alias("h"))
    doubtful, others = split_members(rows, rejected, "h", bits=16)
    doubtful = measure(doubtful, "t").where(~base_failed()).join(rejected.select("bad_host"), F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    kept = measure(others, "t").where(~base_failed()).select("row").union(doubtful.select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
