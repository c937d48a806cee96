"""Quality rules per document and per host, in DataFrame functions only.

Each document gets the counts of the rules in one pass over its text (arrays
within the row, no explode, no shuffle of words).  Rule failures are then summed
by host, each host's failure rate is shrunk toward the corpus rate with a beta
prior fitted to all hosts (method of moments), and the verdict of a host is
joined back to its documents.

Defined cases: NULL or blank text has no words and fails ``min_words``; a NULL
host groups with no other document and gets no host verdict; repeated rows count
as often as they occur; an empty table gives an empty result.  Only the three
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.text import SPACE, window_hashes, word_column
from weekpanel.session import materialize

WINDOW = 5


def _covered(starts: str) -> Column:
    """Words covered by the windows that begin at the sorted positions in ``starts``."""
    gaps = F.transform(F.col(starts), lambda p, k: F.least(F.lit(WINDOW), p - F.get(F.col(starts), k - 1)))
    # the first gap is NULL - p under least(), which gives WINDOW: the first window counts in full
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, host and the rule counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        word_column(F.col(text_col)).alias("words"),
        lines.alias("lines"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
    )
    counted = base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes("words", WINDOW).alias("h"),
    )
    # Only texts with some repeated window are sorted.
    keyed = counted.select(
        "*",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ).alias("sorted"),
    ).drop("h")
    same = lambda x, k: F.get(F.col("sorted"), k)["x"].eqNullSafe(x["x"])
    found = keyed.select(
        "*",
        F.sort_array(
            F.transform(F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
        ).alias("starts"),
    ).drop("sorted")
    return found.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(_covered("starts"), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """``(host, n, failures, rate)`` with the rate shrunk by an empirical beta prior.

    The prior is fitted by moments over hosts: its mean is the corpus rate, its
    strength is mean(1 - mean) / variance - 1, held between 1 and 1000 (one host,
    or hosts of equal rates, leave the variance undefined or zero)."""
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    m, v = hosts.agg(F.sum("failures") / F.sum("n"), F.var_samp(F.col("failures") / F.col("n"))).first()
    m = m or 0.0
    strength = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
    shrunk = (F.col("failures") + F.lit(strength * m)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "failures", shrunk.alias("rate"))


def apply_host_rules(
    docs: DataFrame, min_words: int = 10, repeat_pct: int = 20, host_limit: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Rule counts, ``base_failed``, the host's shrunk rate and ``kept``.

    The counts (a few numbers a row) are written once and read for both the host
    sums and the join back.  The host side is one row per host, written first so
    that the planner knows its size: below the broadcast threshold the documents are
    not shuffled at all, above it the adaptive skew join splits a host that has a
    third of them."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    judged = materialize(
        rule_counts(docs, id_col, text_col, host_col).withColumn("failed", failed), "host-rules"
    )
    rates = materialize(host_rates(judged).select("host", F.col("rate").alias("host_rate")), "host-rates")
    bad_host = F.coalesce(F.col("host_rate") > host_limit, F.lit(False))
    return judged.join(rates, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("base_failed"), (~F.col("failed") & ~bad_host).alias("kept"), "host", "host_rate",
    )
