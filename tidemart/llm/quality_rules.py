"""Quality rules with host-level verdicts, with built-in functions only.

Rules fail single documents; their failures are summed up by host, and each host's failure rate is
shrunk towards the corpus by an empirical beta prior (method of moments over all hosts): a host with
few documents is judged mostly by the prior, a large one by itself. A host whose shrunk rate of some
rule exceeds the limit loses all its documents. Verdicts are one row per host and are joined back.

Defined cases: a null text has no words. A null host is a host. Where hosts differ no more than
chance would have it, the prior is as strong as it may get; without documents the prior rate is 0.
Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.llm.common import SPACE, let, words_of, written

SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
#: A host is dropped when the shrunk share of its documents that fail a rule is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1_000_000.0
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """What a document fails by; the first two are the base rules."""
    n = F.col("n_words")
    return {"short": n < LEAST_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > 50 * n,
            "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
            "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)}


BASE = ("short", "repeats")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2]))).otherwise(
        F.array().cast("array<string>"))

    def covered(rows: Column) -> Column:
        # equal windows lie side by side
        again = F.filter(rows, lambda r, i: F.coalesce(
            F.get(rows, i - 1)["w"] == r["w"], F.lit(False)) | F.coalesce(
            F.get(rows, i + 1)["w"] == r["w"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(
            again, lambda r: F.sequence(r["i"], r["i"] + 2)))))

    def count(found: Column) -> Column:
        placed = F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            let(F.sort_array(placed), covered))

    return let(windows, count)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    return let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own)))


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(words_of(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    symbols = F.length(text) - F.length(F.regexp_replace(text, f"{SYMBOLS}+", ""))
    rows = docs.select(
        "doc_id", F.col(host).alias("host"), counted.alias("counted"),
        symbols.alias("n_symbols"), dup_lines(text).alias("n_dup_lines"))
    counts = {"n_words": F.col("counted.n_words"), "word_chars": F.col("counted.word_chars"),
              "n_repeat_words": F.col("counted.n_repeat_words")}
    return rows.select("doc_id", "host", *[
        counts.get(c, F.col(c)).cast("bigint").alias(c) for c in STATS])


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n_docs, the shrunk failure rate of each rule, host_failed."""
    failed = rules()
    hosts = written(stats.groupBy("host").agg(
        F.count("*").alias("n_docs"),
        *[F.count_if(rule).alias(name) for name, rule in failed.items()]), "rule-hosts")
    n = F.col("n_docs")
    total = hosts.agg(F.sum(n).alias("docs"), F.count("*").alias("hosts"),
                      *[F.sum(name).alias(name) for name in failed]).first()
    rate = {name: (total[name] or 0) / (total["docs"] or 1) for name in failed}
    spread = hosts.agg(*[F.sum(n * F.pow(F.col(name) / n - F.lit(rate[name]), 2)).alias(name)
                         for name in failed]).first()
    shrunk = []
    for name in failed:
        mean = rate[name]
        # between hosts, beyond what the sampling of their documents explains
        noise = mean * (1 - mean)
        excess = ((spread[name] or 0.0) - noise * (total["hosts"] or 0)) / (total["docs"] or 1)
        strength = min(max(noise / excess - 1, WEAKEST), STRONGEST) if excess > 0 else STRONGEST
        shrunk.append(((F.col(name) + F.lit(strength * mean)) / (n + F.lit(strength)))
                      .alias(f"{name}_rate"))
    rates = hosts.select("host", "n_docs", *shrunk)
    return rates.withColumn("host_failed", F.greatest(*[
        F.col(f"{name}_rate") for name in failed]) > limit)


def judged(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its counts, base_failed, host_failed and kept."""
    stats = written(statistics(docs, host), "rule-statistics")
    verdicts = host_verdicts(stats, limit).select(F.col("host").alias("of"), "host_failed")
    failed = rules()
    base = failed[BASE[0]] | failed[BASE[1]]
    return (stats.join(verdicts, F.col("host").eqNullSafe(F.col("of")))
            .select("doc_id", *STATS, base.alias("base_failed"), "host_failed",
                    (~base & ~F.col("host_failed")).alias("kept")))
