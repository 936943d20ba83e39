"""Quality rules with host-level verdicts (native DataFrame expressions only).

Per document, four measures of its whole text feed rules; rule failures are summed by
host, each host's rate is shrunk towards the corpus by a beta prior fitted to the hosts
by moments, and the host verdict is joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import store

SPACES = " \t\n\x0b\x0c\r"  # fixed value: the characters between words
SYMBOLS = "#*$%&|<>"  # fixed value: the symbols that count


def measures(text: Column) -> dict[str, Column]:
    """Columns for every measure but the repeated words (see ``with_measures``)."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.translate(s, SPACES, "") != "")
    return {
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long).

    A null text counts as empty: every measure is 0. Words are runs without space, tab,
    LF, VT, FF or CR. n_repeat_words counts the words covered by a five-word window that
    occurs at least twice in the same text, its first occurrence included. Windows are
    compared by a 64-bit hash of the words' 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__w", F.transform(F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    out = out.withColumns({"n_words": F.size("__w").cast("long")} | measures(t))
    # windows in text order; none with fewer than five words
    out = out.withColumn(
        "__g",
        F.expr("CASE WHEN size(__w) < 6 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(__w) - 5), i -> xxhash64(__w[i], __w[i+1], __w[i+2], __w[i+3], __w[i+4])) END"),
    ).drop("__w")
    # only texts with an equal pair go on: (window, place) sorted, places beside an equal neighbour kept
    out = out.withColumn(
        "__s",
        F.expr("CASE WHEN size(array_distinct(__g)) = size(__g) THEN NULL ELSE array_sort(transform(__g, (g, i) -> struct(g, i))) END"),
    ).drop("__g")
    out = out.withColumn(
        "__p",
        F.expr("CASE WHEN __s IS NULL THEN CAST(array() AS array<int>) ELSE array_sort(transform(filter(transform(__s, (s, k) -> struct(s.i AS i, coalesce(get(__s, k - 1).g = s.g, false) OR coalesce(get(__s, k + 1).g = s.g, false) AS twice)), s -> s.twice), s -> s.i)) END"),
    ).drop("__s")
    return out.withColumn(
        "n_repeat_words",
        F.expr("CASE WHEN size(__p) = 0 THEN 0L ELSE 5L + aggregate(transform(sequence(1, greatest(size(__p) - 1, 1)), k -> coalesce(least(5, get(__p, k) - get(__p, k - 1)), 0)), 0L, (a, x) -> a + x) END"),
    ).drop("__p")


#: Soft rules: name -> SQL over the measures. A document fails at the share given.
RULES = {
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "n_dup_lines >= 3",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "short": "n_words < 10",
}


def host_verdicts(rated: DataFrame, host: str, rules: list[str], bad_ratio: float, least_rate: float) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_rate, host_ratio, host_bad) from 0/1 columns ``rules``.

    A host is bad where the shrunk rate of some rule is ``bad_ratio`` times the corpus's
    rate or more, and ``least_rate`` at least; host_ratio is the highest such ratio. Prior per rule: a beta with the mean and variance of the hosts' rates (hosts weigh by
    their documents); without spread between hosts it is worth 1,000 documents. Two levels
    of sums run map-side before any shuffle, so a host with most rows is no hot key.
    """
    per = rated.groupBy(host).agg(F.count("*").alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in rules])
    weigh = [F.sum("n_docs").alias("n")]
    for r in rules:
        rate = F.col(f"f_{r}") / F.col("n_docs")
        weigh += [F.sum(F.col(f"f_{r}")).alias(f"s_{r}"), F.sum(rate * rate * F.col("n_docs")).alias(f"q_{r}")]
    prior = per.agg(*weigh)
    joined = per.crossJoin(F.broadcast(prior))  # one row, whatever the input
    cols = []
    for r in rules:
        m = F.col(f"s_{r}") / F.col("n")
        v = F.greatest(F.col(f"q_{r}") / F.col("n") - m * m, F.lit(0.0))
        weight = F.when(v > m * (1 - m) / 1000.0, m * (1 - m) / v - 1).otherwise(F.lit(1000.0))
        cols.append(((F.col(f"f_{r}") + m * weight) / (F.col("n_docs") + weight)).alias(f"rate_{r}"))
        cols.append(m.alias(f"mean_{r}"))
    out = joined.select(host, "n_docs", *cols)
    rate, ratio = [F.col(f"rate_{r}") for r in rules], [F.when(F.col(f"mean_{r}") > 0, F.col(f"rate_{r}") / F.col(f"mean_{r}")).otherwise(0.0) for r in rules]
    bad = F.lit(False)
    for x, y in zip(rate, ratio):
        bad = bad | ((x >= least_rate) & (y >= bad_ratio))
    return out.select(host, "n_docs", *rate, F.greatest(*rate, F.lit(0.0)).alias("host_rate"), F.greatest(*ratio, F.lit(0.0)).alias("host_ratio"), bad.alias("host_bad"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", bad_ratio: float = 1.5, least_rate: float = 0.02, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """One row per document: measures, base_failed, host columns and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` percent of
    the words in repeated windows. kept is false for base_failed; otherwise it is false
    only for documents of a bad host (see ``host_verdicts``) that fail a soft rule
    themselves, so a clean document of a bad host stays. A null host is a host
    of its own (''). Repeated rows give repeated rows; an empty table gives none. Other
    columns of the input are ignored, so their names cannot clash.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    rated = with_measures(base).drop("text")
    rated = rated.withColumn("base_failed", F.expr(f"n_words < {int(min_words)} OR 100 * n_repeat_words > {int(max_repeat)} * n_words"))
    rated = rated.withColumns({f"fails_{k}": F.expr(v) for k, v in RULES.items()})
    rated = store.table(rated, "op9")  # the texts are measured once; these rows are small and stay for the result
    names = [f"fails_{k}" for k in RULES]
    verdict = host_verdicts(rated, "host", names, bad_ratio, least_rate).select("host", "host_rate", "host_ratio", "host_bad")
    out = rated.join(verdict, "host", "left")
    own = F.lit(False)
    for k in names:
        own = own | F.col(k)
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce("host_bad", F.lit(False)) & own)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rate", "host_ratio", "host_bad"
    )
