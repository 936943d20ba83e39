"""Stages over document tables: each takes and returns lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import text as T

#: reject rules first, in their order; flags keep the document
REJECTS = ("min_chars", "max_chars", "control_ratio")
FLAGS = ("url_density", "template_residue", "digit_runs", "repetition")


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 1
    max_chars: int = 20000
    control_ratio: float = 0.02
    url_density: float = 2.0
    template_residue: int = 0
    digit_runs: int = 1
    repetition: float = 0.3


@dataclass(frozen=True)
class StageOutcome:
    """``scored`` has every input row with ``reason`` (null for kept); the rest are views."""

    name: str
    scored: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.scored.where("reason IS NULL")

    @property
    def removed(self) -> DataFrame:
        return self.scored.where("reason IS NOT NULL")

    def stats(self, by: str = "lang") -> DataFrame:
        r = F.col("reason")
        return self.scored.groupBy(by).agg(F.count("*").alias("documents_in"), F.count_if(r.isNull()).alias("kept"), F.count_if(r.isNotNull()).alias("removed"))


def first_of(**rules: Column) -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, holds in rules.items():
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def normalize(docs: DataFrame, policy: str = "nfc") -> DataFrame:
    out = T.once(docs, __new=T.normalize(F.col("text"), policy))
    names = [c for c in docs.columns if c != "text"]
    return out.select(*names, (F.col("__new") != F.col("text")).alias("changed"), F.col("__new").alias("text"))


def langid(docs: DataFrame, scripts: dict[str, str], least: float = 0.6, lang: str = "lang") -> StageOutcome:
    """Script gate: no letters, or too few of the declared script. Unknown languages fail.
    A text is read twice: for its known letters and for those of its own script."""
    by = F.raise_error(F.concat(F.lit("unknown language "), F.coalesce(F.col(lang), F.lit("null")))).cast("long")
    for script in sorted(set(scripts.values())):
        by = F.when(F.col(lang).isin([k for k, v in scripts.items() if v == script]), T.letters(F.col("text"), script)).otherwise(by)
    out = T.once(docs, declared=by, letters=T.known_letters(F.col("text")))
    reason = first_of(langid_no_letters=F.col("letters") == 0, langid_mismatch=F.col("declared") < least * F.col("letters"))
    return StageOutcome("langid", out.withColumn("reason", reason))


def measured(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return T.once(docs, chars=F.length(t).cast("long"), controls=T.count(t, T.CONTROL), urls=T.count(t, T.URL),
                  templates=T.count(t, T.TEMPLATE), runs=T.count(t, T.DIGIT_RUN), ratio=T.repetition(t))


def quality(docs: DataFrame, at: Thresholds = Thresholds(), overrides: dict[str, Thresholds] | None = None, lang: str = "lang") -> StageOutcome:
    """Every rule measured for every document; the first reject is the reason; flags of
    kept documents are listed. ``overrides``: thresholds of single languages."""
    d = measured(docs)
    chars = F.greatest("chars", F.lit(1))

    def limit(rule: str) -> Column:
        out = F.lit(getattr(at, rule))
        for name, own in sorted((overrides or {}).items()):
            out = F.when(F.col(lang) == name, getattr(own, rule)).otherwise(out)
        return out

    reason = first_of(min_chars=F.col("chars") < limit("min_chars"), max_chars=F.col("chars") > limit("max_chars"), control_ratio=F.col("controls") / chars > limit("control_ratio"))
    flags = F.array_compact(F.array(
        F.when(F.col("urls") * 1000 / chars > limit("url_density"), "url_density"), F.when(F.col("templates") > limit("template_residue"), "template_residue"),
        F.when(F.col("runs") >= limit("digit_runs"), "digit_runs"), F.when(F.col("ratio") < limit("repetition"), "repetition"),
    ))
    d = d.withColumn("reason", reason)
    return StageOutcome("quality", d.withColumn("flags", F.when(F.col("reason").isNull(), flags).otherwise(F.array().cast("array<string>"))))


def exact_dedup(docs: DataFrame, key: Column | None = None, order: tuple[str, ...] = ("source", "doc_id")) -> StageOutcome:
    """The first of equal texts stays; the others point at it. Only hashes and ids are
    windowed; with a hot text the window's rows are ids, not texts."""
    ids = docs.select(*[F.col(c).alias(f"o_{c}") for c in order], F.coalesce(key, T.sha(F.col("text"))).alias("h") if key is not None else T.sha(F.col("text")).alias("h"))
    first = ids.groupBy("h").agg(F.min(F.struct(*[f"o_{c}" for c in order])).alias("first"))
    d = docs.withColumn("h", key if key is not None else T.sha(F.col("text"))).join(first, "h")
    mine = F.struct(*[F.col(c).alias(f"o_{c}") for c in order])
    return StageOutcome("exact_dedup", d.withColumn("reason", F.when(mine != F.col("first"), "exact_duplicate")))


def content_split(docs: DataFrame, fraction: float = 0.1, seed: int = 1337) -> DataFrame:
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie in (0, 1)")
    return docs.withColumn("side", F.when(T.hash_share(F.col("text"), seed) < fraction, "heldout").otherwise("train"))


def suite_grams(suite: DataFrame, item: str, text: str, n: int = 13) -> DataFrame:
    return suite.select(F.col(item).alias("item"), F.explode(F.array_distinct(T.grams(T.words(F.col(text)), n))).alias("gram"))


#: a suite of no more grams or passages than this goes to every executor; a larger one is joined
MOST_GRAMS = 1_000_000


def found_grams(docs: DataFrame, suite: DataFrame, item: str = "item_id", text: str = "text", n: int = 13) -> DataFrame:
    """(doc_id, pos, gram, item): the suite's grams of n words in each document, each at its
    first place; item is the least one that holds the gram."""
    owner = suite_grams(suite, item, text, n).groupBy("gram").agg(F.min("item").alias("item"))
    held = owner.limit(MOST_GRAMS + 1).collect()
    if len(held) > MOST_GRAMS:
        g = T.grams(T.words(F.col(text)), n)
        mine = docs.select("doc_id", F.posexplode(g).alias("pos", "gram")).groupBy("doc_id", "gram").agg(F.min("pos").alias("pos"))
        return mine.join(owner, "gram").select("doc_id", "pos", "gram", "item")
    shared = docs.sparkSession.sparkContext.broadcast({r.gram: i for i, r in enumerate(held)})

    @F.pandas_udf("array<struct<pos:int,gram:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(Finder.of(shared, n).find)

    hits = docs.select("doc_id", F.explode(T.batched(find(F.col(text)))).alias("g")).select("doc_id", "g.*")
    return hits.join(F.broadcast(owner), "gram").select("doc_id", "pos", "gram", "item")


class Finder:
    """Finds known runs of words in texts: a place counts only where every word is one of
    the runs' words, so few runs are ever put together."""

    built: tuple = (None, None)

    @classmethod
    def of(cls, shared, n: int) -> Finder:
        if cls.built[0] is not shared:
            cls.built = (shared, cls(shared.value, n))
        return cls.built[1]

    def __init__(self, grams, n: int):
        self.grams, self.n = grams, n
        self.known = {w for g in grams for w in g.split(" ")}

    def find(self, text):
        if text is None:
            return []
        w, n, out, run = text.split(), self.n, {}, 0
        known, grams = self.known, self.grams
        for i, x in enumerate(w):
            run = run + 1 if x in known else 0
            if run >= n:
                g = " ".join(w[i - n + 1 : i + 1])
                if g in grams and g not in out:
                    out[g] = i - n + 1
        return [{"pos": p, "gram": g} for g, p in out.items()]


def suite_hits(docs: DataFrame, suite: DataFrame, item: str = "item_id", text: str = "text", n: int = 13) -> DataFrame:
    """(doc_id, matched_ngrams, item): documents that share an n-word gram with the suite;
    item is that of the first matching gram in text order, the least one of equal grams."""
    return found_grams(docs, suite, item, text, n).groupBy("doc_id").agg(F.count("*").alias("matched_ngrams"), F.min_by("item", "pos").alias("item"))


def found_passages(docs: DataFrame, suite: DataFrame, least: int, most: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item, pos): suite texts of ``least`` to ``most`` words that stand in a
    document as consecutive words, each at its first place."""
    s = suite.select(F.col(item).alias("item"), T.words(F.col(text)).alias("p")).where(F.size("p").between(least, most))
    held = s.limit(MOST_GRAMS + 1).collect()
    if len(held) > MOST_GRAMS:
        s = s.withColumn("anchor", F.xxhash64(F.array_join(F.slice("p", 1, least), " ")))
        w = docs.select("doc_id", T.words(F.col(text)).alias("w"))
        here = w.select("doc_id", F.explode(F.transform(T.grams(F.col("w"), least), lambda x, k: F.struct(F.xxhash64(x).alias("anchor"), k.alias("pos"), F.slice("w", k + 1, most).alias("here")))).alias("g"))
        hit = here.select("doc_id", "g.*").join(s, "anchor").where(F.slice("here", F.lit(1), F.size("p")) == F.col("p"))
        return hit.groupBy("doc_id", "item").agg(F.min("pos").alias("pos"))
    starts: dict = {}
    for r in held:
        starts.setdefault(r.p[0], []).append((r.item, list(r.p)))
    shared = docs.sparkSession.sparkContext.broadcast(starts)
    kind = dict(s.dtypes)["item"]

    @F.pandas_udf(f"array<struct<item:{kind},pos:int>>")
    def find(texts: pd.Series) -> pd.Series:
        starts = shared.value

        def one(t):
            w, out = (t or "").split(), {}
            for i, x in enumerate(w):
                for name, p in starts.get(x, ()):
                    if name not in out and w[i : i + len(p)] == p:
                        out[name] = i
            return [{"item": k, "pos": v} for k, v in out.items()]

        return texts.map(one)

    return docs.select("doc_id", F.explode(T.batched(find(F.col(text)))).alias("g")).select("doc_id", "g.*")


def line_counts(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stripped lines that are not empty, with their counts over the whole table or by columns."""
    lines = docs.select(*(by or []), F.explode(F.split("text", "\n")).alias("raw")).select(*(by or []), T.strip(F.col("raw")).alias("line")).where("line <> ''")
    return lines.groupBy(*(by or []), "line").agg(F.count("*").alias("n"))


def ranked(docs: DataFrame, by: str, *order: Column) -> DataFrame:
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
