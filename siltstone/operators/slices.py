"""The slice build: line rules, script markers and the cascade of removal reasons.

Lines are cleaned inside their document's row; shuffles are those of single lines with the
counts by file, of texts with their own hot lines, and of ids and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions import text as T
from siltstone.operators import stages as S
from siltstone.sources import tables

#: removal reasons in the order they are tested
REASONS = (
    "empty", "suite_exact", "suite_ngram", "suite_short", "exact_duplicate", "cross_file_duplicate", "control_chars", "empty_after_cleaning", "no_letters",
    "script_share", "urdu_persian_like", "urdu_uyghur_like", "wiki_markup", "repetition", "suite_after_cleaning", "slice1_duplicate", "near_duplicate",
)

# fixed values: the letters that tell languages of one script apart
MARKERS = {
    "assamese": "ৰৱ",
    "bengali": "র",
    "urdu": "ٹڈڑںےھ",
    "uyghur": "ەۇۆۈۋڭ",
    "sindhi": "ڄڃڇڏڙڪڻٻٺٽ",
    "pashto": "ټډړږښځڅۍ",
    "arabic": "ةى",
    "marathi_lla": "ळ",
}

# fixed values: shares of a file's characters above which a rule is reviewed
REVIEW = {
    "lines:boilerplate": 0.05, "lines:foreign": 0.10, "exact_duplicate": 0.05, "near_duplicate": 0.05, "script_share": 0.08, "no_letters": 0.02,
    "urdu_persian_like": 0.12, "urdu_uyghur_like": 0.01, "wiki_markup": 0.02, "repetition": 0.02, "empty_after_cleaning": 0.02, "control_chars": 0.001,
    "suite_after_cleaning": 0.0,
}


def by_script(lang: Column, scripts: dict[str, str], value) -> Column:
    """value(script) of the language's script; only that branch is evaluated."""
    out = F.lit(None)
    for script in sorted(set(scripts.values())):
        out = F.when(lang.isin([k for k, v in scripts.items() if v == script]), value(script)).otherwise(out)
    return out


def has_letter(text: Column, script: str) -> Column:
    return text.rlike(rf"[\p{{L}}&&[{T.SCRIPTS[script]}]]")


def foreign(line: Column, script: str) -> Column:
    """A line with a letter of any script, none of them of the declared one."""
    return line.rlike(r"\p{L}") & ~has_letter(line, script)


def clean_lines(docs: DataFrame, scripts: dict[str, str], least: int = 100, by: str = "source", lang: str = "lang") -> DataFrame:
    """docs with body (the cleaned text), boilerplate_lines, boilerplate_chars,
    foreign_lines and foreign_chars.

    Every line is stripped. A line seen ``least`` times in its file goes, else a foreign
    one; runs of blank lines become one, outer ones go. Lines meet the hot ones of their
    file by hash join; a document gets an array of its own hot lines only, so its cost does
    not follow the number of hot lines of the file. Texts are named by a hash: two of one
    name share an array that is right for both.
    """
    lines = F.transform(F.split("text", "\n"), T.strip)
    hot = S.line_counts(docs, [by]).where(F.col("n") >= least).select(by, "line")
    name = F.xxhash64("text")
    own = docs.select(by, name.alias("__t"), F.explode(F.array_distinct(lines)).alias("line")).where("line <> ''").join(hot, [by, "line"])
    own = own.groupBy(F.col(by).alias("__by"), "__t").agg(F.collect_set("line").alias("hot"))
    d = docs.join(own, (F.col(by) == F.col("__by")) & (name == F.col("__t")), "left").drop("__by", "__t")

    def tagged(x):
        kind = F.when(F.coalesce(F.array_contains("hot", x), F.lit(False)) & (x != ""), "b").when(F.coalesce(by_script(F.col(lang), scripts, lambda s: foreign(x, s)), F.lit(False)), "f").otherwise("k")
        return F.struct(x.alias("line"), kind.alias("kind"))

    d = T.once(d, __lines=F.transform(lines, tagged)).drop("hot")

    def of(kind):
        return F.filter("__lines", lambda x: x["kind"] == kind)

    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x["line"]))
    body = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(of("k"), lambda x: x["line"]), "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return d.withColumns({
        "body": body, "boilerplate_lines": F.size(of("b")).cast("long"), "boilerplate_chars": chars(of("b")),
        "foreign_lines": F.size(of("f")).cast("long"), "foreign_chars": chars(of("f")),
    }).drop("__lines")


def marker(text: Column, name: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, MARKERS[name], ""))).cast("long")


def marker_label(lang: Column, text: Column, letters: Column) -> Column:
    """Coarse label of languages that share a script."""
    a, b = marker(text, "assamese"), marker(text, "bengali")
    indic = F.when(a + b < 5, "too_few_markers").when(2 * a >= a + b, "assamese_like").otherwise("bengali_like")
    own, arabic = marker(text, "urdu"), None
    for other in ("uyghur", "sindhi", "pashto"):
        n = marker(text, other)
        rule = (n >= 3) & (n > own)
        arabic = F.when(rule, f"{other}_like") if arabic is None else arabic.when(rule, f"{other}_like")
    arabic = arabic.when((own == 0) & (letters >= 50), "no_urdu_letters").otherwise("urdu_like")
    lla = F.when(marker(text, "marathi_lla") >= 3, "has_lla_3plus").otherwise("lla_0_2")
    return F.when(lang.isin("as", "bn"), indic).when(lang == "ur", arabic).when(lang.isin("hi", "mr"), lla).otherwise("n/a")


def fused(text: Column, script: str) -> Column:
    """Latin letters with a combining mark of another script right behind them."""
    if script in ("latin", "arabic"):
        return F.lit(0).cast("long")
    return T.count(text, rf"[A-Za-z][\p{{M}}&&[{T.SCRIPTS[script]}]]")


def short_hits(docs: DataFrame, suite: DataFrame, least: int = 5, most: int = 12) -> DataFrame:
    """(doc_id, item): the suite passage of ``least`` to ``most`` words that stands first in the text."""
    return S.found_passages(docs, suite, least, most).groupBy("doc_id").agg(F.min_by("item", F.struct("pos", "item")).alias("item"))


def build(docs: DataFrame, suite: DataFrame, scripts: dict[str, str], prior: DataFrame | None = None, least: int = 100, at: S.Thresholds = S.Thresholds()) -> DataFrame:
    """(doc_id, lang, source, reason, chars, final): the first of REASONS that holds, null
    for kept documents, and the masked text of those that reach the end of the cascade.

    ``docs`` holds normalised texts in columns doc_id, lang, source, text; ``prior``
    (h: sha256) the final texts of an earlier build. Order in a file is doc_id. Near
    duplicates are the last step: see ``with_near_duplicates``.
    """
    d = clean_lines(docs, scripts, least)
    d = T.once(d, h=T.sha(F.col("text")), chars=F.length("text").cast("long"), controls=T.count(F.col("text"), T.CONTROL), letters=T.known_letters(F.col("body")),
               own=F.coalesce(by_script(F.col("lang"), scripts, lambda s: T.letters(F.col("body"), s)), F.lit(0)), braces=T.count(F.col("body"), T.TEMPLATE),
               n_words=F.size(T.words(F.col("body"))), ratio=T.repetition(F.col("body")), final=T.mask_contacts(F.col("body")))
    d = d.withColumn("label", marker_label(F.col("lang"), F.col("body"), F.col("letters")))
    # everything below reads this table: texts are cleaned and measured once
    d = tables.stored(d.drop("text", "body", "hot").withColumn("__row", F.monotonically_increasing_id()), "slice-facts")
    exact = suite.select(T.sha(F.col("text")).alias("h"), F.lit(True).alias("exact")).distinct()
    grams = S.suite_hits(docs, suite).select("doc_id", F.lit(True).alias("ngram"))
    short = short_hits(docs, suite).select("doc_id", F.lit(True).alias("short"))
    end = d.select("doc_id", F.col("final").alias("text"))
    after = S.suite_hits(end, suite).select("doc_id").unionByName(short_hits(end, suite).select("doc_id")).distinct().withColumn("after", F.lit(True))
    # names of texts and facts meet, the texts themselves come back by row at the end
    facts = d.withColumns({"bare": F.col("final") == "", "__h": T.sha(F.col("final"))}).drop("final").join(exact, "h", "left").join(grams, "doc_id", "left").join(short, "doc_id", "left").join(after, "doc_id", "left")
    # duplicates: first rows of a text in its file, and of a language's files in their order, among those that no suite rule took
    clear = F.col("exact").isNull() & F.col("ngram").isNull() & F.col("short").isNull() & (F.col("chars") > 0)
    firsts = facts.where(clear).groupBy("lang", "h").agg(F.min(F.struct("source", "doc_id")).alias("first"))
    facts = facts.join(firsts, ["lang", "h"], "left")
    if prior is None:
        facts = facts.withColumn("known", F.lit(None).cast("boolean"))
    else:
        facts = facts.join(prior.select(F.col("h").alias("__h"), F.lit(True).alias("known")).distinct(), "__h", "left")
    reason = S.first_of(
        empty=F.col("chars") == 0, suite_exact=F.col("exact"), suite_ngram=F.col("ngram"), suite_short=F.col("short"),
        exact_duplicate=(F.col("source") == F.col("first.source")) & (F.col("doc_id") > F.col("first.doc_id")), cross_file_duplicate=F.col("source") > F.col("first.source"),
        control_chars=F.col("controls") / F.greatest("chars", F.lit(1)) > at.control_ratio, empty_after_cleaning=F.col("bare"), no_letters=F.col("letters") == 0,
        script_share=F.col("own") < 0.6 * F.col("letters"), urdu_persian_like=F.col("label") == "no_urdu_letters", urdu_uyghur_like=F.col("label") == "uyghur_like",
        wiki_markup=F.col("braces") >= 2, repetition=(F.col("n_words") >= 8) & (F.col("ratio") < at.repetition), suite_after_cleaning=F.col("after"), slice1_duplicate=F.col("known"),
    )
    facts = tables.stored(facts.withColumn("reason", reason).select("__row", "reason"), "slice-reasons")
    return d.join(facts, "__row").select("doc_id", "lang", "source", "reason", "chars", "final", "boilerplate_lines", "boilerplate_chars", "foreign_lines", "foreign_chars", "label")


def with_near_duplicates(built: DataFrame, clusters) -> DataFrame:
    """The last reason: members of a cluster other than its root. ``clusters`` is
    ``neardup.clusters``; it sees the final texts that are still kept. Removed ones count
    with their final characters."""
    kept = built.where("reason IS NULL").select("doc_id", "lang", F.col("final").alias("text"))
    near = clusters(kept).where("root <> doc_id").select("doc_id", F.lit(True).alias("near"))
    d = built.join(near, "doc_id", "left")
    return d.withColumn("chars", F.when(F.col("near"), F.length("final")).otherwise(F.col("chars")).cast("long")).withColumn("reason", F.when(F.col("near"), "near_duplicate").otherwise(F.col("reason"))).drop("near")


def reason_table(built: DataFrame) -> DataFrame:
    """(reason, docs, chars, docs_share, chars_share) of every reason, zeros included."""
    spark = built.sparkSession
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(REASONS)], "ord int, reason string")
    got = built.groupBy("reason").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))
    total = built.agg(F.count("*").alias("all_docs"), F.sum("chars").alias("all_chars"))
    t = dim.join(got, "reason", "left").crossJoin(F.broadcast(total))  # one row, whatever the input
    n, c = F.coalesce("docs", F.lit(0)), F.coalesce("chars", F.lit(0))
    return t.select("ord", "reason", n.alias("docs"), c.alias("chars"), (n / F.col("all_docs")).alias("docs_share"), (c / F.col("all_chars")).alias("chars_share"))


def review_rows(shares: DataFrame) -> DataFrame:
    """(rule, share, bound) of rules whose share of characters is above its bound."""
    bounds = shares.sparkSession.createDataFrame(sorted(REVIEW.items()), "rule string, bound double")
    return shares.join(F.broadcast(bounds), "rule").where("share > bound").select("rule", "share", "bound")


def protected_texts(items: DataFrame, key: str, passage: str = "passage", question: str = "question", options: str = "options") -> DataFrame:
    """(id, text): passage, question and each option of every item as a row of its own, in NFC."""
    parts = F.concat(
        F.array(F.struct(F.lit("passage").alias("part"), F.col(passage).alias("text")), F.struct(F.lit("question").alias("part"), F.col(question).alias("text"))),
        F.transform(options, lambda x, k: F.struct(F.concat(F.lit("option"), (k + 1).cast("string")).alias("part"), x.alias("text"))),
    )
    u = items.select(F.col(key).cast("string").alias("key"), F.explode(parts).alias("p"))
    return u.select(F.concat_ws("/", "key", "p.part").alias("id"), T.nfc(F.col("p.text")).alias("text"))


def share_band(share: Column) -> Column:
    """Half-open bands of a fifth; a share of 1 stands alone, no share is none."""
    return (
        F.when(share.isNull(), "none").when(share < 0.2, "0.0-0.2").when(share < 0.4, "0.2-0.4").when(share < 0.6, "0.4-0.6")
        .when(share < 0.8, "0.6-0.8").when(share < 1.0, "0.8-1.0").otherwise("1.0")
    )


def windows(text: Column, size: int = 5000) -> Column:
    """Start, middle and end of a text longer than ``size``, else the text."""
    n = F.length(text)
    parts = F.array(F.substring(text, 1, size), F.substring(text, F.floor(n / 2).cast("int") - (size // 2 - 1), F.lit(size)), F.substring(text, n - (size - 1), F.lit(size)))
    return F.when(n > size, parts).otherwise(F.array(text))
