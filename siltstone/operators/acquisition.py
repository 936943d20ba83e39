"""Rules over sources: shapes of raw pages, ingestion status, manifests, wiki URLs and chapters."""

from __future__ import annotations

from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions import html as H, text as T
from siltstone.operators import stages as S

# fixed values of the shape gate
SPARQL = ("select ?", "wdt:p", "bind(if(", "union {", "filter(contains", "^wdt:")
LINES_LEAST, PROSE_LEAST, LINK_SHARE, CLEANED_LEAST = 5, 20, 0.5, 500
SPLIT_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def wikitext_shape(text: Column) -> Column:
    """Struct: lines, link_lines, ratio, is_redirect, is_sparql_card, cleaned_chars, index_page."""

    def shape(t):
        lines = F.filter(F.transform(F.split(t, SPLIT_LINES), T.strip), lambda x: x != "")

        def of(x):
            prose = lambda y: T.strip(F.regexp_replace(F.regexp_replace(y, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"\{\{[^{}]*\}\}", ""))
            links = F.size(F.filter(x, lambda y: (y.contains("[[") | y.contains("{{")) & (F.length(prose(y)) < PROSE_LEAST)))
            n, first = F.size(x), F.coalesce(F.get(x, F.lit(0)), F.lit(""))
            redirect = first.rlike(r"(?i)^#redirect\b") | (first.startswith("#") & first.contains("[[") & (n <= 3))
            marks = sum((F.contains(F.lower(t), F.lit(m)).cast("int") for m in SPARQL[1:]), F.contains(F.lower(t), F.lit(SPARQL[0])).cast("int"))
            card = marks >= 2
            ratio = F.when(n > 0, links / n).otherwise(0.0)
            index = ((n >= LINES_LEAST) & (ratio >= LINK_SHARE)) | redirect | card
            return F.struct(n.cast("long").alias("lines"), links.cast("long").alias("link_lines"), ratio.alias("ratio"), redirect.alias("is_redirect"), card.alias("is_sparql_card"), index.alias("index_page"))

        return T.let(lines, of)

    return T.let(text, shape)


def ingestion_status(facts: DataFrame) -> DataFrame:
    """facts with status. Columns: attempted, fetched, local, cleaned_chars, index_page,
    has_markup, unproofread (pages), licence_proof, pinned_sha256, sha256."""
    status = S.first_of(
        not_attempted=~F.col("attempted"), fetch_failed=~F.col("fetched"), empty=F.col("cleaned_chars") == 0,
        index_page_refused=F.col("index_page") | (F.col("has_markup") & (F.col("cleaned_chars") < CLEANED_LEAST)), unproofread_refused=F.col("unproofread") > 0,
        local_unverified=F.col("local"), licence_marker_missing=F.col("licence_proof").isNull(), hash_mismatch=F.col("pinned_sha256").isNotNull() & (F.col("pinned_sha256") != F.col("sha256")),
        verified=F.lit(True),
    )
    return facts.withColumn("status", status)


def manifest_problems(sources: DataFrame, slots: DataFrame, licences: list[str], kinds: list[str], most_chars: int) -> DataFrame:
    """(id, problem). sources: id, language, license_id, source_url, license_url,
    attribution, max_chars, kind, sha256, verified; slots: code, source_ids."""
    c = F.col
    rules = {
        "licence": ~c("license_id").isin(licences), "source_url": ~c("source_url").startswith("https://"), "license_url": ~c("license_url").startswith("https://"),
        "attribution": F.length(F.trim("attribution")) < 16, "max_chars": (c("max_chars") <= 0) | (c("max_chars") > most_chars), "kind": ~c("kind").isin(kinds),
        "sha256": c("sha256").isNotNull() & ~c("sha256").rlike("^[0-9a-f]{64}$"), "verified_without_hash": c("verified") & c("sha256").isNull(),
    }
    own = sources.select("id", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("problem"))
    refs = slots.select("code", F.explode("source_ids").alias("id"))
    twice = sources.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    slot_twice = slots.groupBy(c("code").alias("id")).count().where("count > 1").select("id", F.lit("duplicate_slot").alias("problem"))
    dangling = refs.join(sources, "id", "left_anti").select("id", F.lit("unknown_reference").alias("problem"))
    orphan = sources.join(refs, "id", "left_anti").select("id", F.lit("not_referenced").alias("problem"))
    homeless = sources.join(slots.select(c("code").alias("language")), "language", "left_anti").select("id", F.lit("no_slot").alias("problem"))
    out = own
    for more in (twice, slot_twice, dangling, orphan, homeless):
        out = out.unionByName(more)
    return out.distinct()


# fixed values: what inspection counts
PATTERNS = {
    "html": r"</?[a-zA-Z][^<>]{0,200}>", "wiki": r"\{\{|\}\}|\[\[|\]\]|__[A-Z]+__", "entity": r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});",
    "css": r"mw-parser-output|\.[a-z][\p{L}\p{N}_-]*\s*\{[^{}]*:[^{}]*\}", "url": r"https?://", "replacement": r"\x{FFFD}", "control": r"[\x00-\x08\x0b-\x1f\x7f-\x9f]",
    "invisible": r"[\x{200B}\x{2060}\x{FEFF}\x{AD}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "digit_runs": r"(?<![0-9])[0-9]{4,}(?![0-9])",
}


def inspection(text: Column) -> dict[str, Column]:
    return {k: T.count(text, v) for k, v in PATTERNS.items()}


def first_context(text: Column, pattern: str, around: int = 30) -> Column:
    """The first place of a pattern in its surroundings, the place itself between « and »."""
    m = F.regexp_extract(text, f"(?s)(.{{0,{around}}})({pattern})(.{{0,{around}}})", 0)
    return F.when(m != "", F.translate(F.regexp_replace(m, f"(?s)^(.{{0,{around}}})({pattern})(.{{0,{around}}})$", "$1«$2»$3"), "\n", "|"))


# wiki URLs and chapters ----------------------------------------------------------------

# fixed values of the API that renders pages
NEEDED = {"action": "parse", "format": "json", "formatversion": "2"}
REFUSED = ("onlypst", "preview", "pst", "redirects", "summary")
TARGETS = ("page", "pageid", "oldid", "text")
PAGES_TAG = r'^<pages\s+index="([^"<>]+)"\s+from=(\d+)\s+to=(\d+)(?:\s+header=(?:0|1))?\s*/>$'
BATCH, URL_CHARS = 50, 4000


def url_problems(url: Column) -> Column:
    """Array of what is wrong with the address of a rendered page."""
    query = F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.url_decode(F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit(""))).alias("v")))

    def rules(p):
        keys = F.transform(p, lambda x: x["k"])
        value = lambda k: F.coalesce(F.get(F.transform(F.filter(p, lambda x: x["k"] == k), lambda x: x["v"]), F.lit(0)), F.lit(""))
        tag = value("text")
        has = lambda k: F.array_contains(keys, k)
        found = [
            F.when(F.coalesce(F.parse_url(url, F.lit("PROTOCOL")), F.lit("")) != "https", "not_https"), F.when(~F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")).endswith("/api.php"), "not_api"),
            F.when(F.size(keys) != F.size(F.array_distinct(keys)), "repeated"), *[F.when(value(k) != v, f"needs_{k}") for k, v in NEEDED.items()],
            F.when(~F.array_contains(F.split(value("prop"), r"\|"), "text"), "needs_prop_text"), *[F.when(has(k), f"refused_{k}") for k in REFUSED],
            F.when(sum((has(k).cast("int") for k in TARGETS[1:]), has(TARGETS[0]).cast("int")) != 1, "one_target"),
            F.when(has("text") & ~F.trim(tag).rlike(PAGES_TAG), "text_not_pages"), F.when(has("text") & (F.regexp_extract(F.trim(tag), PAGES_TAG, 2).try_cast("long") > F.regexp_extract(F.trim(tag), PAGES_TAG, 3).try_cast("long")), "from_after_to"),
            F.when(has("text") & (value("title") == ""), "needs_title"), F.when(has("text") & (value("contentmodel") != "wikitext"), "needs_contentmodel"),
        ]
        return F.array_compact(F.array(*found))

    return T.let(pairs, rules)


def percent(text: Column) -> Column:
    """Percent-coded as a whole; spaces as %20."""
    out = F.url_encode(text)
    for pattern, by in ((r"\+", "%20"), ("%7E", "~"), (r"\*", "%2A")):
        out = F.regexp_replace(out, pattern, by)
    return out


def page_url(host: Column, title: Column) -> Column:
    """The address that renders one page."""
    return F.concat(F.lit("https://"), host, F.lit("/w/api.php?action=parse&format=json&formatversion=2&prop=text%7Crevid%7Ccategories&disablelimitreport=1&disableeditsection=1&page="), percent(title))


def range_url(host: Column, work: Column, index: Column, start: Column, end: Column) -> Column:
    """The address that renders a range of scan pages; an empty range is an error."""
    tag = F.concat(F.lit('<pages index="'), index, F.lit('" from='), start.cast("string"), F.lit(" to="), end.cast("string"), F.lit(" />"))
    ok = F.concat(F.lit("https://"), host, F.lit("/w/api.php?action=parse&format=json&formatversion=2&prop=text&disablelimitreport=1&disableeditsection=1&contentmodel=wikitext&title="), percent(work), F.lit("&text="), percent(tag))
    return F.when(start > end, F.raise_error(F.lit("start after end"))).otherwise(ok)


def quality_urls(titles: DataFrame, by: str, order: str, title: str, base: str) -> DataFrame:
    """(by, batch, url, n): addresses that ask for the levels of pages, titles in order, at
    most BATCH and URL_CHARS to one. A fold over the titles of one work."""
    head = f"{base}?action=query&format=json&formatversion=2&prop=proofread&titles="

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[str]] = []
        for t in pdf.sort_values(order)[title]:
            more = [*out[-1], t] if out else None
            if more and len(more) <= BATCH and len(head) + len(quote("|".join(more), safe="")) <= URL_CHARS:
                out[-1] = more
            else:
                out.append([t])
        rows = [(pdf[by].iloc[0], k, head + quote("|".join(x), safe=""), len(x)) for k, x in enumerate(out)]
        return pd.DataFrame(rows, columns=[by, "batch", "url", "n"])

    return titles.groupBy(by).applyInPandas(fold, f"{by} {dict(titles.dtypes)[by]}, batch int, url string, n int")


def page_levels(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """(title, level) of answers to ``quality_urls``, also under the names before they were
    normalised; a page without a level has none."""
    form = "struct<query:struct<normalized:array<struct<`from`:string,`to`:string>>,pages:array<struct<title:string,missing:boolean,proofread:struct<quality:int>>>>>"
    q = answers.select(F.from_json(raw, form)["query"].alias("q"))
    own = q.select(F.explode("q.pages").alias("p")).where("NOT coalesce(p.missing, false)").select("p.title", F.col("p.proofread.quality").alias("level"))
    other = q.select(F.explode("q.normalized").alias("n")).select(F.col("n.from").alias("title"), F.col("n.to").alias("to")).join(own.select(F.col("title").alias("to"), "level"), "to").select("title", "level")
    return own.unionByName(other).distinct()


DIGITS = "".join(chr(z + d) for z in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66) for d in range(10))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of the known scripts as 0 to 9."""
    return F.translate(text, DIGITS, "0123456789" * 11)


def chapters(pages: DataFrame, title: str = "title", wikitext: str = "wikitext", work: str = "work") -> DataFrame:
    """(work, title, number, index, from, to, flags): the scan range of each subpage, and
    what speaks against it: no tag, another scan than most, no number in the title."""
    tag = F.regexp_extract(wikitext, r"(?is)<pages\s+([^<>]*?)/?>", 1)
    part = lambda k: F.nullif(F.regexp_extract(tag, rf'(?i)\b{k}\s*=\s*"?([^"\s>]+)"?', 1), F.lit(""))
    index = F.nullif(F.coalesce(F.nullif(F.regexp_extract(tag, r'(?i)\bindex\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(tag, r"(?i)\bindex\s*=\s*([^\"\s>]+)", 1)), F.lit(""))
    tail = ascii_digits(F.trim(F.element_at(F.split(title, "/"), -1)))
    number = lambda x: F.nullif(F.regexp_extract(ascii_digits(x), r"(\d+)", 1), F.lit("")).cast("int")
    d = pages.select(work, title, F.nullif(F.regexp_extract(tail, r"(\d+)\D*$", 1), F.lit("")).cast("int").alias("number"), index.alias("index"), number(part("from")).alias("from"), number(part("to")).alias("to"))
    most = d.where("index IS NOT NULL").groupBy(work, "index").count()
    most = most.groupBy(work).agg(F.max_by("index", F.struct("count", F.col("index"))).alias("scan"))
    d = d.join(most, work, "left")
    flags = F.array_compact(F.array(F.when(F.col("index").isNull(), "no_tag"), F.when(F.col("index") != F.col("scan"), "other_scan"), F.when(F.col("number").isNull(), "no_number")))
    return d.withColumn("flags", flags)


def missing_chapters(table: DataFrame, work: str = "work") -> DataFrame:
    """(work, number): numbers from 1 to the highest that no chapter without flags has."""
    have = table.where("size(flags) = 0").select(work, "number")
    every = have.groupBy(work).agg(F.max("number").alias("most")).select(work, F.explode(F.sequence(F.lit(1), "most")).alias("number"))
    return every.join(have, [work, "number"], "left_anti")


def page_quality_summary(rendered: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """(key, level, n, first, last): pages of a render by proofreading level, in their order."""
    p = rendered.select(key, F.posexplode(pages).alias("pos", "p")).select(key, "pos", "p.name", "p.level")
    return p.groupBy(key, "level").agg(F.count("*").alias("n"), F.min_by("name", "pos").alias("first"), F.max_by("name", "pos").alias("last"))


def unproofread(rendered: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """Pages at level 1 or 2, or of unknown level."""
    p = rendered.select(key, F.explode(pages).alias("p")).select(key, "p.name", "p.level")
    return p.where("level IS NULL OR level IN (1, 2)")


def acquisition_rows(declared: DataFrame, attempts: DataFrame) -> DataFrame:
    """declared(id, language) with reachable (null: not tried) and bytes of attempts(id, ok, bytes)."""
    tried = attempts.groupBy("id").agg(F.bool_or("ok").alias("reachable"), F.max("bytes").alias("bytes"))
    return declared.join(tried, "id", "left")


def acquisition_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("language").agg(
        F.count("*").alias("declared"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"),
        F.count_if(F.col("reachable").isNull()).alias("not_tried"), F.sum("bytes").alias("bytes"),
    )


def rendered_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    return T.once(pages, r=H.rendered(F.col(html)))
