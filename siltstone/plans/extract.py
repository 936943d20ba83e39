"""Queries of sources: cleaning, rendered pages, payloads, URLs, shapes, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import html as H, text as T
from siltstone.operators import acquisition as Q, sampling as P
from siltstone.plans.registry import W, query
from siltstone.sources import tables as R

STRIPPED = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


@query("s6_jsonl_fields", "SELECT doc_id, lang, length(text) AS chars FROM documents WHERE lang IS NOT NULL")
def _(t):
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    d = t.documents.where("lang IS NOT NULL").select(F.from_json(line, "doc_id bigint, lang string, text string").alias("r"))
    return d.select("r.doc_id", "r.lang", F.length("r.text").cast("long").alias("chars"))


@query("s8_heldout_lines", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en'), s AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en' AND doc_id % 3 = 0), a AS (SELECT line, count(*) AS n FROM l WHERE line <> '' GROUP BY line), b AS (SELECT line, count(*) AS m FROM s WHERE line <> '' GROUP BY line) SELECT count(*) FILTER (WHERE n = m) AS equal, count(*) FILTER (WHERE m IS NULL) AS only_lines, count(*) FILTER (WHERE n > m) AS more FROM a FULL JOIN b ON a.line = b.line")
def _(t):
    lines = lambda d: d.select(F.explode(F.split("text", "\r?\n")).alias("line")).where("line <> ''")
    en = t.documents.where("lang = 'en'")
    m = P.multiset_match(lines(en), lines(en.where("doc_id % 3 = 0")), "line")
    return m.agg(F.count_if(F.col("n") == F.col("m")).alias("equal"), F.count_if(F.col("m") == 0).alias("only_lines"), F.count_if((F.col("n") > F.col("m")) & (F.col("m") > 0)).alias("more"))


@query("s10_gutenberg", f"SELECT doc_id, sha256({STRIPPED.format(t='text')}) AS body_sha FROM documents")
def _(t):
    wrapped = F.concat(F.lit("licence\n" + T.GUTENBERG[0] + " X ***\n"), "text", F.lit("\n" + T.GUTENBERG[1] + " X ***\nmore"))
    return t.documents.select("doc_id", T.sha(T.clean(wrapped, F.lit("gutenberg"))).alias("body_sha"))


@query("s11_clean_by_kind", f"SELECT doc_id, sha256(CASE doc_id % 2 WHEN 0 THEN {STRIPPED.format(t='text')} ELSE {STRIPPED.format(t='text')} END) AS body_sha FROM documents")
def _(t):
    marked = F.concat(F.lit(T.GUTENBERG[0] + "\n"), "text", F.lit(T.GUTENBERG[1]))
    kind, raw = F.when(F.col("doc_id") % 2 == 0, "plain").otherwise("gutenberg"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\r\n"), "text")).otherwise(marked)
    return t.documents.select("doc_id", T.sha(T.clean(raw, kind)).alias("body_sha"))


@query("s13_rendered_pages")
def _(t):
    d = Q.rendered_pages(t.pages.select("page_id", "html"))
    return d.select("page_id", T.sha(F.col("r.text")).alias("text_sha"), F.length("r.text").alias("chars"), "r.n_rows", "r.navigation", "r.is_redirect", F.size("r.artifacts").alias("artifacts"))


@query("s13_rendered_words", "SELECT page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: x <> '')) > 0 AS has_text FROM pages")
def _(t):
    return Q.rendered_pages(t.pages.select("page_id", "html")).select("page_id", (F.size(T.words(F.col("r.text"))) > 0).alias("has_text"))


@query("s14_unpaired_links", "SELECT * FROM (VALUES (1, 'a [[b]] c', 0), (2, 'a b c', 1), (3, ' x [[y]] z', 1), (4, 'plain', 0), (5, 'xy', 3)) v(id, text, removed)")
def _(t):
    rows = t.spark.createDataFrame([(1, "a [[b]] c"), (2, "a b]] c"), (3, " [[x [[y]] z"), (4, "plain"), (5, "]]x]]y[[")], "id int, raw string")
    return rows.select("id", H.without_unpaired(F.col("raw")).alias("c")).select("id", "c.text", "c.removed")


@query("s15_payload_html", "SELECT page_id, true AS ok, sha256(html) AS html_sha, url AS title FROM pages")
def _(t):
    raw = F.to_json(F.struct(F.struct(F.col("url").alias("title"), F.when(F.col("page_id") % 2 == 0, F.lit(None)).alias("none"), F.struct(F.col("html").alias("*")).alias("text")).alias("parse")))
    p = T.once(t.pages.select("page_id", raw.alias("raw")), p=H.payloads(F.col("raw")))
    return p.select("page_id", "p.ok", T.sha(F.col("p.html")).alias("html_sha"), "p.title")


@query("s15_cut_payload", "SELECT page_id, starts_with(html, substr(html, 1, 200)) AS holds, true AS cut FROM pages WHERE length(html) > 400")
def _(t):
    d = t.pages.where("length(html) > 400")
    raw = F.to_json(F.struct(F.struct(F.col("url").alias("title"), F.col("html").alias("text")).alias("parse")))
    p = T.once(d.select("page_id", "html", F.substring(raw, F.lit(1), (F.length(raw) / 2).cast("int")).alias("raw")), p=H.payloads(F.col("raw")))
    return p.select("page_id", F.coalesce(F.startswith("html", F.col("p.html")), F.lit(False)).alias("holds"), "p.cut")


@query("s16_strict_payload", "SELECT page_id, page_id % 3 <> 0 AS has_text FROM pages")
def _(t):
    whole = F.to_json(F.struct(F.struct(F.col("html").alias("text")).alias("parse")))
    raw = F.when(F.col("page_id") % 3 == 0, F.substring(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole)
    return t.pages.select("page_id", (H.strict_text(raw) != "").alias("has_text"))


GOOD = "https://x.org/w/api.php?action=parse&format=json&formatversion=2&prop=text&page=A"
URLS = [
    (1, GOOD, 0), (2, GOOD.replace("https", "http"), 1), (3, GOOD + "&redirects=1", 1), (4, GOOD.replace("&page=A", ""), 1), (5, GOOD + "&oldid=3", 1), (6, "https://x.org/w/index.php", 6),
    (7, GOOD.replace("page=A", "text=%3Cpages%20index%3D%22B%22%20from%3D1%20to%3D2%20%2F%3E&title=T&contentmodel=wikitext"), 0),
    (8, GOOD.replace("page=A", "text=%3Cpages%20index%3D%22B%22%20from%3D3%20to%3D2%20%2F%3E&title=T&contentmodel=wikitext"), 1), (9, GOOD.replace("page=A", "text=hello"), 3), (10, GOOD + "&page=B", 1),
]


@query("s17_url_problems", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {n})" for i, _, n in URLS) + ") v(id, problems)")
def _(t):
    d = t.spark.createDataFrame([(i, u) for i, u, _ in URLS], "id int, url string")
    return d.select("id", F.size(Q.url_problems(F.col("url"))).alias("problems"))


@query("s17_built_urls", "SELECT page_id, 0 AS problems FROM pages")
def _(t):
    return t.pages.select("page_id", F.size(Q.url_problems(Q.page_url(F.lit("x.org"), F.col("url")))).alias("problems"))


@query("s17_range_urls", "SELECT page_id, 0 AS problems FROM pages")
def _(t):
    u = Q.range_url(F.lit("x.org"), F.lit("A work"), F.lit("Scan.pdf"), F.col("page_id"), F.col("page_id") + 3)
    return t.pages.select("page_id", F.size(Q.url_problems(u)).alias("problems"))


@query("s17_quality_batches")
def _(t):
    titles = t.pages.select(F.parse_url("url", F.lit("HOST")).alias("host"), "page_id", F.col("url").alias("title"))
    return Q.quality_urls(titles, "host", "page_id", "title", "https://x.org/w/api.php").select("host", "batch", "n", F.length("url").alias("chars"))


@query("s18_page_levels", "SELECT concat('P', page_id) AS title, CAST(page_id % 5 AS INTEGER) AS level FROM pages UNION ALL SELECT concat('p_', page_id), CAST(page_id % 5 AS INTEGER) FROM pages")
def _(t):
    raw = F.format_string('{"query":{"normalized":[{"from":"p_%d","to":"P%d"}],"pages":[{"title":"P%d","proofread":{"quality":%d}},{"title":"gone%d","missing":true}]}}', "page_id", "page_id", "page_id", F.col("page_id") % 5, "page_id")
    return Q.page_levels(t.pages.select(raw.alias("raw")))


@query("s19_item_checks", "SELECT count(*) AS items, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (WHERE length(text) = 0) AS empty FROM benchmark")
def _(t):
    return t.benchmark.agg(F.count("*").alias("items"), (F.count("*") - F.countDistinct("text")).alias("repeated"), F.count_if(F.length("text") == 0).alias("empty"))


CHAPTERS = [
    ("W", "W/अध्याय १", '<pages index="S.pdf" from=3 to=9 />', 1, 3, 9, 0), ("W", "W/2", '<pages index="S.pdf" from="१०" to="20"/>', 2, 10, 20, 0), ("W", "W/4", "<pages index=Other.pdf from=1 to=2 />", 4, 1, 2, 1),
    ("W", "W/5", "text", 5, None, None, 1), ("W", "W/end", '<pages index="S.pdf" from=30 to=31 />', None, 30, 31, 1), ("W", "W/6", '<pages index="S.pdf" from=32 to=40 />', 6, 32, 40, 0),
]


def chapter_table(t):
    return Q.chapters(t.spark.createDataFrame([x[:3] for x in CHAPTERS], "work string, title string, wikitext string"))


@query("s22_chapters", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(["'" + c[1] + "'"] + ["NULL" if x is None else str(x) for x in c[3:]]) + ")" for c in CHAPTERS) + ') v(title, number, "from", "to", flags)')
def _(t):
    return chapter_table(t).select("title", "number", "from", "to", F.size("flags").alias("flags"))


@query("s22_missing_chapters", "SELECT 'W' AS work, unnest([3, 4, 5]) AS number")
def _(t):
    return Q.missing_chapters(chapter_table(t))


@query("g1_page_shapes", "SELECT * FROM (VALUES (1, true, false, 1, 1), (2, false, false, 6, 0), (3, false, true, 1, 0), (4, false, false, 5, 3), (5, true, false, 2, 0)) v(id, is_redirect, is_sparql_card, lines, link_lines)")
def _(t):
    rows = [(1, "#REDIRECT [[A]]"), (2, "one\ntwo\nthree\n\nfour\nfive\nsix"), (3, "SELECT ?item WHERE { ?item wdt:P31 1 } UNION { }"), (4, "[[A]]\n[[B|c]]\nprose that is long enough [[here]]\n{{t}}\nmore"), (5, "#पुनर्प्रेषित [[लेख यह बहुत लम्बा शीर्षक है जो]]\nx")]
    d = T.once(t.spark.createDataFrame(rows, "id int, text string"), s=Q.wikitext_shape(F.col("text")))
    return d.select("id", "s.is_redirect", "s.is_sparql_card", "s.lines", "s.link_lines")


@query("g1_index_pages", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 5")
def _(t):
    # every line of each tenth document becomes a template, which leaves no prose
    made = F.when(F.col("doc_id") % 10 == 0, F.regexp_replace(F.translate("text", "{}", ""), r"([^\n]+)", "{{$1}}")).otherwise(F.translate("text", "[]{}#", ""))
    d = T.once(t.documents.select("doc_id", made.alias("text")), s=Q.wikitext_shape(F.col("text")))
    return d.where("s.index_page").select("doc_id")


STATUS = [  # id, attempted, fetched, local, cleaned_chars, index_page, has_markup, unproofread, licence_proof, pinned, sha, status
    (1, False, False, False, 0, False, False, 0, None, None, None, "not_attempted"), (2, True, False, False, 0, False, False, 0, None, None, None, "fetch_failed"),
    (3, True, True, False, 0, False, False, 0, "payload-marker", None, None, "empty"), (4, True, True, False, 900, True, True, 0, "payload-marker", None, "a", "index_page_refused"),
    (5, True, True, False, 300, False, True, 0, "payload-marker", None, "a", "index_page_refused"), (6, True, True, False, 900, False, False, 2, "payload-marker", None, "a", "unproofread_refused"),
    (7, True, True, False, 900, False, False, 0, None, None, "a", "licence_marker_missing"), (8, True, True, False, 900, False, False, 0, "licence-evidence", "b", "a", "hash_mismatch"),
    (9, True, True, True, 900, False, False, 0, None, None, "a", "local_unverified"), (10, True, True, False, 900, False, False, 0, "licence-evidence", "a", "a", "verified"),
]


@query("g2_ingestion_status", "SELECT * FROM (VALUES " + ", ".join(f"({x[0]}, '{x[-1]}')" for x in STATUS) + ") v(id, status)")
def _(t):
    form = "id int, attempted boolean, fetched boolean, local boolean, cleaned_chars long, index_page boolean, has_markup boolean, unproofread int, licence_proof string, pinned_sha256 string, sha256 string"
    return Q.ingestion_status(t.spark.createDataFrame([x[:-1] for x in STATUS], form)).select("id", "status")


@query("g4_manifest_problems", "SELECT * FROM (VALUES ('a', 'not_referenced'), ('b', 'licence'), ('b', 'source_url'), ('b', 'sha256'), ('c', 'duplicate'), ('c', 'attribution'), ('c', 'no_slot'), ('d', 'unknown_reference'), ('c', 'verified_without_hash')) v(id, problem)")
def _(t):
    long, h = "an attribution that is long", "0" * 64
    rows = [
        ("a", "en", "CC0", "https://a", "https://l", long, 10, "plain", h, True), ("b", "en", "X", "http://b", "https://l", long, 10, "plain", "zz", False),
        ("c", "zz", "CC0", "https://c", "https://l", "short", 10, "plain", None, True), ("c", "zz", "CC0", "https://c", "https://l", long, 10, "plain", h, True),
    ]
    s = t.spark.createDataFrame(rows, "id string, language string, license_id string, source_url string, license_url string, attribution string, max_chars long, kind string, sha256 string, verified boolean")
    slots = t.spark.createDataFrame([("en", ["b", "c", "d"])], "code string, source_ids array<string>")
    return Q.manifest_problems(s, slots, ["CC0"], ["plain"], 1000)


@query("g5_inspection", r"SELECT page_id, len(regexp_extract_all(html, '</?[a-zA-Z][^<>]{0,200}>')) AS html, len(regexp_extract_all(html, '\{\{|\}\}|\[\[|\]\]|__[A-Z]+__')) AS wiki, len(regexp_extract_all(html, '&(?:#[0-9]{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});')) AS entity, len(regexp_extract_all(html, 'https?://')) AS url, len(regexp_extract_all(html, '\x{FFFD}')) AS replacement, len(regexp_extract_all(html, '[\x{200B}\x{2060}\x{FEFF}\x{AD}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]')) AS invisible FROM pages")
def _(t):
    c = Q.inspection(F.col("html"))
    return t.pages.select("page_id", *[c[k].alias(k) for k in ("html", "wiki", "entity", "url", "replacement", "invisible")])


@query("g5_digit_context")
def _(t):
    return t.documents.select("doc_id", Q.first_context(F.col("text"), "[0-9]{5,}").alias("context")).where("context IS NOT NULL").select("doc_id", T.sha(F.col("context")).alias("context_sha"))


@query("a11_acquisition", "WITH d AS (SELECT doc_id, lang AS language, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 <> 1 END AS ok, n_chars FROM documents) SELECT language, count(*) AS declared, count(*) FILTER (WHERE ok) AS reachable, count(*) FILTER (WHERE NOT ok) AS unreachable, count(*) FILTER (WHERE ok IS NULL) AS not_tried, CAST(sum(n_chars) FILTER (WHERE ok IS NOT NULL) AS BIGINT) AS bytes FROM d GROUP BY language")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    tries = t.documents.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 != 1).alias("ok"), F.col("n_chars").alias("bytes"))
    return Q.acquisition_summary(Q.acquisition_rows(d, tries))


@query("a36_page_quality", "SELECT page_id // 50 AS work, CAST(page_id % 3 AS INTEGER) AS level, count(*) AS n, CAST(min(page_id) AS VARCHAR) AS first, CAST(max(page_id) AS VARCHAR) AS last FROM pages GROUP BY 1, 2")
def _(t):
    page = F.struct("page_id", F.struct(F.col("page_id").cast("string").alias("name"), (F.col("page_id") % 3).cast("int").alias("level")).alias("p"))
    works = t.pages.groupBy(F.floor(F.col("page_id") / 50).cast("long").alias("work")).agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["p"]).alias("pages"))  # a work has 50 pages
    return Q.page_quality_summary(works, "work")


@query("m3_mask_samples", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+', '[email]', 'g'), 'https?://[^\s]+|www\.[^\s]+', '[url]', 'g')) AS masked_sha FROM documents WHERE NOT regexp_matches(text, '[0-9](?:[0-9 \-]*[0-9]){6,}')")
def _(t):
    d = t.documents.where(~F.col("text").rlike(T.SAMPLE_NUMBER))
    return d.select("doc_id", T.sha(T.mask_samples(F.col("text"))).alias("masked_sha"))


@query("m4_sample_excerpt")
def _(t):
    return t.documents.select("doc_id", T.sha(T.excerpt(F.col("text"))).alias("excerpt_sha"))


@query("m5_blake_digests")
def _(t):
    return T.once(t.documents.select("doc_id", "text"), b=T.blake(F.col("text"))).select("doc_id", "b.digest16", "b.line8")


@query("m11_nfc_changes", "SELECT doc_id, nfc_normalize(text) <> text AS nfc_changed, regexp_replace(text, '\\s+', '', 'g') = regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '\\s+', '', 'g') AS white_only FROM documents")
def _(t):
    d = T.once(t.documents.select("doc_id", "text"), n=T.nfc(F.col("text")), m=T.normalize(F.col("text"), "none"))
    bare = lambda x: F.regexp_replace(x, T.WS, "")
    return d.select("doc_id", (F.col("n") != F.col("text")).alias("nfc_changed"), (bare(F.col("text")) == bare(F.col("m"))).alias("white_only"))


@query("m11_removed_characters", "WITH m AS (SELECT concat(text, 'e', chr(769), 'a', chr(778)) AS text FROM documents), a AS (SELECT unnest(string_split(text, '')) AS c FROM m), b AS (SELECT unnest(string_split(nfc_normalize(text), '')) AS c FROM m), x AS (SELECT c, count(*) AS n FROM a GROUP BY c), y AS (SELECT c, count(*) AS n FROM b GROUP BY c) SELECT x.c, x.n - coalesce(y.n, 0) AS removed FROM x LEFT JOIN y ON x.c = y.c WHERE x.n > coalesce(y.n, 0)")
def _(t):
    # only texts that change are taken apart
    made = F.concat("text", F.lit("e\u0301a\u030a"))
    d = T.once(t.documents.select(made.alias("text")), n=T.nfc(F.col("text"))).where("n <> text")
    c = d.select(F.explode(F.split("text", "")).alias("c"), F.lit(1).alias("k")).unionByName(d.select(F.explode(F.split("n", "")).alias("c"), F.lit(-1).alias("k")))
    return c.where("c <> ''").groupBy("c").agg(F.sum("k").alias("removed")).where("removed > 0")


@query("m2_masked_counts", f"SELECT doc_id, len({W}) AS words FROM documents WHERE contains(text, '@')")
def _(t):
    return t.documents.where(F.contains("text", F.lit("@"))).select("doc_id", F.size(T.words(F.col("text"))).alias("words"))


@query("g3_licence_evidence", "SELECT source, count(*) AS docs, count(*) FILTER (WHERE contains(lower(text), 'licen')) AS marked FROM documents GROUP BY source")
def _(t):
    marks = t.spark.createDataFrame([("licen",)], "marker string")
    d = t.documents.select("source", F.lower("text").alias("low")).crossJoin(F.broadcast(marks.agg(F.collect_list("marker").alias("m"))))  # one row of markers
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.exists("m", lambda x: F.contains("low", x))).alias("marked"))



@query("s7_chunked_documents", f"SELECT doc_id, len({W}) AS words, true AS fits FROM documents WHERE len({W}) > 0")
def _(t):
    d = t.documents.select("doc_id", F.explode(T.documents_of(F.col("text"))).alias("x"))
    return d.groupBy("doc_id").agg(F.sum(F.size(T.words(F.col("x")))).alias("words"), (F.max(F.length("x")) <= T.MOST_CHARS).alias("fits"))


@query("s21_synthetic", "SELECT 500 AS docs, true AS same, true AS other")
def _(t):
    a, b, c = (P.synthetic(t.spark, 500, s).agg(F.count("*").alias("n"), F.sum(F.xxhash64("text", "lang").cast("decimal(38,0)")).alias(f"h{k}")) for k, s in enumerate((1, 1, 2)))
    return a.crossJoin(b.drop("n")).crossJoin(c.drop("n")).select(F.col("n").alias("docs"), (F.col("h0") == F.col("h1")).alias("same"), (F.col("h0") != F.col("h2")).alias("other"))  # one row each


@query("s25_open_parts", "SELECT lang AS part, count(*) AS docs FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang")
def _(t):
    parts = {x: t.documents.where(F.col("lang") == x) for x in ("de", "fr")}
    return R.open_parts(parts, {k: R.text_digest(v) for k, v in parts.items()}).groupBy("part").agg(F.count("*").alias("docs"))
