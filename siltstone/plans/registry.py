"""Registered queries of the base library and their DuckDB counterparts.

Each query is declared once: ``@query(name, sql)`` over a function of the tables. Text
columns are compared by sha256, so results stay small and exact.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import text as T
from siltstone.operators import neardup, packing, slices, stages as S, statistics as A, tokens as K
from siltstone.sources import tables

QUERIES: dict = {}
ORACLES: dict = {}
LATIN = {"en": "latin", "de": "latin", "es": "latin", "fr": "latin"}


class Tables:
    """Tables of a folder, read on demand."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


NORMAL = r"regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(13), ''), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
GRAM = "list_transform(range(1, greatest(len(w) - {m}, 0) + 1), lambda k: array_to_string(w[k:k+{m}], ' '))"
LET = r"len(regexp_extract_all({t}, '[A-Za-zªºÀ-ÖØ-öø-ɏ]'))"


def g(n: int) -> str:
    return GRAM.format(m=n - 1)


# scans and projections -----------------------------------------------------------------


@query("s1_parquet_rows", "SELECT doc_id, coalesce(lang, '') AS type, sha256(coalesce(text, '')) AS text_sha FROM documents")
def _(t):
    d = tables.parquet_rows(t.spark, f"{t.folder}/documents.parquet", ("doc_id", "lang", "text"))
    return d.select("doc_id", F.coalesce("lang", F.lit("")).alias("type"), T.sha(F.col("text")).alias("text_sha"))


@query("s2_row_count", "SELECT count(*) AS n FROM documents")
def _(t):
    return t.documents.agg(F.count("*").alias("n"))


@query("s3_documents_of_file", "SELECT concat(source, '-', coalesce(CAST(doc_id AS VARCHAR), 'row000000000')) AS id, lang AS language, length(text) AS chars FROM documents")
def _(t):
    return t.documents.select(F.concat_ws("-", "source", F.coalesce(F.col("doc_id").cast("string"), F.format_string("row%09d", F.monotonically_increasing_id()))).alias("id"), F.col("lang").alias("language"), F.length("text").cast("long").alias("chars"))


@query("s4_pruned_sample", "SELECT doc_id, length(text) AS chars FROM documents WHERE doc_id BETWEEN 100 AND 199 AND lang = 'en'")
def _(t):
    wanted = t.spark.range(100, 200).withColumnRenamed("id", "doc_id")  # the bounds reach the scan, the rows themselves the join
    d = t.documents.where("doc_id BETWEEN 100 AND 199 AND lang = 'en'").join(F.broadcast(wanted), "doc_id", "left_semi")
    return d.select("doc_id", F.length("text").cast("long").alias("chars"))


@query("s7_lines_to_documents", r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
 s AS (SELECT source, doc_id, k, trim(raw, ' ') AS line FROM l WHERE trim(raw, ' ') <> '')
 SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) AS seq, sha256(line) AS line_sha FROM s""")
def _(t):
    lines = t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw")).withColumn("line", T.strip(F.col("raw"))).where("line <> ''")
    return lines.select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "k")).cast("long").alias("seq"), T.sha(F.col("line")).alias("line_sha"))


@query("s9_wikitext_clean", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' *\n *', chr(10), 'g'), '^[\s]+|[\s]+$', '', 'g')) AS clean_sha FROM pages""")
def _(t):
    return t.pages.select("page_id", T.sha(T.clean_wikitext(F.col("html"))).alias("clean_sha"))


@query("s12_trim_at_line", "SELECT doc_id, length(CASE WHEN length(text) <= 500 THEN text WHEN contains(substr(text, 1, 500), chr(10)) THEN substr(text, 1, 500 - instr(reverse(substr(text, 1, 500)), chr(10))) ELSE substr(text, 1, 500) END) AS chars FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length(T.trim_text(F.col("text"), 500)).cast("long").alias("chars"))


@query("s17_url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def _(t):
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))


@query("s24_protected_texts", "SELECT concat('item-', item_id) AS id, nfc_normalize(text) AS text FROM benchmark")
def _(t):
    return t.benchmark.select(F.concat(F.lit("item-"), "item_id").alias("id"), T.nfc(F.col("text")).alias("text"))


@query("m1_normalize", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(13), ''), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_sha FROM documents")
def _(t):
    return t.documents.select("doc_id", T.sha(T.normalize(F.col("text"))).alias("text_sha"))


@query("m2_mask_email", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+')) AS emails, sha256(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+', '[email]', 'g')) AS text_sha FROM documents")
def _(t):
    return t.documents.select("doc_id", T.count(F.col("text"), T.EMAIL).alias("emails"), T.sha(F.regexp_replace("text", T.EMAIL, "[email]")).alias("text_sha"))


@query("m2_mask_contacts")
def _(t):
    return t.documents.select("doc_id", T.count(F.col("text"), T.PHONE).alias("phones"), T.sha(T.mask_contacts(F.col("text"))).alias("text_sha"))


@query("m4_excerpt", r"SELECT doc_id, sha256(substr(array_to_string(list_filter(list_transform(string_split(substr(text, 1, 400), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' / '), 1, 200)) AS excerpt_sha FROM documents")
def _(t):
    e = F.array_join(F.filter(F.transform(F.split(F.substring("text", 1, 400), "\n"), T.strip), lambda x: x != ""), " / ")
    return t.documents.select("doc_id", T.sha(F.substring(e, 1, 200)).alias("excerpt_sha"))


@query("m5_sha256", "SELECT doc_id, sha256(text) AS text_sha FROM documents")
def _(t):
    return t.documents.select("doc_id", T.sha(F.col("text")).alias("text_sha"))


@query("m6_sizes", f"SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, len({W}) AS words, len(string_split(text, chr(10))) AS lines FROM documents")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", F.length(x).cast("long").alias("chars"), F.octet_length(x).cast("long").alias("bytes"), F.size(T.words(x)).cast("long").alias("words"), (T.count(x, "\n") + 1).alias("lines"))


@query("m7_count_words", rf"SELECT doc_id, len(list_filter({W}, lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.filter(T.words(F.col("text")), lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("words"))


@query("m8_windows", "SELECT doc_id, sha256(substr(text, 1, 5000)) AS a, sha256(substr(text, CAST(floor(length(text) / 2) AS BIGINT) - 2499, 5000)) AS b, sha256(substr(text, length(text) - 4999, 5000)) AS c FROM documents WHERE length(text) > 5000")
def _(t):
    w = t.documents.where("length(text) > 5000").select("doc_id", slices.windows(F.col("text")).alias("w"))
    return w.select("doc_id", *[T.sha(F.col("w")[k]).alias(x) for k, x in enumerate("abc")])


@query("m9_length_buckets", "SELECT CASE WHEN n_chars < 500 THEN '0-499' WHEN n_chars < 2000 THEN '500-1999' WHEN n_chars < 10000 THEN '2000-9999' ELSE '10000+' END AS bucket, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(t):
    b = F.when(F.col("n_chars") < 500, "0-499").when(F.col("n_chars") < 2000, "500-1999").when(F.col("n_chars") < 10000, "2000-9999").otherwise("10000+")
    return t.documents.groupBy(b.alias("bucket")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("m12_piece_lengths", f"SELECT doc_id, CAST(list_sum(list_transform({W}, lambda x: strlen(x))) AS BIGINT) AS bytes, CAST(list_sum(list_transform({W}, lambda x: length(x))) AS BIGINT) AS chars FROM documents WHERE len({W}) > 0")
def _(t):
    w = T.words(F.col("text"))
    total = lambda f: F.aggregate(F.transform(w, lambda x: f(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.documents.where(F.size(w) > 0).select("doc_id", total(F.octet_length).alias("bytes"), total(F.length).alias("chars"))


# gates and rules -----------------------------------------------------------------------


@query("l1_script_profile", rf"SELECT doc_id, {LET.format(t='text')} AS latin, len(regexp_extract_all(text, '\p{{L}}')) - {LET.format(t='text')} AS unknown, len(regexp_extract_all(text, '[^\s]')) - len(regexp_extract_all(text, '\p{{L}}')) AS common FROM documents")
def _(t):
    p = T.profile(F.col("text"))
    return t.documents.select("doc_id", p["latin"].alias("latin"), p["unknown"].alias("unknown"), p["common"].alias("common"))


@query("l4_langid_gate", rf"SELECT lang, count(*) AS documents_in, count(*) FILTER (WHERE r IS NULL) AS kept, count(*) FILTER (WHERE r IS NOT NULL) AS removed FROM (SELECT lang, CASE WHEN {LET.format(t='text')} = 0 THEN 'none' END AS r FROM documents) GROUP BY lang")
def _(t):
    return S.langid(t.documents, LATIN).stats()


RULES = rf"""m AS (SELECT *, length(text) AS chars, len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1f\x7f-\x{{9f}}]')) AS controls, len(regexp_extract_all(text, 'https?://|www\.')) AS urls,
 len(regexp_extract_all(text, '\{{\{{|\}}\}}')) AS templates, len(regexp_extract_all(text, '[0-9]{{5,}}')) AS runs, {W} AS w FROM documents),
 q AS (SELECT *, CASE WHEN len(w) >= 2 THEN len(list_distinct({g(2)}))::DOUBLE / (len(w) - 1) END AS ratio,
 CASE WHEN chars < 1 THEN 'min_chars' WHEN chars > 20000 THEN 'max_chars' WHEN controls / greatest(chars, 1) > 0.02 THEN 'control_ratio' END AS reason FROM m)"""


@query("q1_q7_quality_reasons", f"WITH {RULES} SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS docs, CAST(sum(chars) AS BIGINT) AS chars FROM q GROUP BY ALL")
def _(t):
    return S.quality(t.documents).scored.groupBy("lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))


@query("q3_q6_flags", f"WITH {RULES}, f AS (SELECT lang, unnest([CASE WHEN urls * 1000.0 / greatest(chars, 1) > 2.0 THEN 'url_density' END, CASE WHEN templates > 0 THEN 'template_residue' END, CASE WHEN runs >= 1 THEN 'digit_runs' END, CASE WHEN ratio < 0.3 THEN 'repetition' END]) AS flag FROM q WHERE reason IS NULL) SELECT lang, flag, count(*) AS docs FROM f WHERE flag IS NOT NULL GROUP BY ALL")
def _(t):
    return S.quality(t.documents).scored.select("lang", F.explode("flags").alias("flag")).groupBy("lang", "flag").agg(F.count("*").alias("docs"))


@query("q6_repetition", f"WITH {RULES} SELECT doc_id, ratio FROM q")
def _(t):
    return t.documents.select("doc_id", T.repetition(F.col("text")).alias("ratio"))


LINES = "l AS (SELECT doc_id, lang, source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), s AS (SELECT * FROM l WHERE line <> '')"


@query("a6_line_counts", f"WITH {LINES}, c AS (SELECT line, count(*) AS n FROM s GROUP BY line) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_lines, count(*) FILTER (WHERE n >= 10) AS ten, count(*) FILTER (WHERE n >= 100) AS hundred FROM c")
def _(t):
    c = S.line_counts(t.documents)
    return c.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_lines"), F.count_if(F.col("n") >= 10).alias("ten"), F.count_if(F.col("n") >= 100).alias("hundred"))


@query("a7_repeated_lines", f"WITH {LINES}, c AS (SELECT line, count(*) AS n FROM s GROUP BY line), b AS (SELECT unnest([2, 10, 100]) AS least) SELECT CAST(least AS BIGINT) AS least, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(n * length(line)) AS BIGINT) AS chars FROM c JOIN b ON n >= least GROUP BY least")
def _(t):
    c = S.line_counts(t.documents).where("n >= 2").withColumn("least", F.explode(F.expr("filter(array(2L, 10L, 100L), x -> n >= x)")))
    return c.groupBy("least").agg(F.sum("n").alias("lines"), F.sum(F.col("n") * F.length("line")).alias("chars"))


@query("a8_top_boilerplate", f"WITH {LINES} SELECT line, count(*) AS n FROM s GROUP BY line ORDER BY n DESC, line LIMIT 25")
def _(t):
    return S.line_counts(t.documents).orderBy(F.desc("n"), "line").limit(25)


@query("b2_b3_clean_lines", f"WITH {LINES}, hot AS (SELECT line FROM s GROUP BY line HAVING count(*) >= 20), k AS (SELECT doc_id, count(*) AS kept_lines, CAST(sum(length(line)) AS BIGINT) AS kept_chars FROM s WHERE line NOT IN (SELECT line FROM hot) GROUP BY doc_id) SELECT d.doc_id, coalesce(kept_lines, 0) AS kept_lines, coalesce(kept_chars, 0) AS kept_chars FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id")
def _(t):
    hot = S.line_counts(t.documents).where("n >= 20").select("line")
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", T.strip(F.col("raw")).alias("line")).where("line <> ''")
    k = lines.join(hot, "line", "left_anti").groupBy("doc_id").agg(F.count("*").alias("kept_lines"), F.sum(F.length("line").cast("long")).alias("kept_chars"))
    return t.documents.select("doc_id").join(k, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept_lines", "kept_chars")])


@query("b9_reason_cascade", rf"WITH {RULES}, r AS (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.lang = q.lang AND e.text = q.text AND e.doc_id < q.doc_id) THEN 'exact_duplicate' WHEN controls > 0 THEN 'control' WHEN {LET.format(t='text')} = 0 THEN 'no_letters' WHEN templates >= 2 THEN 'markup' WHEN len(w) >= 8 AND ratio < 0.3 THEN 'repetition' ELSE 'kept' END AS reason FROM q) SELECT reason, count(*) AS docs FROM r GROUP BY reason")
def _(t):
    d = S.measured(t.documents).withColumn("first", F.min("doc_id").over(Window.partitionBy("lang", T.sha(F.col("text")))))
    r = S.first_of(exact_duplicate=F.col("doc_id") > F.col("first"), control=F.col("controls") > 0, no_letters=T.letters(F.col("text"), "latin") == 0, markup=F.col("templates") >= 2, repetition=(F.size(T.words(F.col("text"))) >= 8) & (F.col("ratio") < 0.3))
    return d.groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count("*").alias("docs"))


@query("b10_review_bounds", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, sum(n_chars) / (SELECT sum(n_chars) FROM documents) > 0.05 AS review FROM documents GROUP BY source")
def _(t):
    d = t.documents.groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return d.select("source", "chars", (F.col("chars") / F.sum("chars").over(Window.partitionBy()) > 0.05).alias("review"))


@query("g3_licence_marker", "SELECT source, count(*) AS docs FROM documents WHERE contains(lower(substr(text, 1, 50000)), 'licen') GROUP BY source")
def _(t):
    return t.documents.where(F.contains(F.lower(F.substring("text", 1, 50000)), F.lit("licen"))).groupBy("source").agg(F.count("*").alias("docs"))


@query("g5_inspect_pages", r"SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z/][^>]*>')) AS tags, len(regexp_extract_all(html, '&[a-z]+;')) AS entities, len(regexp_extract_all(html, 'https?://')) AS urls FROM pages")
def _(t):
    h = F.col("html")
    return t.pages.select("page_id", T.count(h, "<[a-zA-Z/][^>]*>").alias("tags"), T.count(h, "&[a-z]+;").alias("entities"), T.count(h, "https?://").alias("urls"))


# joins and duplicates ------------------------------------------------------------------

SUITE = f"dw AS (SELECT doc_id, lang, {W} AS w FROM documents), bw AS (SELECT item_id, {W} AS w FROM benchmark), dg AS (SELECT doc_id, lang, unnest({g(13)}) AS gram, generate_subscripts({g(13)}, 1) AS pos FROM dw), bg AS (SELECT DISTINCT item_id, unnest({g(13)}) AS gram FROM bw)"


@query("j1_suite_exact", "WITH b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, text FROM documents WHERE doc_id % 10 = 0) SELECT d.doc_id, min(b.item_id) AS item FROM documents d JOIN b ON d.text = b.text GROUP BY d.doc_id")
def _(t):
    suite = t.benchmark.select("item_id", "text").unionByName(t.documents.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("item_id"), "text"))
    b = suite.groupBy(T.sha(F.col("text")).alias("h")).agg(F.min("item_id").alias("item"))
    return t.documents.select("doc_id", T.sha(F.col("text")).alias("h")).join(b, "h").select("doc_id", "item")


@query("j2_suite_ngram", f"WITH {SUITE}, o AS (SELECT gram, min(item_id) AS item FROM bg GROUP BY gram) SELECT doc_id, count(DISTINCT dg.gram) AS matched_ngrams, arg_min(item, pos) AS item FROM dg JOIN o ON dg.gram = o.gram GROUP BY doc_id")
def _(t):
    return S.suite_hits(t.documents, t.benchmark)


@query("j3_short_passages", f"WITH dw AS (SELECT doc_id, {W} AS w FROM documents), bw AS (SELECT item_id, {W} AS w FROM benchmark), s AS (SELECT item_id, array_to_string(w, ' ') AS passage FROM bw WHERE len(w) BETWEEN 5 AND 20) SELECT doc_id, item_id FROM dw JOIN s ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || passage || ' ')")
def _(t):
    return S.found_passages(t.documents, t.benchmark, 5, 20).select("doc_id", F.col("item").alias("item_id")).distinct()


@query("j4_decontaminate_stage", f"WITH {SUITE}, hit AS (SELECT DISTINCT doc_id FROM dg JOIN bg ON dg.gram = bg.gram) SELECT lang, count(*) AS documents_in, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM hit)) AS kept FROM documents GROUP BY lang")
def _(t):
    hit = S.suite_hits(t.documents, t.benchmark).select("doc_id", F.lit(True).alias("hit"))
    return t.documents.select("doc_id", "lang").join(hit, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents_in"), F.count_if(F.col("hit").isNull()).alias("kept"))


@query("j5_contamination_report", f"WITH {SUITE}, t AS (SELECT DISTINCT gram FROM dg) SELECT count(*) AS items, count(*) FILTER (WHERE len(w) >= 13) AS eligible, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM bg JOIN t ON bg.gram = t.gram WHERE bg.item_id = bw.item_id)) AS contaminated FROM bw")
def _(t):
    items = t.benchmark.select("item_id", F.size(T.words(F.col("text"))).alias("n"))
    grams = S.found_grams(t.documents, t.benchmark).select("gram").distinct()
    hit = S.suite_grams(t.benchmark, "item_id", "text").join(grams, "gram", "left_semi").select(F.col("item").alias("item_id"), F.lit(True).alias("hit")).distinct()
    return items.join(hit, "item_id", "left").agg(F.count("*").alias("items"), F.count_if(F.col("n") >= 13).alias("eligible"), F.count_if("hit").alias("contaminated"))


@query("j7_exact_overlap", "SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 1)")
def _(t):
    d = t.documents.select("doc_id", T.sha(F.col("text")).alias("h"))
    return d.where("doc_id % 2 = 0").select("h").distinct().join(d.where("doc_id % 2 = 1").select("h"), "h", "left_semi")


@query("j8_cross_file_duplicates", "WITH d AS (SELECT doc_id, lang, source, min(source) OVER (PARTITION BY lang, text) AS first FROM documents) SELECT source, count(*) AS docs FROM d WHERE source > first GROUP BY source")
def _(t):
    d = t.documents.select("lang", "source", T.sha(F.col("text")).alias("h"))
    first = d.groupBy("lang", "h").agg(F.min("source").alias("first"))
    return d.join(first, ["lang", "h"]).where("source > first").groupBy("source").agg(F.count("*").alias("docs"))


@query("j9_prior_corpus", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def _(t):
    d = t.documents.select("doc_id", T.sha(F.col("text")).alias("h"))
    return d.where("doc_id % 2 = 1").join(d.where("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("j13_dimension_lookup", "SELECT lang, 'latin' AS script, count(*) AS docs FROM documents GROUP BY lang")
def _(t):
    dim = t.spark.createDataFrame(sorted(LATIN.items()), "lang string, script string")
    return t.documents.join(dim, "lang", "left").groupBy("lang", "script").agg(F.count("*").alias("docs"))


@query("j15_division", "SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)")
def _(t):
    have = t.documents.groupBy("source").agg(F.countDistinct("lang").alias("n"))
    return have.join(t.documents.agg(F.countDistinct("lang").alias("n")), "n").select("source")


@query("d1_exact_dedup", "WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents) SELECT source, lang, count(*) AS documents_in, count(*) FILTER (WHERE rn = 1) AS kept FROM d GROUP BY ALL")
def _(t):
    d = S.exact_dedup(t.documents).scored
    return d.groupBy("source", "lang").agg(F.count("*").alias("documents_in"), F.count_if(F.col("reason").isNull()).alias("kept"))


@query("d1b_exact_in_language", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def _(t):
    d = t.documents.select("doc_id", "lang", T.sha(F.col("text")).alias("h"))
    first = d.groupBy("lang", "h").agg(F.min("doc_id").alias("first"))
    return d.join(first, ["lang", "h"]).where("doc_id > first").select("doc_id")


@query("d6_duplicate_stats", "SELECT lang, count(*) - count(DISTINCT text) AS docs_beyond_first FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg((F.count("*") - F.countDistinct(T.sha(F.col("text")))).alias("docs_beyond_first"))


@query("d2_d4_near_duplicates")
def _(t):
    return neardup.clusters(t.documents)


# aggregates ----------------------------------------------------------------------------


def pilot_stage_table(spark, sf_dir):
    """Normalise, gate, quality, exact dedup: documents and characters in and kept, changed
    documents and bytes kept, by language. Texts are read once; duplicates meet by hash,
    as one row for each text and language."""
    docs = S.normalize(Tables(spark, sf_dir).documents.select("doc_id", "lang", "source", "text"))
    gate = S.langid(docs, LATIN).scored.withColumnRenamed("reason", "gate").drop("declared", "letters")
    q = S.quality(gate).scored.withColumn("ok", F.col("gate").isNull() & F.col("reason").isNull())
    d = q.select("lang", "ok", "chars", "changed", T.sha(F.col("text")).alias("h"), F.octet_length("text").cast("long").alias("bytes"), F.struct("source", "doc_id").alias("at"))
    per = d.groupBy("h", "lang").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.min(F.when(F.col("ok"), F.struct("at", "chars", "bytes"))).alias("own"))
    first = F.min("own").over(Window.partitionBy("h"))
    kept = F.col("own").isNotNull() & (F.col("own") == F.col("first"))
    return per.withColumn("first", first).groupBy("lang").agg(
        F.sum("n").alias("documents_in"), F.sum("changed").alias("changed"), F.count_if(kept).alias("kept"),
        F.sum(F.when(kept, F.col("own.chars"))).alias("chars"), F.sum(F.when(kept, F.col("own.bytes"))).alias("bytes"),
    )


ORACLES["a1_pilot_stages"] = f"WITH raw AS (SELECT * FROM main.documents), documents AS (SELECT * EXCLUDE (text), text AS original, {NORMAL} AS text FROM raw), {RULES}, k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM q WHERE reason IS NULL AND {LET.format(t='text')} > 0) SELECT d.lang, count(*) AS documents_in, (SELECT count(*) FROM k WHERE k.lang = d.lang AND rn = 1) AS kept, (SELECT CAST(sum(chars) AS BIGINT) FROM k WHERE k.lang = d.lang AND rn = 1) AS chars, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM k WHERE k.lang = d.lang AND rn = 1) AS bytes, count(*) FILTER (WHERE text <> original) AS changed FROM documents d GROUP BY d.lang"
QUERIES["a1_pilot_stages"] = pilot_stage_table


@query("a2_removals_by_reason", f"WITH {RULES}, r AS (SELECT unnest(['min_chars', 'max_chars', 'control_ratio']) AS reason) SELECT r.reason, count(q.doc_id) AS docs, CAST(coalesce(sum(q.chars), 0) AS BIGINT) AS chars FROM r LEFT JOIN q ON r.reason = q.reason GROUP BY r.reason")
def _(t):
    dim = t.spark.createDataFrame([(x,) for x in S.REJECTS], "reason string")
    got = S.quality(t.documents).removed.groupBy("reason").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))
    return dim.join(got, "reason", "left").select("reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "chars")])


@query("a3_rollup_by_type", "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS type, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def _(t):
    return t.documents.rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("type"), "docs", "chars")


@query("a5_nearest_rank_quantiles", "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), q AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS q) SELECT lang, q, n_chars AS value FROM r JOIN q ON i = least(n - 1, CAST(floor(q * n + 0.5) AS BIGINT))")
def _(t):
    return A.nearest_ranks(t.documents, "lang", "n_chars", [0.01, 0.25, 0.5, 0.75, 0.99])


@query("a9_language_statistics", "SELECT l.lang, count(d.doc_id) AS documents, count(DISTINCT d.source) AS sources, count(DISTINCT d.text) AS unique_texts, count(d.doc_id) - count(DISTINCT d.text) AS duplicates FROM (SELECT unnest(['en', 'de', 'es', 'fr', 'hi']) AS lang) l LEFT JOIN documents d ON d.lang = l.lang GROUP BY l.lang")
def _(t):
    slots = t.spark.createDataFrame([(x,) for x in ("en", "de", "es", "fr", "hi")], "lang string")
    d = t.documents.select("lang", "doc_id", "source", T.sha(F.col("text")).alias("h"))
    return slots.join(d, "lang", "left").groupBy("lang").agg(F.count("doc_id").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("h").alias("unique_texts"), (F.count("doc_id") - F.countDistinct("h")).alias("duplicates"))


@query("a10_coverage_status", "SELECT lang, CASE WHEN count(*) >= 120 THEN 'EVALUATED' WHEN count(*) > 0 THEN 'INSUFFICIENT' ELSE 'NOT_EVALUATED' END AS status FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.when(F.count("*") >= 120, "EVALUATED").when(F.count("*") > 0, "INSUFFICIENT").otherwise("NOT_EVALUATED").alias("status"))


@query("a12_word_token_block", r"WITH k AS (SELECT lang, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|\s+|.')) AS toks FROM documents) SELECT coalesce(lang, 'all') AS lang, count(*) AS examples, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(toks) AS BIGINT) AS tokens, sum(toks) / sum(chars) AS tokens_per_char FROM k GROUP BY GROUPING SETS ((), (lang))")
def _(t):
    k = t.documents.select("lang", F.length("text").cast("long").alias("chars"), T.count(F.col("text"), T.WORD_TOKEN).alias("toks"))
    out = k.rollup("lang").agg(F.count("*").alias("examples"), F.sum("chars").alias("chars"), F.sum("toks").alias("tokens"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "examples", "chars", "tokens", (F.col("tokens") / F.col("chars")).alias("tokens_per_char"))


@query("a17_mean_stdev", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 4) AS sd, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 4).alias("sd"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("a18_wilson", "WITH c AS (SELECT d.lang, sum(quality) AS k, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang), z AS (SELECT *, 1.959963984540054 AS z FROM c) SELECT lang, CAST(n AS BIGINT) AS n, round((k/n + z*z/(2*n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)))/(1+z*z/n), 9) AS lo, round((k/n + z*z/(2*n) + z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n)))/(1+z*z/n), 9) AS hi FROM z")
def _(t):
    c = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = A.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("a20_ngram_coverage", f"WITH {SUITE}, t AS (SELECT DISTINCT gram FROM dg) SELECT bg.item_id, count(*) AS grams, count(t.gram) AS found, count(t.gram) / count(*) >= 0.7 AS substantially FROM bg LEFT JOIN t ON bg.gram = t.gram GROUP BY bg.item_id")
def _(t):
    corpus = S.found_grams(t.documents, t.benchmark).select("gram").distinct().withColumn("hit", F.lit(True))
    s = S.suite_grams(t.benchmark, "item_id", "text").join(corpus, "gram", "left").groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("grams"), F.count_if("hit").alias("found"))
    return s.withColumn("substantially", F.col("found") / F.col("grams") >= 0.7)


@query("a21_sample_estimate", "SELECT lang, count(*) AS n, round(avg(n_chars) * 1000, 4) AS estimate, round(1.96 * 1000 * stddev_samp(n_chars) / sqrt(count(*)), 4) AS half_width FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars") * 1000, 4).alias("estimate"), F.round(1.96 * 1000 * F.stddev_samp("n_chars") / F.sqrt(F.count("*")), 4).alias("half_width"))


@query("a24_passage_keys", "SELECT sha256(text) AS h, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) AS keys FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    d = t.documents.groupBy(T.sha(F.col("text")).alias("h")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "|").alias("keys"), F.count("*").alias("n"))
    return d.where("n > 1").select("h", "keys")


@query("a29_sampling_shares", "SELECT source, sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY source")
def _(t):
    d = t.documents.groupBy("source").agg(F.sum("n_chars").alias("n"))
    return d.select("source", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("a15_bootstrap")
def _(t):
    d = t.documents.select("lang", "doc_id", F.col("n_chars").cast("double").alias("x"), F.octet_length("text").cast("double").alias("y"))
    return A.bootstrap(d, "lang", "x", "y", "doc_id")


# splits, samples, packing --------------------------------------------------------------

SPLIT = "CAST(('0x' || substr(sha256(concat('1337:', sha256(text))), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE < 0.1"


@query("p1_content_split", f"SELECT doc_id, CASE WHEN {SPLIT} THEN 'heldout' ELSE 'train' END AS side FROM documents")
def _(t):
    return S.content_split(t.documents).select("doc_id", "side")


@query("a33_split_side_stats", f"WITH s AS (SELECT lang, n_chars, CASE WHEN {SPLIT} THEN 'heldout' ELSE 'train' END AS side FROM documents) SELECT side, coalesce(lang, 'all') AS lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM s GROUP BY GROUPING SETS ((side), (side, lang))")
def _(t):
    d = S.content_split(t.documents).rollup("side", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return d.where("side IS NOT NULL").select("side", F.coalesce("lang", F.lit("all")).alias("lang"), "docs", "chars")


@query("p2_id_validation", "SELECT doc_id, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 1000000 < 5000 AS validation FROM documents")
def _(t):
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return t.documents.select("doc_id", (F.pmod(h, F.lit(1000000).cast("decimal(20,0)")) < 5000).alias("validation"))


@query("p3_char_budget_shards")
def _(t):
    return packing.budget_shards(t.documents.select("lang", "doc_id", F.length("text").cast("long").alias("chars")), "lang", "doc_id", "chars", 50_000)


@query("p4_hash_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('1337', doc_id)), doc_id) AS pos FROM documents")
def _(t):
    k = F.sha2(F.concat(F.lit("1337"), F.col("doc_id").cast("string")), 256)
    return t.documents.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(k, "doc_id")).cast("long").alias("pos"))


@query("p5_stratum_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('p5/', doc_id)), doc_id) AS r FROM documents) WHERE r <= 20")
def _(t):
    k = F.sha2(F.concat(F.lit("p5/"), F.col("doc_id").cast("string")), 256)
    return S.ranked(t.documents.select("lang", "doc_id"), "lang", k, F.col("doc_id")).where("rank <= 20").select("lang", "doc_id")


@query("p6_quota_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 50")
def _(t):
    return S.ranked(t.documents.select("lang", "doc_id"), "lang", F.col("doc_id")).where("rank <= 50").select("lang", "doc_id")


@query("p8_every_nth", "WITH e AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS before FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, lang FROM e WHERE before < 30000")
def _(t):
    before = F.sum("n_chars").over(Window.partitionBy("lang").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_chars")
    return t.documents.where("doc_id % 5 = 0").select("doc_id", "lang", before.alias("before")).where("before < 30000").select("doc_id", "lang")


@query("p15_hash_chosen_source", "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source FROM s WHERE i = ('0x' || substr(sha256('p15/documents'), 1, 8))::UBIGINT % n")
def _(t):
    s = t.documents.select("source").distinct()
    w = Window.orderBy("source")  # one row per source
    pick = F.pmod(F.conv(F.substring(F.sha2(F.lit("p15/documents"), 256), 1, 8), 16, 10).cast("long"), F.col("n"))
    return s.select("source", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n")).where(F.col("i") == pick).select("source")


# tokens --------------------------------------------------------------------------------


@query("t1_char_vocabulary", "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def _(t):
    return K.char_counts(t.documents)


@query("t2_word_vocabulary", r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 32000")
def _(t):
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(32_000)


@query("t3_mark_aware_pretokens", r"SELECT doc_id, len(regexp_extract_all(text, '\s+|[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]+')) AS pretokens FROM documents")
def _(t):
    return t.documents.select("doc_id", T.count(F.col("text"), T.PRETOKEN).alias("pretokens"))


@query("t5_bpe_train")
def _(t):
    merges = K.train_bpe(t.documents, 60)
    return t.spark.createDataFrame([(i, a.hex(), b.hex()) for i, (a, b) in enumerate(merges)], "rank int, left_bytes string, right_bytes string")


@query("t6_bpe_encode")
def _(t):
    e = K.encode_bpe(t.documents, K.train_bpe(t.documents, 60))
    return e.select("doc_id", F.size("ids").alias("n_tokens"), T.sha(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids_sha"))
