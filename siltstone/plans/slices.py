"""Queries of the slice build: line rules, markers, cascade, inspection and calibration."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import text as T
from siltstone.operators import neardup, slices as B, stages as S
from siltstone.plans.registry import LATIN, LET, LINES, SUITE, W, g, query

#: one language is declared in another script, so that its lines are foreign
MIXED = {**LATIN, "fr": "devanagari"}
MIXED_LETTER = rf"CASE WHEN lang = 'fr' THEN regexp_matches(line, '[\x{{0900}}-\x{{097F}}]') ELSE {LET.format(t='line')} > 0 END"
FOREIGN = rf"(regexp_matches(line, '\p{{L}}') AND NOT ({MIXED_LETTER}))"
HOT = 5

#: made-up texts of languages that share scripts, for the marker rules
MARKED = [
    (1, "as", "ৰৱৰৱৰ কথা"), (2, "as", "ররররর ৰ"), (3, "bn", "র"), (4, "bn", "ররররররর"), (5, "ur", "ٹڈڑ یہ ےےے"), (6, "ur", "ا" * 60), (7, "ur", "ەۇۆۈ ا"), (8, "ur", "ا ب"),
    (9, "hi", "ळळळ क"), (10, "mr", "ळ क"), (11, "en", "plain"), (12, "ur", "ټډړږ ٹ"), (13, "pa", "architectਾਂ xਾ"), (14, "ur", "ەۇۆ ٹڈڑں"), (15, "hi", "latin कक"), (16, "en", "12 34"),
]
MARKED_SQL = "m(id, lang, text) AS (VALUES " + ", ".join(f"({i}, '{x}', '{t}')" for i, x, t in MARKED) + ")"


def marked(t):
    return t.spark.createDataFrame(MARKED, "id int, lang string, text string")


def sql_marker(name: str) -> str:
    return "len(regexp_extract_all(text, '[" + B.MARKERS[name] + "]'))"


@query("l3_top_script", f"WITH {MARKED_SQL} SELECT id, CASE WHEN regexp_matches(text, '^[^\\p{{L}}]*[a-zA-Z]') AND id <> 15 THEN 'latin' WHEN regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') THEN CASE WHEN id = 15 THEN 'latin' ELSE 'devanagari' END WHEN regexp_matches(text, '[\\x{{0980}}-\\x{{09FF}}]') THEN 'bengali' WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'arabic' ELSE 'common' END AS script FROM m")
def _(t):
    return marked(t).select("id", T.top_script(F.col("text")).alias("script"))


@query("l1_script_counts", "WITH p AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), s AS (SELECT doc_id, CASE WHEN regexp_matches(c, '\\s') OR c = '' THEN NULL WHEN NOT regexp_matches(c, '\\p{L}') THEN 'common' WHEN regexp_matches(c, '[A-Za-zÀ-ɏ]') THEN 'latin' ELSE 'unknown' END AS script FROM p) SELECT doc_id, script, count(*) AS n FROM s WHERE script IS NOT NULL GROUP BY ALL")
def _(t):
    p = T.once(t.documents.select("doc_id", "text"), profile=F.map_from_arrays(F.array(*[F.lit(k) for k in [*T.SCRIPTS, "unknown", "common"]]), F.array(*[T.profile(F.col("text"))[k] for k in [*T.SCRIPTS, "unknown", "common"]])))
    return p.select("doc_id", F.explode("profile").alias("script", "n")).where("n > 0")


@query("b1_foreign_lines", f"WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE {FOREIGN}) AS foreign_lines, CAST(coalesce(sum(length(line)) FILTER (WHERE {FOREIGN}), 0) AS BIGINT) AS foreign_chars FROM s GROUP BY doc_id HAVING count(*) FILTER (WHERE {FOREIGN}) > 0")
def _(t):
    d = B.clean_lines(t.documents, MIXED, 1 << 40)
    return d.where("foreign_lines > 0").select("doc_id", "foreign_lines", "foreign_chars")


@query("b3_clean_lines", rf"""WITH l AS (SELECT doc_id, lang, source, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
 hot AS (SELECT source, line FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= {HOT}),
 c AS (SELECT l.*, hot.line IS NOT NULL AS b, hot.line IS NULL AND {FOREIGN.replace("line,", "l.line,")} AS f FROM l LEFT JOIN hot ON l.source = hot.source AND l.line = hot.line)
 SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT b AND NOT f), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS body_sha, count(*) FILTER (WHERE b) AS boilerplate_lines, count(*) FILTER (WHERE f) AS foreign_lines FROM c GROUP BY doc_id""")
def _(t):
    d = B.clean_lines(t.documents, MIXED, HOT)
    return d.select("doc_id", T.sha(F.col("body")).alias("body_sha"), "boilerplate_lines", "foreign_lines")


LETTERS_SQL = r"len(regexp_extract_all(text, '\p{L}'))"
LABEL = f"""CASE WHEN lang IN ('as', 'bn') THEN CASE WHEN {sql_marker('assamese')} + {sql_marker('bengali')} < 5 THEN 'too_few_markers' WHEN {sql_marker('assamese')} >= 0.5 * ({sql_marker('assamese')} + {sql_marker('bengali')}) THEN 'assamese_like' ELSE 'bengali_like' END
 WHEN lang = 'ur' THEN CASE {" ".join(f"WHEN {sql_marker(x)} >= 3 AND {sql_marker(x)} > {sql_marker('urdu')} THEN '{x}_like'" for x in ('uyghur', 'sindhi', 'pashto'))} WHEN {sql_marker('urdu')} = 0 AND {LETTERS_SQL} >= 50 THEN 'no_urdu_letters' ELSE 'urdu_like' END
 WHEN lang IN ('hi', 'mr') THEN CASE WHEN {sql_marker('marathi_lla')} >= 3 THEN 'has_lla_3plus' ELSE 'lla_0_2' END ELSE 'n/a' END"""


@query("b5_marker_labels", f"WITH {MARKED_SQL} SELECT id, {LABEL} AS label FROM m")
def _(t):
    return marked(t).select("id", B.marker_label(F.col("lang"), F.col("text"), T.known_letters(F.col("text"))).alias("label"))


@query("b6_urdu_drop", f"WITH {MARKED_SQL}, x AS (SELECT id, {LABEL} AS label FROM m) SELECT id, CASE label WHEN 'no_urdu_letters' THEN 'urdu_persian_like' ELSE 'urdu_uyghur_like' END AS reason FROM x WHERE label IN ('no_urdu_letters', 'uyghur_like')")
def _(t):
    d = marked(t).withColumn("label", B.marker_label(F.col("lang"), F.col("text"), T.known_letters(F.col("text"))))
    r = S.first_of(urdu_persian_like=F.col("label") == "no_urdu_letters", urdu_uyghur_like=F.col("label") == "uyghur_like")
    return d.select("id", r.alias("reason")).where("reason IS NOT NULL")


@query("b8_fused_marks", f"WITH {MARKED_SQL} SELECT id, len(regexp_extract_all(text, '[A-Za-z][\\x{{0A01}}-\\x{{0A03}}\\x{{0A3C}}-\\x{{0A4D}}]')) AS fused FROM m")
def _(t):
    return marked(t).select("id", B.fused(F.col("text"), "gurmukhi").alias("fused"))


def built(t):
    d = S.normalize(t.documents).drop("changed")
    return B.build(d, t.benchmark, LATIN, least=HOT)


@query("b9_slice_build")
def _(t):
    return built(t).drop("final")


@query("a2_reason_table")
def _(t):
    return B.reason_table(B.with_near_duplicates(built(t), neardup.clusters))


@query("b10_reviewed_rules")
def _(t):
    d = built(t)
    total = d.groupBy("source").agg(F.sum("chars").alias("total"))
    by = d.where("reason IS NOT NULL").groupBy("source", F.col("reason").alias("rule")).agg(F.sum("chars").alias("n"))
    for kind in ("boilerplate", "foreign"):
        by = by.unionByName(d.groupBy("source").agg(F.sum(f"{kind}_chars").alias("n")).withColumn("rule", F.lit(f"lines:{kind}")))
    return B.review_rows(by.join(total, "source").select("source", "rule", (F.col("n") / F.col("total")).alias("share"))).orderBy("rule")


@query("a4_measured_only", f"WITH k AS (SELECT lang, text, length(text) AS n FROM documents WHERE {LET.format(t='text')} > 0) SELECT lang, count(*) FILTER (WHERE n < 200) AS under_200, CAST(coalesce(sum(n) FILTER (WHERE n < 200), 0) AS BIGINT) AS under_200_chars, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]\\p{{M}}')) AS fused_docs FROM k GROUP BY lang")
def _(t):
    d = T.once(t.documents.select("lang", "text"), n=F.length("text").cast("long"), marks=T.count(F.col("text"), r"[A-Za-z]\p{M}")).where(B.has_letter(F.col("text"), "latin"))
    return d.groupBy("lang").agg(F.count_if(F.col("n") < 200).alias("under_200"), F.coalesce(F.sum(F.when(F.col("n") < 200, F.col("n"))), F.lit(0)).alias("under_200_chars"), F.count_if(F.col("marks") > 0).alias("fused_docs"))


# duplicates ----------------------------------------------------------------------------


def clustered(t):
    return neardup.clusters(t.documents).join(t.documents.select("doc_id", "source", F.col("n_chars").alias("chars")), "doc_id")


@query("d4_near_removals")
def _(t):
    return clustered(t).where("root <> doc_id").select("doc_id", F.col("root").alias("duplicate_of"), "lang", F.lit("near_duplicate").alias("reason"), "chars")


@query("d5_removable_by_type")
def _(t):
    c = clustered(t)
    extra = c.groupBy("lang", "source").agg(F.count_if(F.col("root") != F.col("doc_id")).alias("removable"), F.sum(F.when(F.col("root") != F.col("doc_id"), F.col("chars")).otherwise(0)).alias("chars"))
    return extra


@query("d6_duplicate_chars", "WITH d AS (SELECT lang, text, length(text) AS n, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r FROM documents) SELECT lang, count(*) FILTER (WHERE r > 1) AS docs, CAST(coalesce(sum(n) FILTER (WHERE r > 1), 0) AS BIGINT) AS chars FROM d GROUP BY lang")
def _(t):
    per = t.documents.groupBy("lang", T.sha(F.col("text")).alias("h")).agg(F.count("*").alias("c"), F.min(F.length("text")).cast("long").alias("n"))
    return per.groupBy("lang").agg(F.sum(F.col("c") - 1).alias("docs"), F.sum((F.col("c") - 1) * F.col("n")).alias("chars"))


@query("d1_removal_rows", "WITH f AS (SELECT doc_id, source, first_value(doc_id) OVER w AS first_seen, first_value(source) OVER w AS first_source, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY text ORDER BY source, doc_id)) SELECT doc_id, first_seen, first_source, CASE WHEN source = first_source THEN source ELSE concat(least(source, first_source), '|', greatest(source, first_source)) END AS pair FROM f WHERE r > 1")
def _(t):
    d = S.exact_dedup(t.documents.select("doc_id", "source", "text")).scored.where("reason IS NOT NULL")
    one, two = F.col("source"), F.col("first.o_source")
    pair = F.when(one == two, one).otherwise(F.concat_ws("|", F.least(one, two), F.greatest(one, two)))
    return d.select("doc_id", F.col("first.o_doc_id").alias("first_seen"), two.alias("first_source"), pair.alias("pair"))


# suite ---------------------------------------------------------------------------------


@query("j4_removal_rows", f"WITH {SUITE}, o AS (SELECT gram, min(item_id) AS item FROM bg GROUP BY gram) SELECT doc_id, arg_min(item, pos) AS item, count(DISTINCT dg.gram) AS matched, 'suite_ngram' AS reason FROM dg JOIN o ON dg.gram = o.gram GROUP BY doc_id")
def _(t):
    return S.suite_hits(t.documents, t.benchmark).select("doc_id", "item", F.col("matched_ngrams").alias("matched"), F.lit("suite_ngram").alias("reason"))


@query("j4_suite_coverage", f"WITH {SUITE} SELECT count(*) AS items, count(*) FILTER (WHERE len(w) < 13) AS too_short, (SELECT count(DISTINCT bg.item_id) FROM bg JOIN dg ON bg.gram = dg.gram) AS touched FROM bw")
def _(t):
    items = t.benchmark.agg(F.count("*").alias("items"), F.count_if(F.size(T.words(F.col("text"))) < 13).alias("too_short"))
    touched = S.found_grams(t.documents, t.benchmark).agg(F.countDistinct("item").alias("touched"))
    return items.crossJoin(touched)  # one row each


@query("j7_item_overlap", "SELECT item_id FROM benchmark WHERE regexp_replace(text, '\\s+', ' ', 'g') IN (SELECT regexp_replace(concat(substr(text, 1, length(text))), '\\s+', ' ', 'g') FROM benchmark WHERE item_id % 2 = 0)")
def _(t):
    h = lambda d: d.select("item_id", T.sha(F.regexp_replace("text", r"\s+", " ")).alias("h"))
    return h(t.benchmark).join(h(t.benchmark.where("item_id % 2 = 0")).select("h"), "h", "left_semi").select("item_id")


@query("s24_protected_unpivot", f"WITH q AS (SELECT item_id, text, {W} AS w FROM benchmark), u AS (SELECT item_id, 'passage' AS part, text FROM q UNION ALL SELECT item_id, 'question', array_to_string(w[1:5], ' ') FROM q UNION ALL SELECT item_id, 'option' || k, w[k] FROM q, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) SELECT concat(item_id, '/', part) AS id, nfc_normalize(text) AS text FROM u")
def _(t):
    w = T.words(F.col("text"))
    q = t.benchmark.select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(w, 1, 5), " ").alias("question"), F.slice(w, 1, 4).alias("options"))
    return B.protected_texts(q, "item_id")


# inspection and calibration ------------------------------------------------------------


@query("a31_share_bands", f"WITH s AS (SELECT lang, {LET.format(t='text')} AS l, len(regexp_extract_all(text, '[^\\s]')) AS n FROM documents), b AS (SELECT lang, CASE WHEN n = 0 THEN 'none' WHEN l / n < 0.2 THEN '0.0-0.2' WHEN l / n < 0.4 THEN '0.2-0.4' WHEN l / n < 0.6 THEN '0.4-0.6' WHEN l / n < 0.8 THEN '0.6-0.8' WHEN l / n < 1.0 THEN '0.8-1.0' ELSE '1.0' END AS band FROM s) SELECT lang, band, count(*) AS docs FROM b GROUP BY ALL")
def _(t):
    ink = T.count(F.col("text"), r"(?U)[^\s\x1c-\x1f]")
    d = T.once(t.documents.select("lang", "text"), share=T.letters(F.col("text"), "latin") / F.when(ink > 0, ink))
    return d.groupBy("lang", B.share_band(F.col("share")).alias("band")).agg(F.count("*").alias("docs"))


@query("a31_window_patterns", f"WITH w AS (SELECT source, unnest([substr(text, 1, 5000), substr(text, CAST(floor(length(text) / 2) AS BIGINT) - 2499, 5000), substr(text, length(text) - 4999, 5000)]) AS t, generate_subscripts([1, 2, 3], 1) AS k, doc_id FROM documents WHERE length(text) > 5000), p AS (SELECT doc_id, source, string_agg(CASE WHEN {LET.format(t='t')} >= 0.6 * len(regexp_extract_all(t, '[^\\s]')) THEN 'P' ELSE 'F' END, '' ORDER BY k) AS pattern FROM w GROUP BY ALL) SELECT source, pattern, count(*) AS docs FROM p GROUP BY ALL")
def _(t):
    d = t.documents.where("length(text) > 5000").select("source", B.windows(F.col("text")).alias("w"))
    one = lambda x: F.when(T.letters(x, "latin") >= 0.6 * T.count(x, r"(?U)[^\s\x1c-\x1f]"), "P").otherwise("F")
    return d.groupBy("source", F.array_join(F.transform("w", one), "").alias("pattern")).agg(F.count("*").alias("docs"))


@query("a31_long_documents", "SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE n_chars > 20000 GROUP BY source")
def _(t):
    return t.documents.where("n_chars > 20000").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("a31_short_suite_by_length", f"WITH dw AS (SELECT doc_id, ' ' || array_to_string({W}, ' ') || ' ' AS t FROM documents), bw AS (SELECT item_id, {W} AS w FROM benchmark), s AS (SELECT item_id, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS p FROM bw WHERE len(w) BETWEEN 3 AND 40), h AS (SELECT DISTINCT n, item_id, doc_id FROM dw JOIN s ON contains(t, p)) SELECT CASE WHEN n <= 4 THEN '3-4' WHEN n <= 6 THEN '5-6' WHEN n <= 9 THEN '7-9' WHEN n <= 12 THEN '10-12' ELSE '13-40' END AS bucket, count(DISTINCT item_id) AS items FROM h GROUP BY 1")
def _(t):
    hit = S.found_passages(t.documents, t.benchmark, 3, 40).join(t.benchmark.select(F.col("item_id").alias("item"), F.size(T.words(F.col("text"))).alias("n")), "item")
    n = F.col("n")
    return hit.groupBy(F.when(n <= 4, "3-4").when(n <= 6, "5-6").when(n <= 9, "7-9").when(n <= 12, "10-12").otherwise("13-40").alias("bucket")).agg(F.countDistinct("item").alias("items"))


@query("a31_rule_hits", rf"WITH m AS (SELECT source, text, length(text) AS n FROM documents), r AS (SELECT source, unnest([CASE WHEN len(regexp_extract_all(text, '[0-9]{{5,}}')) >= 1 THEN 'digit_runs' END, CASE WHEN len(regexp_extract_all(text, '\{{\{{|\}}\}}')) > 0 THEN 'template_residue' END, CASE WHEN len(regexp_extract_all(text, 'https?://|www\.')) * 1000.0 / greatest(n, 1) > 2.0 THEN 'url_density' END]) AS rule FROM m) SELECT source, count(*) FILTER (WHERE rule = 'digit_runs') AS digit_runs, count(*) FILTER (WHERE rule = 'template_residue') AS template_residue, count(*) FILTER (WHERE rule = 'url_density') AS url_density FROM r GROUP BY source")
def _(t):
    d = T.once(t.documents.select("source", "text"), runs=T.count(F.col("text"), T.DIGIT_RUN), templates=T.count(F.col("text"), T.TEMPLATE), urls=T.count(F.col("text"), T.URL), n=F.greatest(F.length("text"), F.lit(1)))
    return d.groupBy("source").agg(F.count_if(F.col("runs") >= 1).alias("digit_runs"), F.count_if(F.col("templates") > 0).alias("template_residue"), F.count_if(F.col("urls") * 1000 / F.col("n") > 2.0).alias("url_density"))


@query("a32_inspection", f"WITH s AS (SELECT source, lang, substr(text, 1, 5000) AS t, length(text) AS n FROM documents), v AS (SELECT source, n, {LET.format(t='t')} AS l, len(regexp_extract_all(t, '\\p{{L}}')) AS a FROM s) SELECT source, CASE WHEN a = 0 THEN 'no_letters' WHEN l < 0.6 * a THEN 'mismatch' ELSE 'pass' END AS verdict, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars FROM v GROUP BY ALL")
def _(t):
    head = F.substring("text", 1, 5000)
    d = T.once(t.documents.select("source", "text"), own=T.letters(head, "latin"), every=T.count(head, r"\p{L}"), n=F.length("text").cast("long"))
    verdict = F.when(F.col("every") == 0, "no_letters").when(F.col("own") < 0.6 * F.col("every"), "mismatch").otherwise("pass")
    return d.groupBy("source", verdict.alias("verdict")).agg(F.count("*").alias("docs"), F.sum("n").alias("chars"))


@query("a32_mismatch_scripts", f"WITH {MARKED_SQL} SELECT CASE WHEN id IN (1, 2, 3, 4) THEN 'bengali' WHEN id IN (9, 10) THEN 'devanagari' ELSE 'arabic' END AS script, count(*) AS docs FROM m WHERE id NOT IN (11, 13, 15, 16) GROUP BY 1")
def _(t):
    s = marked(t).select(T.top_script(F.col("text")).alias("script"))
    return s.where("script NOT IN ('latin', 'common')").groupBy("script").agg(F.count("*").alias("docs"))


@query("m9_word_buckets", f"WITH w AS (SELECT len({W}) AS n FROM benchmark) SELECT CASE WHEN n < 3 THEN '0-2' WHEN n <= 4 THEN '3-4' WHEN n <= 6 THEN '5-6' WHEN n <= 9 THEN '7-9' WHEN n <= 12 THEN '10-12' ELSE '13+' END AS bucket, count(*) AS items FROM w GROUP BY 1")
def _(t):
    n = F.size(T.words(F.col("text")))
    return t.benchmark.groupBy(F.when(n < 3, "0-2").when(n <= 4, "3-4").when(n <= 6, "5-6").when(n <= 9, "7-9").when(n <= 12, "10-12").otherwise("13+").alias("bucket")).agg(F.count("*").alias("items"))


@query("a7_top_lines_by_file", f"WITH {LINES}, c AS (SELECT source, line, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, line) AS k FROM c WHERE n >= 2) SELECT source, line, n FROM r WHERE k <= 3")
def _(t):
    c = S.line_counts(t.documents, ["source"]).where("n >= 2")
    return c.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "line"))).where("k <= 3").select("source", "line", "n")
