"""Queries of evaluation tables: token scans, scores, comparisons, fits, run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation as E, stages as S
from siltstone.plans.registry import SPLIT, SUITE, W, query

#: token ids of these queries: the first 15 bits of a word's hash, the same in both engines
IDS = f"list_transform({W}, lambda x: ('0x' || substr(sha256(x), 1, 4))::INTEGER)"
TOKENS = f"dt AS (SELECT doc_id, {IDS} AS ids FROM documents), bt AS (SELECT item_id, {IDS} AS ids FROM benchmark)"
GRAM5 = "list_transform(range(1, greatest(len(ids) - 4, 0) + 1), lambda k: ids[k:k+4])"


def ids(text="text"):
    return F.transform(T.words(F.col(text)), lambda x: F.conv(F.substring(F.sha2(x, 256), 1, 4), 16, 10).cast("int"))


def tokens(t):
    return t.documents.select("doc_id", ids().alias("ids")), t.benchmark.select("item_id", ids().alias("ids"))


@query("j10_token_scan", f"WITH {TOKENS}, g AS (SELECT doc_id, unnest({GRAM5}) AS gram, unnest(range(0, greatest(len(ids) - 4, 0))) AS pos FROM dt), b AS (SELECT DISTINCT item_id, unnest({GRAM5}) AS gram FROM bt), h AS (SELECT b.item_id, g.doc_id, g.pos, g.gram FROM g JOIN b ON g.gram = b.gram), s AS (SELECT item_id, count(*) AS windows, min((doc_id, pos)) AS f, count(DISTINCT gram) AS found FROM h GROUP BY item_id), n AS (SELECT item_id, count(*) AS total FROM b GROUP BY item_id) SELECT n.item_id, coalesce(windows, 0) AS windows, s.f[1] AS first_key, CAST(s.f[2] AS INTEGER) AS first_pos, coalesce(found, 0) AS found, total FROM n LEFT JOIN s ON n.item_id = s.item_id")
def _(t):
    d, b = tokens(t)
    return E.token_scan(d, b, "doc_id", "item_id", n=5)


@query("a20_histogram", f"WITH {SUITE}, t AS (SELECT DISTINCT gram FROM dg), c AS (SELECT bg.item_id, count(*) AS total, count(t.gram) AS found FROM bg LEFT JOIN t ON bg.gram = t.gram GROUP BY bg.item_id) SELECT CASE WHEN found = 0 THEN 'none' ELSE CAST(least(9, CAST(floor(found / total * 10) AS INTEGER)) AS VARCHAR) END AS bin, count(*) AS texts FROM c GROUP BY 1")
def _(t):
    corpus = S.found_grams(t.documents, t.benchmark).select("gram").distinct().withColumn("hit", F.lit(True))
    c = S.suite_grams(t.benchmark, "item_id", "text").join(corpus, "gram", "left").groupBy("item").agg(F.count("*").alias("total"), F.count_if("hit").alias("found"))
    return E.coverage_histogram(c)


@query("j11_flagged_questions", f"WITH {SUITE}, hit AS (SELECT DISTINCT bg.item_id FROM bg JOIN dg ON bg.gram = dg.gram) SELECT item_id // 4 AS item, bool_or(item_id IN (SELECT item_id FROM hit)) AS flagged, count(*) FILTER (WHERE len(w) < 13) AS too_short FROM bw GROUP BY 1")
def _(t):
    parts = t.benchmark.select(F.col("item_id").alias("id"), F.floor(F.col("item_id") / 4).cast("long").alias("item"), F.size(T.words(F.col("text"))).alias("n"))
    grams = S.found_grams(t.documents, t.benchmark).select("gram").distinct()
    hits = S.suite_grams(t.benchmark, "item_id", "text").join(grams, "gram", "left_semi").select(F.col("item").alias("id")).distinct()
    return E.flagged_questions(parts, hits)


@query("j6_leakage", f"WITH s AS (SELECT *, {W} AS w, {SPLIT} AS held FROM documents), n AS (SELECT CAST(floor(2000 / count(DISTINCT lang)) AS BIGINT) AS quota FROM s WHERE NOT held), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM s WHERE NOT held), g AS (SELECT doc_id, held, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k+7], ' ')) ELSE list_transform(range(1, greatest(length(array_to_string(w, '')) - 6, 1)), lambda k: substr(array_to_string(w, ''), k, 8)) END) AS gram FROM s), tg AS (SELECT DISTINCT gram FROM g WHERE doc_id IN (SELECT doc_id FROM r)) SELECT doc_id, text IN (SELECT text FROM s WHERE NOT held) AS exact, doc_id IN (SELECT doc_id FROM g WHERE held AND gram IN (SELECT gram FROM tg)) AS overlap FROM s WHERE held")
def _(t):
    d = S.content_split(t.documents)
    return E.leakage(d.where("side = 'train'"), d.where("side = 'heldout'"))


@query("j14_aligned_scores", "SELECT doc_id, CAST(n_chars AS DOUBLE) AS a, CAST(n_chars + 1 AS DOUBLE) AS b FROM documents")
def _(t):
    one = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("v"))
    return E.aligned(one, one.withColumn("v", F.col("v") + 1), "doc_id", "v")


@query("j14_mismatched_scores", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'a' ELSE 'b' END AS side FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 AND doc_id % 7 <> 0")
def _(t):
    return E.mismatched(t.documents.where("doc_id % 11 <> 0 OR doc_id % 7 = 0").select("doc_id"), t.documents.where("doc_id % 7 <> 0").select("doc_id"), "doc_id")


@query("j16_cross_check", "SELECT source AS name, 'missing' AS problem FROM documents GROUP BY source HAVING count(*) FILTER (WHERE doc_id % 50 = 0) = 0 AND min(doc_id) >= 0 UNION ALL SELECT 'nowhere', 'unreferenced'")
def _(t):
    d = t.documents.select(F.col("source").alias("name"), "doc_id")
    extra = t.spark.createDataFrame([("nowhere",)], "name string")
    return E.cross_check(d.select("name"), d.where("doc_id % 50 = 0").select("name").unionByName(extra), "name")


@query("j16_steps", "SELECT * FROM (VALUES ('a', 3), ('a', 4)) v(plan, ord)")
def _(t):
    return E.steps_out_of_order(t.spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, True), ("b", 2, False)], "plan string, ord int, done boolean"))


@query("j17_suite_identity", "SELECT item_id AS ord FROM benchmark WHERE item_id = 7")
def _(t):
    other = t.benchmark.withColumn("text", F.when(F.col("item_id").isin(7, 9), "changed").otherwise(F.col("text")))
    return E.identical_in_order(t.benchmark, other, "item_id", ["text"]).select("ord")


@query("j18_frozen_counts", "SELECT source, lang FROM documents WHERE doc_id IN (3, 5) GROUP BY ALL")
def _(t):
    d = t.documents.select("doc_id", "source", "lang", F.col("n_chars").alias("chars"))
    return E.count_differences(d, d.where("doc_id NOT IN (3, 5)"), ["source", "lang"]).select("source", "lang")


@query("j19_subsets", "SELECT name, split_part(name, '_', 1) AS code, CASE WHEN name LIKE '%\\_removed' ESCAPE '\\' THEN 'removed' WHEN split_part(name, '_', 1) IN ('hin', 'ben') THEN 'selected' ELSE 'other' END AS status FROM (SELECT unnest(['hin_Deva', 'ben_Beng', 'eng_Latn', 'hin_Deva_removed']) AS name)")
def _(t):
    names = t.spark.createDataFrame([("hin_Deva",), ("ben_Beng",), ("eng_Latn",), ("hin_Deva_removed",)], "name string")
    return E.matched_subsets(names, t.spark.createDataFrame([("hin",), ("ben",)], "code string"))


# scores: bits are made of the documents' sizes -------------------------------------------

BITS = "(doc_id % 13 + 1) * 10.0"


def scores(t):
    return t.documents.select("doc_id", "lang", "source", ((F.col("doc_id") % 13 + 1) * 10.0).alias("bits"), F.col("n_chars").cast("double").alias("bytes"))


@query("a14_bits_per_byte", f"SELECT lang, source, count(*) AS documents, sum({BITS})::DOUBLE AS bits, sum(n_chars)::DOUBLE AS units, sum({BITS})::DOUBLE / nullif(sum(n_chars), 0) AS ratio FROM documents GROUP BY GROUPING SETS ((), (lang), (lang, source))")
def _(t):
    return E.bits_per_unit(scores(t), [[], ["lang"], ["lang", "source"]])


@query("a16_paired_delta")
def _(t):
    d = scores(t).select("lang", "doc_id", F.col("bits").alias("a"), (F.col("bits") * F.when(F.col("lang") == "en", 1.1).when(F.col("lang") == "de", 0.9).otherwise(1 + (F.col("doc_id") % 3 - 1) * 0.2)).alias("b"), F.col("bytes").alias("units"))
    return E.paired_delta(d, "lang", "doc_id")


@query("a16_verdicts", "SELECT * FROM (VALUES ('de', 'better'), ('en', 'worse')) v(lang, verdict)")
def _(t):
    d = scores(t).where("lang IN ('en', 'de')").select("lang", "doc_id", F.col("bits").alias("a"), (F.col("bits") * F.when(F.col("lang") == "en", 1.1).otherwise(0.9)).alias("b"), F.col("bytes").alias("units"))
    return E.paired_delta(d, "lang", "doc_id").select("lang", "verdict")


@query("a19_pooled_parts", f"WITH p AS (SELECT lang, doc_id % 3 AS part, sum({BITS})::DOUBLE AS b, sum(n_chars)::DOUBLE AS n FROM documents GROUP BY 1, 2) SELECT lang, part, b / nullif(n, 0) AS ratio, sum(b) OVER (PARTITION BY lang) / nullif(sum(n) OVER (PARTITION BY lang), 0) AS pooled FROM p")
def _(t):
    d = scores(t).withColumn("part", F.col("doc_id") % 3)
    parts = d.groupBy("lang", "part").agg(F.sum("bits").alias("b"), F.sum("bytes").alias("n"))
    pooled = parts.groupBy("lang").agg((F.sum("b") / F.nullif(F.sum("n"), F.lit(0))).alias("pooled"))
    return parts.join(pooled, "lang").select("lang", "part", (F.col("b") / F.nullif(F.col("n"), F.lit(0))).alias("ratio"), "pooled")


@query("a22_loss_summary", f"WITH n AS (SELECT doc_id, {BITS} / 5 AS nats, CASE WHEN n_chars > 100 THEN 0.3 END AS tpb FROM documents) SELECT doc_id, nats::DOUBLE AS val_loss, round(exp(least(nats, 20.0)), 4) AS val_ppl, (nats / ln(2))::DOUBLE AS bits_per_token, (nats / ln(2) * tpb)::DOUBLE AS bits_per_byte, NULL::DOUBLE AS bits_per_char FROM n")
def _(t):
    d = scores(t).select("doc_id", (F.col("bits") / 5).alias("nats"), F.when(F.col("bytes") > 100, 0.3).alias("tpb"))
    s = E.loss_summary(F.col("nats"), F.col("tpb"), F.lit(0.0))
    return d.select("doc_id", *[(F.round(v, 4) if k == "val_ppl" else v).alias(k) for k, v in s.items()])


@query("a23_document_bits", "WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS x FROM documents) SELECT doc_id, count(*) AS tokens, round(sum(length(x)) / ln(2), 6) AS bits FROM w WHERE length(x) % 5 <> 0 GROUP BY doc_id")
def _(t):
    n = F.length("x")
    d = t.documents.select(F.col("doc_id").alias("doc"), F.explode(T.words(F.col("text"))).alias("x")).select("doc", F.when(n % 5 == 0, F.lit(float("nan"))).otherwise(n.cast("double")).alias("nats"))
    return E.token_bits(d).select(F.col("doc").alias("doc_id"), "tokens", F.round("bits", 6).alias("bits"))


@query("a18_option_choice", "WITH o AS (SELECT item_id, k, (item_id * 7 + k * 3) % 5 AS s FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT item_id, CAST(min(k) AS INTEGER) AS choice FROM o WHERE s = (SELECT max(s) FROM o p WHERE p.item_id = o.item_id) GROUP BY item_id")
def _(t):
    d = t.benchmark.select("item_id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    return E.best_option(d, "item_id", "k", (F.col("item_id") * 7 + F.col("k") * 3) % 5)


REPORTS = [("char", 0, "c1", 1.0, 1.0, 5.0, 0.0, 0), ("word", 1, "c1", 0.3, 3.3, 1.2, 0.1, 9), ("bpe", 2, "c1", 0.4, 2.5, 1.9, 0.0, 0)]


@query("a13_comparison", "SELECT * FROM (VALUES ('tokens_per_char', 'bpe', 0.4), ('chars_per_token', 'bpe', 2.5), ('tokens_per_word', 'bpe', 1.9), ('unk_rate', 'char', 0.0), ('round_trip_failures', 'char', 0.0)) v(metric, tokenizer, value)")
def _(t):
    form = "label string, ord int, corpus string, tokens_per_char double, chars_per_token double, tokens_per_word double, unk_rate double, round_trip_failures int"
    return E.compare(t.spark.createDataFrame(REPORTS, form))


@query("a12_word_compression", f"WITH k AS (SELECT lang, source, length(text) AS chars, strlen(text) AS bytes, len({W}) AS words, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|\\s+|.')) AS toks FROM documents) SELECT lang, source, count(*) AS examples, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(words) AS BIGINT) AS words, CAST(sum(toks) AS BIGINT) AS tokens, sum(chars) / sum(toks) AS chars_per_token, sum(toks) / nullif(sum(words), 0) AS tokens_per_word FROM k GROUP BY GROUPING SETS ((), (lang), (source))")
def _(t):
    x = F.col("text")
    k = T.once(t.documents.select("lang", "source", "text"), chars=F.length(x).cast("long"), bytes=F.octet_length(x).cast("long"), words=F.size(T.words(x)).cast("long"), toks=T.count(x, T.WORD_TOKEN))
    out = k.drop("text").groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("examples"), F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.sum("toks").alias("tokens"))
    return out.select("lang", "source", "examples", "chars", "bytes", "words", "tokens", (F.col("chars") / F.col("tokens")).alias("chars_per_token"), (F.col("tokens") / F.nullif(F.col("words"), F.lit(0))).alias("tokens_per_word"))


@query("a10_slot_status", "WITH s AS (SELECT unnest(['en', 'de', 'xx', 'yy']) AS lang, unnest([true, true, true, false]) AS declared), c AS (SELECT lang, count(*) AS examples, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 2 = 0 GROUP BY lang) SELECT s.lang, coalesce(examples, 0) AS examples, round(100.0 * coalesce(chars, 0) / 500000, 4) AS percent, CASE WHEN examples >= 200 AND chars >= 500000 THEN 'EVALUATED' WHEN examples > 0 THEN 'INSUFFICIENT' WHEN declared THEN 'UNVERIFIED' ELSE 'NOT_EVALUATED' END AS status FROM s LEFT JOIN c ON s.lang = c.lang")
def _(t):
    slots = t.spark.createDataFrame([("en", True), ("de", True), ("xx", True), ("yy", False)], "lang string, declared boolean")
    c = t.documents.where("doc_id % 2 = 0").groupBy("lang").agg(F.count("*").alias("examples"), F.sum("n_chars").alias("chars"))
    d = slots.join(c, "lang", "left")
    status = F.when((F.col("examples") >= 200) & (F.col("chars") >= 500000), "EVALUATED").when(F.col("examples") > 0, "INSUFFICIENT").when(F.col("declared"), "UNVERIFIED").otherwise("NOT_EVALUATED")
    return d.select("lang", F.coalesce("examples", F.lit(0)).alias("examples"), F.round(100.0 * F.coalesce("chars", F.lit(0)) / 500000, 4).alias("percent"), status.alias("status"))


@query("a9_side_statistics", f"WITH s AS (SELECT lang, text, n_chars, {SPLIT} AS held FROM documents) SELECT lang, count(*) AS documents, count(DISTINCT text) AS unique_texts, CAST(coalesce(sum(n_chars) FILTER (WHERE NOT held), 0) AS BIGINT) AS train_chars, CAST(coalesce(sum(n_chars) FILTER (WHERE held), 0) AS BIGINT) AS eval_chars, CAST(coalesce(sum(strlen(text)) FILTER (WHERE NOT held), 0) AS BIGINT) AS train_bytes, CAST(coalesce(sum(strlen(text)) FILTER (WHERE held), 0) AS BIGINT) AS eval_bytes FROM s GROUP BY lang")
def _(t):
    d = T.once(S.content_split(t.documents.select("lang", "text", "n_chars")), h=T.sha(F.col("text")), b=F.octet_length("text").cast("long"))
    per = lambda c, side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("h").alias("unique_texts"), per("n_chars", "train").alias("train_chars"), per("n_chars", "heldout").alias("eval_chars"), per("b", "train").alias("train_bytes"), per("b", "heldout").alias("eval_bytes"))


@query("a21_delta_estimate", "WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v, avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0.0 END) AS keep FROM documents GROUP BY lang) SELECT lang, round(100000 * keep * m, 3) AS estimate, round(1.96 * 100000 * sqrt(keep * keep * v / n + m * m * keep * (1 - keep) / n), 3) AS half_width FROM g")
def _(t):
    g = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"), F.var_samp("n_chars").alias("v"), F.avg(F.when(F.col("n_chars") > 200, 1.0).otherwise(0.0)).alias("keep"))
    k, m = F.col("keep"), F.col("m")
    return g.select("lang", F.round(100000 * k * m, 3).alias("estimate"), F.round(1.96 * 100000 * F.sqrt(k * k * F.col("v") / F.col("n") + m * m * k * (1 - k) / F.col("n")), 3).alias("half_width"))


# runs ------------------------------------------------------------------------------------

RUNS = [("a", 1, "loss", 2.0, "success"), ("a", 2, "loss", 2.2, "success"), ("b", 1, "loss", 1.8, "success"), ("b", 2, "loss", None, "failed"), ("c", 1, "loss", None, "failed"), ("c", 2, "loss", None, "failed"), ("d", 1, "loss", 1.5, "success"), ("d", 2, "loss", 1.7, "success")]
RUNS_SQL = "r(config, seed, metric, value, status) AS (VALUES " + ", ".join(f"('{c}', {s}, '{m}', {'NULL' if v is None else v}::DOUBLE, '{x}')" for c, s, m, v, x in RUNS) + ")"
RUN_FORM = "config string, seed int, metric string, value double, status string"


def runs(t):
    return t.spark.createDataFrame(RUNS, RUN_FORM)


@query("a17_seed_statistics", f"WITH {RUNS_SQL} SELECT config, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS stdev, min(value) AS least, max(value) AS most, CASE WHEN count(value) = count(*) THEN 'success' WHEN count(value) > 0 THEN 'partial' ELSE 'failed' END AS status FROM r GROUP BY ALL")
def _(t):
    return E.seed_statistics(runs(t))


@query("a17_usable_seeds", f"WITH {RUNS_SQL} SELECT seed FROM r WHERE config IN ('a', 'd', 'b') GROUP BY seed HAVING count(*) FILTER (WHERE status = 'success') = 3")
def _(t):
    return E.usable_seeds(runs(t).where("config <> 'c'"))


@query("a27_adoption", "SELECT 'loss' AS metric, 'superior' AS verdict")
def _(t):
    return E.adoption(E.seed_statistics(runs(t)), "a", "d")


@query("a34_chosen_rate", "WITH s AS (SELECT doc_id % 5 AS lr, avg(n_chars) AS mean FROM documents GROUP BY 1) SELECT min(lr) AS lr FROM s WHERE mean <= (SELECT min(mean) FROM s) + 200")
def _(t):
    return E.chosen_rate(t.documents.groupBy((F.col("doc_id") % 5).alias("lr")).agg(F.avg("n_chars").alias("mean")), 200.0)


@query("a26_power_law", "SELECT lang, count(*) AS n, round(regr_slope(log10(strlen(text)), log10(n_chars)), 6) AS exponent, round(pow(10, regr_intercept(log10(strlen(text)), log10(n_chars))), 6) AS k FROM documents WHERE n_chars > 0 GROUP BY lang")
def _(t):
    d = t.documents.where("n_chars > 0").select("lang", "n_chars", F.octet_length("text").alias("bytes"))
    return E.power_law(d, "lang", "n_chars", "bytes").select("lang", "n", F.round("exponent", 6).alias("exponent"), F.round("k", 6).alias("k"))


@query("a26_parabola", "SELECT * FROM (VALUES ('low', 5, 1000.0, 2.0, true), ('up', 5, NULL, NULL, false)) v(budget, n, x_opt, y_opt, bracketed)")
def _(t):
    pts = [("low", 10.0**k, (k - 3.0) ** 2 + 2.0) for k in (1.5, 2.5, 3.0, 3.5, 4.5)] + [("up", 10.0**k, -((k - 3.0) ** 2)) for k in (1.5, 2.5, 3.0, 3.5, 4.5)]
    p = E.parabola(t.spark.createDataFrame(pts, "budget string, x double, y double"), "budget", "x", "y", 0.01)
    return p.select("budget", "n", F.round("x_opt", 6).alias("x_opt"), F.round("y_opt", 6).alias("y_opt"), "bracketed")


@query("a30_merged_sweeps", "WITH s AS (SELECT source AS config, doc_id % 3 AS dir, max(n_chars) AS score FROM documents GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY dir DESC) AS r FROM s) SELECT config, score FROM m WHERE r = 1 ORDER BY score DESC, config LIMIT 5")
def _(t):
    s = t.documents.groupBy(F.col("source").alias("config"), (F.col("doc_id") % 3).alias("dir")).agg(F.max("n_chars").alias("score"))
    return E.merged_sweeps(s).orderBy(F.desc("score"), "config").limit(5).select("config", "score")


@query("a25_record_rollup", "SELECT * FROM (VALUES ('f', 'EXP-001', 'First', 'DONE'), ('f', 'EXP-002', 'Second', 'OPEN'), ('f', 'EXP-003', 'Third', NULL)) v(file, id, title, status)")
def _(t):
    text = ["# Log", "## EXP-001: First", "Status: open", "text", "**Status:** done", "## EXP-002: Second", "- Status: open", "## EXP-003: Third", "nothing"]
    return E.parse_records(t.spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, n int, line string"))


@query("a28_suite_totals", f"SELECT count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len({W})) AS BIGINT) AS words FROM benchmark")
def _(t):
    x = F.col("text")
    return t.benchmark.agg(F.count("*").alias("items"), F.sum(F.length(x)).alias("chars"), F.sum(F.octet_length(x)).alias("bytes"), F.sum(F.size(T.words(x))).alias("words"))


@query("a35_unit_rates", f"SELECT CASE WHEN {SPLIT} THEN 'val' ELSE 'train' END AS split, CAST(sum(len({W})) AS BIGINT) AS tokens, sum(len({W})) / sum(strlen(text)) AS tokens_per_byte, sum(len({W})) / sum(length(text)) AS tokens_per_char FROM documents GROUP BY 1")
def _(t):
    d = S.content_split(t.documents).select(F.when(F.col("side") == "heldout", "val").otherwise("train").alias("split"), F.size(T.words(F.col("text"))).cast("long").alias("tokens"), F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))
    return E.unit_rates(d)


@query("run_derived_seeds", "SELECT DISTINCT source, ('0x' || substr(sha256(concat('1337|', source)), 57, 8))::UBIGINT::BIGINT AS seed FROM documents")
def _(t):
    return t.documents.select("source").distinct().select("source", E.derived_seed(F.lit(1337), F.col("source")).alias("seed"))


@query("run_path_hash", "SELECT sha256(string_agg(concat_ws(chr(9), source, CAST(n AS VARCHAR), h), chr(10) ORDER BY concat_ws(chr(9), source, CAST(n AS VARCHAR), h))) AS sha256, count(*) AS files FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n, sha256(source) AS h FROM documents GROUP BY source)")
def _(t):
    f = t.documents.groupBy(F.col("source").alias("path")).agg(F.sum("n_chars").alias("bytes")).withColumn("sha256", F.sha2("path", 256))
    return E.path_hash(f)

