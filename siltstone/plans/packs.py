"""Queries of samples, windows, packed files and tokenisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import packing as B, sampling as P, tokens as K
from siltstone.plans.registry import W, query

WORDS = rf"len({W})"
MERGES = 40


@query("p6_quota_with_fill", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE lang <> 'en' OR doc_id < 40), q AS (SELECT CAST(floor(300 / count(DISTINCT lang)) AS BIGINT) AS quota FROM r), own AS (SELECT lang, doc_id FROM r, q WHERE k <= quota), rest AS (SELECT lang, doc_id FROM r, q WHERE k > quota ORDER BY lang, doc_id LIMIT (SELECT 300 - count(*) FROM own)) SELECT * FROM own UNION ALL SELECT * FROM rest")
def _(t):
    return P.quota_sample(t.documents.where("lang <> 'en' OR doc_id < 40").select("lang", "doc_id"), "lang", "doc_id", 300)


@query("p7_hash_sample")
def _(t):
    return P.hash_sample(t.documents.select("doc_id"), "doc_id", 100, 48)


@query("p9_one_pass_windows", "WITH f AS (SELECT source AS name, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY source) SELECT name, count(*) AS windows, CAST(max(k) * 512 AS BIGINT) AS last FROM (SELECT name, unnest(range(0, (tokens - 1) // 512)) AS k FROM f) GROUP BY name")
def _(t):
    f = t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("tokens"))
    return P.one_pass_windows(f, 512, 43).groupBy("name").agg(F.count("*").alias("windows"), F.max("start").alias("last"))


@query("p9_window_order", "WITH f AS (SELECT CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY source) SELECT CAST(sum((tokens - 1) // 512) AS BIGINT) AS windows, CAST(sum((tokens - 1) // 512) - 1 AS BIGINT) AS last, true AS all_once FROM f")
def _(t):
    f = t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("tokens"))
    w = P.one_pass_windows(f, 512, 43)
    return w.agg(F.count("*").alias("windows"), F.max("ord").alias("last"), ((F.countDistinct("ord") == F.count("*")) & (F.countDistinct("window") == F.count("*"))).alias("all_once"))


@query("p10_resumed_reads", "WITH f AS (SELECT CAST(sum((t - 1) // 512) AS BIGINT) AS n FROM (SELECT sum(n_chars) AS t FROM documents GROUP BY source)) SELECT CAST((n - 100) // 32 * 8 AS BIGINT) AS reads, CAST((n - 100) // 32 AS BIGINT) AS steps FROM f")
def _(t):
    f = t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("tokens"))
    return P.resumed(P.one_pass_windows(f, 512, 43), 100, 8, 1, 4).agg(F.count("*").alias("reads"), F.countDistinct("step").alias("steps"))


@query("p11_random_windows", "SELECT 500 AS n, true AS inside")
def _(t):
    f = t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("tokens"))
    w = P.random_windows(f, 512, 500, 5).join(f, "name")
    return w.agg(F.count("*").alias("n"), F.bool_and((F.col("start") >= 0) & (F.col("start") + 512 < F.col("tokens"))).alias("inside"))


@query("p12_stream_split", "SELECT CASE WHEN doc_id < CAST(floor((SELECT count(*) FROM documents) * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split, count(*) AS tokens FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM documents) GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    d = t.documents.select((F.row_number().over(Window.orderBy("doc_id")) - 1).alias("pos"))  # ids alone
    return P.stream_split(d, "pos").groupBy("split").agg(F.count("*").alias("tokens"))


@query("p14_scoring_segments", f"WITH n AS (SELECT doc_id, {WORDS} AS n FROM documents) SELECT doc_id, CAST(n - 1 AS BIGINT) AS targets FROM n WHERE n > 1")
def _(t):
    d = t.documents.select("doc_id", F.size(T.words(F.col("text"))).alias("n")).where("n > 1").withColumn("first", F.lit(1))
    return P.scoring_segments(d, "n", "first", 64).groupBy("doc_id").agg(F.sum("targets").alias("targets"))


@query("p4_parity_order")
def _(t):
    order = P.parity_shuffle(t.documents.count(), 1337)
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(order)], "pos int, row int")


@query("k1_shard_sizes")
def _(t):
    s = B.budget_shards(t.documents.select("lang", "doc_id", F.length("text").cast("long").alias("chars")), "lang", "doc_id", "chars", 50_000)
    d = s.join(t.documents.select("lang", "doc_id", F.length("text").alias("chars")), ["lang", "doc_id"])
    return d.groupBy("lang", "shard").agg(F.count("*").alias("docs"), (F.sum("chars") + F.count("*") - 1).alias("chars"))


@query("k4_manifest_counts", "SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE lang IN ('de', 'en') GROUP BY lang")
def _(t):
    m = B.manifest({x: t.documents.where(F.col("lang") == x) for x in ("de", "en")}, "2000-01-01", build=1)
    return t.spark.createDataFrame([(k, v["documents"], v["chars"], v["bytes"]) for k, v in m["tables"].items()], "lang string, documents long, chars long, bytes long")


@query("k9_provenance", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unpinned' ELSE 'mismatch' END AS status FROM documents")
def _(t):
    pin = F.when(F.col("doc_id") % 3 == 0, T.sha(F.col("text"))).when(F.col("doc_id") % 3 == 2, F.lit("0" * 64))
    return B.provenance(t.documents.select(F.col("doc_id").alias("id"), "text", pin.alias("pinned")))


@query("p13_pack_checks", "SELECT count(*) AS docs, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens, 0 AS repeated_ids, 0 AS end_tokens_inside, 0 AS without_end, 0 AS above_end, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def _(t):
    # ids of single bytes; 256 ends a document
    units = F.transform(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    return B.pack_checks(B.packed(t.documents, units, 256), 256).drop("n_train", "n_val")


@query("p13_val_split", "SELECT count(*) FILTER (WHERE v) AS val_docs, count(*) FILTER (WHERE NOT v) AS train_docs FROM (SELECT ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 1000000 < 50000 AS v FROM documents)")
def _(t):
    p = B.packed(t.documents, F.array().cast("array<int>"), 0, ppm=50_000)
    return p.agg(F.count_if(F.col("split") == "val").alias("val_docs"), F.count_if(F.col("split") == "train").alias("train_docs"))


@query("t1_char_encode", "WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents WHERE doc_id % 2 = 0), d AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE doc_id % 2 = 1) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE c NOT IN (SELECT c FROM v)) AS unknown FROM d WHERE c <> '' GROUP BY doc_id")
def _(t):
    return K.char_encode(t.documents.where("doc_id % 2 = 1"), K.char_counts(t.documents.where("doc_id % 2 = 0")))


TOKEN = r"regexp_extract_all(text, '(?s)[A-Za-z]+|[0-9]+|\s+|.')"
VOCAB = f"w AS (SELECT doc_id, unnest({TOKEN}) AS token, generate_subscripts({TOKEN}, 1) AS pos FROM documents), c AS (SELECT token, count(*) AS n, min((doc_id, pos)) AS f FROM w GROUP BY token), v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, f) AS id FROM c QUALIFY id <= 1999)"


@query("t2_word_tokens", f"WITH {VOCAB} SELECT CAST(id AS INTEGER) AS id, token, n FROM v UNION ALL SELECT 0, '<unk>', 0")
def _(t):
    return K.word_vocabulary(t.documents, 2000)


@query("t2_word_encode", f"WITH {VOCAB} SELECT doc_id, count(*) AS tokens, count(*) FILTER (WHERE token NOT IN (SELECT token FROM v)) AS unknown FROM w GROUP BY doc_id")
def _(t):
    return K.word_encode(t.documents, K.word_vocabulary(t.documents, 2000))


@query("t4_gpt2_pretokens", r"SELECT doc_id, len(regexp_extract_all(text, '\s?\p{L}+|\s?\p{N}+|[^\s\p{L}\p{N}]+|\s')) AS pretokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(K.gpt2_pretokens(F.col("text"))).alias("pretokens"))


@query("t7_chunk_token_counts", "SELECT doc_id, true AS equal FROM documents")
def _(t):
    m = K.train_bpe(t.documents, MERGES)
    e = K.encode_bpe(t.documents.withColumn("own", F.col("text")), m, keep=("own",))
    return K.decode_bpe(e, m, keep=("own",)).select("doc_id", (F.col("own") == F.col("text")).alias("equal"))


@query("t9_special_tokens", "SELECT doc_id, 1 AS specials, true AS equal FROM documents WHERE doc_id < 50")
def _(t):
    d = t.documents.where("doc_id < 50").select("doc_id", F.concat("text", F.lit("<|end|>x")).alias("text"))
    m = K.train_bpe(t.documents.where("doc_id < 50"), 20)
    e = K.encode_bpe(d, m, ("<|end|>", "<|end"))
    back = K.decode_bpe(e, m, ("<|end|>", "<|end"))
    return e.join(back, "doc_id").join(d.select("doc_id", F.col("text").alias("own")), "doc_id").select("doc_id", F.size(F.filter("ids", lambda x: x >= 276)).alias("specials"), (F.col("text") == F.col("own")).alias("equal"))


@query("t10_tokeniser_sweep")
def _(t):
    return K.sweep(t.documents, [10, MERGES], {"mark": T.PRETOKEN, "gpt2": K.GPT2})


@query("t11_artifact", "SELECT true AS same, true AS refused")
def _(t):
    a = K.artifact(K.train_bpe(t.documents.where("doc_id < 100"), 10), ("<|end|>",))
    try:
        K.load_artifact({**a, "specials": []})
        refused = False
    except ValueError:
        refused = True
    return t.spark.createDataFrame([(K.load_artifact(a).n_ordinary == 266, refused)], "same boolean, refused boolean")
