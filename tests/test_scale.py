"""Steps whose cost or result once depended on the size of the table."""

import collections
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.functions import html as H, text as T
from siltstone.operators import evaluation as E, neardup, slices, stages, tokens as K


def test_leakage_reads_all_of_train(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * 10 + k).cast("string"))), " ")
    train = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).withColumn("text", words)
    held = spark.createDataFrame([(9000, "en", "x w29991 w29992 w29993 w29994 w29995 w29996 w29997 w29998 y"), (9001, "en", "w29991 w29992 nothing more that is the same as there"), (9002, "en", "ab cde fg")], "doc_id long, lang string, text string")
    more = spark.createDataFrame([(8000, "en", "abcdef gh")], "doc_id long, lang string, text string")
    got = {r.doc_id: (r.exact, r.overlap) for r in E.leakage(train.select("doc_id", "lang", "text").unionByName(more), held).collect()}
    assert got == {9000: (False, True), 9001: (False, False), 9002: (False, False)}
    same = E.leakage(more, spark.createDataFrame([(1, "en", "abc defg h"), (2, "en", "abcdef gh")], "doc_id long, lang string, text string"))
    assert {r.doc_id: (r.exact, r.overlap) for r in same.collect()} == {1: (False, True), 2: (True, True)}


def test_arrow_batches_are_bounded(spark):
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    for made in (lambda: T.nfc(F.col("text")), lambda: H.rendered(F.col("text")), lambda: H.strict_text(F.col("text")), lambda: stages.suite_hits(d, d.withColumnRenamed("doc_id", "item_id")), lambda: neardup.clusters(d.withColumn("lang", F.lit("x")))):
        spark.conf.set(rows, "10000")
        spark.conf.set(size, "67108864")
        made()
        assert (int(spark.conf.get(rows)), int(spark.conf.get(size).rstrip("b"))) == (T.BATCH_ROWS, T.BATCH_BYTES)
    spark.conf.set(rows, "10")
    T.nfc(F.col("text"))
    assert spark.conf.get(rows) == "10"
    spark.conf.unset(rows)


def test_composed_texts_stay_out_of_python(spark):
    assert all(unicodedata.is_normalized("NFC", chr(i) + chr(j)) for i in range(0x300) for j in (0x41, 0x61, 0xE9, i))
    rows = ["plain", "é", "e\u0301a\u030a", "\u1112\u1161\u11ab", "\u0958", "", None, "\u212b", "“x”", "\U0001d15e"]
    d = spark.createDataFrame(list(enumerate(rows)), "id int, text string").select("id", T.nfc(F.col("text")).alias("n"))
    assert {r.id: r.n for r in d.collect()} == {i: x if x is None else unicodedata.normalize("NFC", x) for i, x in enumerate(rows)}
    sent = re.search(r"_nfc\((.*)\)#", d._jdf.queryExecution().optimizedPlan().toString())[1]
    assert sent.startswith("CASE WHEN RLIKE")  # null for texts that cannot change


def test_counts_by_runs(spark):
    rows = ["abc DEF 12 é कख", "", None, "a@b.co +91 98765 43210 987-65", "tel 98765 43210, x@y", "1234567890", "11.1234567890 \u0967\u0968 a a a a", "one"]
    d = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    x = F.col("text")
    pairs = F.transform(F.sequence(F.lit(1), F.size(T.words(x)) - 1), lambda k: F.array_join(F.slice(T.words(x), k, 2), " "))
    plain = [T.count(x, rf"[\p{{L}}&&[{T.KNOWN}]]"), T.count(x, rf"[\p{{L}}&&[{T.SCRIPTS['devanagari']}]]"), F.regexp_replace(F.regexp_replace(x, T.EMAIL, "[email]"), T.PHONE, "[phone]"), F.when(F.size(T.words(x)) >= 2, F.size(F.array_distinct(pairs)) / (F.size(T.words(x)) - 1))]
    for a, b in zip([T.known_letters(x), T.letters(x, "devanagari"), T.mask_contacts(x), T.repetition(x)], plain):
        assert d.where(~a.eqNullSafe(b)).count() == 0


def test_documents_meet_their_own_hot_lines(spark):
    rows = [(i, "x", "en", f"only {i}\nshared {i // 2}\n tail ") for i in range(40)] + [(40, "y", "en", "only 0\nshared 0\n tail "), (40, "y", "en", "only 0\nshared 0\n tail "), (41, "z", "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    c = slices.clean_lines(d, {"en": "latin"}, 2)
    got = sorted((r.doc_id, r.body, r.boilerplate_lines) for r in c.where("text IS NOT NULL").collect())
    assert got == [(i, f"only {i}", 2) for i in range(40)] + [(40, "", 3)] * 2 and c.count() == 43
    # no array of a whole file's lines is made: hot lines are gathered by file and text
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[source#\d+\], ", plan) and re.search(r"Aggregate \[source#\d+, __t#\d+L?\], ", plan)


def test_words_that_the_signer_remembers(spark):
    s = neardup.Signer()
    texts = [" ".join(f"w{i}" for i in range(k * 1000, k * 1000 + 1000)) for k in range(200)]
    assert s.sign(texts + texts[:1])[200] == s.sign(texts[:1])[0] and len(s.crc) <= (1 << 16) + 1000


def test_bands_carry_no_signatures(spark, monkeypatch):
    made = {}
    keep = neardup.tables.stored
    monkeypatch.setattr(neardup.tables, "stored", lambda df, name: made.setdefault(name, keep(df, name)))
    base = [f"w{i}" for i in range(120)]
    d = spark.createDataFrame([(1, "en", " ".join(base)), (2, "en", " ".join(base[:-1] + ["z"])), (3, "en", " ".join(f"v{i}" for i in range(99))), (4, "de", " ".join(base)), (5, "en", "a b")], "doc_id long, lang string, text string")
    assert {r.doc_id: r.root for r in neardup.clusters(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert [tuple(r) for r in made["neardup-edges"].collect()] == [("en", 2, 1)]


def test_words_encoded_together(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("aab c") for _ in range(rng.randrange(0, 12))) for _ in range(400)] + ["aaaaa", "", "é", "<|x|>", "abab" * 9]
    for _ in range(40):
        merges, known = [], [b"a", b"b", b"c", b" "]
        for _ in range(12):
            p = rng.choice(known), rng.choice(known)
            merges.append(p)
            known.append(p[0] + p[1])
        bpe = K.Bpe(merges, ("<|x|>",))
        want = [[bpe.specials[w]] if w in bpe.specials else bpe.chunk(w) for w in words]
        for most in (1024, 0):
            monkeypatch.setattr(K, "SWEPT", most)
            ids, size = bpe.encode(words)
            assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want
    assert [len(x) for x in K.Bpe([]).encode([])] == [0, 0]


def test_pairs_counted_in_arrays():
    words, n = ["aaaa", "abab", "", "aaa b", "é"], [3, 5, 7, 11, 13]
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64())], ["chunk", "n"])
    steps = [(b"a", b"a"), (b"a", b"b"), (b"ab", b"ab"), (b"aa", b"a")]
    token = [bytes([i]) for i in range(256)] + [a + b for a, b in steps]
    for k in range(len(steps) + 1):
        want = collections.Counter()
        for w, c in zip(words, n):
            f = tuple(bytes([x]) for x in w.encode())
            for p in steps[:k]:
                f = K.apply(f, p)
            for p in zip(f, f[1:]):
                want[p] += c
        ids = [(token.index(a), token.index(b), token.index(a + b)) for a, b in steps[:k]]
        got = {(token[p // 300], token[p % 300]): c for r in K.pair_sums([batch.slice(0, 2), batch.slice(2)], ids, 300) for p, c in zip(*(x.to_pylist() for x in r.columns))}
        assert got == want


def test_encoding_and_counting_words_without_moving_texts(spark):
    d = spark.createDataFrame([(i, f"the cat {i} sat on the mat") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    e = K.encode_bpe(d, [(b"t", b"h"), (b"th", b"e")], ("<|e|>",))
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: r.ids for r in e.collect()}
    assert rows[50] == rows[51] == [] and rows[7][:2] == [257, 32] and len(rows) == 52
    v = K.word_vocabulary(d, 6)
    assert [(r.id, r.token) for r in v.orderBy("id").collect()] == [(0, "<unk>"), (1, " "), (2, "the"), (3, "cat"), (4, "sat"), (5, "on")]
    w = K.word_encode(d, spark.createDataFrame(v.collect(), v.schema))
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", w._jdf.queryExecution().executedPlan().toString())) == 1
    assert {tuple(r) for r in w.collect()} == {(i, 13, 2) for i in range(50)}
