"""Text expressions on rows that the tables do not hold."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import neardup, packing, stages as S, tokens


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


def test_normalize(spark):
    raw = "  café  a\t\tb\r\n\nc \x1f"
    want = re.sub(r"[ \t]{2,}", " ", unicodedata.normalize("NFC", raw).replace("\r", "")).strip()
    assert one(spark, raw, T.normalize(F.col("text"))) == want
    assert one(spark, want, T.normalize(F.col("text"))) == want


def test_unknown_policy():
    try:
        T.normalize(F.lit("x"), "nfd")
    except ValueError:
        return
    raise AssertionError


def test_masks(spark):
    assert one(spark, "a.b@c.de und +49 170 1234567 und 1234.5", T.mask_contacts(F.col("text"))) == "[email] und [phone] und 1234.5"


def test_profile(spark):
    p = T.profile(F.col("text"))
    row = spark.createDataFrame([("aé कख 1! ж",)], "text string").select(*[v.alias(k) for k, v in p.items()]).first()
    assert (row.latin, row.devanagari, row.unknown, row.common) == (2, 2, 1, 2)


def test_trim(spark):
    assert one(spark, "ab\ncd\nef", T.trim_text(F.col("text"), 6)) == "ab\ncd"
    assert one(spark, "abcdef", T.trim_text(F.col("text"), 4)) == "abcd"


def test_gate_and_rules(spark):
    d = spark.createDataFrame([(1, "hello", "en"), (2, "123", "en"), (3, "привет a", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.reason for r in S.langid(d, {"en": "latin"}).scored.collect()}
    assert got[1] is None and got[2] == "langid_no_letters" and got[3] is None
    q = spark.createDataFrame([(1, ""), (2, "x" * 20001), (3, "a\x01\x02"), (4, "12345 ok")], "doc_id long, text string")
    r = {x.doc_id: (x.reason, x.flags) for x in S.quality(q).scored.collect()}
    assert r[1][0] == "min_chars" and r[2][0] == "max_chars" and r[3][0] == "control_ratio" and r[4] == (None, ["digit_runs"])


def test_budget(spark):
    d = spark.createDataFrame([("a", 1, 4), ("a", 2, 5), ("a", 3, 50), ("a", 4, 1)], "k string, i long, n long")
    got = {r.i: r.shard for r in packing.budget_shards(d, "k", "i", "n", 10).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}


def test_bpe_round_trip(spark):
    d = spark.createDataFrame([(1, "low lower lowest"), (2, "été कान")], "doc_id long, text string")
    m = tokens.train_bpe(d, 10)
    assert m[0] == (b"l", b"o") or m[0] == (b"o", b"w")
    back = {r.doc_id: r.text for r in tokens.decode_bpe(tokens.encode_bpe(d, m), m).collect()}
    assert back == {r.doc_id: r.text for r in d.collect()}


def test_bpe_counts_rare_chunks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(60)) + " aaaaa aaaa ababab") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = tokens.train_bpe(d, 60)
    assert all(tokens.train_bpe(d, 60, most) == whole for most in (0, 5, 200))


def test_long_chains_settle(spark):
    ids = list(range(140))
    random.Random(6).shuffle(ids)
    chain = [("en", max(a, b), min(a, b)) for a, b in zip(ids, ids[1:])] + [("de", i + 1, i) for i in range(130)] + [("en", 901, 900)]
    docs = spark.createDataFrame([("en", i) for i in [*ids, 900, 901, 950]] + [("de", i) for i in range(131)], "lang string, doc_id long")
    got = {(r.lang, r.doc_id): r.root for r in neardup._settle(spark.createDataFrame(chain, "lang string, u long, v long"), docs, "lang", "doc_id").collect()}
    assert len(got) == 274 and got == {(g, i): 900 if i in (900, 901) else i if i == 950 else 0 for g, i in got}
    with pytest.raises(RuntimeError):
        neardup._settle(spark.createDataFrame(chain, "lang string, u long, v long"), docs, "lang", "doc_id", most=1)
