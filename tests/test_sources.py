import hashlib

from siltstone.sources import tables
from siltstone.streaming import stages


def test_jsonl_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a#1", "x\ny", "en", "a", 1, 3)], tables.JSONL)
    tables.write_jsonl(d, str(tmp_path / "j"))
    assert tables.jsonl(spark, str(tmp_path / "j")).collect() == d.collect()


def test_verify(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").write_bytes(b"2")
    want = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("c", "0")], "name string, sha256 string")
    got = {r.name: r.problem for r in tables.verify_files(spark, str(tmp_path), want).collect()}
    assert got == {"b": "unexpected", "c": "missing"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "hello there", "en"), (2, "12", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, text string, lang string").parquet(str(tmp_path / "in"))
    stages.run(s, {"en": "latin"}, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
