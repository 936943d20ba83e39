"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import decontam, hosts, jaccard, langid, lines, pieces, records, secrets, shards, suffix
from siltstone.llm.oracles import ORACLES  # noqa: F401


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_sharding(spark, sf_dir):
    return shards.assign(_docs(spark, sf_dir))


def op6_secret_scans(spark, sf_dir):
    return secrets.scan(_docs(spark, sf_dir))


def op9_quality_rules(spark, sf_dir):
    q = hosts.quality(_docs(spark, sf_dir))
    return q.withColumns({c: F.round(c, 9) for c in ("host_rate", "host_ratio")})


QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_language_id": langid.op4_language_id,
    "op5_token_records": records.op5_token_records,
    "op6_secret_scans": op6_secret_scans,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}
