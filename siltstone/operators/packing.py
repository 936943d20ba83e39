"""Order-dependent packing: character budgets, shard files and token files with their checks."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions import text as T


def budget_shards(df: DataFrame, by: str, order: str, chars: str, budget: int) -> DataFrame:
    """(by, order, shard): whole documents in order, a joining line feed counted; one larger
    than the budget stands alone. The fold runs on ids and sizes only, a group at a time:
    16 bytes a document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        shard, used, out = 0, 0, []
        for n in pdf[chars]:
            need = n + (1 if used else 0)
            if used and used + need > budget:
                shard, used, need = shard + 1, 0, n
            out.append(shard)
            used += need
        return pd.DataFrame({by: pdf[by], order: pdf[order], "shard": out})

    kinds = dict(df.dtypes)
    return df.groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, shard bigint")


def write_text_shards(docs: DataFrame, shards: DataFrame, by: str, order: str, path: str) -> None:
    """A folder of text files for each shard, a document a line in order; line feeds inside
    a document become spaces."""
    d = docs.join(shards, [by, order])
    line = F.regexp_replace("text", r"[\r\n]+", " ")
    d = d.select(by, F.format_string("%06d", "shard").alias("shard"), order, line.alias("value"))
    d.repartition(by, "shard").sortWithinPartitions(by, "shard", order).select("value", by, "shard").write.partitionBy(by, "shard").text(path)


def read_text_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces: equal values give equal bytes."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def fingerprint(conf: dict) -> str:
    return hashlib.sha256(canonical(conf).encode()).hexdigest()


def manifest(tables: dict[str, DataFrame], created_at: str, **facts) -> dict:
    """Counts of each table with a hash that leaves the time out."""
    body = {"tables": {k: {c: int(v or 0) for c, v in d.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes")).first().asDict().items()} for k, d in tables.items()}, **facts}
    return {**body, "content_sha256": fingerprint(body), "created_at": created_at}


def provenance(rows: DataFrame, key: str = "id") -> DataFrame:
    """(id, status): verified only where a hash is pinned and equals the text's."""
    h = T.sha(F.col("text"))
    return rows.select(key, F.when(F.col("pinned").isNull(), "unpinned").when(F.col("pinned") == h, "verified").otherwise("mismatch").alias("status"))


# token files -----------------------------------------------------------------------------


def packed(docs: DataFrame, encode: Column, eot: int, key: str = "doc_id", ppm: int = 5_000) -> DataFrame:
    """(key, split, ids): ids of each text with one end token behind it; the split by id hash."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    split = F.when(F.pmod(h, F.lit(1_000_000).cast("decimal(20,0)")) < ppm, "val").otherwise("train")
    return docs.select(key, split.alias("split"), F.concat(encode, F.array(F.lit(eot))).alias("ids"), F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))


def pack_checks(rows: DataFrame, eot: int, key: str = "doc_id") -> DataFrame:
    """One row: documents, tokens, and what must be 0: repeated ids, end tokens inside or
    missing at the end, ids above the end token; sums by split."""
    ids = F.col("ids")
    inside = F.size(F.filter(ids, lambda x: x == eot)) - 1
    return rows.agg(
        F.count("*").alias("docs"), F.sum(F.size(ids)).alias("tokens"), (F.count("*") - F.countDistinct(key)).alias("repeated_ids"), F.sum(inside).alias("end_tokens_inside"),
        F.count_if(F.element_at(ids, -1) != eot).alias("without_end"), F.sum(F.size(F.filter(ids, lambda x: x > eot))).alias("above_end"),
        F.sum(F.when(F.col("split") == "train", F.size(ids)).otherwise(0)).alias("n_train"), F.sum(F.when(F.col("split") == "val", F.size(ids)).otherwise(0)).alias("n_val"),
        F.sum("bytes").alias("bytes"), F.sum("chars").alias("chars"),
    )


def val_ids_digest(rows: DataFrame, key: str = "doc_id") -> str:
    """sha256 over the sorted validation ids, a line feed between; they are a small share by
    definition and come a partition at a time."""
    h, first = hashlib.sha256(), True
    for r in rows.where("split = 'val'").select(F.col(key).cast("string").alias("k")).orderBy("k").toLocalIterator():
        h.update(("" if first else "\n").encode() + r.k.encode())
        first = False
    return h.hexdigest()


def write_tokens(rows: DataFrame, path: str, order: str = "doc_id", slices: int = 16) -> DataFrame:
    """Little-endian two-byte ids, train before val, documents in order, as part files whose
    names sort in that order, written through Spark as binary rows. Returns the index:
    (part, split, tokens, sha256). Ids must be below 2**16."""
    d = rows.repartitionByRange(slices, F.col("split"), F.col(order)).sortWithinPartitions("split", order).select("split", "ids")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, list[bytes]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                a = np.asarray(x.values)
                if len(a) and (a.max() >= 1 << 16 or a.min() < 0):
                    raise ValueError("an id does not fit two bytes")
                held.setdefault(s, []).append(a.astype("<u2").tobytes())
        for s, x in held.items():
            data = b"".join(x)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s]), pa.array([len(data) // 2], pa.int64()), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], ["part", "split", "tokens", "sha256", "data"])

    d.mapInArrow(run, "part int, split string, tokens bigint, sha256 string, data binary").write.parquet(path)
    return d.sparkSession.read.parquet(path).drop("data")


def read_tokens(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(part, split, pos, id): the tokens of a folder that ``write_tokens`` wrote."""
    d = spark.read.parquet(path)
    d = d if split is None else d.where(F.col("split") == split)

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.frombuffer(x, "<u2").astype(np.int32))

    return d.select("part", "split", F.posexplode(ids("data")).alias("pos", "id"))


def document_digests(spark: SparkSession, path: str, eot: int, raw: list[bytes]) -> DataFrame:
    """(part, doc, digest): blake2b digests of the documents of token files, cut at the end
    tokens. ``raw``: bytes of each id, the vocabulary."""

    @F.pandas_udf("array<string>")
    def digests(s: pd.Series) -> pd.Series:
        def one(x):
            a = np.frombuffer(x, "<u2")
            ends = np.flatnonzero(a == eot)
            out, lo = [], 0
            for e in ends.tolist():
                out.append(hashlib.blake2b(b"".join(raw[i] for i in a[lo:e]), digest_size=16).hexdigest())
                lo = e + 1
            return out

        return s.map(one)

    return spark.read.parquet(path).select("part", "split", F.posexplode(digests("data")).alias("doc", "digest"))


def file_members(content: Column) -> Column:
    """How many gzip members a file holds."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        import zlib

        def one(x):
            n, rest = 0, bytes(x)
            while rest:
                d = zlib.decompressobj(31)
                d.decompress(rest)
                d.flush()
                n, rest = n + 1, d.unused_data
            return n

        return s.map(one)

    return count(content)
