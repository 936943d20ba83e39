"""Readers and writers with fixed schemas: nothing is inferred."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
JSONL = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("row", LongType()), StructField("tokens", LongType())])


def parquet_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Projected columns; a missing one is an error, null text is empty."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    out = df.select(*columns)
    return out.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in columns else out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder (``spark.checkpoint.dir``) and read back, for
    tables that several parts of a plan read."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file:///tmp/siltstone-shared"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, plain or gzip."""
    return spark.read.schema(JSONL).json(path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """A document a line, keys in the order of their names; with ``order`` the part files
    hold rising ranges of it, so equal tables give equal lines in equal order."""
    d = df.select(*sorted(df.columns))
    if order:
        d = d.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    d.write.option("compression", "gzip").json(path)


def open_parts(parts: dict[str, DataFrame], expected: dict[str, tuple[int, str]], text: str = "text") -> DataFrame:
    """The parts of a corpus as one table with a column part, after each has the recorded
    number of texts and the recorded digest (see ``text_digest``); an error otherwise."""
    for name, df in parts.items():
        if name not in expected:
            raise ValueError(f"{name} is not recorded")
        if text_digest(df, text) != expected[name]:
            raise ValueError(f"{name} does not hold the recorded texts")
    out = None
    for name, df in sorted(parts.items()):
        df = df.withColumn("part", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def text_digest(df: DataFrame, text: str = "text") -> tuple[int, str]:
    """(texts, digest): sums of the 32-bit words of the texts' sha256, so that neither order
    nor partitions matter and repeated texts count."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    word = lambda k: F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)"))
    r = df.agg(F.count("*"), *[word(k) for k in range(8)]).first()
    return r[0], "-".join(format(int(x or 0) % (1 << 64), "016x") for x in r[1:])


def joined_members(content):
    """The gzip members of a file as one: the same bytes, compressed once, without a time."""
    @F.pandas_udf("binary")
    def join(s: pd.Series) -> pd.Series:
        import gzip

        return s.map(lambda x: gzip.compress(gzip.decompress(bytes(x)), mtime=0))

    return join(content)


def verify_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(name, problem) of files against ``expected(name, sha256)``: missing, unexpected or
    mismatch. Files are hashed where they are read."""
    have = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = expected.join(have, "name", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "mismatch")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")
