"""MinHash near duplicates: signatures, bands, verified links, least-row clusters."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from siltstone.functions import text as T
from siltstone.sources import tables

PERMS, BANDS, ROWS, LEAST = 128, 16, 8, 0.8  # fixed values of the operator
MULT = 1_000_003


def _params(seed: int = 35) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)


class Signer:
    """Signatures of many texts at a time: the words of a batch lie in one array, a word is
    hashed once, and each permutation takes its minima over all texts in one pass."""

    BATCH = 1 << 16  # words at a time, or one text
    KNOWN = 1 << 16  # words whose hashes are remembered

    def __init__(self):
        self.a, self.b = _params()
        self.crc: dict[str, int] = {}

    def words(self, text: str) -> list[int]:
        known, crc = self.crc, zlib.crc32
        if len(known) > self.KNOWN:
            known.clear()
        out = []
        for w in text.split():
            h = known.get(w)
            if h is None:
                h = known[w] = crc(w.encode())
            out.append(h)
        return out

    def sign(self, texts) -> list[list[int] | None]:
        """128 minima of five-word shingle hashes, upper 32 bits; none below five words."""
        out: list = []
        held: list[list[int]] = []
        size = 0
        for t in texts:
            held.append([] if t is None else self.words(t))
            size += len(held[-1])
            if size >= self.BATCH:
                out += self.minima(held)
                held, size = [], 0
        return out + self.minima(held)

    def minima(self, held: list[list[int]]) -> list[list[int] | None]:
        grams = np.array([max(0, len(w) - 4) for w in held], np.int64)
        live = np.flatnonzero(grams)
        out: list = [None] * len(held)
        if not len(live):
            return out
        flat = np.array([h for i in live for h in held[i]], np.uint64)
        first = np.cumsum(grams[live] + 4) - (grams[live] + 4)  # of each text's words
        at = np.repeat(first - (np.cumsum(grams[live]) - grams[live]), grams[live]) + np.arange(grams.sum())
        with np.errstate(over="ignore"):
            poly = np.zeros(len(at), np.uint64)
            for k in range(5):
                poly = poly * np.uint64(MULT) + flat[at + k]
            cut = np.cumsum(grams[live]) - grams[live]
            low = np.stack([np.minimum.reduceat(poly * a + b, cut) for a, b in zip(self.a, self.b)], 1)
        for i, row in zip(live.tolist(), (low >> np.uint64(32)).astype(np.int64).tolist()):
            out[i] = row
        return out


_signer: list[Signer] = []


@F.pandas_udf(ArrayType(LongType()))
def _signatures(s: pd.Series) -> pd.Series:
    if not _signer:
        _signer.append(Signer())
    return pd.Series(_signer[0].sign(s))


def clusters(docs: DataFrame, by: str = "lang", row: str = "doc_id") -> DataFrame:
    """(by, row, root): each member is compared with the least row of each of its buckets;
    agreement of LEAST links them, transitively over bands. Roots settle by alternating
    star steps, whose rounds grow with the logarithm of a chain's length.

    Signatures are written once; bands meet by name alone, and a signature only travels to
    the pairs that share a band. Rows of one name count as one each."""
    sig = docs.select(by, row, T.batched(_signatures("text")).alias("sig")).where("sig IS NOT NULL")
    sig = tables.stored(sig.withColumn("__id", F.monotonically_increasing_id()), "neardup-signatures")
    bands = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    keyed = sig.select(by, F.struct(row, *[F.col("sig")[k].alias(f"s{k}") for k in range(3)], "__id").alias("at"), F.explode(bands).alias("band"))
    heads = keyed.groupBy(by, "band").agg(F.min("at").alias("head"))
    pairs = keyed.join(heads, [by, "band"]).where(F.col(f"head.{row}") < F.col(f"at.{row}"))
    pairs = pairs.select(F.col("at.__id").alias("__id"), F.col("head.__id").alias("__head")).distinct()
    one = sig.select("__id", by, F.col(row).alias("u"), "sig")
    two = sig.select(F.col("__id").alias("__head"), F.col(row).alias("v"), F.col("sig").alias("own"))
    agree = F.size(F.filter(F.zip_with("sig", "own", lambda x, y: x == y), lambda x: x)) / PERMS
    edges = tables.stored(pairs.join(two, "__head").join(one, "__id").where(agree >= LEAST).select(by, "u", "v").distinct(), "neardup-edges")
    cur = edges.groupBy(by, "u").agg(F.min("v").alias("v"))
    links = edges.join(cur.select(by, "u", F.col("v").alias("m")), [by, "u"])
    # rows under one member are linked with its least one
    flat = links.select(by, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(cur.select(by, "u", "v")).distinct()
    return _settle(flat, docs, by, row)


def _settle(edges: DataFrame, docs: DataFrame, by: str, row: str, most: int = 60) -> DataFrame:
    """Roots by large-star and small-star steps: every link is moved towards the least row
    seen, until none moves."""
    spark = edges.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file:///tmp/siltstone-shared"
    spark.sparkContext.setCheckpointDir(folder)

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64(by, "u", "v").cast("decimal(38,0)"))).first()

    cur = edges.where("u <> v").select(by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    was = state(cur)
    for _ in range(most):
        both = cur.unionByName(cur.select(by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, [by, "u"]).where("v > u AND v <> m").select(by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(by, "u").agg(F.min("v").alias("m"))
        small = large.join(down, [by, "u"]).where("v <> m").select(by, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(by, "u", F.col("m").alias("v")))
        cur = small.distinct().checkpoint()
        now = state(cur)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("clusters did not settle")
    label = cur.select(by, F.col("u").alias(row), F.col("v").alias("root"))
    return docs.select(by, row).join(label, [by, row], "left").select(by, row, F.coalesce("root", row).alias("root"))
