"""Samples, shuffles, windows and packed token files."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

GOLDEN = 0x9E3779B97F4A7C15  # fixed values: the constants of SplitMix64
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def splitmix64(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    with np.errstate(over="ignore"):
        z = x + u(GOLDEN)
        z = (z ^ z >> u(30)) * u(MIX[0])
        z = (z ^ z >> u(27)) * u(MIX[1])
        return z ^ z >> u(31)


def shuffle_key(index: Column, seed: int) -> Column:
    """Order key of row numbers, as a signed long that sorts like the unsigned one."""

    @F.pandas_udf("bigint")
    def key(i: pd.Series) -> pd.Series:
        u = np.uint64
        with np.errstate(over="ignore"):
            k = splitmix64(i.to_numpy(np.int64).astype(np.uint64) ^ u(seed) * u(GOLDEN))
        return pd.Series((k ^ u(1 << 63)).view(np.int64))

    return key(index)


def hash_sample(rows: DataFrame, index: str, k: int, seed: int) -> DataFrame:
    """The k rows whose key is least; of equal keys the lower row."""
    return rows.withColumn("__key", shuffle_key(F.col(index), seed)).orderBy("__key", index).limit(k).drop("__key")


def quota_sample(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows: an equal quota of each group in order, then, where groups are
    short of theirs, the first others in (group, order)."""
    groups = rows.select(by).distinct().count()
    quota = max(1, most // max(1, groups))
    r = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    own, rest = r.where(F.col("__r") <= quota), r.where(F.col("__r") > quota)
    left = most - own.count()
    if left <= 0:
        return own.orderBy(by, order).limit(most).drop("__r")
    return own.unionByName(rest.orderBy(by, order).limit(left)).drop("__r")


def parity_shuffle(n: int, seed: int) -> list[int]:
    """The order that Python's own shuffle gives n rows: for runs that must repeat an earlier one."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def multiset_match(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """(value's sha, n, m): how often each value occurs on either side."""
    h = F.sha2(value, 256).alias("h")
    a = left.groupBy(h).agg(F.count("*").alias("n"))
    b = right.groupBy(h).agg(F.count("*").alias("m"))
    return a.join(b, "h", "full_outer").select("h", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def one_pass_windows(files: DataFrame, block: int, seed: int, name: str = "name", tokens: str = "tokens") -> DataFrame:
    """(ord, name, start): every whole window of every file once, in a fixed shuffled order.
    A file of n tokens has (n - 1) // block windows; files come in the order of their names."""
    c = files.select(name, F.floor((F.col(tokens) - 1) / block).cast("long").alias("c"))
    before = F.sum("c").over(Window.orderBy(name)) - F.col("c")  # one row a file
    w = c.withColumn("before", before).where("c > 0").select(name, "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("k"))
    w = w.select(name, (F.col("k") * block).alias("start"), (F.col("before") + F.col("k")).alias("window")).withColumn("key", shuffle_key(F.col("window"), seed))
    return ordered(w, "key", "window").select("ord", name, "start", "window")


def ordered(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """rows with ord (from 0) by a key that is spread over all longs: rows are dealt by the
    key's range, numbered in each and moved on by the counts before, so no task holds all."""
    part = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 58)
    r = rows.withColumn("__s", part.cast("int"))
    n = r.groupBy("__s").agg(F.count("*").alias("n"))  # 64 rows
    before = n.select("__s", (F.sum("n").over(Window.orderBy("__s")) - F.col("n")).alias("__b"))
    r = r.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(key, tie)) - 1)
    return r.join(F.broadcast(before), "__s").withColumn("ord", (F.col("__b") + F.col("__r")).cast("long")).drop("__s", "__b", "__r")


def order_fingerprint(windows: DataFrame) -> str:
    """sha256 of the window numbers in order, eight bytes each; read a partition at a time."""
    h = hashlib.sha256()
    for r in windows.orderBy("ord").select("window").toLocalIterator(prefetchPartitions=True):
        h.update(int(r.window).to_bytes(8, "little"))
    return h.hexdigest()


def resumed(windows: DataFrame, position: int, batch: int, rank: int = 0, world: int = 1) -> DataFrame:
    """(step, place, ...) of what process ``rank`` of ``world`` reads from a position on;
    steps without all their windows are not read."""
    n = windows.count()
    if not 0 <= position <= n:
        raise ValueError(f"position {position} outside 0..{n}")
    if world < 1 or not 0 <= rank < world:
        raise ValueError(f"rank {rank} of {world} processes is not valid")
    at, chunk = F.col("ord") - position, batch * world
    d = windows.where((at >= 0) & (at < (n - position) // chunk * chunk))
    d = d.withColumns({"step": F.floor(at / chunk).cast("long"), "place": F.pmod(at, F.lit(chunk))})
    return d.where(F.floor(F.col("place") / batch) == rank).withColumn("place", F.pmod("place", F.lit(batch)))


def random_windows(files: DataFrame, block: int, n: int, seed: int, name: str = "name", tokens: str = "tokens") -> DataFrame:
    """(i, name, start): n windows at uniform offsets, files by their share of the tokens."""
    c = files.where(F.col(tokens) > block).select(name, F.col(tokens).alias("t"))
    hi = F.sum("t").over(Window.orderBy(name))
    c = c.select(name, "t", (hi - F.col("t")).alias("lo"), hi.alias("hi"))  # one row a file
    total = c.agg(F.sum("t")).first()[0] or 0
    i = files.sparkSession.range(n).withColumnRenamed("id", "i")
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/{salt}"), "i"), 11).cast("double") / F.lit(float(1 << 53))
    i = i.withColumn("at", unit("file") * total)
    d = i.join(F.broadcast(c), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return d.select("i", name, F.floor(unit("place") * (F.col("t") - block)).cast("long").alias("start"))


def segments(length: int, first: int, block: int) -> list[tuple[int, int, int]]:
    """(start, end, targets): windows that together score the tokens from ``first`` on once
    each; windows move on by half a block."""
    if not 1 <= first <= length:
        raise ValueError("first must lie in [1, length]")
    out, done, half = [], first, max(1, block // 2)
    while done < length:
        reach = done + half if out else max(done + half, block + 1)
        end = min(length, reach)
        out.append((max(0, end - block - 1), end, end - done))
        done = end
    return out


def scoring_segments(rows: DataFrame, length: str, first: str, block: int) -> DataFrame:
    """rows with start, end and targets of their scoring windows."""

    @F.pandas_udf("array<struct<start:int,end:int,targets:int>>")
    def cut(n: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "targets"), x)) for x in segments(int(a), int(b), block)] for a, b in zip(n, f)])

    return rows.withColumn("__s", F.explode(cut(length, first))).select(*rows.columns, "__s.*")


def stream_split(tokens: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """tokens with split: the last part of a flat stream is val."""
    n = tokens.count()
    return tokens.withColumn("split", F.when(F.col(order) < int(n * share), "train").otherwise("val"))


def synthetic(spark, n: int, seed: int, langs: tuple[str, ...] = ("en", "de"), words: int = 40) -> DataFrame:
    """(doc_id, lang, text) of n made-up documents that only depend on the arguments."""
    i = spark.range(n).withColumnRenamed("id", "doc_id")
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(len(langs))) + 1).cast("int"))
    word = lambda k: F.substring(F.translate(F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string"), k.cast("string")), 256), "0123456789", "ghijklmnop"), F.lit(1), F.pmod(F.xxhash64("doc_id", k), F.lit(6)).cast("int") + 2)
    size = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(words)).cast("int") + 1
    return i.select("doc_id", lang.alias("lang"), F.array_join(F.transform(F.sequence(F.lit(1), size), word), " ").alias("text"))
