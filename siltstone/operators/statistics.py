"""Statistics over grouped rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.sampling import GOLDEN, splitmix64

Z = 1.959963984540054  # fixed value: the 97.5 % point of the normal distribution


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    p, z = k / n, F.lit(Z)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def nearest_ranks(df: DataFrame, by: str, value: str, qs: list[float]) -> DataFrame:
    """(by, q, value): ordered[min(n - 1, floor(q * n + 0.5))]. Distinct values are counted
    first, so a group is a run of counts rather than its rows."""
    c = df.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    c = c.withColumns({"hi": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(by))})
    q = F.explode(F.array(*[F.lit(x) for x in qs])).alias("q")
    c = c.select(by, value, "c", "hi", "n", q)
    at = F.least(F.col("n") - 1, F.floor(F.col("q") * F.col("n") + 0.5))
    return c.where((at < F.col("hi")) & (at >= F.col("hi") - F.col("c"))).select(by, "q", F.col(value).alias("value"))


def bootstrap(df: DataFrame, by: str, x: str, y: str, key: str, rounds: int = 1000, seed: int = 17) -> DataFrame:
    """(by, ratio, lo, hi): percentile interval of sum(x)/sum(y) under Poisson resampling.

    Every row draws its own count for each round from a hash of its key, the round and the
    seed, so equal values draw apart. Rows are never gathered: a task sends ``rounds`` sums
    a group. ``key`` must tell the rows of a group apart; a group of one row has no interval.
    """
    kind = dict(df.dtypes)[by]
    rows = df.select(by, F.xxhash64(F.lit(seed), F.col(key), F.col(by)).alias("h"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def run(batches):
        sums: dict = {}
        u = np.uint64
        step = np.arange(rounds, dtype=np.uint64) * u(GOLDEN)
        for b in batches:
            f = b.to_pandas()
            for name, g in f.groupby(by, dropna=False):
                total = sums.setdefault(None if name != name else name, np.zeros((2, rounds)))
                for lo in range(0, len(g), 1024):
                    part = g.iloc[lo : lo + 1024]
                    draw = splitmix64(part["h"].to_numpy(np.int64).view(np.uint64)[:, None] + step) >> u(11)
                    times = np.searchsorted(POISSON, draw.astype(np.float64) / float(1 << 53), side="right").astype(np.float64)
                    total += part[["x", "y"]].to_numpy(float).T @ times
        if sums:
            names = [k for k in sums for _ in range(rounds)]
            yield pa.RecordBatch.from_arrays([pa.array(names, rows_type), pa.array(list(range(rounds)) * len(sums), pa.int32()), pa.array(np.concatenate([v[0] for v in sums.values()])), pa.array(np.concatenate([v[1] for v in sums.values()]))], [by, "round", "sx", "sy"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows_type = to_arrow_type(df.schema[by].dataType)
    sums = rows.mapInArrow(run, f"{by} {kind}, round int, sx double, sy double").groupBy(by, "round").agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    ci = sums.where("sy <> 0").withColumn("v", F.col("sx") / F.col("sy")).groupBy(by).agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))
    own = df.groupBy(by).agg((F.sum(x) / F.nullif(F.sum(y), F.lit(0))).alias("ratio"), F.count("*").alias("n"))
    out = own.join(ci.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left")
    return out.select(by, "ratio", F.when(F.col("n") > 1, F.col("lo")).alias("lo"), F.when(F.col("n") > 1, F.col("hi")).alias("hi"))


#: Poisson(1): shares of rows that are drawn at most 0, 1, 2, ... times
POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])


def paired_verdict(delta_lo: Column, delta_hi: Column) -> Column:
    return F.when(delta_hi < 0, "better").when(delta_lo > 0, "worse").otherwise("no difference")
