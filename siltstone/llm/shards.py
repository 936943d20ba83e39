"""Sharding by a hierarchical weighted hash tree (native expressions).

A key descends region, rack and shard. At each level every child draws -ln(u)/weight,
u a hash of the key and the child's name, and the least draw wins; a node's weight is the
sum below it. When weights change, keys move only into or out of the changed subtrees.
A shard that is added stands in a region of its own, so it only takes keys into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import store


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n: int, per_rack: int = 4, racks: int = 2, first: int = 40) -> tuple[Leaf, ...]:
    """n shards. The first ``first`` are laid out at once, ``per_rack`` to a rack and
    ``racks`` racks to a region; each later one is ``grown``, so that from there on a tree of
    one more shard only moves keys into it."""
    tree = tuple(Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(min(n, first)))
    for _ in range(n - first):
        tree = grown(tree)
    return tree


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """One more shard, in a new rack of a new region."""
    return (*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight))


def _winner(key: Column, kind: str, nodes: list[tuple[int, float]]) -> Column:
    """Name of the child with the least draw; equal draws go to the smaller name."""
    if len(nodes) == 1:
        return F.lit(nodes[0][0])
    draws = []
    for name, weight in nodes:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{kind}/{name}"), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(name).alias("n")))
    return F.least(*draws)["n"]


def place(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """Shard of a key (null keys count as '')."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def level(leaves: tuple[Leaf, ...], depth: int) -> Column:
        field = ("region", "rack", "shard")[depth]
        sums: dict[int, float] = {}
        for x in leaves:
            sums[getattr(x, field)] = sums.get(getattr(x, field), 0.0) + x.weight
        pick = _winner(key, field, sorted(sums.items()))
        if depth == 2:
            return pick
        out = None
        for name in sorted(sums):
            below = level(tuple(x for x in leaves if getattr(x, field) == name), depth + 1)
            out = F.when(pick == name, below) if out is None else out.when(pick == name, below)
        return out

    return level(tree, 0).cast("int")


def assign(docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text", tree: tuple[Leaf, ...] | None = None, slices: int | None = None) -> DataFrame:
    """One row per document: its shard, its place in it, and its shard with one more.

    Law "key": doc_id and the tree alone decide. size: UTF-8 bytes (null: none) plus 16.
    slot runs from 0 without gaps in each shard: documents of a shard are dealt by a hash
    of doc_id over ``slices`` (by default as many as shuffle partitions), numbered in each
    and moved on by the counts of the slices before, so no task holds a whole shard.
    Order in a slice: doc_id (null first), then crc32, then size; equal rows are
    interchangeable. A null doc_id is a key like any other; repeated rows each get a slot;
    an empty table gives no rows; other columns are ignored.
    """
    tree = tree or topology(n_shards)
    spark = docs.sparkSession
    slices = slices or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col(doc_id), tree).alias("shard"),
        place(F.col(doc_id), grown(tree)).alias("grown_shard"),
    )
    # repeated rows of one doc_id spread by their content too
    rows = store.table(rows.withColumn("__slice", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"), F.lit(slices)).cast("int")), "op2")
    counts = rows.groupBy("shard", "__slice").agg(F.count("*").alias("n"))  # shards x slices rows at most
    before = counts.select("shard", "__slice", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY __slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n").alias("__before"))
    out = rows.withColumn("__rn", F.expr("row_number() OVER (PARTITION BY shard, __slice ORDER BY doc_id, text_crc32, size)")).join(before, ["shard", "__slice"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("__before") + F.col("__rn") - 1).cast("long").alias("slot"), "grown_shard")
