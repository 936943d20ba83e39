"""Secret scans with corpus-wide ownership (native DataFrame expressions only).

Three fixed patterns give the base spans. A wider pattern gives candidate strings. The
hashes of all candidates, those inside base spans too, and of the base spans' own secrets
are counted by distinct owners and repositories over the whole corpus. Candidates of one
owner only, that look live, are added as spans. Widely copied strings are examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import store

# fixed values: patterns, the least length of the secret, and the order of the kinds
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"  # runs are maximal, so short ones need no match to be passed over
WIDE = r"([A-Za-z0-9_-]{20,})"
KINDS = ("assign", "access", "hex", "owned")
OPEN, PART = "\x01", "\x02"


def _marked(text: Column, pattern: str, secret_group: int) -> Column:
    """Array of (start, end, n, s) for each match: code points, end exclusive, the
    secret's length and the secret. Matches are put between marks, so that the pieces'
    lengths give the places; ``text`` must not hold the marks (see ``_clean``)."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{PART}${secret_group}{OPEN}"), OPEN)
    # odd pieces are matches: match + PART + secret
    return F.expr(
        "aggregate({p}, struct(0 AS at, false AS hit, CAST(array() AS array<struct<start:int,end:int,n:int,s:string>>) AS found), "
        "(a, x) -> CASE WHEN a.hit THEN struct(a.at + instr(x, '\\u0002') - 1 AS at, false AS hit, "
        "array_append(a.found, struct(a.at AS start, a.at + instr(x, '\\u0002') - 1 AS end, length(x) - instr(x, '\\u0002') AS n, substr(x, instr(x, '\\u0002') + 1) AS s)) AS found) "
        "ELSE struct(a.at + length(x) AS at, true AS hit, a.found AS found) END, a -> a.found)".format(p="__pieces")
    ), pieces


def _with_spans(df: DataFrame, out: str, pattern: str, group: int, keep: str, needle: Column) -> DataFrame:
    """Adds array ``out`` of kept matches; texts without ``needle`` skip the pattern's work."""
    expr, pieces = _marked(F.col("__t"), pattern, group)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,n:int,s:string>>)")
    df = df.withColumn("__pieces", F.when(needle, pieces))
    return df.withColumn(out, F.when(F.size(F.coalesce("__pieces", F.array())) > 1, F.filter(expr, lambda x: F.expr("true") if not keep else x["n"] >= int(keep))).otherwise(none)).drop("__pieces")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in its order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _tagged(col: str, k: int) -> Column:
    return F.transform(F.col(col), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str | tuple[str, ...] = ("source", "lang"), owner: str = "source", max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """One row per document with its base and added spans.

    Candidates are runs of 20 or more of [A-Za-z0-9_-] that hold a digit, a lower-case and
    an upper-case letter and at least ten different characters. One is live when no more
    than ``max_owners`` owners and ``max_repositories`` repositories hold it, in whatever place,
    inside base spans too; it becomes a span of kind "owned" unless a base span overlaps it.
    A base span's secret, or a candidate that no base span overlaps, that more owners or
    repositories hold is an example (n_example counts its places); n_live counts the places
    of those that are live. A repository is named by the columns ``repository`` that docs
    has, together. Null text: no spans. Null owner or repository: a value of
    its own (''). Repeated rows: each gets the same result. Empty table: no rows. Other
    columns are ignored.
    """
    names = [c for c in ((repository,) if isinstance(repository, str) else repository) if c in docs.columns]
    t = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + PART, "\x03\x03")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("repository"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__key"),
        t.alias("__t"),
    )
    rows = _with_spans(rows, "assign", ASSIGN, 2, "6", F.col("__t").rlike(r"[:=]"))
    rows = _with_spans(rows, "access", ACCESS, 1, "20", F.col("__t").contains("AKIA"))
    rows = _with_spans(rows, "hex", HEX, 1, "24", F.lit(True))
    rows = _with_spans(rows, "wide", WIDE, 1, "20", F.lit(True))
    rows = rows.drop("__t")
    base = F.concat(_tagged("assign", 1), _tagged("access", 2), _tagged("hex", 3))
    rows = rows.withColumn("base", base)
    looks = F.filter(
        "wide",
        lambda x: x["s"].rlike("[0-9]") & x["s"].rlike("[a-z]") & x["s"].rlike("[A-Z]") & (F.size(F.array_distinct(F.split(x["s"], ""))) >= 10),
    )
    # own: 0 for a base span's secret, which ends its match, 1 for a free candidate, 2 for one that a base span overlaps
    secret = F.transform(F.concat("assign", "access", "hex"), lambda x: F.struct((x["end"] - x["n"]).alias("start"), x["end"].alias("end"), F.lit(0).alias("own"), F.sha2(x["s"], 256).alias("h")))
    wide = F.transform(looks, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])), 2).otherwise(1).alias("own"), F.sha2(x["s"], 256).alias("h")))
    rows = rows.select(
        "doc_id", "__key", "owner", "repository",
        F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        "base",
        F.concat(secret, wide).alias("cands"),
    )
    rows = store.table(rows, "op6")  # texts are scanned once; from here on rows hold spans only
    cands = rows.where(F.size("cands") > 0).select("doc_id", "__key", "owner", "repository", F.explode("cands").alias("c"))
    held = cands.groupBy(F.col("c.h").alias("h"), "owner", "repository").agg(F.lit(1).alias("one"))  # map-side first: a copied string is no hot key
    freq = held.groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    judged = cands.where("c.own < 2").select("doc_id", "__key", "c.*").join(freq, "h")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    per = judged.groupBy("doc_id", "__key").agg(
        F.collect_set(F.when(live & (F.col("own") == 1), F.struct("start", F.lit(4).alias("k"), "end"))).alias("owned"),
        F.collect_set(F.when(~live, F.struct("start", "end"))).alias("copied"),
        F.collect_set(F.when(live, F.struct("start", "end"))).alias("own_places"),
    ).withColumnRenamed("doc_id", "__id").withColumnRenamed("__key", "__k2")
    out = rows.join(per, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("__key") == F.col("__k2")), "left")
    text_base = _joined(F.col("base"))
    owned = F.coalesce("owned", F.expr("CAST(array() AS array<struct<start:int,k:int,end:int>>)"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(text_base, 256).alias("base_sha256"),
        _joined(F.concat("base", owned)).alias("spans"),
        F.size(owned).cast("long").alias("n_owned"),
        F.coalesce(F.size("copied"), F.lit(0)).cast("long").alias("n_example"),
        F.coalesce(F.size("own_places"), F.lit(0)).cast("long").alias("n_live"),
    )
