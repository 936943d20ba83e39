"""N-gram Jaccard join with a count-vector R-tree.

Links are all pairs of texts whose sets of five-word shingles have a Jaccard similarity
of 0.75 or more, exactly. Documents with equal sets are one node.

1. One order of all shingles: by hash, but those that lie in the hash-order prefixes of
   more than SMALL nodes last (exact counts, kept as a fixed-size bit table). Two linked
   sets share a shingle among each one's first n - ceil(0.75 n) + 1 of any one order.
2. Shingles that lie in the prefix of two nodes or more meet by shingle. Each node comes
   with its point: how many of its shingles fall into each of GROUPS hash groups. The sum
   of coordinate minima bounds the overlap of two sets from above.
3. Small meetings are compared pair by pair by size, place and point. In a large meeting
   all members are first compared with two pivots; after their links are verified, what
   is left between different components is searched over finer points (FINE groups), by
   an R-tree where a meeting is large: first the likeliest pairs of each two components,
   then, of those still apart, more, then all that the points admit.
4. Every such pair is verified on the whole sets; links give components.

Every admitted pair of nodes of different components is verified in the end; pairs inside
a component need not be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.llm import graph, kernel as K, store

GROUPS = 64
FINE = 512
TREE = 32
ROUNDS = (4, None)
SMALL = 12
WIDE = 4096
SLICE = 1 << 16  # postings or pairs that are open at a time
U = np.uint64
PACKED_POINT, PACKED_FINE = GROUPS // 2 + 1, FINE // 2 + 1
POSTING = np.dtype([("tok", "<u8"), ("sig", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("vec", "u1", PACKED_POINT)])
OPENED = np.dtype([("tok", "<u8"), ("sig", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("vec", "<u2", GROUPS)])
OPENED_FINE = np.dtype([("tok", "<u8"), ("sig", "<u8"), ("n", "<u4"), ("pos", "<u4"), ("vec", "<u2", FINE), ("label", "<i8")])
DOC = np.dtype([("doc_id", "<i8"), ("sig", "<u8"), ("n", "<u4"), ("null", "<u4")])
PAIRS = "a bigint, b bigint"


def signature(s: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(K.mix(np.array([K.mix(s).sum() + U(len(s))], np.uint64))[0])


def need(na, nb, num: int, den: int):
    """Least overlap of linked sets: den*i >= num*(na+nb-i)."""
    return -((-num * (na + nb)) // (num + den))


def ordered(s: np.ndarray, sunk: K.Bits | None) -> np.ndarray:
    """A sorted set in the one order of shingles; sunk ones have the top bit set."""
    s = s & U((1 << 63) - 1)
    if sunk is None:
        return np.sort(s)
    low = sunk.has(s)
    return np.sort(s | (low.astype(np.uint64) << U(63)))


def packed_point(keys: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts by group, rounded up to multiples of a step, in half bytes; the step is the
    last byte, 0 for a set too large to be bounded."""
    c = np.bincount((keys & U(groups - 1)).astype(np.int64), minlength=groups)
    step = max(1, -(-int(c.max(initial=0)) // 15))
    out = np.zeros(groups // 2 + 1, np.uint8)
    if step < 256:
        q = -(-c // step)
        out[:-1] = q[0::2] | q[1::2] << 4
        out[-1] = step
    return out


def counts(vec: np.ndarray) -> np.ndarray:
    """Packed points as counts; 65535 throughout for those not bounded."""
    step = vec[:, -1:].astype(np.uint16)
    out = np.empty((len(vec), 2 * (vec.shape[1] - 1)), np.uint16)
    out[:, 0::2] = (vec[:, :-1] & 15) * step
    out[:, 1::2] = (vec[:, :-1] >> 4) * step
    out[step[:, 0] == 0] = 65535
    return out


def opened(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), OPENED)
    for c in ("tok", "sig", "n", "pos"):
        out[c] = p[c]
    out["vec"] = counts(p["vec"])
    return out


def meets(va: np.ndarray, vb: np.ndarray, least) -> np.ndarray:
    """Whether summed coordinate minima reach ``least``; two points that did not fit pass."""
    top = np.iinfo(va.dtype).max
    full = (va[..., 0] == top) & (vb[..., 0] == top)
    return full | (np.minimum(va, vb).sum(axis=-1, dtype=np.int64) >= least)


def admits(p: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of postings of one shingle may be linked (never false for a link at
    its first common shingle)."""
    na, nb = p["n"][i].astype(np.int64), p["n"][j].astype(np.int64)
    least = need(na, nb, num, den)
    rest = 1 + np.minimum(na - p["pos"][i] - 1, nb - p["pos"][j] - 1)
    ok = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (rest >= least) & (p["sig"][i] != p["sig"][j])
    k = np.flatnonzero(ok)
    step = (1 << 20) // p["vec"].shape[1]
    for x in range(0, len(k), step):
        part = k[x : x + step]
        ok[part] = meets(p["vec"][i[part]], p["vec"][j[part]], least[part])
    return ok


class RTree:
    """Bulk-loaded over points sorted by size: nodes hold the coordinate maxima, the size
    range and the components below them."""

    LEAF, FAN = 16, 8

    def __init__(self, p: np.ndarray, label: np.ndarray):
        self.order = np.lexsort((p["vec"][:, 0], p["n"]))
        self.p, self.label = p[self.order], label[self.order]
        self.levels = []
        cut = np.arange(0, len(p), self.LEAF)
        vec = np.maximum.reduceat(self.p["vec"], cut, axis=0)
        lo, hi = np.minimum.reduceat(self.p["n"], cut), np.maximum.reduceat(self.p["n"], cut)
        self.levels.append((vec, lo, hi))
        while len(vec) > self.FAN:
            cut = np.arange(0, len(vec), self.FAN)
            vec, lo, hi = np.maximum.reduceat(vec, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((vec, lo, hi))

    def search(self, q, num: int, den: int) -> np.ndarray:
        """Places (in tree order) of points whose bound admits a link with q."""
        n = int(q["n"])
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            vec, lo, hi = self.levels[depth]
            nodes = nodes[nodes < len(vec)]
            fits = (den * n >= num * lo[nodes].astype(np.int64)) & (den * hi[nodes].astype(np.int64) >= num * n)
            nodes = nodes[fits]
            nodes = nodes[meets(vec[nodes], q["vec"], need(n, np.maximum(lo[nodes].astype(np.int64), -(-num * n // den)), num, den))]
            step = self.FAN if depth else self.LEAF
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
        return nodes[nodes < len(self.p)]


def _sets(docs: DataFrame, schema: str, emit) -> DataFrame:
    """Runs emit(state) over every distinct set that a task meets, once each."""

    def run(batches):
        seen, work = set(), emit()
        next(work)
        for b in batches:
            for _, s in K.shingle_sets(b.column(1)):
                if len(s):
                    sig = signature(s)
                    if sig not in seen:
                        seen.add(sig)
                        out = work.send((sig, s))
                        if out:
                            yield from out
        out = work.send(None)
        if out:
            yield from out

    return docs.mapInArrow(run, schema)


def _meetings(bucket: int, table: pa.Table, num: int, den: int):
    """Postings of a bucket -> admitted pairs of small meetings and pivots' pairs of large
    ones; large meetings' postings go on, as payload."""
    packed = K.unpack(table, POSTING)
    packed = packed[np.lexsort((packed["sig"], packed["tok"]))]
    if len(packed):
        packed = packed[np.r_[True, (packed["tok"][1:] != packed["tok"][:-1]) | (packed["sig"][1:] != packed["sig"][:-1])]]
    cut = np.flatnonzero(np.r_[True, packed["tok"][1:] != packed["tok"][:-1]]) if len(packed) else np.zeros(0, np.int64)
    ends, lo = np.r_[cut[1:], len(packed)], 0
    while lo < len(cut):  # points are opened for some whole meetings at a time
        hi = max(lo + 1, int(np.searchsorted(ends, cut[lo] + SLICE, side="right")))
        yield from _met(bucket, packed[cut[lo] : ends[hi - 1]], cut[lo:hi] - cut[lo], num, den)
        lo = hi


def _met(bucket: int, packed: np.ndarray, cut: np.ndarray, num: int, den: int):
    p = opened(packed)
    size = np.diff(np.r_[cut, len(p)])
    found = []
    small = np.repeat((size > 1) & (size <= SMALL), size)
    q = p[small]
    for d in range(1, SMALL):
        if len(q) <= d:
            break
        i = np.flatnonzero(q["tok"][:-d] == q["tok"][d:])
        if not len(i):
            break
        i = i[admits(q, i, i + d, num, den)]
        found.append(np.stack([q["sig"][i], q["sig"][i + d]], 1))
    large = np.flatnonzero(size > SMALL)
    big = []
    for g in large:
        m = p[cut[g] : cut[g] + size[g]]
        for pivot in (0, 1):  # the least names: mostly the same ones for all shingles of a group of copies
            j = np.arange(pivot + 1, len(m))
            i = np.full(len(j), pivot)
            k = admits(m, i, j, num, den)
            found.append(np.stack([m["sig"][i[k]], m["sig"][j[k]]], 1))
        big.append(packed[cut[g] : cut[g] + size[g]])
    ab = K.distinct_pairs(np.concatenate(found)) if found else np.zeros((0, 2), np.uint64)
    yield _pair_batch(ab, bucket, None)
    if big:
        m = np.concatenate(big)
        for x in range(0, len(m), 1 << 16):
            yield _pair_batch(np.zeros((0, 2), np.uint64), bucket, m[x : x + (1 << 16)].tobytes())


def _postings(rows: DataFrame, sunk_b, live_b, nb: int, prefix) -> DataFrame:
    """Packed postings of live prefix shingles, by shingle, in buckets 0 to nb-1, and packed
    documents (doc_id, name, size), dealt by doc_id over buckets nb to 2*nb-1."""

    def run(batches):
        seen, pack, docs = set(), K.Packer(nb), K.Packer(nb)
        for b in batches:
            own = np.zeros(b.num_rows, DOC)
            own["doc_id"] = b.column(0).fill_null(0).to_numpy()
            own["null"] = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, s in K.shingle_sets(b.column(1)):
                if not len(s):
                    continue
                sig = signature(s)
                own["sig"][row], own["n"][row] = sig, len(s)
                if sig in seen:
                    continue
                seen.add(sig)
                keys, p = prefix(s, sunk_b.value)
                at = np.flatnonzero(live_b.value.has(keys[:p]))
                if len(at):
                    rec = np.zeros(len(at), POSTING)
                    rec["tok"], rec["sig"], rec["n"], rec["pos"], rec["vec"] = keys[at], sig, len(keys), at, packed_point(keys)
                    yield from pack.add(K.bucket_of(keys[at], nb), rec)
            yield from docs.add(nb + K.bucket_of(own["doc_id"].view(np.uint64), nb), own)
        yield from pack.close()
        yield from docs.close()

    return rows.mapInArrow(run, K.PACKED)


def _met_or_docs(bucket: int, table: pa.Table, nb: int, num: int, den: int):
    names = ["a", "b", "bucket", "payload", "doc_id", "n_shingles", "sig"]
    if bucket < nb:
        for r in _meetings(bucket, table, num, den):
            k = r.num_rows
            yield pa.RecordBatch.from_arrays([*r.columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
        return
    d = K.unpack(table, DOC)
    k = len(d)
    none = pa.nulls(k, pa.int64())
    ids = pa.array(d["doc_id"].copy(), mask=d["null"].astype(bool))
    sig = pa.array((d["sig"] ^ U(1 << 63)).view(np.int64), mask=d["n"] == 0)
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), ids, pa.array(d["n"].astype(np.int64)), sig], names)


def _pair_batch(ab: np.ndarray, bucket: int, payload: bytes | None) -> pa.RecordBatch:
    a, b = ab.min(axis=1, initial=np.iinfo(np.uint64).max), ab.max(axis=1, initial=0)
    sa, sb = (a ^ U(1 << 63)).view(np.int64), (b ^ U(1 << 63)).view(np.int64)
    k = len(ab)
    arrays = [pa.array(sa), pa.array(sb), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
    if payload is not None:
        arrays = [pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "bucket", "payload"])


def _named(sigs: DataFrame) -> K.Bits:
    """Bit table of set names, sized by their number; what it lets through besides is only
    fetched in vain."""
    bits = K.bits_for(sigs.count())

    def run(batches):
        for b in batches:
            yield from K.bit_rows(K.distinct(b.column(0).to_numpy().view(np.uint64) ^ U(1 << 63)), bits)

    return K.bits_total(sigs.mapInArrow(run, K.PACKED), bits)


def _fetch(rows: DataFrame, heads: DataFrame, sigs: DataFrame, whole: bool) -> DataFrame:
    """(sig, data) per name in ``sigs``: the whole set or its finer point. Repeated rows of
    one doc_id may give a name twice; pairs are made distinct again.

    Only documents whose id is the least of a wanted name's are read word by word (by a
    fixed-size bit table; what it lets through besides is computed in vain)."""
    spark = rows.sparkSession
    sigs = store.table(sigs.select("sig").distinct(), "op8-named")
    named_b = spark.sparkContext.broadcast(_named(sigs))
    ids_b = spark.sparkContext.broadcast(_named(heads.join(sigs, "sig", "left_semi").where("d IS NOT NULL").select(F.col("d").alias("sig"))))
    store.drop(sigs)

    def run(batches):
        seen = set()
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy().view(np.uint64) ^ U(1 << 63)
            b = b.filter(pa.array(ids_b.value.has(ids) | b.column(0).is_null().to_numpy(zero_copy_only=False)))
            sig, data = [], []
            for _, s in K.shingle_sets(b.column(1)):
                if len(s):
                    name = signature(s)
                    if name not in seen and named_b.value.has(np.array([name], np.uint64))[0]:
                        seen.add(name)
                        sig.append(name - (1 << 63))
                        data.append(s.tobytes() if whole else packed_point(s, FINE).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(data, pa.binary())], ["sig", "data"])

    return rows.mapInArrow(run, "sig bigint, data binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(2)[i].as_buffer(), np.uint64)
                y = np.frombuffer(b.column(3)[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter = int((y[at] == x).sum())
                if den * inter >= num * (len(x) + len(y) - inter):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    one = pairs.join(sets.select(F.col("sig").alias("a"), F.col("data").alias("ka")), "a")
    two = one.join(sets.select(F.col("sig").alias("b"), F.col("data").alias("kb")), "b").select("a", "b", "ka", "kb")
    return two.mapInArrow(run, PAIRS).distinct()


def _rest(bucket: int, table: pa.Table, num: int, den: int, top: int | None):
    """What large meetings leave between different components: all admitted pairs, or the
    ``top`` likeliest of each two components."""
    tok, label = table.column("tok").to_numpy().view(np.uint64), table.column("label").to_numpy()
    fine = table.column("fine").combine_chunks()
    fine = fine.chunk(0) if isinstance(fine, pa.ChunkedArray) else fine
    first = fine.offset * PACKED_FINE  # all values have this length
    fine = np.frombuffer(fine.buffers()[2], np.uint8)[first : first + len(fine) * PACKED_FINE].reshape(-1, PACKED_FINE)
    order = np.lexsort((label, tok))
    cut = np.flatnonzero(np.r_[True, tok[order][1:] != tok[order][:-1]])
    for lo, hi in zip(cut, np.r_[cut[1:], len(order)]):
        at = order[lo:hi]
        if label[at[0]] == label[at[-1]]:
            continue
        m = np.zeros(len(at), OPENED_FINE)  # one meeting's points are open at a time
        m["tok"], m["label"], m["vec"] = tok[at], label[at], counts(fine[at])
        m["sig"] = table.column("sig").to_numpy().view(np.uint64)[at]
        m["n"], m["pos"] = table.column("n").to_numpy()[at], table.column("pos").to_numpy()[at]
        i, j = _apart(m, num, den, top)
        ab = K.distinct_pairs(np.stack([m["sig"][i], m["sig"][j]], 1))
        a, b = (ab[:, 0] ^ U(1 << 63)).view(np.int64), (ab[:, 1] ^ U(1 << 63)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _asked(m: np.ndarray, num: int, den: int):
    """Pairs (i, j) of a meeting that may be looked at, about SLICE at a time."""
    if len(m) <= TREE:
        yield np.triu_indices(len(m), 1)
        return
    # the largest component's members need not ask
    lab, count = np.unique(m["label"], return_counts=True)
    tree = RTree(m, m["label"])
    held, n = [], 0
    for q in np.flatnonzero(m["label"] != lab[count.argmax()]):
        j = tree.order[tree.search(m[q], num, den)]
        held.append((q, j[m["label"][j] != m["label"][q]]))
        n += len(held[-1][1])
        if n >= SLICE:
            yield np.repeat([q for q, _ in held], [len(j) for _, j in held]), np.concatenate([j for _, j in held])
            held, n = [], 0
    if held:
        yield np.repeat([q for q, _ in held], [len(j) for _, j in held]), np.concatenate([j for _, j in held])


def _apart(m: np.ndarray, num: int, den: int, top: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Admitted pairs between different components of a meeting, all or the ``top``
    likeliest of each two components. Besides the pairs that stay, SLICE are held at a time."""
    held, n, most = [], 0, SLICE

    def best(held):
        i, j, likely = (np.concatenate(x) for x in zip(*held))
        a, b = np.minimum(m["label"][i], m["label"][j]), np.maximum(m["label"][i], m["label"][j])
        o = np.lexsort((m["sig"][i] ^ m["sig"][j], -likely, b, a))
        a, b = a[o], b[o]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        o = o[np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)])) < top]
        return [(i[o], j[o], likely[o])]

    for i, j in _asked(m, num, den):
        apart = m["label"][i] != m["label"][j]
        i, j = i[apart], j[apart]
        ok = admits(m, i, j, num, den)
        i, j = i[ok].astype(np.int32), j[ok].astype(np.int32)
        if top is None or not len(i):
            likely = np.zeros(len(i))
        else:
            likely = np.concatenate([np.minimum(m["vec"][i[x : x + 4096]], m["vec"][j[x : x + 4096]]).sum(axis=1, dtype=np.int64) for x in range(0, len(i), 4096)]) / need(m["n"][i].astype(np.int64), m["n"][j].astype(np.int64), num, den)
        held.append((i, j, likely))
        n += len(i)
        if top is not None and n > most:
            held = best(held)
            n = len(held[0][0])
            most = max(SLICE, 2 * n)
    if top is not None and n:
        held = best(held)
    if not held:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, sig (name of its set).

    component_id is the least doc_id reachable by links of at least ``percent`` (51 to
    99). Null, empty and wordless texts have no shingles and are linked with nothing, not
    even each other. Equal texts are linked. Repeated doc_ids and null doc_ids are rows
    like any other (a component of null ids only has a null id). Empty table: no rows.
    Other columns are ignored.
    """
    return _linked(docs, doc_id, text, percent).drop("label")


def _linked(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """``link`` with one more column: label, which names the row's component (null without shingles)."""
    spark = docs.sparkSession
    K.once(spark)
    num, den = percent, 100
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nb = K.n_buckets(spark)

    def prefix(s, sunk):
        keys = ordered(s, sunk)
        return keys, len(keys) - (-(-num * len(keys) // den)) + 1

    def keys_only(sunk_b):
        def emit():
            out, pack = None, K.Packer(nb)
            while True:
                got = yield out
                if got is None:
                    yield list(pack.close())
                    return
                keys, p = prefix(got[1], sunk_b and sunk_b.value)
                out = list(pack.add(K.bucket_of(keys[:p], nb), keys[:p]))

        return _sets(rows, K.PACKED, emit)

    sunk_b = spark.sparkContext.broadcast(K.repeated(keys_only(None), SMALL + 1, (1 << 63) - 1))
    live_b = spark.sparkContext.broadcast(K.repeated(keys_only(sunk_b), 2))
    met = store.table(K.exchange(_postings(rows, sunk_b, live_b, nb, prefix), lambda b, t: _met_or_docs(b, t, nb, num, den), "a bigint, b bigint, bucket int, payload binary, doc_id bigint, n_shingles bigint, sig bigint"), "op8-met")
    met_all = met
    named = met.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "sig")
    met = met.where("n_shingles IS NULL").select("a", "b", "bucket", "payload")
    pairs = store.table(met.where("bucket IS NULL").select("a", "b").distinct(), "op8-pairs")
    large = met.where("bucket IS NOT NULL").select("bucket", "payload")
    first_pairs = pairs

    all_heads = heads = store.table(named.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("d")), "op8-heads")

    def checked(pairs):
        sets = store.table(_fetch(rows, heads, pairs.select(F.explode(F.array("a", "b")).alias("sig")), True), "op8-sets")
        out = store.table(_verified(pairs, sets, num, den), "op8-links")
        store.drop(sets)
        return out

    # first: the pairs found so far
    links = checked(pairs)
    labels = graph.components(links)

    # then large meetings, between components
    members = store.table(_members(large), "op8-members")
    fine = store.table(_fetch(rows, heads, members, False).dropDuplicates(["sig"]), "op8-fine")
    for top in ROUNDS:
        tagged = members.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        mixed = tagged.groupBy("tok").agg((F.min("label") < F.max("label")).alias("mixed"), F.count("*").alias("members")).where("mixed").drop("mixed")
        tagged = tagged.join(mixed, "tok")
        # very large meetings split by size: linked sizes lie in one band or in neighbours
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("int")
        tagged = tagged.withColumn("band", F.explode(F.when(F.col("members") > WIDE, F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))))
        tagged = tagged.withColumn("tok", F.when(F.col("band") >= 0, F.xxhash64("tok", "band")).otherwise(F.col("tok")))
        tagged = tagged.join(fine.withColumnRenamed("data", "fine"), "sig")
        tagged = tagged.select(F.pmod(F.xxhash64("tok"), F.lit(nb)).cast("int").alias("bucket"), "tok", (F.col("sig").bitwiseXOR(F.lit(-(1 << 63)))).alias("sig"), "n", "pos", "fine", "label")
        more = K.exchange(tagged, lambda b, t, top=top: _rest(b, t, num, den, top), PAIRS).distinct()
        more = store.table(more.join(pairs, ["a", "b"], "left_anti"), "op8-more")
        if more.limit(1).count():
            pairs = pairs.unionByName(more)
            links = links.unionByName(checked(more))
            store.drop(labels)
            labels = graph.components(links)

    heads = heads.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = heads.groupBy("label").agg(F.min("d").alias("component_id"))
    heads = heads.join(least, "label").select("sig", "component_id", "label")
    out = named.join(heads, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sig", "label")
    out = store.table(out, "op8-out")
    store.drop(met_all, first_pairs, all_heads, members, fine, labels)
    return out


def _members(large: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for x in b.column("payload"):
                p = np.frombuffer(x.as_buffer(), POSTING)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p["tok"].copy().view(np.int64)), pa.array((p["sig"] ^ U(1 << 63)).view(np.int64)), pa.array(p["n"].astype(np.int64)), pa.array(p["pos"].astype(np.int64))],
                    ["tok", "sig", "n", "pos"],
                )

    return large.mapInArrow(run, "tok bigint, sig bigint, n bigint, pos bigint")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Rows of ``docs``, all columns: one of each component, and all without shingles. The
    one of a component has its least doc_id (none only where no row has one), of rows with
    that id the least set name and then the least text hash."""
    rows = _linked(docs, doc_id, text, percent)
    key = F.col(doc_id).cast("long")
    heads = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("h"))
    heads = heads.select(F.col("h.doc_id").alias("__id"), F.col("h.sig").alias("__set"))
    kept = heads.unionByName(rows.where("label IS NULL").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__set")))
    twice = store.table(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")), "op8-twice")
    again, none = twice.limit(1).count() > 0, rows.where("doc_id IS NULL").limit(1).count() > 0
    single = docs.join(kept.select("__id").distinct(), key == F.col("__id"), "left_semi")
    if not again and not none:
        return single
    # an id of several rows names no row: theirs are told apart by set and text
    many = docs.where(key.isNull())
    if again:
        single = single.join(twice, key == F.col("__id"), "left_anti")
        many = many.unionByName(docs.join(twice, key == F.col("__id"), "left_semi"))
    many = _with_set(many, text)
    bare = many.where("__name IS NULL").select(docs.columns)
    held = many.where("__name IS NOT NULL").join(heads, (F.col("__name") == F.col("__set")) & key.eqNullSafe(F.col("__id")), "left_semi")
    one = held.groupBy("__name").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("r")).select("r.*")
    return single.unionByName(bare).unionByName(one)


def _with_set(docs: DataFrame, text: str) -> DataFrame:
    """Adds __name, the name of the text's set; null without shingles."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            names: list = [None] * b.num_rows
            for row, s in K.shingle_sets(b.column(at)):
                if len(s):
                    names[row] = signature(s) - (1 << 63)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], [*b.schema.names, "__name"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__name", LongType())]))


def op8_ngram_jaccard_join(spark, sf_dir):
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("sig")
