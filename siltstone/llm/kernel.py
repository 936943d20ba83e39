"""Vectorised kernels over the bytes of Arrow text columns, and packed exchanges.

Texts are taken in blocks of about 256 KB of whole texts; words, lines and shingles of a
block are arrays of places and 64-bit hashes, so no Python object is made per word.
Hashes are sums of byte * B**place modulo 2**64 from one running sum per block, moved to
place 0 by the inverse power and mixed.

A packed exchange sends many small records as one binary value per (task, bucket).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True  # fixed values: \x20 and \x09-\x0D
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0.. and B**-0.. modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(size, U(b))
            a[0] = U(1)
            out.append(np.multiply.accumulate(a))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which beats the hash table of np.unique by far)."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[cut], np.diff(np.r_[cut, len(x)])


def distinct_pairs(ab: np.ndarray) -> np.ndarray:
    """Distinct rows of two columns, the smaller value of each row first, sorted."""
    if not len(ab):
        return ab
    a, b = ab.min(axis=1), ab.max(axis=1)
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return np.stack([a[new], b[new]], 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of each text) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) with about BLOCK bytes each."""
    raw, offs = text_bytes(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def running(buf: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Running sums C with C[e]-C[s] = sum of (byte+1)*B**place over [s, e)."""
    pw, _ = powers(len(buf) + 1)
    v = (buf if fold is None else fold[buf]).astype(np.uint64)
    v += U(1)
    v *= pw[: len(buf)]
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def spans_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inv = powers(len(c))
    return mix((c[e] - c[s]) * inv[s])


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a block: runs of bytes without gaps; texts' edges end words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = (buf != 32) & (buf - np.uint8(9) > 4) if gap is SPACE else ~gap[buf]
    # starts and ends in turn; a text's edge inside a run ends one word and starts another
    edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    inner = offs[(offs > 0) & (offs < len(buf))]
    inner = inner[ink[inner] & ink[inner - 1]]
    if len(inner):
        inner = np.repeat(distinct(inner), 2)
        edge = np.insert(edge, np.searchsorted(edge, inner), inner)
    edge = np.r_[np.zeros(int(ink[0]), np.int64), edge, np.full(int(ink[-1]), len(buf))]
    return edge[::2], edge[1::2]


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of each text.

    Shingles are k successive words; a text of fewer words has its whole sequence as
    one; a text without words has none.
    """
    for lo, hi, buf, offs in blocks(column):
        s, e = words(buf, offs)
        h = spans_hash(running(buf, LOWER if lower else None), s, e)
        at = np.searchsorted(s, offs)
        grams = np.zeros(0, np.uint64)
        if len(h) >= k:
            grams = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                grams *= U(BASE)
                grams += h[j : len(h) - k + 1 + j]
                grams ^= grams >> U(29)
            grams = mix(grams)
        for row in range(lo, hi):
            a, b = at[row - lo], at[row - lo + 1]
            m = b - a
            if m >= k:
                yield row, distinct(grams[a : b - k + 1])
            elif m:
                g = U(m)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        g = (g * U(BASE)) ^ x
                yield row, mix(np.array([g], np.uint64))
            else:
                yield row, np.zeros(0, np.uint64)


def once(spark, rows: int = 1000) -> None:
    """Bounds what an Arrow batch holds: texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def n_buckets(spark) -> int:
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


PACKED = "bucket int, payload binary"


class Packer:
    """Gathers records by bucket and hands them out as packed rows."""

    def __init__(self, buckets: int, flush: int = 8 << 20):
        self.buckets, self.flush, self.parts, self.size = buckets, flush, [], 0

    def add(self, bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.parts.append((bucket, records))
            self.size += records.nbytes
        if self.size >= self.flush:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        b = np.concatenate([x for x, _ in self.parts])
        r = np.concatenate([x for _, x in self.parts])
        self.parts, self.size = [], 0
        two = b.min() >= 0 and b.max() < 1 << 16  # two-byte values are sorted by their digits
        order = np.argsort(b.astype(np.uint16) if two else b, kind="stable")
        b, r = b[order], r.take(order, axis=0)  # take copies records whole, an index field by field
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        ends = np.r_[cut[1:], len(b)]
        yield pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array([r[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())], ["bucket", "payload"])


def unpack(table: pa.Table, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in table.column("payload")]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys ^ U(0x5851F42D4C957F2D)) >> U(32)) * U(n) >> U(32)).astype(np.int32)


def exchange(packed: DataFrame, fn: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """All payloads of a bucket go to one call of fn; buckets are many and even."""

    form = to_arrow_schema(StructType.fromDDL(schema))

    def run(key, table):
        return pa.Table.from_batches(list(fn(key[0].as_py(), table)), form)

    return packed.groupBy("bucket").applyInArrow(run, schema)


# a sketch's cells travel in so many parts

SKETCH_CHUNKS = 64


SEGMENTS = 256


class Bits:
    """Bit table with two places per key, both in the key's segment."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.width = len(data) * 8 // SEGMENTS

    @staticmethod
    def places(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys ^ U(0xA0761D6478BD642F))
        m = U(width - 1)
        return (h >> U(56)).astype(np.int64), (h & m).astype(np.uint32), ((h >> U(26)) & m).astype(np.uint32)

    def has(self, keys: np.ndarray) -> np.ndarray:
        seg, a, b = self.places(keys, self.width)
        seg *= self.width
        x, y = seg + a, seg + b
        return ((self.data[x >> 3] >> (x & 7).astype(np.uint8)) & (self.data[y >> 3] >> (y & 7).astype(np.uint8)) & 1).astype(bool)


def bits_for(keys: int) -> int:
    """Size of a bit table: 16 places a key, 2**20 to 2**30 (128 MB). Beyond 2**26 keys a
    table lets more through, which the exact step behind each use drops."""
    return 1 << min(30, max(20, (16 * max(1, keys) - 1).bit_length()))


def bit_rows(keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows for ``bits_total``: the places that keys set, by segment."""
    if len(keys):
        seg, a, b = Bits.places(keys, bits // SEGMENTS)
        yield from _by(np.r_[seg, seg], np.r_[a, b])


def _by(bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    p = Packer(0)
    yield from p.add(bucket, records)
    yield from p.close()


def bits_total(rows: DataFrame, bits: int) -> Bits:
    """The bit table on the driver: bits / 8 bytes, whatever the input."""
    width = bits // SEGMENTS

    def add(bucket, table):
        seg = np.zeros(width, np.uint8)
        for x in table.column("payload"):
            seg[np.frombuffer(x.as_buffer(), np.uint32)] = 1
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(seg, bitorder="little").tobytes()], pa.binary())], ["bucket", "payload"])

    data = np.zeros(bits // 8, np.uint8)
    for r in exchange(rows, add, PACKED).collect():
        data[r.bucket * width // 8 : (r.bucket + 1) * width // 8] = np.frombuffer(r.payload, np.uint8)
    return Bits(data)


def repeated(keys: DataFrame, least: int, mask: int = (1 << 64) - 1) -> Bits:
    """Bit table of the keys (packed 8-byte, by bucket) that occur ``least`` times or more;
    its size follows their number (see ``bits_for``)."""
    from siltstone.llm import store

    def dup(bucket, table):
        k = np.sort(unpack(table, np.uint64) & U(mask))
        d = least - 1
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([distinct(k[d:][k[d:] == k[:-d]]).tobytes()], pa.binary())], ["bucket", "payload"])

    found = store.table(exchange(keys, dup, PACKED), "repeated")
    out = packed_bits(found)
    store.drop(found)
    return out


def packed_bits(found: DataFrame) -> Bits:
    """Bit table of packed 8-byte keys, sized by their number."""
    from pyspark.sql import functions as F

    bits = bits_for((found.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) >> 3)

    def place(batches):
        for b in batches:
            for x in b.column("payload"):
                yield from bit_rows(np.frombuffer(x.as_buffer(), np.uint64), bits)

    return bits_total(found.mapInArrow(place, PACKED), bits)
