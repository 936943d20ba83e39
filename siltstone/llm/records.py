"""Token ids as length-delimited binary records with a separate offset index.

A data file holds one record per document, in ascending doc_id order:
8 bytes length, 4 bytes masked checksum of those, payload, 4 bytes masked checksum of
the payload; all little-endian. The payload is the ids as 2- or 4-byte unsigned integers.
A checksum c (crc32) is masked as ((c >> 15 | c << 17) + 0xa282ead8) modulo 2**32.
An index file holds 24 bytes per record: doc_id (8, signed), offset (8), ids (4), flags
(4: bit 0 doc_id is null, bits 8 and up the bytes per id), so records can be read in any
order. A manifest names the files in order with their counts.
"""

from __future__ import annotations

import array
import json
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import kernel as K, store

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u4"), ("flags", "<u4")])
MASK = 0xA282EAD8  # fixed value of the record format


def masked(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, offset: int) -> memoryview:
    head = data[offset : offset + 8]
    (length,) = struct.unpack("<Q", head)
    if struct.unpack("<I", data[offset + 8 : offset + 12])[0] != masked(head):
        raise ValueError(f"bad length checksum at {offset}")
    body = data[offset + 12 : offset + 12 + length]
    if len(body) != length or struct.unpack("<I", data[offset + 12 + length : offset + 16 + length])[0] != masked(body):
        raise ValueError(f"bad payload checksum at {offset}")
    return body


def _byte_chars() -> str:
    """Byte-level alphabet (fixed rule): printable Latin-1 bytes stand for themselves, the
    other bytes, in order, for the characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return "".join(out)


class WordIds:
    """Ids of texts through the tokenizers library, each distinct chunk once.

    Chunks end at spaces and line feeds, which the tokenizer's pattern drops and no
    normalisation step joins across, so their ids in a row are the text's ids. A chunk of
    letters below U+0250 (composed already), with or without closing punctuation, is one
    token of the pattern and one more: its lower-case bytes go straight to the library's
    merge model. Every other chunk goes through the whole tokenizer. The memory of chunks
    is bounded: at ``most`` it starts anew.
    """

    CLOSING = ".,|;:!?"

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.most, self.seen, self.low = most, {"": b""}, {"": b""}
        chars = _byte_chars()
        self.table = {i: chars[i] for i in range(256) if chars[i] != chr(i)}
        # the short way is taken only with a tokenizer on which it gives the same ids
        probe = ["The", "l'été".split("'")[1], "Straße", "Ñandú", "x", "über"]
        self.short = all(self.short_ids(w) == self.full_ids(w) for w in probe)

    def full_ids(self, w: str) -> bytes:
        return np.array(self.tok.encode(w, add_special_tokens=False).ids, self.kind).tobytes()

    def short_ids(self, w: str) -> bytes:
        low = w.lower()
        got = self.low.get(low)
        if got is None:
            got = array.array(self.kind.char, [t.id for t in self.merge(low.encode().decode("latin-1").translate(self.table))]).tobytes()
            self.low[low] = got
        return got

    def learn(self, new: list[str]) -> None:
        rest, seen = [], self.seen
        if self.short:
            for w in new:
                body = w if w.isalpha() else w.rstrip(self.CLOSING)
                if body.isalpha() and (body.isascii() or max(body) < "\u0250" and body.lower().isalpha()):
                    ids = self.short_ids(body)
                    if len(body) < len(w):
                        tail = w[len(body) :]
                        if tail not in seen:
                            seen[tail] = self.full_ids(tail)
                        ids = ids + seen[tail]
                    seen[w] = ids
                else:
                    rest.append(w)
        else:
            rest = new
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                seen[w] = array.array(self.kind.char, e.ids).tobytes()

    def payloads(self, texts: list[str]) -> list[bytes]:
        parts = [x.replace("\n", " ").split(" ") for x in texts]
        if len(self.seen) + len(self.low) > self.most:
            self.seen, self.low = {"": b""}, {"": b""}
        flat = list(chain.from_iterable(parts))
        ids = list(map(self.seen.get, flat))
        new = [i for i, v in enumerate(ids) if v is None]
        self.learn(list({flat[i] for i in new}))
        for i in new:
            ids[i] = self.seen[flat[i]]
        out, at = [], 0
        for p in parts:
            out.append(b"".join(ids[at : at + len(p)]))
            at += len(p)
        return out


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, uri: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1) -> list[dict]:
    """Encodes and writes all documents below ``uri``; returns the manifest.

    Documents are range-partitioned and sorted by doc_id (null first, equal ids by text),
    one data and one index file a partition. A file is written under a name of its
    attempt and then renamed, so a repeated task leaves the same files.
    """
    spark = docs.sparkSession
    K.once(spark, 500)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(root, recursive=True)
        name, own = f"{root}/part-{ctx.partitionId():06d}", f".{ctx.taskAttemptId()}.tmp"
        enc, index, at, total = encoder(tokenizer), [], 0, 0
        end = np.array([end_id], enc.kind).tobytes()
        with files.open_output_stream(name + ".bin" + own) as out:
            for b in batches:
                payloads = enc.payloads(b.column(1).to_pylist())
                ids = b.column(0).to_pylist()
                ix = np.zeros(len(ids), INDEX)
                for k, (i, p) in enumerate(zip(ids, payloads)):
                    rec = frame(p + end)
                    n = len(p) // enc.kind.itemsize + 1
                    ix[k] = (i or 0, at, n, (i is None) | enc.kind.itemsize << 8)
                    out.write(rec)
                    at += len(rec)
                    total += n
                index.append(ix)
        ix = np.concatenate(index) if index else np.zeros(0, INDEX)
        with files.open_output_stream(name + ".idx" + own) as out:
            out.write(ix.tobytes())
        for kind in (".bin", ".idx"):
            files.move(name + kind + own, name + kind)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{ctx.partitionId():06d}"]), pa.array([len(ix)], pa.int64()), pa.array([total], pa.int64())], ["part", "docs", "ids"])

    found = sorted((r.asDict() for r in rows.mapInArrow(run, "part string, docs bigint, ids bigint").collect()), key=lambda r: r["part"])
    start = 0
    for r in found:
        r["start"] = start
        start += r["ids"]
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    files.create_dir(root, recursive=True)  # an empty table has no tasks
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(found).encode())
    return found


def read(spark, uri: str, manifest: list[dict], ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, with ``ids``, ids) of every record, read back
    and checked."""
    K.once(spark, 500)
    files_df = spark.createDataFrame([(r["part"], r["start"]) for r in manifest], "part string, start bigint").repartition(max(1, len(manifest)))

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(uri)
        for b in batches:
            for part, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_input_file(f"{root}/{part}.idx") as f:
                    ix = np.frombuffer(f.read(), INDEX)
                with files.open_input_file(f"{root}/{part}.bin") as f:
                    for lo in range(0, len(ix), 500):
                        some = ix[lo : lo + 500]
                        width = some["flags"] >> 8
                        stop = int(some["offset"][-1]) + 16 + int(some["n"][-1]) * int(width[-1])
                        base = int(some["offset"][0])
                        data = memoryview(f.read_at(stop - base, base))
                        crcs, payloads = [], []
                        for r, w in zip(some, width):
                            own = np.frombuffer(unframe(data, int(r["offset"]) - base), f"<u{w}").astype("<u4")
                            if len(own) != r["n"]:
                                raise ValueError("index and record differ")
                            if ids:
                                payloads.append(own)
                            crcs.append(zlib.crc32(own))
                        n = some["n"].astype(np.int64)
                        first = start + np.cumsum(n) - n
                        start += int(n.sum())
                        cols = [pa.array(some["doc_id"], mask=(some["flags"] & 1).astype(bool)), pa.array(first), pa.array(n), pa.array(crcs, pa.int64())]
                        if ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(payloads).astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files_df.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def token_records(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", uri: str | None = None, ids: bool = True) -> DataFrame:
    """Writes all documents as records (into the shared folder by default) and reads them.

    Null and empty texts have the end id alone. Repeated rows are records of their own;
    of equal doc_ids the smaller text comes first. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    uri = uri or store.fresh(spark, "records")
    return read(spark, uri, write(docs, tokenizer, uri, doc_id, text), ids)


def op5_token_records(spark, sf_dir):
    import public_tokenizers

    return token_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
