"""Tokenisation: vocabularies counted by Spark, merges trained on the chunk table."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from siltstone.functions import text as T
from siltstone.sources import tables

Merges = list[tuple[bytes, bytes]]


def char_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, n): all pre-tokens with their counts over all documents."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(T.PRETOKEN), F.lit(0))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


BLOCK = 4 << 20  # bytes of chunks that are counted at a time


def laid_out(raw: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes of words as token numbers in one array, with a gap (-1) behind each word."""
    token = np.full(len(raw) + len(width), -1, np.int32)
    token[np.arange(len(raw)) + np.repeat(np.arange(len(width)), width)] = raw
    return token


def merged(token: np.ndarray, a: int, b: int, z: int) -> np.ndarray | None:
    """Puts z in the place of each a b, in place; which tokens stay, or None without a pair."""
    at = np.flatnonzero((token[:-1] == a) & (token[1:] == b))
    if not len(at):
        return None
    if a == b:  # of a run of equal tokens every other pair, from its left
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], at, 0))
        at = at[(at - first) % 2 == 0]
    token[at] = z
    keep = np.ones(len(token), bool)
    keep[at + 1] = False
    return keep


def pair_sums(batches: list[pa.RecordBatch], merges: list[tuple[int, int, int]], size: int):
    """(p, n): counts of the pairs left to right * ``size`` + right of chunks(chunk, n) after
    the merges. All chunks are one array of token numbers with a gap behind each."""
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    text = pc.cast(t.column("chunk").combine_chunks(), pa.large_binary())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    width = np.diff(offs)
    token = laid_out(raw, width)
    n = np.repeat(t.column("n").to_numpy(), width + 1)
    for a, b, z in merges:
        keep = merged(token, a, b, z)
        if keep is not None:
            token, n = token[keep], n[keep]
    live = (token[:-1] >= 0) & (token[1:] >= 0)
    p, n = token[:-1][live].astype(np.int64) * size + token[1:][live], n[:-1][live]
    order = np.argsort(p, kind="stable")
    p, n = p[order], n[order]
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(p[cut]), pa.array(np.add.reduceat(n, cut) if len(cut) else n)], ["p", "n"])


class Tail:
    """Pair counts of the chunks beyond those that the driver holds, as bounds.

    Chunks are counted where they lie, as arrays of token numbers (see ``pair_sums``).
    ``most`` bounds each pair's count from above: a merge only takes occurrences away from
    the pairs there are, and a new token's pair occurs no more often than the pair of its
    end, nor than the token. Pairs without a token of a merge since ``count`` are exact."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks.select("chunk", "n")
        self.token = [bytes([i]) for i in range(256)]
        self.id = {t: i for i, t in enumerate(self.token)}
        self.merges: list[tuple[int, int, int]] = []
        self.count()

    def count(self) -> None:
        merges, size = list(self.merges), len(self.token)

        def run(batches):
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.nbytes
                if n >= BLOCK:
                    yield from pair_sums(held, merges, size)
                    held, n = [], 0
            yield from pair_sums(held, merges, size)

        T.batched(F.col("chunk"))
        got = self.chunks.mapInArrow(run, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect()
        self.most = {(self.token[r.p // size], self.token[r.p % size]): r.n for r in got}
        self.touched: set = set()

    def range(self, p: tuple[bytes, bytes]) -> tuple[int, int]:
        high = self.most.get(p, 0)
        return (0 if self.touched.intersection(p) else high), high

    def merge(self, p: tuple[bytes, bytes]) -> None:
        (a, b), z = p, p[0] + p[1]
        own = self.most.get(p, 0)
        new = Counter({(z, z): self.most.get((b, a), 0)})
        for (x, y), n in self.most.items():
            if x == b:
                new[z, y] += n
            if y == a:
                new[x, z] += n
        # a token that two merges make has the sum of both
        for q, n in new.items():
            self.most[q] = self.most.get(q, 0) + min(n, own)
        self.most.pop(p, None)
        if z not in self.id:
            self.id[z] = len(self.token)
            self.token.append(z)
        self.merges.append((self.id[a], self.id[b], self.id[z]))
        self.touched |= {a, b, z}


def train_bpe(docs: DataFrame, n_merges: int, most: int = 200_000) -> Merges:
    """Merges over the pre-tokens of all documents: see ``train_chunks``."""
    return train_chunks(chunk_counts(docs), n_merges, most)


def train_chunks(chunks: DataFrame, n_merges: int, most: int = 200_000) -> Merges:
    """Byte-level merges: the most frequent pair each time, of equal ones the least. Pair
    counts follow the words that a merge changes. The driver holds the ``most`` frequent
    chunks; the others' pairs are counted by Spark, again whenever their bounds leave the
    next merge open, so all chunks count in full."""
    return _train(tables.stored(chunks, "chunks"), n_merges, most)


def _train(chunks: DataFrame, n_merges: int, most: int = 200_000) -> Merges:
    head = chunks.orderBy(F.desc("n"), "chunk").limit(most).collect()
    words = {tuple(bytes([b]) for b in r.chunk.encode()): r.n for r in head}
    tail = None
    if len(head) == most:
        last = head[-1] if head else None
        rest = chunks if last is None else chunks.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("chunk") > last.chunk)))
        tail = Tail(rest)
    forms = list(words)
    counts = [words[f] for f in forms]
    pairs: Counter = Counter()
    where: dict = {}
    for i, f in enumerate(forms):
        for p in zip(f, f[1:]):
            pairs[p] += counts[i]
            where.setdefault(p, set()).add(i)
    merges: Merges = []
    while len(merges) < n_merges:
        best = _next(pairs, tail)
        if best is None:
            break
        merges.append(best)
        if tail:
            tail.merge(best)
        for i in where.pop(best, ()):
            f = forms[i]
            for p in zip(f, f[1:]):
                pairs[p] -= counts[i]
                if pairs[p] <= 0:
                    del pairs[p]
            forms[i] = f = apply(f, best)
            for p in zip(f, f[1:]):
                pairs[p] += counts[i]
                where.setdefault(p, set()).add(i)
        pairs.pop(best, None)
    return merges


def _next(pairs: Counter, tail: Tail | None) -> tuple[bytes, bytes] | None:
    """The most frequent pair of head and tail, of equal ones the least."""
    if not tail:
        return min(pairs, key=lambda p: (-pairs[p], p), default=None)
    while True:
        ranges = {}
        for p in pairs.keys() | tail.most.keys():
            low, high = tail.range(p)
            ranges[p] = pairs.get(p, 0) + low, pairs.get(p, 0) + high
        best = min(ranges, key=lambda p: (-ranges[p][0], p), default=None)
        if best is None:
            return None
        low = ranges[best][0]
        if low > 0 and all(p == best or (-high, p) > (-low, best) for p, (_, high) in ranges.items()):
            return best
        if not tail.touched:
            return None  # all counts are exact, so no pair is left
        tail.count()


def apply(form: tuple[bytes, ...], pair: tuple[bytes, bytes]) -> tuple[bytes, ...]:
    out, i = [], 0
    while i < len(form):
        if i + 1 < len(form) and (form[i], form[i + 1]) == pair:
            out.append(form[i] + form[i + 1])
            i += 2
        else:
            out.append(form[i])
            i += 1
    return tuple(out)


def encode_word(word: str, ranks: dict) -> tuple[bytes, ...]:
    form = tuple(bytes([b]) for b in word.encode())
    while len(form) > 1:
        best = min(zip(form, form[1:]), key=lambda p: ranks.get(p, 1 << 30))
        if best not in ranks:
            break
        form = apply(form, best)
    return form


SWEPT = 1024  # merges up to which all words of a batch go through them together
REMEMBERED = 1 << 16  # beyond, words whose ids a worker keeps


class Bpe:
    """Ids: bytes 0-255, then the merges in their order, then special tokens."""

    def __init__(self, merges: Merges, specials: tuple[str, ...] = ()):
        self.ranks = {p: i for i, p in enumerate(merges)}
        self.raw = [bytes([i]) for i in range(256)] + [a + b for a, b in merges] + [s.encode() for s in specials]
        self.n_ordinary = 256 + len(merges)
        self.ids = {}
        for i, x in enumerate(self.raw[: self.n_ordinary]):
            self.ids.setdefault(x, i)
        self.specials = {s: self.n_ordinary + i for i, s in enumerate(specials)}
        self.known: dict = {}

    def chunk(self, word: str) -> list[int]:
        return [self.ids[x] for x in encode_word(word, self.ranks)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each). With few merges all words go through them
        together, by rank: behind a merge that gives a token of an earlier pair once more, from
        that pair on."""
        if len(self.ranks) > SWEPT:
            own = [self._remembered(w) for w in words]
            size = np.array([len(x) for x in own], np.int64)
            return np.fromiter(chain.from_iterable(own), np.int32, int(size.sum())), size
        raw = [b"\0" if w in self.specials else w.encode() for w in words]
        token = laid_out(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64))
        steps = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in sorted(self.ranks, key=self.ranks.get)]
        early: dict = {}
        for k, (a, b, _) in enumerate(steps):
            early.setdefault(a, k)
            early.setdefault(b, k)
        k = 0
        while k < len(steps):
            keep = merged(token, *steps[k])
            if keep is not None:
                token = token[keep]
                k = min(k, early.get(steps[k][2], k + 1) - 1)
            k += 1
        ends = np.flatnonzero(token < 0)
        starts = np.r_[np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1]
        for i, w in enumerate(words) if self.specials else ():
            if w in self.specials:
                token[starts[i]] = self.specials[w]
        return token[token >= 0], ends - starts

    def _remembered(self, word: str) -> list[int]:
        x = self.known.get(word)
        if x is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            x = self.known[word] = [self.specials[word]] if word in self.specials else self.chunk(word)
        return x

    def decode(self, ids) -> str:
        """Unknown ids are an error; bytes that are no text become U+FFFD."""
        ids = list(ids)
        if ids and not 0 <= min(ids) <= max(ids) < len(self.raw):
            bad = next(i for i in ids if not 0 <= i < len(self.raw))
            raise ValueError(f"id {bad} outside 0..{len(self.raw) - 1}")
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


def encode_bpe(docs: DataFrame, merges: Merges, specials: tuple[str, ...] = (), key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, ids): pre-tokens are encoded where their document lies, each distinct one
    of a batch once; special tokens are cut out first, longest first, and are one id each."""
    bpe = Bpe(merges, specials)
    split = F.array(F.col("text"))
    if specials:
        quoted = "|".join("\\Q" + s + "\\E" for s in sorted(specials, key=lambda x: (-len(x), x)))
        split = F.split(F.regexp_replace("text", f"({quoted})", "\x01$1\x01"), "\x01")
    names = F.array(*[F.lit(s) for s in specials]).cast("array<string>")
    pre = F.flatten(F.transform(split, lambda x: F.when(F.array_contains(names, x), F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(T.PRETOKEN), F.lit(0)))))
    rows = docs.select(key, *keep, T.batched(pre).alias("__pre"))
    form = StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        for b in batches:
            words = b.column(b.num_columns - 1)
            coded = words.flatten().dictionary_encode()
            every, size = bpe.encode(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy()
            n = size[at]  # ids of each place
            ends = np.r_[0, np.cumsum(n)]
            ids = every[np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n) + np.arange(ends[-1])]
            lines = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends[lines], pa.int32()), pa.array(ids))], form.names)

    return rows.mapInArrow(run, form)


def decode_bpe(rows: DataFrame, merges: Merges, specials: tuple[str, ...] = (), key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    bpe = Bpe(merges, specials)

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda ids: bpe.decode(ids.tolist()))

    return rows.select(key, *keep, T.batched(decode("ids")).alias("text"))


#: GPT-2-style pre-tokens: a white space before a run of letters or of digits belongs to the run
GPT2 = r"(?U)[\s\x1c-\x1f]?\p{L}+|[\s\x1c-\x1f]?\p{N}+|[^\s\x1c-\x1f\p{L}\p{N}]+|[\s\x1c-\x1f]"


def gpt2_pretokens(text):
    return F.regexp_extract_all(text, F.lit(GPT2), F.lit(0))


def char_encode(docs: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, unknown): characters and those outside the vocabulary(c), which become U+FFFD."""
    c = docs.select(key, F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    j = c.groupBy(key, "c").agg(F.count("*").alias("n")).join(vocab.select("c", F.lit(True).alias("known")), "c", "left")
    return j.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"))


def word_vocabulary(docs: DataFrame, most: int = 32_000, least: int = 1) -> DataFrame:
    """(id, token, n): the commonest word tokens, of equal ones the one that comes first in
    the corpus; id 0 is the unknown token."""
    tokens = F.regexp_extract_all("text", F.lit("(?s)" + T.WORD_TOKEN), F.lit(0))
    n = docs.select("doc_id", F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where(F.col("n") >= least)
    n = tables.stored(n, "vocabulary")
    # places are only looked up for tokens that may be in, where several start in one document
    last = n.orderBy(F.desc("n"), "doc_id").limit(most - 1).agg(F.min(F.struct("n", -F.col("doc_id"))).alias("x")).select("x.*").first()
    may = n if last[0] is None else n.where((F.col("n") > last[0]) | ((F.col("n") == last[0]) & (F.col("doc_id") <= -last[1])))
    may = F.broadcast(may)  # ``most`` and the tokens of one document at most
    w = docs.join(F.broadcast(may.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.posexplode(tokens).alias("pos", "token"))
    first = w.join(may, ["doc_id", "token"]).groupBy("doc_id", "token", "n").agg(F.min("pos").alias("pos"))
    top = first.orderBy(F.desc("n"), "doc_id", "pos").limit(most - 1)
    from pyspark.sql import Window

    ranked = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "doc_id", "pos")))  # at most ``most`` rows
    return ranked.select("id", "token", "n").unionByName(docs.sparkSession.createDataFrame([(0, "<unk>", 0)], "id int, token string, n bigint"))


def word_encode(docs: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens, unknown): word tokens of each text and those outside the vocabulary."""
    w = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit("(?s)" + T.WORD_TOKEN), F.lit(0))).alias("token"))
    j = w.join(F.broadcast(vocab.where("id > 0").select("token", "id")), "token", "left")  # a vocabulary is bounded
    return j.groupBy(key).agg(F.count("*").alias("tokens"), F.count_if(F.col("id").isNull()).alias("unknown"))


def _cost(bpe: Bpe):
    @F.pandas_udf("struct<n:bigint,ok:boolean>")
    def cost(s: pd.Series) -> pd.DataFrame:
        every, size = bpe.encode(list(s))
        cut = np.cumsum(size)[:-1]
        return pd.DataFrame({"n": size, "ok": [bpe.decode(x.tolist()) == w for x, w in zip(np.split(every, cut), s)]})

    return cost


def sweep(docs: DataFrame, sizes: list[int], pretokens: dict[str, str]) -> DataFrame:
    """(pretoken, merges, tokens, chars, chars_per_token, failures): merge tokenisers of a
    grid; the most merges are trained once for each kind of pre-token and cut to size."""
    out = None
    chars = F.lit(docs.agg(F.sum(F.length("text"))).first()[0]).cast("long")
    for name, pattern in sorted(pretokens.items()):
        chunks = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
        chunks = tables.stored(chunks, "chunks")
        merges = _train(chunks, max(sizes))
        for size in sizes:
            cost = _cost(Bpe(merges[:size]))
            r = chunks.select("n", cost("chunk").alias("c")).agg(F.sum(F.col("n") * F.col("c.n")).alias("tokens"), F.sum(F.when(F.col("c.ok"), 0).otherwise(F.col("n"))).alias("failures"))
            r = r.select(F.lit(name).alias("pretoken"), F.lit(size).alias("merges"), "tokens", chars.alias("chars"), (chars / F.col("tokens")).alias("chars_per_token"), "failures")
            out = r if out is None else out.unionByName(r)
    return out


def artifact(merges: Merges, specials: tuple[str, ...] = ()) -> dict:
    """A tokeniser as plain values, with a hash over them."""
    import hashlib
    import json

    body = {"kind": "byte-bpe", "merges": [[a.hex(), b.hex()] for a, b in merges], "specials": list(specials)}
    return {**body, "sha256": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def load_artifact(value: dict) -> Bpe:
    """The tokeniser of an artifact; an error where the hash does not fit."""
    merges = [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in value["merges"]]
    if artifact(merges, tuple(value["specials"])) != value:
        raise ValueError("the artifact's hash does not fit its content")
    return Bpe(merges, tuple(value["specials"]))
