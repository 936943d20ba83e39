"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is cut into marked words: runs of the space mark with what follows, cut at line
feeds or, if no piece of the model joins a letter to another character, wherever letters
start or end. No piece crosses such a cut, so words are encoded alone. The
distinct new words of a batch are sorted, which lays out their trie depth-first; the
forward pass keeps one state per character of the current path and starts each word at
the end of the prefix it shares with the one before.

Two forward passes share that walk. For a unigram model the state is the best score of
the prefix (Viterbi). For a merge (BPE) model the state is the last piece of the prefix's
own encoding: of the pieces that end here, the one that the merges keep apart from the
last piece of what is before it; back from the end these pieces are the encoding.
The tests hold both walks against the sentencepiece library (``differing``) and against
brute force.
"""

from __future__ import annotations

import array
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import kernel as K

MARK = "▁"  # fixed value: the space mark of the models
COARSE = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
FINE = re.compile(rf"{MARK}*(?:[^\W\d_]+|(?:[^\w{MARK}]|[\d_])+)|{MARK}+")
LETTER = re.compile(r"[^\W\d_]")


class Pieces:
    def __init__(self, path: str, kind: str = "bpe", most: int = 250_000, sp=None):
        """``most`` words and twice as many pairs of pieces are remembered, which bounds a
        worker's memory (about 150 MB); ``sp`` stands in for the model file's own processor."""
        if sp is None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        self.kind, self.most = kind, most
        n = sp.vocab_size()
        self.vocab: dict[str, int] = {}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.vocab[p] = i
                self.raw[i] = p.encode()
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("pieces of this model cross the cuts between words")
        joins = {x for p in self.vocab for x in zip(p, p[1:]) if MARK not in x}
        mixed = any(bool(LETTER.match(a)) != bool(LETTER.match(b)) for a, b in joins)
        self.findall = (COARSE if mixed else FINE).findall
        ends2: dict[str, set[int]] = {}
        ends3: dict[str, set[int]] = {}
        for p in self.vocab:
            if len(p) > 1:
                ends2.setdefault(p[-2:], {1}).add(len(p))
            if len(p) > 2:
                ends3.setdefault(p[-3:], {1, 2}).add(len(p))
        self.ends2 = {k: tuple(sorted((x for x in v if x < 3), reverse=True)) for k, v in ends2.items()}
        self.ends3 = {k: tuple(sorted(v, reverse=True)) for k, v in ends3.items()}
        self.names = {i: p for p, i in self.vocab.items()}
        self.width = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.apart: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.seen: dict[str, bytes] = {}

    def halves(self, i: int) -> tuple[int, int]:
        """The two pieces whose merge gives piece i (itself twice where none)."""
        if i not in self.split:
            self.split[i] = (i, i)
            s = list(self.names[i])
            while len(s) > 2:
                best, at = None, -1
                for k in range(len(s) - 1):
                    x = self.vocab.get(s[k] + s[k + 1])
                    if x is not None and x != i and (best is None or self.score[x] > best):
                        best, at = self.score[x], k
                if at < 0:
                    return self.split[i]
                s[at : at + 2] = [s[at] + s[at + 1]]
            if len(s) == 2 and s[0] in self.vocab and s[1] in self.vocab:
                self.split[i] = (self.vocab[s[0]], self.vocab[s[1]])
        return self.split[i]

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether merges leave a and b side by side: no piece across their border would
        have been merged before its parts were merged into a and b."""
        key = (a, b)
        got = self.apart.get(key)
        if got is None:
            names, vocab, score = self.names, self.vocab, self.score
            got, limit, same = True, float("-inf"), True
            while True:
                x = vocab.get(names[a] + names[b])
                # merged before the later of a and b was made: ranks fall with scores, of equal ranks the left goes first
                if x is not None and (score[x] > limit or same and score[x] == limit or limit == float("-inf")):
                    got = False
                    break
                la, lb = len(names[a]) > 1 and self.halves(a)[1] != a, len(names[b]) > 1 and self.halves(b)[0] != b
                if not la and not lb:
                    break
                # the piece merged last is taken apart first; of equal ranks the right one
                if la and (not lb or score[a] < score[b]):
                    limit, same = score[a], False
                    a = self.halves(a)[1]
                else:
                    limit, same = score[b], True
                    b = self.halves(b)[0]
            if len(self.apart) > 2 * self.most:
                self.apart.clear()
            self.apart[key] = got
        return got

    def walk(self, words: list[str]):
        """Ids of sorted distinct words, by one depth-first walk of their trie."""
        vocab, score, bpe = self.vocab, self.score, self.kind == "bpe"
        find, known, by3, by2, apart = vocab.get, self.apart.get, self.ends3.get, self.ends2.get, self.keeps_apart
        # of each prefix: its last piece (-1 none, -2 a character without piece), where that starts, its best score
        piece, start, best = [-1], [0], [0.0]
        before = ""
        for w in words:
            k, m = 0, min(len(before), len(w))
            while k < m and before[k] == w[k]:
                k += 1
            del piece[k + 1 :], start[k + 1 :], best[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                new, at = -2, i - 1
                # lengths of pieces that end like this, longest first
                sizes = (i > 2 and by3(w[i - 3 : i])) or (i > 1 and by2(w[i - 2 : i])) or (1,)
                if bpe:
                    for n in sizes:
                        if n <= i:
                            t = find(w[i - n : i])
                            if t is not None:
                                prev = piece[i - n]
                                if prev >= 0:
                                    ok = known((prev, t))
                                    if ok is None:
                                        ok = apart(prev, t)
                                    if not ok:
                                        continue
                                new, at = t, i - n
                                break
                else:
                    top = best[i - 1] - 1e6
                    for n in sizes:
                        if n <= i:
                            t = find(w[i - n : i])
                            if t is not None and best[i - n] + score[t] > top:
                                new, at, top = t, i - n, best[i - n] + score[t]
                    best.append(top)
                piece.append(new)
                start.append(at)
            before = w
            ids, i = [], len(w)
            while i:
                t, j = piece[i], start[i]
                if t >= 0:
                    ids.append(t)
                else:
                    ids.extend(self.byte[x] for x in reversed(w[j:i].encode("utf-8", "surrogatepass")))
                i = j
            ids.reverse()
            yield ids

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > self.most:
            self.seen = {}
        new = sorted(words.difference(self.seen))
        pack, code = array.array, self.width.char
        for w, ids in zip(new, self.walk(new)):
            self.seen[w] = pack(code, ids).tobytes()

    def differing(self, words: set[str]) -> list[str]:
        """Words whose ids are not the library's: what the tests hold the walk against. The
        library puts one mark before a text, so it is asked for the word without its first
        mark; words without one stand behind a line feed, whose pieces are taken off."""
        own = sorted(words)
        theirs = self.sp.encode([w[1:] if w[0] == MARK else "\n" + w for w in own], num_threads=1)
        out = []
        for w, ids, lib in zip(own, self.walk(own), theirs):
            want = [self.vocab.get(MARK)] if w == MARK else lib if w[0] == MARK else lib[2:]
            if ids != want:
                out.append(w)
        return out

    def cut(self, text: str) -> list[str]:
        """Marked words; joined they are the text with marks for spaces and one before it."""
        return self.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.cut(x) for x in texts]
        self.learn(set().union(*parts) if parts else set())
        get = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), self.width) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes joined, marks become spaces, the first is dropped."""
        out = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if out[:1] == " " else out


_models: dict[tuple[str, str], Pieces] = {}


def model(path: str, kind: str = "bpe") -> Pieces:
    if (path, kind) not in _models:
        _models[path, kind] = Pieces(path, kind)
    return _models[path, kind]


def encode(docs: DataFrame, path: str, kind: str = "bpe", doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (ids as little-endian 32-bit),
    round_trip (decoding gives the text back; space marks in the text count as spaces)
    and, with ``ids``, the ids.

    A null text counts as empty: no ids, round_trip true. Whole texts are encoded.
    Repeated rows and empty tables need no care; other columns are ignored.
    """
    K.once(docs.sparkSession)

    def run(batches):
        m = model(path, kind)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = [x or "" for x in part.column(1).to_pylist()]
                got = m.encode(texts)
                n = [len(x) for x in got]
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()), pa.array([m.decode(x) == t.replace(MARK, " ") for x, t in zip(got, texts)])]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
                if ids:
                    flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind_of = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind_of}, n_pieces bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * ids)


def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
