"""Benchmark decontamination by latent semantic retrieval.

1. Over all passages (PASSAGE words each) of all documents, the words of the benchmark are
   counted: passage frequencies give TF-IDF weights.
2. A randomised SVD of the TF-IDF matrix A of all passages, with the benchmark's own
   passages weighted to the same total: every task adds its part of A'(A W) for a fixed
   random W; the sum's orthonormal basis is the latent space.
3. Windows of 32 words, eight apart, of every document are projected; each benchmark
   item's cosine with each window is one matrix product. Windows at or above ``cosine``
   are candidates, and so are those, whatever their cosine, in which a run of ``run``
   words of an item (or a whole shorter item) begins: runs are looked up exactly.
4. A candidate region is read word by word: the longest common subsequence with the item,
   the longest run in common, and how many of the item's answer words it holds decide.

The benchmark is taken in blocks of items of bounded size; only a block's weights and
basis go to the executors. Documents are only ever read, never joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import kernel as K

U = np.uint64
PASSAGE, STEP, SPAN, RANK = 64, 8, 4, 96
CHUNKS = 32
LONG = 65

# words end at white space and at ASCII punctuation
GAP = np.ones(256, bool)
GAP[128:] = False
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    GAP[_c] = False


@dataclass(frozen=True)
class Rules:
    """cosine: least latent cosine of a window that is a candidate without a run. A region is contaminated when it
    holds a common run of ``run`` words (or a whole shorter item), or when its longest
    common subsequence has ``share`` of the item's words and it holds ``answers`` of the
    item's answer words. Items of fewer than ``least`` words are passed over."""

    cosine: float = 0.45
    share: float = 0.6
    answers: float = 0.5
    run: int = 13
    least: int = 5


def block_words(buf: np.ndarray, offs: np.ndarray):
    s, e = K.words(buf, offs, GAP)
    return s, K.spans_hash(K.running(buf, K.LOWER), s, e)


class Items:
    """A block of benchmark items: ids, word hashes, and the sorted vocabulary."""

    def __init__(self, ids: list[int], texts: list[str | None], answers: list[str | None] | None = None):
        self.ids, self.hashes, self.answers = [], [], []
        self.explicit = []
        for k, (i, t) in enumerate(zip(ids, texts)):
            self.ids.append(i)
            self.hashes.append(self._of(t))
            self.explicit.append(self._of(answers[k]) if answers and answers[k] else None)
        flat = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        self.vocab = K.distinct(flat)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.vocab & U((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _of(t: str | None) -> np.ndarray:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return block_words(raw, np.array([0, len(raw)]))[1]

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words of h are in the vocabulary, their places in it)."""
        if not len(self.vocab):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.flatnonzero(self.bits[(h & U((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[k]), len(self.vocab) - 1)
        ok = self.vocab[at] == h[k]
        return k[ok], at[ok]


def common_subsequence(region: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region.tolist():
        m = where.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def common_run(region: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest run of words in common."""
    where: dict[int, list[int]] = {}
    for i, w in enumerate(item.tolist()):
        where.setdefault(w, []).append(i)
    best, before = 0, {}
    for w in region.tolist():
        now = {}
        for i in where.get(w, ()):
            now[i] = before.get(i - 1, 0) + 1
            best = max(best, now[i])
        before = now
    return best


def _order(v: np.ndarray, n: int) -> np.ndarray:
    """Stable order of places below n (two-byte values are sorted by their digits)."""
    return np.argsort(v.astype(np.uint16) if n <= 65536 else v, kind="stable")


def _summed(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of all tasks' arrays of a fixed shape, by chunks of rows."""

    def add(bucket, table):
        total = None
        for x in table.column("payload"):
            v = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            total = v if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["bucket", "payload"])

    out = np.zeros(shape)
    parts = np.array_split(np.arange(shape[0]), CHUNKS)
    for r in K.exchange(rows, add, K.PACKED).collect():
        out[parts[r.bucket]] = np.frombuffer(r.payload).reshape(-1, shape[1])
    return out


def _chunks(a: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(a.astype(np.float32), CHUNKS)
    live = [i for i, x in enumerate(parts) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([parts[i].tobytes() for i in live], pa.binary())], ["bucket", "payload"])


def _passages(column):
    """Blocks of a text column: (offsets by row, first row, word hashes, passage of each word)."""
    for lo, hi, buf, offs in K.blocks(column):
        s, h = block_words(buf, offs)
        at = np.searchsorted(s, offs)
        yield lo, hi, h, at


def _passage_of(at: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    n = np.diff(at)
    per = -(-n // size)
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(len(n)), n)
    return first[row] + (np.arange(at[-1]) - at[row]) // size, int(per.sum())


def frequencies(rows: DataFrame, items_b) -> np.ndarray:
    """(vocabulary + 1): passages that hold each word, then the number of passages."""

    def run(batches):
        items = items_b.value
        total = np.zeros((len(items.vocab) + 1, 1))
        for b in batches:
            for _, _, h, at in _passages(b.column(0)):
                of, n = _passage_of(at, PASSAGE)
                k, v = items.places(h)
                if len(v):
                    # once for each passage
                    o = _order(v, len(items.vocab))
                    word, passage = v[o], of[k[o]]
                    new = np.r_[True, (word[1:] != word[:-1]) | (passage[1:] != passage[:-1])]
                    total[:-1, 0] += np.bincount(word[new], minlength=len(items.vocab))
                total[-1, 0] += n
        yield _chunks(total)

    n = len(items_b.value.vocab) + 1
    return _summed(rows.mapInArrow(run, K.PACKED), (n, 1))[:, 0]


def _sums(rows: np.ndarray, v: np.ndarray, cut: np.ndarray, out: np.ndarray, to: np.ndarray) -> None:
    """out[to] = np.add.reduceat(rows[v], cut), by the same additions in the same order:
    the next row of every stretch at once, and whole stretches beyond LONG rows."""
    size = np.diff(np.r_[cut, len(v)])
    o = np.argsort(-size, kind="stable")
    at, size = cut[o], size[o]
    live = np.searchsorted(-size, -np.arange(1, LONG), side="left")  # stretches of more than d rows
    long = int(np.searchsorted(-size, -LONG, side="left"))
    total = rows.take(v[at], axis=0)
    for d, m in enumerate(live.tolist(), 1):
        if m == long:
            break
        total[long:m] += rows.take(v[at[long:m] + d], axis=0)
    for i in range(long):
        total[i] = rows.take(v[at[i] : at[i] + size[i]], axis=0).sum(axis=0)
    out[to[o]] = total


def _product(of: np.ndarray, v: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, their rows of N'(N scaled)) for passages given as (passage, word) pairs, passage ascending."""
    if not len(v):
        return np.zeros(0, np.int64), np.zeros((0, scaled.shape[1]), np.float32)
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    y = np.empty((len(cut), scaled.shape[1]), np.float32)
    _sums(scaled, v, cut, y, np.arange(len(cut)))
    back = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(v)]))
    o = _order(v, len(scaled))
    vs = v[o]
    c2 = np.flatnonzero(np.r_[True, vs[1:] != vs[:-1]])
    out = np.empty((len(c2), scaled.shape[1]), np.float32)
    _sums(y, back[o], c2, out, np.arange(len(c2)))
    return vs[c2], out


def latent_basis(rows: DataFrame, items: Items, items_b, weight: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis (vocabulary, rank) of the range of A'A W."""
    spark = rows.sparkSession
    rank = min(rank, max(1, len(items.vocab)))
    start = np.random.default_rng(7).standard_normal((len(items.vocab), rank)).astype(np.float32)
    start_b = spark.sparkContext.broadcast((weight, start))

    def run(batches):
        items, (w, g) = items_b.value, start_b.value
        scaled = (g * w[:, None]).astype(np.float32)
        total = np.zeros(g.shape)
        for b in batches:
            for _, _, h, at in _passages(b.column(0)):
                of, _ = _passage_of(at, PASSAGE)
                k, v = items.places(h)
                word, part = _product(of[k], v, scaled)
                total[word] += part
        yield _chunks(total * w[:, None])

    corpus = _summed(rows.mapInArrow(run, K.PACKED), start.shape)
    own, scaled = np.zeros(start.shape), (start * weight[:, None]).astype(np.float32)
    for h in items.hashes:
        v = np.searchsorted(items.vocab, h)
        word, part = _product(np.zeros(len(v), np.int64), v, scaled)
        own[word] += part
    own *= weight[:, None]
    # both parts weigh the same
    size = np.linalg.norm(corpus), np.linalg.norm(own)
    both = corpus / max(size[0], 1e-9) + own / max(size[1], 1e-9)
    q, _ = np.linalg.qr(both)
    return q


def _named(v: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Names of the runs of n words of v at the given places."""
    g = np.zeros(len(start), np.uint64)
    for d in range(n):
        g = K.mix(g * U(K.BASE) + v[start + d].astype(np.uint64) + U(1))
    return g


class Search:
    """What a task needs to find a block's items in texts."""

    def __init__(self, items: Items, weight: np.ndarray, basis: np.ndarray, rules: Rules):
        self.items, self.rules = items, rules
        self.rows = (basis * weight[:, None]).astype(np.float32)
        v = [np.searchsorted(items.vocab, h) for h in items.hashes]
        vec = np.stack([self.rows[x].sum(axis=0) if len(x) else np.zeros(basis.shape[1], np.float32) for x in v]) if v else np.zeros((0, basis.shape[1]), np.float32)
        norm = np.linalg.norm(vec, axis=1)
        self.vec = (vec / np.maximum(norm, 1e-9)[:, None]).astype(np.float32)
        self.size = np.array([len(h) for h in items.hashes], np.int64)
        self.usable = np.array([len(h) >= rules.least for h in items.hashes], bool)
        # item words a region must hold for the subsequence that is asked for, and for that or the run
        share = [ceil(rules.share * len(x)) for x in v]
        self.least = np.array([[max(1, n), max(1, min(n, rules.run, len(x)))] for n, x in zip(share, v)], np.int64).reshape(-1, 2)
        self.member = np.zeros((len(v), len(items.vocab)), np.uint16)  # how often each item has each word
        for j, x in enumerate(v):
            np.add.at(self.member[j], x, 1)
        # by length: sorted names of the items' runs, and whose they are
        self.runs = {}
        for n in sorted({min(rules.run, len(x)) for x, u in zip(v, self.usable) if u and len(x)}):
            own = [(j, x) for j, x in enumerate(v) if self.usable[j] and min(rules.run, len(x)) == n]
            name = np.concatenate([_named(x, np.arange(len(x) - n + 1), n) for _, x in own])
            whose = np.repeat([j for j, _ in own], [len(x) - n + 1 for _, x in own])
            o = np.argsort(name, kind="stable")
            self.runs[n] = name[o], whose[o]
        # answer words: those given, else the quarter of the item's words that fewest items hold
        # (not the rarest of the corpus: those that a paraphrase left out are rare for that)
        shared = (self.member > 0).sum(axis=0)
        self.answers = []
        for h, x, given in zip(items.hashes, v, items.explicit):
            if given is not None and len(given):
                self.answers.append(set(given.tolist()))
            else:
                o = np.argsort(shared[x], kind="stable")[: max(1, len(x) // 4)]
                self.answers.append(set(h[o].tolist()))

    def judge(self, region: np.ndarray, j: int) -> tuple[int, int, int] | None:
        """(subsequence, run, answer words) if the region holds item j."""
        r, item = self.rules, self.items.hashes[j]
        sub = common_subsequence(region, item)
        if sub < min(r.run, len(item)) and sub < ceil(r.share * len(item)):
            return None
        run = common_run(region, item)
        found = len(self.answers[j].intersection(region.tolist()))
        if run >= min(r.run, len(item)) or (sub >= ceil(r.share * len(item)) and found >= r.answers * len(self.answers[j])):
            return sub, run, found
        return None

    def find(self, column):
        """(row, item place, cosine, subsequence, run, answers, first word, end word)."""
        it = self.items
        if not it.ids:
            return
        for lo, hi, h, at in _passages(column):
            k, v = it.places(h)
            if not len(k):
                continue
            of, n = _passage_of(at, STEP)
            text = np.repeat(np.arange(hi - lo), -(-np.diff(at) // STEP))
            cut = np.flatnonzero(np.r_[True, of[k][1:] != of[k][:-1]])
            part = np.zeros((n + SPAN, self.rows.shape[1]), np.float32)
            _sums(self.rows, v, cut, part, of[k][cut])
            # a window: SPAN steps of one text
            win = part[:n].copy()
            same = np.r_[text, np.full(SPAN, -1)]
            for d in range(1, SPAN):
                last = np.flatnonzero(same[d : n + d] != text)
                kept = win[last]
                win += part[d : n + d]
                win[last] = kept
            norm = np.maximum(np.sqrt((win * win).sum(axis=1)), 1e-9)
            first = np.searchsorted(text, np.arange(hi - lo))
            found = [self._run_windows(k, v, at, first)]
            for x in range(0, n, 4096):
                cos = win[x : x + 4096] @ self.vec.T
                cos /= norm[x : x + 4096, None]
                at_least = cos >= self.rules.cosine
                at_least &= self.usable
                w, j = np.divmod(np.flatnonzero(at_least), len(it.ids))
                found.append((w + x, j))
            w, j = (np.concatenate(x) for x in zip(*found))
            if not len(w):
                continue
            key = K.distinct((text[w] * len(it.ids) + j) * n + w)
            w, j = key % n, key // n % len(it.ids)
            by_run = np.isin(key, (text[found[0][0]] * len(it.ids) + found[0][1]) * n + found[0][0])
            cos = np.concatenate([(win[w[x : x + 4096]] * self.vec[j[x : x + 4096]]).sum(axis=1) for x in range(0, len(w), 4096)]) / norm[w]
            row, m = text[w], self.size[j]
            # windows whose regions touch are one region
            cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (j[1:] != j[:-1]) | (np.diff(w) * STEP > m[1:] + STEP * SPAN)])
            end = np.r_[cut[1:], len(w)] - 1
            top = np.maximum.reduceat(cos, cut)
            with_run = np.logical_or.reduceat(by_run, cut).astype(np.int64)  # all others have none
            row, j, m = row[cut], j[cut], m[cut]
            s = np.maximum(0, (w[cut] - first[row]) * STEP - m)
            e = np.minimum(at[row + 1] - at[row], (w[end] - first[row] + SPAN) * STEP + m)
            # a long region is read in overlapping stretches, so that far-off words don't add up
            per = np.maximum(1, -(-(e - m - s) // m))
            of_region = np.repeat(np.arange(len(s)), per)
            x = s[of_region] + (np.arange(len(of_region)) - (np.cumsum(per) - per)[of_region]) * m[of_region]
            y = np.minimum(e[of_region], x + 2 * m[of_region] + STEP * SPAN)
            p = np.searchsorted(k, at[row[of_region]] + x)
            q = np.searchsorted(k, at[row[of_region]] + y)
            best: dict = {}
            for z in np.flatnonzero(self._holds(v, p, q, j[of_region], self.least[j[of_region], with_run[of_region]])).tolist():
                r = int(of_region[z])
                got = self.judge(h[at[row[r]] + x[z] : at[row[r]] + y[z]], int(j[r]))
                if got and (r not in best or got > best[r][0]):
                    best[r] = got, int(x[z]), int(y[z])
            for r, (got, x0, y0) in best.items():
                yield lo + int(row[r]), int(j[r]), float(top[r]), *got, x0, y0

    def _run_windows(self, k: np.ndarray, v: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item place) of every run of an item's words: ``k`` and ``v`` are the
        places of a block's vocabulary words in the block and in the vocabulary."""
        ws, js = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (name, whose) in self.runs.items():
            if len(k) < n:
                continue
            i = np.flatnonzero(k[n - 1 :] - k[: len(k) - n + 1] == n - 1)
            row = np.searchsorted(at, k[i], side="right") - 1
            inside = k[i] + n <= at[row + 1]
            i, row = i[inside], row[inside]
            g = _named(v, i, n)
            a, b = np.searchsorted(name, g), np.searchsorted(name, g, side="right")
            size = b - a
            js.append(whose[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())])
            ws.append(np.repeat(first[row] + (k[i] - at[row]) // STEP, size))
        return np.concatenate(ws), np.concatenate(js)

    def _holds(self, v: np.ndarray, p: np.ndarray, q: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether v[p:q] and item j have ``least`` words in common, each as often as both
        have it, for arrays p, q, j and least: no common subsequence or run is longer."""
        out, n, member = np.zeros(len(p), bool), self.member.shape[1], self.member.ravel()
        for x in range(0, len(p), 4096):
            lo, size, of = p[x : x + 4096], (q - p)[x : x + 4096], j[x : x + 4096]
            word = v[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
            mine = np.flatnonzero(member.take(np.repeat(of * n, size) + word))
            own, word = np.repeat(np.arange(len(lo)), size)[mine], word[mine]
            # enough of them even with all their repeats
            some = (np.bincount(own, minlength=len(lo)) >= least[x : x + 4096])[own]
            pair, often = K.counted(own[some] * n + word[some])
            own, word = pair // n, pair % n
            out[x : x + 4096] = np.bincount(own, weights=np.minimum(often, member.take(of[own] * n + word)), minlength=len(lo)) >= least[x : x + 4096]
        return out


def searches(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, text: str, rules: Rules, rank: int, block: int, answer: str | None = None) -> list:
    """A broadcast Search for each block of at most ``block`` items."""
    spark = docs.sparkSession
    K.once(spark)
    rows = docs.select(F.col(text).alias("text"))
    b = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")).orderBy("i", "t")
    found, ids, texts, answers = [], [], [], []

    def close():
        items = Items(ids, texts, answers)
        items_b = spark.sparkContext.broadcast(items)
        df = frequencies(rows, items_b)
        weight = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1
        found.append(spark.sparkContext.broadcast(Search(items, weight, latent_basis(rows, items, items_b, weight, rank), rules)))

    for r in b.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        answers.append(r.a)
        if len(ids) == block:
            close()
            ids, texts, answers = [], [], []
    if ids:
        close()
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules = Rules(), rank: int = RANK, block: int = 4096, answer: str | None = None) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, cosine, lcs, run,
    answers, first_word, end_word (the best region by lcs, then place).

    ``answer`` names a benchmark column with the items' answers, whose words a region must
    hold; without one (or where it is null) they are the quarter of the item's words that fewest items hold.
    Null, empty and short texts hold nothing; null items and items of fewer than five
    words are passed over; an empty benchmark or corpus gives no rows; repeated rows each
    report. Other columns are ignored.
    """
    found = searches(docs, benchmark, item_id, item_text, text, rules, rank, block, answer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    form = "doc_id bigint, item_id bigint, cosine double, lcs bigint, run bigint, answers bigint, first_word bigint, end_word bigint"
    names = [x.split()[0] for x in form.split(", ")]

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = []
            for s in found:
                best: dict = {}
                for row, j, cos, sub, length, ans, x, y in s.value.find(b.column(1)):
                    if (row, j) not in best or sub > best[row, j][1]:
                        best[row, j] = (cos, sub, length, ans, x, y)
                out += [(ids[row], s.value.items.ids[j], *v) for (row, j), v in sorted(best.items())]
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "cosine" else pa.int64()) for n, c in zip(names, cols)], names)

    return rows.mapInArrow(run, form)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules = Rules(), rank: int = RANK, block: int = 4096, answer: str | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no item. Rows without text stay;
    repeated rows stay or go together; an empty benchmark keeps all."""
    found = searches(docs, benchmark, item_id, item_text, text, rules, rank, block, answer)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for s in found:
                for hit in s.value.find(b.column(at)):
                    keep[hit[0]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op3_decontamination(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
