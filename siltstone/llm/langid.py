"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled text. A
text is parsed against each automaton into longest matches; the language that needs the
fewest phrases, normalised to bits per character, wins. The parse runs over all pieces
and all languages of a batch at once, one character per step, as table look-ups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import kernel as K

PIECE = 256


def folds() -> tuple[np.ndarray, np.ndarray]:
    """For each BMP code point: its lower-case form (white space -> space), and whether
    it is a letter. Characters beyond the BMP are one character (0)."""
    low, letter = np.arange(65536, dtype=np.uint32), np.zeros(65536, bool)
    for i in range(65536):
        c = chr(i)
        letter[i] = c.isalpha()
        if c.isspace():
            low[i] = 32
        elif letter[i]:
            f = c.lower()
            low[i] = ord(f) if len(f) == 1 and ord(f) < 65536 else i
    return low, letter


class Automaton:
    """Suffix automaton over small integers: transitions as dicts."""

    def __init__(self, codes):
        self.next, self.link, self.len = [{}], [-1], [0]
        last = 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.len[q] == self.len[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur


@dataclass
class Model:
    langs: list[str]
    classes: np.ndarray  # BMP code point -> class; 0 pads, 1 is any character of no sample
    width: int  # classes from here on have their transitions in keys and after, not in the table
    table: np.ndarray  # (row of the state + class) -> 2 * next row + whether a phrase ended
    keys: np.ndarray  # row of the state << 16 | class, ascending
    after: np.ndarray  # next row
    roots: np.ndarray
    bits: np.ndarray  # bits a phrase costs, by language
    letter: np.ndarray


def build(samples: dict[str, str], alphabet: int = 62) -> Model:
    """samples: folded text by language. All their characters count: the ``alphabet`` most
    frequent by table, the others by sorted transitions. Size: at most 2 * len(sample)
    states of alphabet + 2 entries each, and 3 * len(sample) transitions."""
    _, letter = folds()
    langs = sorted(samples)
    count: Counter = Counter()
    for x in samples.values():
        count.update(x)
    known = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])) if ord(c) < 65536][: 65536 - 2]
    classes = np.full(65536, 1, np.uint16)
    code = {}
    for i, c in enumerate(known):
        classes[ord(c)] = code[c] = i + 2
    width = min(len(known), alphabet) + 2
    parts, roots, base = [], [], 0
    rare: dict[int, int] = {}
    for lang in langs:
        a = Automaton([code.get(c, 1) for c in samples[lang]])
        n = len(a.next)
        nxt = np.full((n, width), -1, np.int64)
        for s, row in enumerate(a.next):
            for c, to in row.items():
                if c < width:
                    nxt[s, c] = to
                else:
                    rare[(base + s) * width << 16 | c] = (base + to) * width
        nxt[:, 1] = -1  # characters of no sample match nothing
        start = np.where(nxt[0] < 0, 0, nxt[0])
        t = np.where(nxt < 0, start[None, :], nxt)
        t = (t + base) * width * 2 + (nxt < 0)
        t[:, 0] = base * width * 2  # padding costs nothing
        parts.append(t.astype(np.int32))
        roots.append(base * width)
        base += n
    if base * width * 2 >= 1 << 31:
        raise ValueError("the samples are too large for one table")
    bits = np.array([np.log2(max(2, len(samples[x]))) for x in langs])
    table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
    keys = np.array(sorted(rare), np.int64)
    after = np.array([rare[k] for k in keys.tolist()], np.int32)
    return Model(langs, classes, width, table, keys, after, np.array(roots, np.int32), bits, letter)


def _rare(model: Model, state: np.ndarray, c: np.ndarray, root: int) -> np.ndarray:
    """What the table would hold for the rarer classes ``c``."""

    def step(rows):
        key = rows.astype(np.int64) << 16 | c
        at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        return model.keys[at] == key, model.after[at]

    on, to = step(state)
    begins, start = step(np.full(len(c), root))
    return np.where(on, to * 2, np.where(begins, start, root) * 2 + 1)


def phrases(model: Model, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, languages): phrases of the greedy parse. A text is parsed in pieces of
    PIECE characters, whatever its length; each piece starts a phrase."""
    n = len(offs) - 1
    size = np.diff(offs)
    pieces = -(-size // PIECE)
    owner = np.repeat(np.arange(n), pieces)
    first = np.cumsum(pieces) - pieces
    start = offs[:-1][owner] + (np.arange(len(owner)) - first[owner]) * PIECE
    out = np.zeros((n, len(model.langs)), np.int64)
    for lo in range(0, len(owner), 4096):
        s, o = start[lo : lo + 4096], owner[lo : lo + 4096]
        stop = np.minimum(s + PIECE, offs[o + 1])
        k = len(s)
        where = s[None, :] + np.arange(PIECE)[:, None]
        grid = np.where(where < stop[None, :], codes[np.minimum(where, len(codes) - 1)], 0).astype(np.int32)
        few = [np.flatnonzero(x) if any_ else None for x, any_ in zip(grid >= model.width, (grid >= model.width).any(axis=1))]
        table_grid = np.where(grid < model.width, grid, 1).astype(np.int32)
        for j in range(len(model.langs)):
            state = np.full(k, model.roots[j], np.int32)
            ends = np.ones(k, np.int32)
            for t in range(PIECE):
                row = state[few[t]] if few[t] is not None else None
                state += table_grid[t]
                v = model.table.take(state)
                if row is not None:
                    v[few[t]] = _rare(model, row, grid[t][few[t]], model.roots[j])
                ends += v & 1
                state = v >> 1
            out[:, j] += np.bincount(o, weights=ends, minlength=n).astype(np.int64)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 without a letter."""
    names, scores = [], []
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total < 1 << 20):
            total += len(texts[hi] or "")
            hi += 1
        part = [x or "" for x in texts[lo:hi]]
        lo = hi
        cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.r_[0, np.cumsum([len(x) for x in part])]
        bmp = np.where(cp < 65536, cp, 0).astype(np.uint16)
        alpha = np.r_[0, np.cumsum(model.letter[bmp])]
        lettered = (alpha[offs[1:]] - alpha[offs[:-1]]) > 0
        if (cp >= 65536).any():
            lettered |= np.array([any(ord(c) > 65535 and c.isalpha() for c in x) for x in part])
        if not model.langs:
            names += ["und"] * len(part)
            scores += [0.0] * len(part)
            continue
        rate = phrases(model, model.classes[bmp], offs) * model.bits / np.maximum(np.diff(offs), 1)[:, None] if len(cp) else np.zeros((len(part), len(model.langs)))
        best = rate.argmin(axis=1)  # ties: the first name
        least = rate[np.arange(len(part)), best]
        other = np.partition(rate, 1, axis=1)[:, 1] if len(model.langs) > 1 else np.full(len(part), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            sure = np.where(np.isinf(other), 1.0, other / (other + least))
        for i in range(len(part)):
            names.append(model.langs[best[i]] if lettered[i] else "und")
            scores.append(float(sure[i]) if lettered[i] else 0.0)
    return names, scores


def held_out(doc_id):
    """crc32 of doc_id as text, modulo 4, is 2 (a null doc_id counts as '')."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 400, sample_chars: int = 16384) -> Model:
    """Fits on at most ``sample_docs`` documents and ``sample_chars`` characters a language.

    Only rows with a lang and a text that are not held out count. Documents come in the
    order of a hash of doc_id and text; each gives up to 256 characters from a place its
    hash chooses. Counts by language cover all rows; the sample's rows are filtered by a
    hash threshold on the executors, so no task sorts a language.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.length("t") > 0) & ~held_out(F.col("i")))
    rows = rows.withColumn("h", F.xxhash64("t"))
    n = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not n:
        return build({})
    share = F.lit(None).cast("double")
    for name, k in n.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, 2.0 * sample_docs / k))).otherwise(share)
    u = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    at = F.pmod("h", F.greatest(F.length("t") - 255, F.lit(1)))
    got = rows.where(u < share).select("l", "h", F.substring(F.col("t"), (at + 1).cast("int"), F.lit(256)).alias("t")).distinct().collect()
    low, _ = folds()
    samples: dict[str, str] = {}
    for name in n:
        own = sorted((r.h & (2**64 - 1), r.t) for r in got if r.l == name)[:sample_docs]
        out, size = [], 0
        for _, x in own:
            if size >= sample_chars:
                break
            x = "".join(chr(low[ord(c)]) if ord(c) < 65536 else "\0" for c in x)[: sample_chars - size]
            out.append(x)
            size += len(x)
        if size:
            samples[name] = "".join(out)
    return build(samples)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    score is second / (first + second) of the two least bit rates. A null text, or one
    without a letter, is ``und`` with score 0; so is every text where nothing could be
    learned. Whole texts are parsed; repeated rows and an empty table need no care; other
    columns are ignored. Only the text is an input of a prediction.
    """
    spark = docs.sparkSession
    K.once(spark)
    model = model or learn(docs, doc_id, text, lang)
    # fold and class in one table
    low, _ = folds()
    model.classes = model.classes[low]
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            names, scores = predict(m, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())
