"""Removal of repeated byte strings by external induced suffix sorting.

Every string of PASSAGE_BYTES bytes has one anchor: of the GRAM-byte strings in it the one with
the least hash, the leftmost of equal ones. Equal strings have equal anchors, so

1. the strings of a document fall into segments (runs of starts with one anchor); segments
   meet by anchor. Anchors are those of shorter strings of PASSAGE_BYTES, so that repeated
   passages below LENGTH are found too; a segment holds LENGTH bytes from each start. A segment that occurs twice as it stands repeats throughout.
2. Where different segments share an anchor, their bytes go to a shard by anchor and all
   suffixes of the shard are sorted there with their common-prefix lengths; a string
   repeats if its suffix has a neighbour with LENGTH bytes in common.
3. What repeats is joined back by document.

The sorter follows induced sorting with common prefixes: suffixes are typed; the leftmost
smaller-type suffixes are named by their substrings and ordered by the names, recursively
in pairs of names until they are told apart or LENGTH bytes are covered; the larger-type
and then the smaller-type suffixes are induced in one scan each. Queues by first byte,
kept on disk beyond a bound, take the tuples (place, common prefix with the one before);
range minima of the scanned prefixes give the induced ones. Each scan step takes all
tuples of a queue at once.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.llm import kernel as K, store

U = np.uint64
LENGTH, GRAM = 400, 48
PASSAGE_BYTES, PASSAGE_WORDS = 280, 50  # what repeats at this size is reported, not removed
CHUNK = 1 << 20
BATCH = 1 << 20
SEPARATOR, NONE = 0xFE, np.uint8(0xFF)  # no bytes of UTF-8
SEGMENT = np.dtype([("gram", "<u8"), ("seg", "<u8"), ("doc", "<u8"), ("start", "<u4"), ("size", "<u4"), ("starts", "<u4")])
SPAN = np.dtype([("doc", "<u8"), ("start", "<u4"), ("end", "<u4")])


# the sorter ----------------------------------------------------------------------------


class Queue:
    """Tuples in order, first in first out; beyond ``most`` bytes they wait in a file."""

    def __init__(self, most: int):
        self.parts, self.held, self.most, self.file, self.filed = [], 0, most, None, []

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.append((pos.astype(np.int32), lcp.astype(np.uint16)))
        self.held += 6 * len(pos)
        if self.held > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            for p, c in self.parts:
                p.tofile(self.file)
                c.tofile(self.file)
                self.filed.append(len(p))
            self.parts, self.held = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        if self.filed:
            self.file.seek(0)
            for n in self.filed:
                p = np.fromfile(self.file, np.int32, n)
                parts.append((p, np.fromfile(self.file, np.uint16, n)))
            self.file.close()
            self.file, self.filed = None, []
        parts += self.parts
        self.parts, self.held = [], 0
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint16)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def __bool__(self) -> bool:
        return bool(self.parts or self.filed)


class Minima:
    """Minima of ranges [a, b] of an array."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.rows[0])
        k = np.frexp((b - a + 1).astype(np.float64))[1].astype(np.int64) - 1
        for level in range(len(self.rows), int(k.max(initial=0)) + 1):
            half = 1 << (level - 1)
            row = self.rows[-1].copy()  # the last places hold no whole range and are not asked for
            np.minimum(row[: n - half], self.rows[-1][half:], out=row[: n - half])
            self.rows.append(row)
        flat = np.concatenate(self.rows) if len(self.rows) > 1 else self.rows[0]
        return np.minimum(flat[k * n + a], flat[k * n + b + 1 - (1 << k)])


class Sorter:
    """Sorts the suffixes of one text; see the module's head."""

    def __init__(self, text: np.ndarray, length: int = LENGTH, most: int = 32 << 20, counts: np.ndarray | None = None):
        self.t, self.length, self.most = text, length, most
        self.counts = counts  # which suffixes count; none: all
        self.last, self.gap, self.sums = None, 0, None
        n = len(text)
        self.w = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)  # eight bytes from each place
        for k in (1, 2, 4):
            self.w = (self.w[:-k] << U(8 * k)) | self.w[k:]
        self.w = self.w[:n]
        self.cap = length + 8
        self.best = np.zeros(n, np.uint16)  # longest common prefix with a neighbour, up to the cap
        less = np.zeros(n, bool)  # smaller-type: the suffix is below the next one
        if n > 1:
            differ = np.flatnonzero(text[:-1] != text[1:])
            size = np.diff(np.r_[-1, differ])
            less[: size.sum()] = np.repeat(text[differ] < text[differ + 1], size)
        star = less.copy()
        star[0] = False
        star[1:] &= ~less[:-1]
        self.star = np.flatnonzero(star)
        # the byte before each place, where a scan up or down takes it; NONE is no byte of a text
        before = np.r_[np.full(min(n, 1), NONE, np.uint8), text[:-1]]
        kind = np.r_[False, less[:-1]][:n]
        self.before = np.where(kind, before, NONE), np.where(kind, NONE, before)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to the cap: by hashes of halving lengths
        down to 8 bytes, then by the bytes."""
        if len(a) > 1 << 15:
            return np.concatenate([self.common(a[x : x + (1 << 15)], b[x : x + (1 << 15)]) for x in range(0, len(a), 1 << 15)])
        # most differ in the first eight bytes
        n, diff = len(self.t), self.w[a] ^ self.w[b]
        out = np.minimum(self._lead(diff), np.minimum(n - a, n - b))
        k = np.flatnonzero(diff == 0)
        if len(k):
            out[k] = self._common(a[k], b[k])
        return np.minimum(out, self.cap)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.t)
        if self.sums is None:
            self.sums = K.running(self.t)
        pw, _ = K.powers(n + 1)
        c, most = self.sums, np.minimum(n - a, n - b)
        d = np.zeros(len(a), np.int64)
        step = 1 << (max(8, self.cap).bit_length() - 1)
        while step >= 8:
            k = np.flatnonzero(d + step <= most)
            x, y = a[k] + d[k], b[k] + d[k]
            same = (c[x + step] - c[x]) * pw[y] == (c[y + step] - c[y]) * pw[x]
            d[k[same]] += step
            step >>= 1
        k = np.flatnonzero(d < most)
        diff = self.w[a[k] + d[k]] ^ self.w[b[k] + d[k]]
        d[k] += np.where(diff == 0, 8, self._lead(diff))
        return np.minimum(d, most)

    @staticmethod
    def _lead(v: np.ndarray) -> np.ndarray:
        """Zero bytes before the first other one."""
        g = np.zeros(len(v), np.int64)
        for k in range(1, 8):
            g += (v >> U(64 - 8 * k)) == 0
        return g

    def order_stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Leftmost smaller-type suffixes in order, with common prefixes."""
        p = self.star
        m = len(p)
        if not m:
            return p, np.zeros(0, np.uint16)
        n = len(self.t)
        size = np.diff(np.r_[p, n]) + 1  # to the next one, its first byte included
        # names of the substrings: eight bytes at a time, filled up with 0xFF, which no text holds, so
        # that of two with the same bytes the shorter is the larger, as its last byte is smaller-type
        rank = np.zeros(m, np.int64)
        k = 0
        live = np.arange(m)
        while len(live):
            at = np.minimum(p[live] + 8 * k, n - 1)
            left = np.clip(size[live] - 8 * k, 0, 8)
            w = self.w[at].copy()
            cutoff = left < 8
            fill = np.where(left > 0, (U(1) << (U(8) * (U(8) - np.maximum(left, 1).astype(np.uint64)))) - U(1), U(0xFFFFFFFFFFFFFFFF))
            w = np.where(cutoff, w | fill, w)
            rank[live] = self._refine(rank[live], w, False)
            k += 1
            # on with groups that are not single and go on
            r = rank[live]
            tied = np.bincount(r, minlength=m)[r] > 1
            more = np.zeros(m + 1, bool)
            more[r[size[live] > 8 * k]] = True
            live = live[tied & more[r]]
        # pairs of names until told apart or far enough
        step = 1
        live = np.arange(m)
        while True:
            # names only part: who stands alone, or in a group read far enough, is done
            r = rank[live]
            tied = np.bincount(r, minlength=m)[r] > 1
            live, r = live[tied], r[tied]
            to = live + step
            inside = to < m
            reach = np.where(inside, p[np.minimum(to, m - 1)], n + self.cap) - p[live]
            # a group goes on while one of it has not been read far enough
            short = np.zeros(m + 1, bool)
            short[r[reach < self.cap]] = True
            on = short[r]
            live, to, inside = live[on], to[on], inside[on]
            if not len(live):
                break
            nxt = np.where(inside, rank[np.minimum(to, m - 1)], -1) + 1
            rank[live] = self._refine(rank[live], nxt.astype(np.uint64), True)
            step *= 2
        o = np.argsort(rank)
        q = p[o]
        lcp = np.zeros(m, np.uint16)
        lcp[1:] = self.common(q[:-1], q[1:])
        return q, lcp

    @staticmethod
    def _refine(rank: np.ndarray, word: np.ndarray, short: bool) -> np.ndarray:
        """New names: within each old name by ``word`` (``short``: below 2**32); a name is
        its group's first place among all, so other groups keep theirs."""
        if not short:
            o = np.argsort(word)
            w = word[o]
            place = np.empty(len(o), np.uint64)
            place[o] = np.cumsum(np.r_[False, w[1:] != w[:-1]]) if len(o) else 0
            word = place
            if len(o) and rank.min() == rank.max():
                out = np.empty(len(o), np.int64)
                out[o] = rank[0] + np.maximum.accumulate(np.where(np.r_[True, w[1:] != w[:-1]], np.arange(len(o)), 0))
                return out
        key = (rank.astype(np.uint64) << U(32)) | word
        o = np.argsort(key)
        key = key[o]
        at = np.arange(len(key))
        new_word = np.r_[True, key[1:] != key[:-1]]
        r = key >> U(32)
        new_rank = np.r_[True, r[1:] != r[:-1]]
        group = np.maximum.accumulate(np.where(new_rank, at, 0))
        first = np.maximum.accumulate(np.where(new_word, at, 0))
        out = np.empty(len(key), np.int64)
        out[o] = r.astype(np.int64) + first - group
        return out

    def induce(self, pos, lcp, queues, used, carry, c, up: bool) -> None:
        """One batch of scanned suffixes of queue c: pushes the suffixes one byte before."""
        prev = self.before[up][pos]
        sel = np.flatnonzero(prev != NONE)
        low = lcp.min() if len(lcp) else 0
        if not len(sel):
            np.minimum(carry, low, out=carry)
            return
        to = prev[sel]
        o = np.argsort(to, kind="stable")
        sel, to = sel[o], to[o]
        head = np.r_[True, to[1:] != to[:-1]]
        mins = Minima(lcp)
        a = np.where(head, 0, np.r_[0, sel[:-1] + 1])
        got = mins.of(a, sel).astype(np.int64)
        first = np.flatnonzero(head)
        got[first] = np.minimum(got[first], carry[to[first]])
        val = np.minimum(got + 1, self.cap).astype(np.uint16)
        ends = np.r_[first[1:], len(sel)]
        np.minimum(carry, low, out=carry)
        for x, y in zip(first.tolist(), ends.tolist()):
            b = int(to[x])
            v = val[x:y]
            if not used[b]:
                v[0] = 0
                used[b] = True
            queues[b].push(pos[sel[x:y]] - 1, v)
            last = int(sel[y - 1])
            carry[b] = lcp[last + 1 :].min() if last + 1 < len(lcp) else self.cap

    def note(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """The next suffixes in order, with the bytes each has in common with the one before.
        Of suffixes that count the longest common prefix is kept."""
        if not len(pos):
            return
        k = np.arange(len(pos)) if self.counts is None else np.flatnonzero(self.counts[pos])
        if not len(k):
            self.gap = min(self.gap, int(lcp.min()))
            return
        low = np.minimum.reduceat(lcp[: k[-1] + 1], np.r_[0, k[:-1] + 1])
        low[0] = min(low[0], self.gap)
        at = pos[k]
        before = at[:-1] if self.last is None else np.r_[self.last, at[:-1]]
        low = low[1:] if self.last is None else low
        for x in (at[len(at) - len(low) :], before):  # in each of the two a suffix stands once
            self.best[x] = np.maximum(self.best[x], low)
        self.last, self.gap = at[-1:], int(lcp[k[-1] + 1 :].min(initial=self.cap))

    def scan(self) -> np.ndarray:
        """For each suffix the longest common prefix with any other, up to the cap."""
        n = len(self.t)
        if not n:
            return self.best
        stars, star_lcp = self.order_stars()
        cuts = np.searchsorted(self.t[stars], np.arange(257))
        queues, used = [Queue(self.most // 64) for _ in range(256)], np.zeros(256, bool)
        carry = np.full(256, 0, np.int64)
        larger: list[tuple[np.ndarray, np.ndarray]] = []
        first = int(self.t[n - 1])
        queues[first].push(np.array([n - 1]), np.array([0]))
        used[first] = True
        for c in range(256):
            done = []
            while queues[c]:
                pos, lcp = queues[c].take()
                done.append((pos, lcp))
                self.induce(pos, lcp, queues, used, carry, c, True)
            pos = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int32)
            lcp = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.uint16)
            larger.append((pos, lcp))
            q, ql = stars[cuts[c] : cuts[c + 1]], star_lcp[cuts[c] : cuts[c + 1]].copy()
            if len(q):
                ql[0] = self.common(pos[-1:].astype(np.int64), q[:1])[0] if len(pos) else 0
                self.induce(q, ql, queues, used, carry, c, True)
        queues, used = [Queue(self.most // 64) for _ in range(256)], np.zeros(256, bool)
        carry[:] = 0
        for c in range(255, -1, -1):
            last, self.gap = None, 0
            while queues[c]:
                pos, lcp = queues[c].take()
                if last is None:
                    lcp[:1] = 0
                self.note(pos, lcp)
                self.induce(pos, lcp, queues, used, carry, c, False)
                last = pos[-1:]
            pos, lcp = larger[c]
            larger[c] = None
            if len(pos):
                pos = pos[::-1]
                lcp = np.r_[np.zeros(1, np.uint16), lcp[::-1][:-1]]
                if last is not None:
                    lcp[0] = self.common(last.astype(np.int64), pos[:1].astype(np.int64))[0]
                self.note(pos, lcp)
                self.induce(pos, lcp, queues, used, carry, c, False)
        return self.best


def _prefixes(parts: list[np.ndarray], length: int, starts: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that each place has in common with another, first place of each text), over
    the texts with a byte between them."""
    gap = np.array([SEPARATOR], np.uint8)
    whole = np.concatenate([x for p in parts for x in (p, gap)]) if parts else np.zeros(0, np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    counts = None
    if starts is not None:
        counts = np.zeros(len(whole) + 1, np.int64)
        np.add.at(counts, first, 1)
        np.add.at(counts, first + np.array(starts, np.int64), -1)
        counts = np.cumsum(counts)[:-1] > 0
    best = Sorter(whole, length, counts=counts).scan().astype(np.int64)
    rest = np.repeat(first + size, size + 1) - np.arange(len(whole))
    common = np.minimum(np.minimum(best, length), rest)
    if counts is not None:
        common[~counts] = 0
    return common, first


def common_prefixes(parts: list[np.ndarray], length: int = LENGTH, starts: list[int] | None = None) -> list[np.ndarray]:
    """For each place of each text, how many bytes from there on, up to ``length`` and
    within the text, start anywhere else too. ``starts``: so many first places of each text
    count, the others are only read on to."""
    common, first = _prefixes(parts, length, starts)
    return [common[a : a + len(p)] for a, p in zip(first.tolist(), parts)]


def repeats(parts: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its places start a string of ``length`` bytes that starts
    anywhere else too; strings never cross texts."""
    return [x[: max(0, len(x) - length + 1)] >= length for x in common_prefixes(parts, length)]


def ranges(parts: list[np.ndarray], starts: list[int], least: int = PASSAGE_BYTES, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the strings of ``least`` bytes or more that start anywhere else
    too, none within another; those of ``length`` bytes that overlap are one."""
    common, at = _prefixes(parts, length, starts)
    k = np.flatnonzero(common >= least)
    end = k + common[k]
    long = common[k] >= length
    reach = np.r_[-1, np.maximum.accumulate(end)[:-1]] if len(k) else end
    k, end, long = (x[end > reach] for x in (k, end, long))
    if not len(k):
        return k, k, end
    new = np.r_[True, ~(long[1:] & long[:-1] & (k[1:] <= end[:-1]))]
    first = np.flatnonzero(new)
    k, end = k[first], end[np.r_[first[1:] - 1, len(k) - 1]]
    text = np.searchsorted(at, k, side="right") - 1
    return text, k - at[text], end - at[text]


# the corpus ----------------------------------------------------------------------------


def doc_key(ids: np.ndarray, nulls: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(ids.view(np.uint64) + nulls.astype(np.uint64) * U(0x9E3779B97F4A7C15)) ^ texts)


def segments(buf: np.ndarray, offs: np.ndarray, length: int = PASSAGE_BYTES, gram: int = GRAM, reach: int = LENGTH, sums: np.ndarray | None = None):
    """(row, first start, size in bytes, starts, anchor's hash, segment's hash) of a block. Anchors
    are those of the strings of ``length`` bytes; a segment goes on for ``reach`` bytes from
    its last start, or to the end of the text. ``sums``: the running sums of buf, where known."""
    out = []
    rows = np.flatnonzero(np.diff(offs) >= length)
    if not len(rows):
        return None
    span = length - gram + 1
    # blocks are cut into pieces that overlap by what one string needs
    for lo in range(0, max(1, len(buf) - length + 1), CHUNK):
        piece = buf[lo : lo + CHUNK + reach - 1]
        if len(piece) < length:
            continue
        c = sums if sums is not None and len(piece) == len(buf) else K.running(piece)
        _, inv = K.powers(len(c))
        h = K.mix((c[gram:] - c[:-gram]) * inv[: len(c) - gram])
        key = (h & ~U((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        m, width = key, 1
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
        m = m[: min(len(m), CHUNK)]
        # a segment ends where the anchor changes, a text begins, or no string of it begins any more
        new = np.r_[True, m[1:] != m[:-1]]
        for edge in (offs[:-1] - lo, offs[1:] - length + 1 - lo):
            new[edge[(edge >= 0) & (edge < len(m))]] = True
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(m)] - 1
        row = np.searchsorted(offs, first + lo, side="right") - 1
        ok = first + lo + length <= offs[row + 1]
        first, last, row = first[ok], last[ok], row[ok]
        if not len(first):
            continue
        anchor = (m[first] & U((1 << 24) - 1)).astype(np.int64)
        end = np.minimum(last + reach, offs[row + 1] - lo)
        seg = K.spans_hash(c, first, end) + (end - first).astype(np.uint64)
        out.append((row, first + lo - offs[row], end - first, last - first + 1, h[anchor], seg))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def _blocks(batches):
    for b in batches:
        nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = b.column(0).fill_null(0).to_numpy()
        for lo, hi, buf, offs in K.blocks(b.column(1)):
            sums = K.running(buf)
            whole = K.spans_hash(sums, offs[:-1], offs[1:]) + np.diff(offs).astype(np.uint64)
            yield doc_key(ids[lo:hi], nulls[lo:hi], whole), buf, offs, sums


def _met(rows: DataFrame, nb: int) -> DataFrame:
    """Rows (-1, spans that repeat) and (-2, anchors under which different segments meet)."""

    def run(batches):
        pack = K.Packer(nb)
        for keys, buf, offs, sums in _blocks(batches):
            got = segments(buf, offs, sums=sums)
            if got:
                row, start, size, starts, gram, seg = got
                r = np.zeros(len(row), SEGMENT)
                r["gram"], r["seg"], r["doc"], r["start"], r["size"], r["starts"] = gram, seg ^ K.mix(gram + starts.astype(np.uint64)), keys[row], start, size, starts
                yield from pack.add(K.bucket_of(gram, nb), r)
        yield from pack.close()

    def meet(bucket, table):
        r = K.unpack(table, SEGMENT)
        if not len(r):
            return
        o = np.argsort(r["seg"])  # its name has its anchor in it
        r = r[o]
        s_new = np.r_[True, r["seg"][1:] != r["seg"][:-1]]
        s = np.flatnonzero(s_new)
        copies = np.diff(np.r_[s, len(r)])
        twice = r[np.repeat(copies > 1, copies)]
        spans = np.zeros(len(twice), SPAN)
        spans["doc"], spans["start"], spans["end"] = twice["doc"], twice["start"], twice["start"] + twice["size"]
        gram, kinds = K.counted(r["gram"][s])
        mixed = gram[kinds > 1]
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int32()), pa.array([spans.tobytes(), mixed.tobytes()], pa.binary())], ["bucket", "payload"])

    return K.exchange(rows.mapInArrow(run, K.PACKED), meet, K.PACKED)


def _batches(head: np.ndarray):
    """Segments of a bucket in batches of whole anchors, of about BATCH bytes: only segments
    of one anchor must be sorted together, so only a larger anchor takes more memory."""
    if not len(head):
        return
    o = np.argsort(head["gram"], kind="stable")
    gram = head["gram"][o]
    cut = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    size = np.add.reduceat(head["size"][o].astype(np.int64), cut)
    ends = np.r_[cut[1:], len(o)]
    lo, held = 0, 0
    for end, n in zip(ends.tolist(), size.tolist()):
        held += n
        if held >= BATCH or end == len(o):
            yield o[lo:end]
            lo, held = end, 0


def _shards(rows: DataFrame, mixed_b, nb: int) -> DataFrame:
    """Spans that the sorter finds, packed."""

    def run(batches):
        seen: set[int] = set()
        held: dict[int, list[bytes]] = {}
        size = 0

        def out():
            k = list(held)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([b"".join(held[x]) for x in k], pa.binary())], ["bucket", "payload"])

        for keys, buf, offs, sums in _blocks(batches):
            got = segments(buf, offs, sums=sums)
            if not got:
                continue
            row, start, length, starts, gram, seg = got
            k = np.flatnonzero(mixed_b.value.has(gram))
            bucket = K.bucket_of(gram, nb)
            rec = np.zeros(len(k), SEGMENT)
            rec["gram"], rec["seg"], rec["doc"], rec["start"], rec["size"], rec["starts"] = gram[k], seg[k] ^ K.mix(gram[k] + starts[k].astype(np.uint64)), keys[row[k]], start[k], length[k], starts[k]
            for i, r in zip(k.tolist(), rec):
                name = int(r["seg"])
                if name in seen:
                    continue
                seen.add(name)
                a = int(offs[row[i]] + start[i])
                held.setdefault(int(bucket[i]), []).append(r.tobytes() + buf[a : a + int(length[i])].tobytes())
                size += int(length[i]) + SEGMENT.itemsize
            if size > 8 << 20:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    def sort(bucket, table):
        heads, parts, seen = [], [], {}
        for x in table.column("payload"):
            data = x.as_buffer()
            at, view = 0, memoryview(data)
            while at < len(view):
                h = np.frombuffer(view[at : at + SEGMENT.itemsize], SEGMENT)[0]
                at += SEGMENT.itemsize
                if int(h["seg"]) not in seen:  # copies repeat throughout and are known
                    seen[int(h["seg"])] = True
                    heads.append(h)
                    parts.append(np.frombuffer(view[at : at + int(h["size"])], np.uint8))
                at += int(h["size"])
        head = np.array(heads, SEGMENT)
        found = [np.zeros(0, SPAN)]
        for some in _batches(head):
            text, a, b = ranges([parts[i] for i in some], head["starts"][some].tolist())
            h = head[some][text]
            spans = np.zeros(len(text), SPAN)
            spans["doc"], spans["start"], spans["end"] = h["doc"], h["start"] + a, h["start"] + b
            found.append(spans)
        spans = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([spans.tobytes()], pa.binary())], ["bucket", "payload"])

    return K.exchange(rows.mapInArrow(run, K.PACKED), sort, K.PACKED)


def repeated_spans(rows: DataFrame, nb: int) -> DataFrame:
    """(doc, spans): of each document with repeats (by its key) all spans, unmerged."""
    spark = rows.sparkSession
    met = store.table(_met(rows, nb), "op1-met")
    mixed_b = spark.sparkContext.broadcast(K.packed_bits(met.where("bucket = -2")))
    spans = met.where("bucket = -1").unionByName(_shards(rows, mixed_b, nb))

    def deal(batches):
        pack = K.Packer(nb)
        for b in batches:
            for x in b.column(1):
                s = np.frombuffer(x.as_buffer(), SPAN)
                yield from pack.add(K.bucket_of(s["doc"], nb), s)
        yield from pack.close()

    def gather(bucket, table):
        s = np.sort(K.unpack(table, SPAN), order=["doc", "start"])
        if not len(s):
            return
        cut = np.flatnonzero(np.r_[True, s["doc"][1:] != s["doc"][:-1]])
        ends = np.r_[cut[1:], len(s)]
        both = np.stack([s["start"], s["end"]], 1).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array(s["doc"][cut].view(np.int64)), pa.array([both[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], ["doc", "spans"])

    out = store.table(K.exchange(spans.mapInArrow(deal, K.PACKED), gather, "doc bigint, spans binary"), "op1-spans")
    store.drop(met)
    return out


def merged(s: np.ndarray) -> np.ndarray:
    """Maximal runs of covered bytes: overlapping and touching spans are one."""
    if not len(s):
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], reach[np.r_[first[1:], len(s)] - 1]], 1)


def whole_words(data: memoryview, start: int, end: int) -> int:
    """Words of a text that lie in [start, end) whole."""
    part = bytes(data[start:end])
    inside = len(part.split())
    cut = lambda at: 0 < at < len(data) and not bytes(data[at - 1 : at]).isspace() and not bytes(data[at : at + 1]).isspace()
    return inside - cut(start) - cut(end)


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated,
    spans (the removed runs as [start, end) bytes) and kept (the remaining bytes).

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too.
    n_repeated counts the bytes, kept or not, of strings that start anywhere else too and
    have LENGTH bytes, or PASSAGE_WORDS whole words and PASSAGE_BYTES bytes. Null
    is empty. Repeated rows repeat each other. Documents shorter than LENGTH stay whole.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    K.once(spark)
    nb = K.n_buckets(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_spans(rows, nb)

    def keyed(batches):
        for b in batches:
            nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            keys = []
            for lo, hi, buf, offs in K.blocks(b.column(1)):
                whole = K.spans_hash(K.running(buf), offs[:-1], offs[1:]) + np.diff(offs).astype(np.uint64)
                keys.append(doc_key(ids[lo:hi], nulls[lo:hi], whole).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["doc_id", "text", "doc"])

    joined = rows.mapInArrow(keyed, "doc_id bigint, text string, doc bigint").join(spans, "doc", "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in batches:
            out = []
            for t, raw in zip(b.column(1), b.column(2)):
                data = memoryview(t.as_buffer())
                found = np.frombuffer(raw.as_py() or b"", "<u4").reshape(-1, 2).astype(np.int64)
                long = found[:, 1] - found[:, 0] >= LENGTH
                runs = merged(found[long])
                passages = [x for x, ok in zip(found.tolist(), long) if ok or whole_words(data, *x) >= PASSAGE_WORDS]
                passages = merged(np.array(passages, np.int64).reshape(-1, 2))
                keep, at = [], 0
                for s, e in runs.tolist():
                    keep.append(data[at:s])
                    at = e
                keep.append(data[at:])
                kept = b"".join(keep)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), int((passages[:, 1] - passages[:, 0]).sum()), runs.tolist(), kept))
            n, r, k, sha, again, runs, kept = zip(*out) if out else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(again, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated bigint, spans array<array<bigint>>, kept binary")


def op1_suffix_dedup(spark, sf_dir):
    out = dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans")
