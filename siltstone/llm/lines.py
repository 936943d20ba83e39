"""Near-duplicate line removal by an exact set-similarity join.

A line's set is its distinct words, each the 40-bit hash of its bytes. One order of all
words, rare ones first (by a fixed-size sketch of their counts over lines), gives each
line a prefix; linked lines share a word of their prefixes, where they meet. A word of
the prefix that very many lines hold is refined: linked lines whose first common word it
is have a second one among their prefixes of one word more, and meet at the two.

In a meeting, pairs pass the length filter, the positional filter and a bound on the
symmetric difference (the bits in which two 128-bit parity maps differ). Of what passes
each line first offers its few likeliest earlier partners; those are verified on the
whole sets; lines that are still open then offer more, and in the end all. A line goes if
an earlier line (by doc_id, then place) has a Jaccard similarity of the threshold or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.llm import kernel as K, store

U, U32 = np.uint64, np.uint32
CELLS = 1 << 22
SMALL = 48  # meetings up to here offer all their pairs at once
ROUNDS = (3, 48, None)  # partners that a line of a larger meeting offers, round by round
HELD = 1 << 21  # pairs of meetings that are looked at together
HOT = 14 * 8  # level from which a word is refined: it stands in about 2**14 lines or more
FIRST = -(1 << 63)  # stands for a null doc_id: before all others
POSTING = np.dtype([("tok", "<u8"), ("sig", "<u8"), ("m0", "<u8"), ("m1", "<u8"), ("age", "<u2")])  # tok: 40 bits of the word, 16 of the size, 8 of the place
PAIRS = "a bigint, b bigint"
CAP, PLACES = 65535, 255
WORD = U((1 << 40) - 1)


class Lines:
    """Sets of the lines of a block: for line i, words[at[i]:at[i+1]] in their order."""

    __slots__ = ("row", "no", "tag", "sig", "n", "at", "words", "level")


def line_sets(column: pa.Array, level: np.ndarray | None = None) -> Iterator[Lines]:
    """Lines with a word, in blocks of at most 65,536 lines. ``level``: rank of each cell
    of the sketch (0 to 255), none to sort by hash alone."""
    for lo, hi, buf, offs in K.blocks(column):
        if not len(buf):
            continue
        s, e = K.words(buf, offs)
        if not len(s):
            continue
        run = K.running(buf)
        h = K.spans_hash(run, s, e) >> U(24)
        tag = K.spans_hash(run, offs[:-1], offs[1:]) >> U(32)
        begin, row_of, no_of = _begins(buf, offs)
        words_in = np.diff(np.r_[np.searchsorted(s, begin), len(s)])
        used = np.flatnonzero(words_in)
        for x, y, out in _sets(h, words_in[used], level):
            row = row_of[used[x:y]]
            out.row, out.no, out.tag = row + lo, no_of[used[x:y]], tag[row]
            yield out


def _begins(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, text, place in the text) of the lines of a block that have a byte."""
    feeds = np.flatnonzero(buf == 10)
    after = feeds + 1
    begin = K.distinct(np.r_[offs[:-1][np.diff(offs) > 0], after[after < len(buf)]])
    row_of = np.searchsorted(offs, begin, side="right") - 1
    # place of a line in its text: line feeds of the text before it
    return begin, row_of, np.searchsorted(feeds, begin) - np.searchsorted(feeds, offs[row_of])


def _sets(h: np.ndarray, words_in: np.ndarray, level: np.ndarray | None = None) -> Iterator[tuple[int, int, Lines]]:
    """Sets of lines of words_in words (one at least) each, which h holds in turn: lines x
    to y at a time."""
    cuts = np.r_[0, np.cumsum(words_in)]
    for x in range(0, len(words_in), 1 << 16):
        y = min(x + (1 << 16), len(words_in))
        w = h[cuts[x] : cuts[y]]
        which = np.repeat(np.arange(y - x, dtype=np.uint64), words_in[x:y])
        key = (which << U(48)) | w
        if level is not None:
            key |= level[cell(w)].astype(np.uint64) << U(40)
        key = K.distinct(key)
        owner = (key >> U(48)).astype(np.int64)
        out = Lines()
        out.words = key & WORD
        out.level = ((key >> U(40)) & U(255)).astype(np.uint8)
        out.n = np.bincount(owner, minlength=y - x)
        out.at = np.r_[0, np.cumsum(out.n)]
        out.sig = K.mix(np.add.reduceat(K.mix(out.words), out.at[:-1]) + out.n.astype(np.uint64))
        yield x, y, out


def cell(word: np.ndarray) -> np.ndarray:
    return ((word * U(0x9E3779B97F4A7C15)) >> U(42)).astype(np.int64)


def need(na, nb, num: int, den: int):
    return -((-num * (na + nb)) // (num + den))


class Met:
    """Names a task has met lately, with the least age of each: a table of fixed size, so
    some names come again. Only repeats work."""

    def __init__(self, cells: int = 1 << 20):
        self.sig, self.age = np.zeros(cells, np.uint64), np.zeros(cells, np.int64)

    def fresh(self, sig: np.ndarray, age: np.ndarray) -> np.ndarray:
        """Places of names that are new or older than before, the oldest of each once."""
        o = np.lexsort((age, sig))
        o = o[np.r_[True, sig[o][1:] != sig[o][:-1]]] if len(o) else o
        at = (sig[o] & U(len(self.sig) - 1)).astype(np.int64)
        o, at = (x[(self.sig[at] != sig[o]) | (self.age[at] > age[o])] for x in (o, at))
        self.sig[at], self.age[at] = sig[o], age[o]
        return o


def _blocks(batches, level=None):
    for b in batches:
        ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for ls in line_sets(b.column(1), level):
            yield ids, ls


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ U(1 << 63)).view(np.int64)


LINE = np.dtype([("sig", "<u8"), ("doc_id", "<i8"), ("tag", "<u4"), ("line", "<u4")])
COUNT = np.dtype([("cell", "<u4"), ("n", "<u4")])
GONE = np.dtype([("doc_id", "<i8"), ("tag", "<u4"), ("line", "<u4")])


def _first_pass(rows: DataFrame, nb: int) -> DataFrame:
    """Packed lines (sig, doc_id, tag, line), by sig; per task, in buckets from ``nb`` on,
    the counts of the sketch's cells."""

    def run(batches):
        pack, counts, met = K.Packer(nb), np.zeros(CELLS, U32), Met()
        for ids, ls in _blocks(batches):
            rec = np.zeros(len(ls.n), LINE)
            rec["sig"], rec["doc_id"], rec["tag"], rec["line"] = ls.sig, ids[ls.row], ls.tag, ls.no
            yield from pack.add(K.bucket_of(ls.sig, nb), rec)
            pick = np.zeros(len(ls.n), bool)
            pick[met.fresh(ls.sig, np.zeros(len(ls.n), np.int64))] = True
            np.add.at(counts, cell(ls.words[np.repeat(pick, ls.n)]), U32(1))
        yield from pack.close()
        at = np.flatnonzero(counts)
        part = CELLS // K.SKETCH_CHUNKS
        rec = np.zeros(len(at), COUNT)
        rec["cell"], rec["n"] = at % part, counts[at]
        yield from pack.add((nb + at // part).astype(np.int32), rec)
        yield from pack.close()

    return rows.mapInArrow(run, K.PACKED)


FOUND = "sig bigint, doc_id bigint, tag bigint, line bigint, bucket int, payload binary"


def _levels_or_firsts(bucket: int, table: pa.Table, nb: int):
    """First lines as rows and later copies packed (bucket -1), or the levels of a part of
    the cells (bucket 0 on)."""
    names = ["sig", "doc_id", "tag", "line", "bucket", "payload"]

    def packed(bucket, data):
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names)

    if bucket >= nb:
        total = np.zeros(CELLS // K.SKETCH_CHUNKS, np.int64)
        for x in table.column("payload"):
            r = np.frombuffer(x.as_buffer(), COUNT)
            total[r["cell"]] += r["n"]
        # eighths of a power of two of the count: 0 for a word of one line
        yield packed(bucket - nb, np.clip(np.log2(np.maximum(total, 1.0)) * 8, 0, 255).astype(np.uint8).tobytes())
        return
    r = K.unpack(table, LINE)
    r = r.take(np.lexsort((r["line"], r["tag"], r["doc_id"], r["sig"])))
    new = np.r_[True, r["sig"][1:] != r["sig"][:-1]] if len(r) else np.zeros(0, bool)
    f = r.take(np.flatnonzero(new))
    m = len(f)
    yield pa.RecordBatch.from_arrays([pa.array(_signed(f["sig"])), pa.array(f["doc_id"].copy()), pa.array(f["tag"].astype(np.int64)), pa.array(f["line"].astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    # rows that are equal in id and text share their first line
    own = f.take(np.cumsum(new) - 1)
    same = (r["doc_id"] == own["doc_id"]) & (r["tag"] == own["tag"]) & (r["line"] == own["line"])
    late = np.zeros(int((~same).sum()), GONE)
    for c in GONE.names:
        late[c] = r[c][~same]
    if len(late):
        yield packed(-1, late.tobytes())


def _maps(ls: Lines, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the lines' words over 128 cells."""
    at = np.repeat(ls.at[k] - np.r_[0, np.cumsum(ls.n[k])[:-1]], ls.n[k]) + np.arange(ls.n[k].sum())
    g = K.mix(ls.words[at])
    bit, high = U(1) << (g & U(63)), (g >> U(6)) & U(1) == 1
    cut = np.r_[0, np.cumsum(ls.n[k])[:-1]]
    return np.bitwise_xor.reduceat(np.where(high, U(0), bit), cut), np.bitwise_xor.reduceat(np.where(high, bit, U(0)), cut)


def _postings(rows: DataFrame, level_b, low: int, high: int, nb: int, num: int, den: int) -> DataFrame:
    scale = CAP / max(1, high - low)

    def run(batches):
        pack, met = K.Packer(nb), Met()
        for ids, ls in _blocks(batches, level_b.value):
            age = np.clip((ids[ls.row].astype(np.float64) - low) * scale, 0, CAP).astype(np.int64)
            k = met.fresh(ls.sig, age)
            if not len(k):
                continue
            n = ls.n[k]
            p = n - (-(-num * n // den)) + 1
            owner = np.repeat(np.arange(len(k)), p)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(p) - p, p)
            at = ls.at[k][owner] + pos
            word, level = ls.words[at], ls.level[at]
            hot = np.flatnonzero(level >= HOT)
            # a word of one line meets none
            cold = np.flatnonzero((level > 0) & (level < HOT))
            which, place, key = [cold], [pos[cold]], [word[cold]]
            if len(hot):
                # the second common word stands behind the first, in the prefix of one word more
                reach = np.minimum(p, n - 1)[owner[hot]] - pos[hot]
                first = np.repeat(hot, reach)
                step = np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
                key.append((K.mix(word[first] ^ K.mix(ls.words[at[first] + step])) & WORD))
                which.append(first)
                place.append(pos[first])
                # sets of one word have no second
                alone = hot[n[owner[hot]] == 1]
                key.append(word[alone])
                which.append(alone)
                place.append(pos[alone])
            which, place, key = np.concatenate(which), np.concatenate(place), np.concatenate(key)
            rec = np.zeros(len(which), POSTING)
            m0, m1 = _maps(ls, k)
            o = owner[which]
            rec["tok"] = (key << U(24)) | (np.minimum(n, CAP)[o].astype(np.uint64) << U(8)) | np.minimum(place, PLACES).astype(np.uint64)
            rec["sig"], rec["m0"], rec["m1"], rec["age"] = ls.sig[k][o], m0[o], m1[o], age[k][o]
            yield from pack.add(K.bucket_of(key, nb), rec)
        yield from pack.close()

    return rows.mapInArrow(run, K.PACKED)


def _parts(p: np.ndarray):
    return (p["tok"] >> U(24)), ((p["tok"] >> U(8)) & U(CAP)).astype(np.int64), (p["tok"] & U(PLACES)).astype(np.int64)


def slack(na, nb, pa_, pb, differ, num: int, den: int):
    """How many bits the maps may still differ in: negative where the pair can't be linked."""
    least = need(na, nb, num, den)
    ok = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= least)
    spare = np.where(ok, na + nb - 2 * least - differ, -1)
    return np.where((na == CAP) | (nb == CAP), 0, spare)


def _reach(n, pos, num: int, den: int) -> np.ndarray:
    """Size of the largest partner that a posting's own size and place allow."""
    most = np.minimum(den * n // num, (num + den) * (n - pos) // num - n)
    return np.where(n == CAP, CAP, np.clip(most, 0, CAP))


def _spans(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Successive parts of a column of counts that add up to ``most``, or of one row."""
    ends = np.cumsum(count)
    x = 0
    while x < len(count):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + most, side="right")))
        yield x, y
        x = y


def _near(cols, rows, lo, hi, num, den):
    """(i, j, spare) of the pairs of ``rows`` with the places lo to hi (by row) that pass."""
    sig, m0, m1, n, pos = cols
    some = hi > lo
    rows, lo, hi = rows[some], lo[some], hi[some]
    count = hi - lo
    top = n[hi - 1] + n[rows]
    bound = np.minimum(top * (den - num) // (num + den), 255)  # no pair of the row may differ in more bits (top - 2 * need would not grow with top)
    bound[(n[rows] == CAP) | (n[hi - 1] == CAP)] = 255
    bound = bound.astype(np.uint8)
    out = [(np.zeros(0, np.int64),) * 3]
    for x, y in _spans(count, 1 << 15):
        c = count[x:y]
        i = np.repeat(rows[x:y], c)
        j = np.arange(len(i)) + np.repeat(lo[x:y] - (np.cumsum(c) - c), c)
        differ = np.bitwise_count(m0[i] ^ m0[j])
        differ += np.bitwise_count(m1[i] ^ m1[j])
        ok = np.flatnonzero(differ <= np.repeat(bound[x:y], c))
        i, j, d = i[ok], j[ok], differ[ok].astype(np.int64)
        spare = slack(n[i], n[j], pos[i], pos[j], d, num, den)
        ok = (spare >= 0) & (sig[i] != sig[j])
        out.append((i[ok], j[ok], spare[ok]))
    return [np.concatenate(x) for x in zip(*out)]


def _likeliest(i, j, spare, top: int | None, left: np.ndarray):
    """Of pairs (later, earlier) each later one's ``top`` likeliest (None: all); ``left``
    gets whose there are more."""
    if top is None or not len(i):
        return i, j
    o = np.argsort((i << 17) - np.minimum(spare, CAP))
    i, j = i[o], j[o]
    head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[head, len(i)])
    left[i[head[size > top]]] = True
    few = np.arange(len(i)) - np.repeat(head, size) < top
    return i[few], j[few]


def _offers(cols, age, cut, size, is_open, top, left, num, den):
    """(i, j) of the pairs that meetings offer, part by part; postings are by meeting, then
    size. Small meetings offer all; in others each open line its ``top`` likeliest earlier
    partners."""
    n, pos = cols[3], cols[4]
    rank = np.repeat(np.arange(len(cut)) << 17, size)
    by = rank | n
    hi = np.searchsorted(by, rank | _reach(n, pos, num, den), side="right")
    here = np.arange(len(n))
    count = np.maximum(hi - here - 1, 0)
    made = np.add.reduceat(count, cut)
    # each pair once, from its smaller side, where a meeting's pairs can be held at once
    whole = (size <= SMALL) | (np.logical_and.reduceat(is_open, cut) & (made <= HELD))
    small = np.repeat(size <= SMALL, size)
    once = np.flatnonzero(np.repeat(whole, size))
    ends = np.cumsum(size[whole])
    for x, y in _spans(made[whole], HELD):
        r = once[ends[x - 1] if x else 0 : ends[y - 1]]
        i, j, spare = _near(cols, r, r + 1, hi[r], num, den)
        all_ = small[i]
        yield i[all_], j[all_]
        i, j, spare = i[~all_], j[~all_], spare[~all_]
        a, b = age[i] >= age[j], age[j] >= age[i]
        yield _likeliest(np.r_[i[a], j[b]], np.r_[j[a], i[b]], np.r_[spare[a], spare[b]], top, left)
    asks = np.flatnonzero(np.repeat(~whole, size) & is_open)
    lo = np.searchsorted(by, rank[asks] | -(-num * n[asks] // den))
    for x, y in _spans(np.maximum(hi[asks] - lo, 0), HELD):
        i, j, spare = _near(cols, asks[x:y], lo[x:y], hi[asks[x:y]], num, den)
        late = age[i] >= age[j]
        yield _likeliest(i[late], j[late], spare[late], top, left)


NAMES = ["a", "b", "bucket", "payload"]
MET = "a bigint, b bigint, bucket int, payload binary"


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    ab = K.distinct_pairs(np.concatenate(found)) if found else np.zeros((0, 2), np.uint64)
    k = len(ab)
    return pa.RecordBatch.from_arrays([pa.array(_signed(ab[:, 0].copy())), pa.array(_signed(ab[:, 1].copy())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], NAMES)


def _meet(bucket: int, p: np.ndarray, is_open: np.ndarray | None, top: int | None, num: int, den: int):
    """Pairs of a bucket's meetings, and the postings of those that have more to offer."""
    if not len(p):
        return
    # one posting of each name in a meeting, with its least age; records move once, at the end
    tok, sig = np.ascontiguousarray(p["tok"]), np.ascontiguousarray(p["sig"])
    o = np.argsort((tok & ~U((1 << 24) - 1)) | (sig & U((1 << 24) - 1)))
    word, sig = tok[o] >> U(24), sig[o]
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (sig[1:] != sig[:-1])])
    age = np.minimum.reduceat(p["age"][o], first)
    word, o = word[first], o[first]
    # a name alone meets none
    met = np.r_[False, word[1:] == word[:-1]]
    met[:-1] |= met[1:]
    age, o = age[met], o[met]
    if not len(o):
        return
    by = np.argsort(tok[o])
    o = o[by]
    is_open = np.ones(len(o), bool) if is_open is None else is_open[o]
    p = p.take(o)
    p["age"] = age[by]
    word, n, pos = _parts(p)
    cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    size = np.diff(np.r_[cut, len(p)])
    cols = (*(np.ascontiguousarray(p[c]) for c in ("sig", "m0", "m1")), n, pos)
    left = np.zeros(len(p), bool)
    found, held = [], 0
    for i, j in _offers(cols, age[by].astype(np.int64), cut, size, is_open, top, left, num, den):
        found.append(np.stack([cols[0][i], cols[0][j]], 1))
        held += len(i)
        if held > 500_000:
            yield _pairs_batch(found)
            found, held = [], 0
    yield _pairs_batch(found)
    more = np.flatnonzero(np.repeat(np.logical_or.reduceat(left, cut), size))
    for x in range(0, len(more), 1 << 16):
        y = more[x : x + (1 << 16)]
        rec = np.zeros(len(y), OPENED)
        rec["p"], rec["open"] = p.take(y), left[y]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([bucket], pa.int32()), pa.array([rec.tobytes()], pa.binary())], NAMES)


OPENED = np.dtype([("p", POSTING), ("open", "?")])


def _place(doc_id: np.ndarray, tag: np.ndarray, line: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(doc_id.view(np.uint64) + K.mix(tag.astype(np.uint64))) + line.astype(np.uint64))


def _owner(doc_id: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(doc_id.view(np.uint64)) ^ U(0xD6E8FEB86659FD93))


def _wanted_sets(ids: np.ndarray, column: pa.Array, places: K.Bits) -> Iterator[Lines]:
    """Sets (words, n, at and sig only) of the lines whose place the bit table holds. Texts
    of other owners aren't looked at, and only the lines themselves are cut into words."""
    mine = places.has(_owner(ids))
    ids, column = ids[mine], column.filter(pa.array(mine))
    for lo, _, buf, offs in K.blocks(column):
        if not len(buf):
            continue
        begin, row, no = _begins(buf, offs)
        tag = K.spans_hash(K.running(buf), offs[:-1], offs[1:]) >> U(32)
        k = np.flatnonzero(places.has(_place(ids[row + lo], tag[row], no)))
        size = np.diff(np.r_[begin, len(buf)])[k]
        ends = np.r_[0, np.cumsum(size)]
        buf = buf[np.repeat(begin[k] - ends[:-1], size) + np.arange(ends[-1])]
        s, e = K.words(buf, ends)
        words_in = np.diff(np.searchsorted(s, ends))
        h = K.spans_hash(K.running(buf), s, e) >> U(24)
        for _, _, ls in _sets(h, words_in[words_in > 0]):
            yield ls


def _fetch(rows: DataFrame, places_b) -> DataFrame:
    """(sig, words) of the lines whose place the bit table holds, with their documents':
    places of first lines, so a name comes about once (what the table lets through besides
    has the same words, or is dropped by the join). A word is the five bytes of its hash."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for ls in _wanted_sets(ids, b.column(1), places_b.value):
                five = np.ascontiguousarray(ls.words.view(np.uint8).reshape(-1, 8)[:, :5])
                at = pa.py_buffer((5 * ls.at).astype(np.int32))
                words = pa.Array.from_buffers(pa.binary(), len(ls.n), [None, at, pa.py_buffer(five)])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(ls.sig)), words], ["sig", "words"])

    return rows.mapInArrow(run, "sig bigint, words binary")


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """(words of all rows, words in each row) of a column of five-byte words."""
    parts = [x.as_buffer() for x in column]
    n = np.array([x.size // 5 for x in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :5] = flat
    return out.view(np.uint64).ravel(), n


def linked(x, y, num: int, den: int) -> np.ndarray:
    """Whether the sets of two columns, row by row, have the similarity asked for."""
    (wx, nx), (wy, ny) = _words(x), _words(y)
    row = lambda n: np.repeat(np.arange(len(n), dtype=np.uint64), n) << U(40)
    both = np.sort(np.r_[wx | row(nx), wy | row(ny)])
    inter = np.bincount((both[1:][both[1:] == both[:-1]] >> U(40)).astype(np.int64), minlength=len(nx))
    return den * inter >= num * (nx + ny - inter)


def _verified(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(sig) of the lines that one of the pairs links with an earlier one."""
    spark = rows.sparkSession
    f = F.struct("doc_id", "tag", "line")
    one = pairs.join(firsts.select(F.col("sig").alias("a"), f.alias("fa")), "a").join(firsts.select(F.col("sig").alias("b"), f.alias("fb")), "b")
    later = F.col("fa") < F.col("fb")
    dated = store.table(one.select("a", "b", F.when(later, F.col("b")).otherwise(F.col("a")).alias("late"), "fa", "fb"), "op7-pairs")
    wanted = dated.select(F.explode(F.array("fa", "fb")).alias("f")).distinct().select("f.*")

    def place(bits):
        def run(batches):
            for b in batches:
                doc_id, tag, line = (b.column(c).to_numpy() for c in ("doc_id", "tag", "line"))
                yield from K.bit_rows(K.distinct(np.r_[_place(doc_id, tag, line), _owner(doc_id)]), bits)

        return run

    bits = K.bits_for(4 * dated.count())
    places_b = spark.sparkContext.broadcast(K.bits_total(wanted.mapInArrow(place(bits), K.PACKED), bits))
    sets = store.table(_fetch(rows, places_b), "op7-sets")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 10_000):
                x = b.slice(lo, 10_000)
                yield x.select(["late"]).rename_columns(["sig"]).filter(pa.array(linked(x.column("wa"), x.column("wb"), num, den)))

    side = lambda x: sets.select(F.col("sig").alias(x), F.col("words").alias(f"w{x}"))
    two = dated.select("a", "b", "late").join(side("a"), "a").join(side("b"), "b").select("late", "wa", "wb")
    out = store.table(two.mapInArrow(run, "sig bigint").distinct(), "op7-gone")
    store.drop(sets, dated)
    return out


def _asking(batches):
    """Names of open lines among the postings that wait for another round."""
    for b in batches:
        for bucket, x in zip(b.column("bucket").to_pylist(), b.column("payload")):
            r = np.frombuffer(x.as_buffer(), OPENED)
            sig = K.distinct(r["p"]["sig"][r["open"]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), bucket, np.int32)), pa.array(_signed(sig))], ["bucket", "sig"])


def _again(met: DataFrame, gone: DataFrame, top: int | None, num: int, den: int) -> DataFrame:
    """The next round: open lines of the waiting meetings offer more partners."""
    waiting = met.where("bucket IS NOT NULL").select("bucket", "payload")
    closed = waiting.mapInArrow(_asking, "bucket int, sig bigint").join(gone, "sig", "left_semi")
    marked = waiting.withColumn("sig", F.lit(None).cast("bigint")).unionByName(closed.withColumn("payload", F.lit(None).cast("binary")))

    def run(bucket, table):
        r = K.unpack(table.select(["payload"]).drop_null(), OPENED)
        sig = table.column("sig").drop_null().to_numpy()
        p = r["p"].copy()
        yield from _meet(bucket, p, r["open"] & ~np.isin(_signed(p["sig"]), sig), top, num, den)

    return K.exchange(marked, run, MET)


def removed_lines(rows: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, tag, lines): places (from 0) of the lines that go, for each text that loses
    one. ``tag`` names the text among those of one doc_id."""
    spark = rows.sparkSession
    num, den = percent, 100
    nb = K.n_buckets(spark)
    first = store.table(K.exchange(_first_pass(rows, nb), lambda b, t: _levels_or_firsts(b, t, nb), FOUND), "op7-lines")
    firsts = first.where("bucket IS NULL").select("sig", "doc_id", "tag", "line")
    level = np.zeros(CELLS, np.uint8)
    part = CELLS // K.SKETCH_CHUNKS
    for r in first.where("bucket >= 0").select("bucket", "payload").collect():  # CELLS bytes, whatever the input
        level[r.bucket * part : (r.bucket + 1) * part] = np.frombuffer(r.payload, np.uint8)
    level_b = spark.sparkContext.broadcast(level)
    low, high = rows.agg(F.min(F.when(F.col("doc_id") != FIRST, F.col("doc_id"))), F.max("doc_id")).first()
    met = store.table(K.exchange(_postings(rows, level_b, low or 0, high or 0, nb, num, den), lambda b, t: _meet(b, K.unpack(t, POSTING), None, ROUNDS[0], num, den), MET), "op7-met")
    pairs = store.table(met.where("bucket IS NULL").select("a", "b").distinct(), "op7-met")
    gone = _verified(rows, firsts, pairs, num, den)
    for top in ROUNDS[1:]:
        if not met.where("bucket IS NOT NULL").limit(1).count():
            break
        nxt = store.table(_again(met, gone, top, num, den), "op7-met")
        store.drop(met)
        met = nxt
        more = store.table(met.where("bucket IS NULL").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "op7-met")
        if more.limit(1).count():
            new = store.table(gone.unionByName(_verified(rows, firsts, more, num, den)).distinct(), "op7-gone")
            store.drop(gone)
            gone = new
        pairs, old = store.table(pairs.unionByName(more), "op7-met"), pairs
        store.drop(old, more)
    store.drop(met, pairs)

    def copies(batches):
        for b in batches:
            for x in b.column(0):
                r = np.frombuffer(x.as_buffer(), GONE)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"].copy()), pa.array(r["tag"].astype(np.int64)), pa.array(r["line"].astype(np.int64))], ["doc_id", "tag", "line"])

    late = first.where("bucket = -1").select("payload").mapInArrow(copies, "doc_id bigint, tag bigint, line bigint")
    linked_ = firsts.join(gone, "sig", "left_semi").select("doc_id", "tag", "line")
    out = store.table(late.unionByName(linked_).groupBy("doc_id", "tag").agg(F.collect_set("line").alias("lines")), "op7-removed")
    store.drop(first, gone)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with its columns, the text without its removed lines, and two more columns
    (long), n_lines and n_removed, whose names get underscores before them where docs has
    such columns.

    Lines end at LF; a line without a word always stays and is never compared. Of lines
    with equal sets only the first stays, in the order doc_id (null first), text hash,
    place. A line goes when any earlier line is linked with it, whether that one stays or
    not. A null text stays null and has no lines. Equal rows are one; rows that share a
    doc_id only are told apart by their texts. An empty table gives no rows. Ids are
    integers, or strings of digits.
    """
    spark = docs.sparkSession
    K.once(spark)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST))
    rows = docs.select(key.alias("doc_id"), F.col(text).alias("text"))
    removed = removed_lines(rows, percent)

    def ids(batches):
        for b in batches:
            yield from K.bit_rows(K.distinct(K.mix(b.column(0).to_numpy().view(np.uint64))), bits)

    bits = K.bits_for(removed.count())
    losing_b = spark.sparkContext.broadcast(K.bits_total(removed.select("doc_id").mapInArrow(ids, K.PACKED), bits))
    names = free_names(docs.columns, "n_lines", "n_removed")
    counted = [StructField(x, LongType()) for x in names]
    held = free_names(docs.columns, "__id", "__tag", "__lines")
    at = docs.columns.index(text)
    width = len(docs.columns)

    # texts that lose nothing go straight through; only the others are dealt out by id
    def split(losing: bool):
        def run(batches):
            for b in batches:
                k = losing_b.value.has(K.mix(b.column(width).to_numpy().view(np.uint64)))
                b = b.filter(pa.array(k if losing else ~k))
                if losing:
                    tags = [K.spans_hash(K.running(buf), offs[:-1], offs[1:]) >> U(32) for _, _, buf, offs in K.blocks(b.column(at))]
                    tag = np.concatenate(tags).astype(np.int64) if tags else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tag)], [*b.schema.names, held[1]])
                else:
                    n = pc.fill_null(pc.add(pc.count_substring(b.column(at), "\n").cast(pa.int64()), 1), 0)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, pa.array(np.zeros(len(n), np.int64))], [*b.schema.names[:-1], *names])

        return run

    own = docs.withColumn(held[0], key)
    whole = own.mapInArrow(split(False), StructType([*docs.schema.fields, *counted]))
    losing = own.mapInArrow(split(True), StructType([*docs.schema.fields, StructField(held[0], LongType()), StructField(held[1], LongType())]))
    removed = removed.select(F.col("doc_id").alias(held[0]), F.col("tag").alias(held[1]), F.col("lines").alias(held[2]))
    joined = losing.join(removed, [held[0], held[1]], "left").select(*docs.columns, held[2])

    def run(batches):
        for b in batches:
            texts, total, gone = [], [], []
            for t, drop in zip(b.column(at).to_pylist(), b.column(width).to_pylist()):
                lines = (t or "").split("\n")
                drop = set(drop or ())
                left = [x for i, x in enumerate(lines) if i not in drop]
                texts.append(None if t is None else "\n".join(left))
                total.append(0 if t is None else len(lines))
                gone.append(len(lines) - len(left))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*b.schema.names[:-1], *names])

    return whole.unionByName(joined.mapInArrow(run, StructType([*docs.schema.fields, *counted])))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The names, with underscores before those that are taken."""
    used, out = {x.lower() for x in taken}, []
    for x in wanted:
        while x.lower() in used:
            x = f"_{x}"
        out.append(x)
    return out


def op7_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
