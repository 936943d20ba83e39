"""Queries without SQL against plain Python, and operators on made-up rows."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import siltstone.plans  # noqa: F401
from siltstone.functions import html as H, text as T
from siltstone.operators import acquisition, evaluation as E, neardup, packing, sampling, slices, stages, statistics as A, tokens as K
from siltstone.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def run(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, FOLDER).collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_contacts(spark, docs):
    email = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    phone = re.compile(r"(?<![\w+])\+\d{1,3}(?:[ -]?\d){8,13}(?!\d)|(?<!\d)[6-9]\d{4}[ -]\d{5}(?!\d)|(?<![\d.,])\d{10,13}(?![\d.,])")
    for r in run(spark, "m2_mask_contacts"):
        t = docs[r["doc_id"]]["text"]
        assert r["phones"] == len(phone.findall(t)) and r["text_sha"] == sha(phone.sub("[phone]", email.sub("[email]", t)))


def test_excerpts_and_digests(spark, docs):
    for r in run(spark, "m4_sample_excerpt"):
        t = " / ".join(x.strip() for x in docs[r["doc_id"]]["text"][:1664].splitlines() if x.strip())
        t = re.sub(r"https?://\S+|www\.\S+", "[url]", re.sub(r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]", t))
        t = re.sub(r"\d(?:[\d \-]*\d){6,}", lambda m: f"[{sum(c.isdigit() for c in m[0])} digits]", t)
        assert r["excerpt_sha"] == sha(t[:400] + ("..." if len(t) > 400 else ""))
    for r in run(spark, "m5_blake_digests"):
        t = docs[r["doc_id"]]["text"].encode()
        assert (r["digest16"], r["line8"]) == (hashlib.blake2b(t, digest_size=16).hexdigest(), hashlib.blake2b(t, digest_size=8).hexdigest())


def signature(t):
    a = np.random.Generator(np.random.PCG64(35))
    mult, add = a.integers(0, 1 << 63, 128, dtype=np.uint64) | np.uint64(1), a.integers(0, 1 << 63, 128, dtype=np.uint64)
    w = [zlib.crc32(x.encode()) for x in t.split()]
    if len(w) < 5:
        return None
    grams = {sum(w[i + k] * pow(1_000_003, 4 - k, 1 << 64) for k in range(5)) % (1 << 64) for i in range(len(w) - 4)}
    return [min((g * int(m) + int(b)) % (1 << 64) for g in grams) >> 32 for m, b in zip(mult, add)]


def test_near_duplicates(spark, docs):
    pick = sorted(docs)[:120]
    sig = {i: signature(docs[i]["text"]) for i in pick}
    root = {i: i for i in pick}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for band in range(16):
        buckets = collections.defaultdict(list)
        for i in pick:
            if sig[i]:
                buckets[docs[i]["lang"], tuple(sig[i][8 * band : 8 * band + 8])].append(i)
        for m in buckets.values():
            for i in m[1:]:
                if sum(x == y for x, y in zip(sig[m[0]], sig[i])) / 128 >= 0.8:
                    a, b = find(m[0]), find(i)
                    root[max(a, b)] = min(a, b)
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").where(f"doc_id <= {pick[-1]}")
    assert {r.doc_id: r.root for r in neardup.clusters(d).collect()} == {i: find(i) for i in pick}


def test_long_chain_settles(spark):
    rows = [(1, i, i + 1) for i in range(300)]
    edges = spark.createDataFrame(rows, "by int, u long, v long")
    nodes = spark.createDataFrame([(1, i) for i in range(302)], "by int, row long")
    got = {r.row: r.root for r in neardup._settle(edges, nodes, "by", "row").collect()}
    assert got == {**dict.fromkeys(range(301), 0), 301: 301}


def test_near_removals(spark, docs):
    roots = {r["doc_id"]: r["root"] for r in run(spark, "d2_d4_near_duplicates")}
    gone = {r["doc_id"]: (r["duplicate_of"], r["chars"]) for r in run(spark, "d4_near_removals")}
    assert gone == {i: (v, docs[i]["n_chars"]) for i, v in roots.items() if i != v}
    by = collections.Counter((docs[i]["lang"], docs[i]["source"]) for i in gone)
    assert {(r["lang"], r["source"]): r["removable"] for r in run(spark, "d5_removable_by_type") if r["removable"]} == dict(by)


def test_bootstrap(spark, docs):
    for r in run(spark, "a15_bootstrap"):
        own = [x for x in docs.values() if x["lang"] == r["lang"]]
        x, y = np.array([d["n_chars"] for d in own], float), np.array([len(d["text"].encode()) for d in own], float)
        assert abs(r["ratio"] - x.sum() / y.sum()) < 1e-12 and r["lo"] <= r["ratio"] <= r["hi"]
        g = np.random.default_rng(0)
        v = [x[k].sum() / y[k].sum() for k in (g.integers(0, len(x), len(x)) for _ in range(1000))]
        lo, hi = np.quantile(v, [0.025, 0.975])
        assert hi - lo < 1e-12 or 0.6 < (r["hi"] - r["lo"]) / (hi - lo) < 1.6


def test_bootstrap_of_copies_narrows(spark):
    base = [(float(i % 7 + 1), float(i % 5 + 2)) for i in range(40)]
    one = spark.createDataFrame([("a", i, *v) for i, v in enumerate(base)], "g string, id long, x double, y double")
    many = spark.createDataFrame([("a", i, *v) for i, v in enumerate(base * 25)], "g string, id long, x double, y double")
    a, b = (A.bootstrap(d, "g", "x", "y", "id").first() for d in (one, many))
    assert abs(a.ratio - b.ratio) < 1e-9 and 0.12 < (b.hi - b.lo) / (a.hi - a.lo) < 0.3


def test_verdicts(spark):
    rows = [("up", i, 10.0, 11.0 + i % 2, 5.0) for i in range(60)] + [("same", i, 10.0, 10.0 + (i % 2 * 2 - 1), 5.0) for i in range(60)] + [("single", 1, 1.0, 2.0, 1.0)]
    got = {r.g: r.verdict for r in E.paired_delta(spark.createDataFrame(rows, "g string, id long, a double, b double, units double"), "g", "id").collect()}
    assert got["up"] == "worse" and got["same"] == "no difference"


def test_budget_shards(spark, docs):
    got = {r["doc_id"]: (r["lang"], r["shard"]) for r in run(spark, "p3_char_budget_shards")}
    sizes = {(r["lang"], r["shard"]): (r["docs"], r["chars"]) for r in run(spark, "k1_shard_sizes")}
    for lang in {d["lang"] for d in docs.values()}:
        shard, used, n = 0, 0, collections.Counter()
        for i in sorted(i for i, d in docs.items() if d["lang"] == lang):
            need = len(docs[i]["text"]) + (used > 0)
            if used and used + need > 50_000:
                shard, used, need = shard + 1, 0, len(docs[i]["text"])
            used += need
            n[shard] += 1
            assert got[i] == (lang, shard)
        assert all(sizes[lang, s][0] == k for s, k in n.items())
        assert sizes[lang, shard][1] == used


def test_bpe(spark, docs):
    merges = [(bytes.fromhex(r["left_bytes"]), bytes.fromhex(r["right_bytes"])) for r in sorted(run(spark, "t5_bpe_train"), key=lambda r: r["rank"])]

    def pre(t):
        kind = lambda c: "s" if c.isspace() else "w" if unicodedata.category(c)[0] in "LNM" else "o"
        out = []
        for c in t:
            if out and kind(out[-1][-1]) == kind(c):
                out[-1] += c
            else:
                out.append(c)
        return out

    chunks = collections.Counter(w for d in docs.values() for w in pre(d["text"]))
    forms = {w: [bytes([b]) for b in w.encode()] for w in chunks}
    for pair in merges[:12]:
        n = collections.Counter()
        for w, f in forms.items():
            for p in zip(f, f[1:]):
                n[p] += chunks[w]
        assert pair == min(n, key=lambda p: (-n[p], p))
        forms = {w: list(K.apply(tuple(f), pair)) for w, f in forms.items()}
    bpe = K.Bpe(merges)
    for r in run(spark, "t6_bpe_encode")[:40]:
        ids = [i for w in pre(docs[r["doc_id"]]["text"]) for i in bpe.chunk(w)]
        assert (r["n_tokens"], r["ids_sha"]) == (len(ids), sha(" ".join(map(str, ids)))) and bpe.decode(ids) == docs[r["doc_id"]]["text"]
    with pytest.raises(ValueError):
        bpe.decode([len(bpe.raw)])


def test_sweep(spark, docs):
    rows = run(spark, "t10_tokeniser_sweep")
    assert len(rows) == 4 and all(r["failures"] == 0 and r["chars"] == sum(len(d["text"]) for d in docs.values()) for r in rows)
    assert all(a["tokens"] > b["tokens"] for a in rows for b in rows if a["pretoken"] == b["pretoken"] and a["merges"] < b["merges"])


def test_samples(spark, docs):
    u = lambda x: x % (1 << 64)

    def key(i, seed):
        z = u((i ^ u(seed * sampling.GOLDEN)) + sampling.GOLDEN)
        z = u((z ^ z >> 30) * sampling.MIX[0])
        z = u((z ^ z >> 27) * sampling.MIX[1])
        return z ^ z >> 31

    assert {r["doc_id"] for r in run(spark, "p7_hash_sample")} == set(sorted(docs, key=lambda i: (key(i, 48), i))[:100])
    want = list(range(len(docs)))
    random.Random(1337).shuffle(want)
    assert [r["row"] for r in sorted(run(spark, "p4_parity_order"), key=lambda r: r["pos"])] == want
    files = spark.createDataFrame([("a", 1000), ("b", 400), ("c", 5)], "name string, tokens long")
    w = sampling.one_pass_windows(files, 10, 3)
    got = [(r.name, r.start) for r in w.orderBy("ord").collect()]
    every = [("a", 10 * k) for k in range(99)] + [("b", 10 * k) for k in range(39)]
    order = sorted(range(len(every)), key=lambda i: (key(i, 3), i))
    assert got == [every[i] for i in order]
    assert sampling.order_fingerprint(w) == hashlib.sha256(np.array(order, "<i8").tobytes()).hexdigest()
    parts = [{(r.name, r.start) for r in sampling.resumed(w, 8, 5, k, 2).collect()} for k in (0, 1)]
    assert parts[0] | parts[1] == set(got[8:138]) and not parts[0] & parts[1]
    with pytest.raises(ValueError):
        sampling.resumed(w, 999, 5)


def test_segments():
    for n, first, block in [(5, 1, 8), (50, 3, 8), (17, 16, 4), (9, 1, 1), (3, 3, 4)]:
        scored = [i for s, e, k in sampling.segments(n, first, block) for i in range(e - k, e)]
        assert scored == list(range(first, n)) and all(e - s <= block + 1 for s, e, _ in sampling.segments(n, first, block))


def test_html():
    page = """<html><head><title>no</title></head><body><p>One&nbsp;two​ <a href=x>[[link</a></p><div style="display: none">hid</div>
    <table><tr><td>a</td><td>b</td></tr></table><p>x<br><br>y</p><ul><li><a>nav only</a></li></ul><span class="pagenum ws-pagenum" data-page-name="P/1" data-page-quality="3">1</span><br>joined</p><sup class="reference">[1]</sup></body>"""
    r = H.render(page)
    assert r["text"].split("\n") == ["One two link", "", "a b", "", "x", "", "y", "", "nav only", "", "joined"]
    assert r["navigation"] == 2 and r["pages"] == [{"name": "P/1", "level": 3}] and r["artifacts"][H.MARKER_NAME] == 1 and r["artifacts"][H.JOIN_NAME] == 1
    assert r["artifacts"]["U+200B ZERO WIDTH SPACE"] == 1 and r["artifacts"][H.NBSP_NAME] == 1
    assert H.render("<div class='redirectMsg'>x</div>")["is_redirect"] and H.render("</p></div>stray")["text"] == "stray"
    assert H.payload('{"error":{"code":"missingtitle"}}')["error"] == "missingtitle" and H.payload("[1]")["error"] == "no_object"
    cut = H.payload('{"parse":{"title":"T","text":"<p>caf\\u00e9 and mo', True)
    assert cut["ok"] and cut["cut"] and cut["html"] == "<p>café and mo" and cut["title"] == "T"
    assert not H.payload('{"parse":{"text":"<p>x')["ok"]


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()}
    for r in run(spark, "s13_rendered_pages"):
        want = H.render(pages[r["page_id"]])
        assert r["text_sha"] == sha(want["text"]) and r["n_rows"] == want["n_rows"] and "<p>" not in want["text"]
    for r in run(spark, "s17_quality_batches"):
        assert r["n"] <= acquisition.BATCH and (r["chars"] <= acquisition.URL_CHARS or r["n"] == 1)


def test_digit_context(spark, docs):
    for r in run(spark, "g5_digit_context"):
        t = docs[r["doc_id"]]["text"]
        m = re.search("[0-9]{5,}", t)
        want = f"{t[max(0, m.start() - 30) : m.start()]}«{m[0]}»{t[m.end() : m.end() + 30]}".replace("\n", "|")
        assert r["context_sha"] == sha(want)


def test_clean_lines(spark):
    rows = [(1, "f", "hi", "  कख गघ \n\n\nABC only\nhot line\nकख latin mixed\n12 34\n"), (2, "f", "hi", "hot line\n\nhot line"), (3, "g", "en", "hot line\nΑΒΓ\nplain\n\n\nlast")]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = {r.doc_id: r for r in slices.clean_lines(d, {"hi": "devanagari", "en": "latin"}, 3).collect()}
    assert got[1].body == "कख गघ\n\nकख latin mixed\n12 34" and (got[1].boilerplate_lines, got[1].foreign_lines) == (1, 1)
    assert got[2].body == "" and got[3].body == "hot line\nplain\n\nlast" and got[3].foreign_chars == 3


def test_reason_cascade(spark):
    """One document for each of the reasons, and kept ones."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    hi = "".join(chr(0x915 + rng.randrange(20)) for _ in range(30))
    item, short, prior, near = text(20), text(8), text(30), text(200).split()
    one, two = text(30), text(31)
    mail = "aa bb cc dd ee a.b@c.de ff gg hh ii jj kk ll mm"
    rows = [
        (1, "s1", "en", "", "empty"), (2, "s1", "en", item, "suite_exact"), (3, "s1", "en", f"{text(9)} {item} {text(9)}", "suite_ngram"), (4, "s1", "en", f"{text(9)} {short} {text(9)}", "suite_short"),
        (5, "s1", "en", one, None), (6, "s1", "en", one, "exact_duplicate"), (7, "s0", "en", two, None), (8, "s1", "en", two, "cross_file_duplicate"), (9, "s1", "en", text(6) + "\x01" * 9, "control_chars"),
        (10, "s1", "en", hi, "empty_after_cleaning"), (11, "s1", "en", "12 34 56", "no_letters"), (12, "s1", "en", f"ab {hi}\n12", "script_share"), (13, "s1", "ur", "ا" * 60, "urdu_persian_like"),
        (14, "s1", "ur", "ەۇۆۈ" + "ا" * 10, "urdu_uyghur_like"), (15, "s1", "en", f"{text(9)} {{{{a}}}} {{{{b", "wiki_markup"), (16, "s1", "en", "aa bb " * 20, "repetition"),
        (17, "s1", "en", mail, "suite_after_cleaning"), (18, "s1", "en", prior, "slice1_duplicate"), (19, "s1", "en", " ".join(near), None), (20, "s1", "en", " ".join([*near[:100], "zz", *near[101:]]), "near_duplicate"),
    ]
    d = spark.createDataFrame([r[:4] for r in rows], "doc_id long, source string, lang string, text string")
    suite = spark.createDataFrame([(1, item), (2, short), (3, mail.replace("a.b@c.de", "[email]"))], "item_id long, text string")
    old = spark.createDataFrame([(sha(prior),)], "h string")
    built = slices.build(d, suite, {"en": "latin", "ur": "arabic"}, old, 100)
    got = {r.doc_id: r.reason for r in slices.with_near_duplicates(built, neardup.clusters).collect()}
    assert got == {r[0]: r[4] for r in rows}
    table = {r.reason: r.docs for r in slices.reason_table(built).collect()}
    assert set(table) == set(slices.REASONS) and table["empty"] == 1 and table["near_duplicate"] == 0


def test_review_rows(spark):
    shares = spark.createDataFrame([("repetition", 0.03), ("repetition", 0.01), ("suite_after_cleaning", 0.001)], "rule string, share double")
    assert sorted(r.rule for r in slices.review_rows(shares).collect()) == ["repetition", "suite_after_cleaning"]


def test_thresholds_of_a_language(spark):
    d = spark.createDataFrame([(1, "en", "x" * 50), (2, "de", "x" * 50)], "doc_id long, lang string, text string")
    got = {r.doc_id: r.reason for r in stages.quality(d, overrides={"de": stages.Thresholds(max_chars=10)}).scored.collect()}
    assert got == {1: None, 2: "max_chars"}


def test_scripts(spark):
    rows = ["ɐⱠꜢ", "ªº", "ꣲ", "कa", "漢字", "", "12"]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    from pyspark.sql import functions as F

    p = {r.i: r for r in d.select("i", T.profile(F.col("t"))["latin"].alias("latin"), T.profile(F.col("t"))["devanagari"].alias("deva"), T.profile(F.col("t"))["unknown"].alias("unknown"), T.known_letters(F.col("t")).alias("known")).collect()}
    assert [p[i].latin for i in range(7)] == [3, 0, 0, 1, 0, 0, 0] and p[2].deva == 0 and p[1].unknown == 2 and p[4].unknown == 2 and p[3].known == 2


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 7), [j % 50 for j in range(i)]) for i in range(200)], "doc_id long, text string, ids array<int>")
    from pyspark.sql import functions as F

    rows = packing.packed(docs, F.col("ids"), 60, ppm=200_000)
    check = packing.pack_checks(rows, 60).first()
    assert check.docs == 200 and check.tokens == sum(range(200)) + 200 and check.n_train + check.n_val == check.tokens
    assert check.repeated_ids == check.end_tokens_inside == check.without_end == check.above_end == 0
    index = packing.write_tokens(rows, str(tmp_path / "t"), slices=4)
    assert index.agg(F.sum("tokens")).first()[0] == check.tokens
    back = packing.read_tokens(spark, str(tmp_path / "t"), "val").orderBy("part", "pos").collect()
    val = sorted(r.doc_id for r in rows.where("split = 'val'").collect())
    assert [r.id for r in back] == [x for i in val for x in [*[j % 50 for j in range(i)], 60]]
    assert packing.val_ids_digest(rows) == hashlib.sha256("\n".join(sorted(map(str, val))).encode()).hexdigest()
    raw = [bytes([65 + i]) for i in range(60)] + [b""]
    got = {r.digest for r in packing.document_digests(spark, str(tmp_path / "t"), 60, raw).collect()}
    assert got == {hashlib.blake2b(b"".join(raw[j % 50] for j in range(i)), digest_size=16).hexdigest() for i in range(200)}


def test_shard_files_and_manifests(spark, tmp_path):
    import gzip

    d = spark.createDataFrame([(i, "en", f"doc {i}\nline") for i in range(9)], "doc_id long, lang string, text string")
    s = packing.budget_shards(d.selectExpr("lang", "doc_id", "length(text) AS chars"), "lang", "doc_id", "chars", 30)
    packing.write_text_shards(d, s, "lang", "doc_id", str(tmp_path / "s"))
    rows = packing.read_text_shards(spark, str(tmp_path / "s")).collect()
    assert sorted(r.value for r in rows) == [f"doc {i} line" for i in range(9)] and {int(r["shard"]) for r in rows} == {0, 1, 2, 3, 4}
    a, b = packing.manifest({"x": d}, "2020"), packing.manifest({"x": d}, "2021")
    assert a["content_sha256"] == b["content_sha256"] and a != b and a["tables"]["x"]["documents"] == 9
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.gz").write_bytes(gzip.compress(b"one") + gzip.compress(b"two"))
    f = spark.read.format("binaryFile").load(str(tmp_path / "g"))
    assert f.select(packing.file_members(f.content)).first()[0] == 2


def test_comparisons_refuse_mixed_corpora(spark):
    rows = [("a", 0, "c1", 1.0, 1.0, 1.0, 0.0, 0), ("b", 1, "c2", 1.0, 1.0, 1.0, 0.0, 0)]
    form = "label string, ord int, corpus string, tokens_per_char double, chars_per_token double, tokens_per_word double, unk_rate double, round_trip_failures int"
    with pytest.raises(Exception, match="more than one corpus"):
        E.compare(spark.createDataFrame(rows, form)).collect()
    one = spark.createDataFrame([(1, 1.0)], "doc long, v double")
    with pytest.raises(Exception, match="only one side"):
        E.aligned(one, one.where("doc > 1"), "doc", "v").collect()


def test_large_suites_are_joined(spark, monkeypatch):
    d, b = (spark.read.parquet(f"{FOLDER}/{x}.parquet") for x in ("documents", "benchmark"))
    small = [sorted(map(tuple, f(d, b).collect())) for f in (stages.suite_hits, lambda d, b: stages.found_passages(d, b, 3, 40).select("doc_id", "item", "pos"))]
    monkeypatch.setattr(stages, "MOST_GRAMS", 0)
    assert small == [sorted(map(tuple, f(d, b).collect())) for f in (stages.suite_hits, lambda d, b: stages.found_passages(d, b, 3, 40).select("doc_id", "item", "pos"))]
    assert small[0]


def test_chunks():
    long = ("word " * 300).strip()
    assert T.chunked("a\n\n b \n") == ["a", "b"]
    got = T.chunked(f"First one. {long}. Last?\nx" + "y" * 2500)
    assert all(len(x) <= T.MOST_CHARS for x in got) and got[0] == "First one." and "Last?" in got
    assert "".join("".join(x.split()) for x in got) == "".join(f"First one. {long}. Last? x{'y' * 2500}".split())


def test_parts_and_members(spark, tmp_path):
    import gzip

    from siltstone.sources import tables as R

    a, b = (spark.createDataFrame([(i, f"{n}{i}") for i in range(5)], "doc_id long, text string") for n in "ab")
    want = {"a": R.text_digest(a), "b": R.text_digest(b)}
    assert R.open_parts({"a": a, "b": b.repartition(3)}, want).count() == 10
    with pytest.raises(ValueError, match="recorded"):
        R.open_parts({"a": a, "b": b.where("doc_id > 0").union(b.where("doc_id = 1"))}, want)
    R.write_jsonl(a, str(tmp_path / "j"), "doc_id")
    assert [r.text for r in R.jsonl(spark, str(tmp_path / "j")).collect()] == [f"a{i}" for i in range(5)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.gz").write_bytes(gzip.compress(b"one") + gzip.compress(b"two"))
    f = spark.read.format("binaryFile").load(str(tmp_path / "g"))
    x = f.select(R.joined_members(f.content).alias("c"), packing.file_members(R.joined_members(f.content)).alias("n")).first()
    assert gzip.decompress(bytes(x.c)) == b"onetwo" and x.n == 1
