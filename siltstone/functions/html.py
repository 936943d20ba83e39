"""Text of rendered HTML pages, and the API payloads that carry them.

One reader turns the events of the standard library's parser into rows of visible text;
it runs in an Arrow function, a page at a time.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

from siltstone.functions import text as T

# fixed values: elements and classes without text, elements that end a row, elements without an end
HIDDEN_TAGS = frozenset("head noscript script style template title".split())
HIDDEN_CLASSES = frozenset("mw-cite-backlink mw-editsection mw-references-wrap noprint pagenum reference references ws-noexport ws-pagenum".split())
ROW_TAGS = frozenset("address article aside blockquote caption center dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split())
CELL_TAGS = frozenset(["td", "th"])
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = {"​": "U+200B ZERO WIDTH SPACE", "‎": "U+200E LEFT-TO-RIGHT MARK", "⁠": "U+2060 WORD JOINER", "﻿": "U+FEFF ZERO WIDTH NO-BREAK SPACE"}
NBSP, NBSP_NAME = " ", "U+00A0 NO-BREAK SPACE -> space"
JOIN_NAME, MARKER_NAME = "page-join line break -> space", "unmatched link marker"

PAGE = StructType([StructField("name", StringType()), StructField("level", IntegerType())])
RENDERED = StructType([
    StructField("text", StringType()), StructField("n_rows", LongType()), StructField("navigation", LongType()), StructField("is_redirect", BooleanType()),
    StructField("is_scan", BooleanType()), StructField("pages", ArrayType(PAGE)), StructField("artifacts", MapType(StringType(), LongType())),
])
ANSWER = StructType([StructField("ok", BooleanType()), *[StructField(x, StringType()) for x in ("html", "title", "error")], StructField("cut", BooleanType())])

DROP = str.maketrans({**dict.fromkeys(INVISIBLE, None), NBSP: " "})
UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
PAIR = re.compile(r"\[\[|\]\]")


class Reader(HTMLParser):
    """Rows of text; an empty row is a paragraph break."""

    def __init__(self, least: int):
        super().__init__(convert_charrefs=True)
        self.least = least  # fewer visible characters outside links make a row with links navigation
        self.open: list[tuple[str, bool, bool]] = []  # tag, hidden, poem
        self.links = self.poems = self.nav = self.joins = 0
        self.rows: list[str] = []
        self.row: list[str] = []
        self.inside = self.outside = 0  # visible characters of the row in links and out of them
        self.seen: Counter = Counter()
        self.pages: dict[str, int | None] = {}
        self.redirect = self.scan = self.anchor = False

    # events

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        kinds = set(a.get("class", "").split())
        self.facts(a, kinds)
        hidden = bool(self.open and self.open[-1][1])
        self.anchor |= not hidden and bool(kinds & {"pagenum", "ws-pagenum"})
        if tag in EMPTY_TAGS:
            if not hidden and tag == "br":
                self.break_row()
            elif not hidden and tag in ROW_TAGS:
                self.paragraph()
            return
        hidden = hidden or tag in HIDDEN_TAGS or bool(kinds & HIDDEN_CLASSES) or bool(UNSEEN.search(a.get("style", "")))
        poem = not hidden and "poem" in kinds
        self.open.append((tag, hidden, poem))
        if not hidden:
            self.edge(tag)
            self.links += tag == "a"
            self.poems += poem

    def handle_endtag(self, tag):
        if tag in EMPTY_TAGS or all(x[0] != tag for x in self.open):
            return  # an end without a start closes nothing
        while True:
            name, hidden, poem = self.open.pop()
            if not hidden:
                self.links -= name == "a"
                self.poems -= poem
                self.edge(name)
            if name == tag:
                return

    def handle_data(self, data):
        if self.open and self.open[-1][1]:
            return
        for c in set(data) & (INVISIBLE.keys() | {NBSP}):
            self.seen[INVISIBLE.get(c, NBSP_NAME)] += data.count(c)
        ink = sum(not c.isspace() and c not in INVISIBLE for c in data)
        if self.links:
            self.inside += ink
        else:
            self.outside += ink
        self.anchor &= not ink
        self.row.append(data)

    # rows

    def edge(self, tag):
        if tag in ROW_TAGS:
            self.paragraph()
        elif tag in CELL_TAGS:
            self.row.append(" ")

    def break_row(self):
        if self.anchor and not self.poems:  # the printed line goes on over the page's end
            self.row.append(" ")
            self.joins += 1
            self.anchor = False
        elif not self.end_row() and self.rows and self.rows[-1]:
            self.rows.append("")

    def paragraph(self):
        self.anchor = False
        self.end_row()
        if self.rows and self.rows[-1]:
            self.rows.append("")

    def end_row(self) -> bool:
        text = " ".join("".join(self.row).translate(DROP).split())
        if text:
            self.nav += bool(self.inside) and self.outside < self.least
            self.rows.append(text)
        self.row, self.inside, self.outside = [], 0, 0
        return bool(text)

    def facts(self, a, kinds):
        """What pages say of themselves, hidden parts included."""
        self.redirect |= bool(kinds & {"redirectMsg", "redirectText"})
        self.scan |= "prp-pages-output" in kinds
        if kinds & {"pagenum", "ws-pagenum"}:
            name, level = a.get("data-page-name", "").strip(), a.get("data-page-quality", "").strip()
            if not name and "data-page-number" in a:
                title = unquote(a.get("title", "")).replace("_", " ").strip()
                name = title if re.search(":.*/", title) else ""
            if name:
                self.pages.setdefault(name, int(level) if level.isdigit() else None)


def unpaired_removed(text: str) -> tuple[str, int]:
    """Without link marks that have no partner, and how many those were."""
    waiting, lone = [], []
    for m in PAIR.finditer(text):
        if m[0] == "[[":
            waiting.append(m.start())
        elif waiting:
            waiting.pop()
        else:
            lone.append(m.start())
    lone = sorted(waiting + lone)
    parts, at = [], 0
    for x in lone:
        parts.append(text[at:x])
        at = x + 2
    return "".join(parts) + text[at:], len(lone)


CUT = StructType([StructField("text", StringType()), StructField("removed", IntegerType())])


@F.pandas_udf(CUT)
def _cut(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else unpaired_removed(x) for x in s], columns=["text", "removed"])


def without_unpaired(text: Column) -> Column:
    """Struct of the text without unpaired link marks and their number."""
    return T.batched(_cut(text))


def render(html: str, least: int = 20) -> dict:
    r = Reader(least)
    r.feed(html)
    r.close()
    r.end_row()
    rows = r.rows
    while rows and not rows[-1]:
        rows.pop()
    cut = [unpaired_removed(x) for x in rows]
    counts = r.seen + Counter({JOIN_NAME: r.joins, MARKER_NAME: sum(n for _, n in cut)})
    return {
        "text": "\n".join(x for x, _ in cut), "n_rows": sum(bool(x) for x, _ in cut), "navigation": r.nav, "is_redirect": r.redirect, "is_scan": r.scan,
        "pages": [{"name": k, "level": v} for k, v in r.pages.items()], "artifacts": {k: counts[k] for k in sorted(counts) if counts[k]},
    }


NONE = {"text": None, "n_rows": None, "navigation": None, "is_redirect": None, "is_scan": None, "pages": None, "artifacts": None}


@F.pandas_udf(RENDERED)
def _render(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([NONE if x is None else render(x) for x in s], columns=list(NONE))


def rendered(html: Column) -> Column:
    """Struct of a page's text and facts; null for null."""
    return T.batched(_render(html))


# payloads ------------------------------------------------------------------------------


def whole_string(raw: str, at: int) -> tuple[str, bool]:
    """The JSON string that starts behind the quote before ``at``, as far as it is there,
    and whether it ends."""
    m = re.compile(r'(?:[^"\\]|\\(?:u[0-9a-fA-F]{4}|[^u]))*').match(raw, at)
    body = m[0]
    while True:
        try:
            return json.loads(f'"{body}"', strict=False), raw[m.end() : m.end() + 1] == '"'
        except ValueError:
            body = body[:-1]


def payload(raw: str, allow_cut: bool = False) -> dict:
    """ok, html, title and error of an API answer; of a cut one what there is, if asked for."""
    out = {"ok": False, "html": None, "title": None, "error": None, "cut": False}
    try:
        got = json.loads(raw)
    except ValueError:
        out["error"], out["cut"] = "not_json", raw.lstrip().startswith("{")
        m = re.search(r'"text"\s*:\s*(?:\{\s*"\*"\s*:\s*)?"', raw)
        if allow_cut and m:
            out["html"], _ = whole_string(raw, m.end())
            t = re.search(r'"title"\s*:\s*"', raw[: m.start()])
            out |= {"ok": True, "error": None, "title": whole_string(raw, t.end())[0] if t else None}
        return out
    if not isinstance(got, dict):
        return out | {"error": "no_object"}
    if "error" in got:
        return out | {"error": str((got["error"] or {}).get("code", "error")) if isinstance(got["error"], dict) else "error"}
    parse = got.get("parse")
    text = parse.get("text") if isinstance(parse, dict) else None
    text = text.get("*") if isinstance(text, dict) else text  # older answers wrap it
    if not isinstance(text, str):
        return out | {"error": "no_text"}
    return out | {"ok": True, "html": text, "title": parse.get("title")}


@F.pandas_udf(ANSWER)
def _payload(s: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(("ok", "html", "title", "error", "cut"))
    return pd.DataFrame([none if x is None else payload(x, True) for x in s], columns=list(none))


def payloads(raw: Column) -> Column:
    """Struct of an API answer; a cut one gives what it holds."""
    return T.batched(_payload(raw))


@F.pandas_udf(StringType())
def _strict(s: pd.Series) -> pd.Series:
    def one(x):
        p = payload(x, True)
        return render(p["html"])["text"] if p["ok"] and not p["cut"] and p["html"] is not None else ""

    return s.map(lambda x: None if x is None else one(x))


def strict_text(raw: Column) -> Column:
    """Text of a whole and error-free API answer, else the empty string."""
    return F.coalesce(T.batched(_strict(raw)), F.lit(""))
