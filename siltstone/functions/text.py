"""Text expressions shared by the operators (all JVM-side but ``nfc``).

The whitespace, letter and digit classes are those of the data model: Unicode white space
with U+001C-001F, letters without combining marks, decimal digits of any script.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

WS = r"(?U)[\s\x1c-\x1f]+"
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# fixed values: the contact patterns that are masked
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
PHONE = (
    r"(?<![\p{L}\p{N}_+])\+\p{Nd}{1,3}(?:[ -]?\p{Nd}){8,13}(?!\p{Nd})"
    r"|(?<!\p{Nd})[6-9]\p{Nd}{4}[ -]\p{Nd}{5}(?!\p{Nd})"
    r"|(?<![\p{Nd}.,])\p{Nd}{10,13}(?![\p{Nd}.,])"
)
CONTROL = r"[\x00-\x08\x0e-\x1f\x7f-\x9f]"
URL = r"https?://|www\."
TEMPLATE = r"\{\{|\}\}"
DIGIT_RUN = r"[0-9]{5,}"
PRETOKEN = r"(?U)[\s\x1c-\x1f]+|[\p{L}\p{N}\p{M}]+|[^\s\x1c-\x1f\p{L}\p{N}\p{M}]+"
WORD_TOKEN = r"[A-Za-z]+|[0-9]+|\s+|."

# fixed values: code point ranges of the scripts the gate knows
SCRIPTS = {
    "latin": r"\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{24F}\x{250}-\x{2A8}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}",
    "devanagari": r"\x{900}-\x{97F}",
    "bengali": r"\x{980}-\x{9FF}",
    "gurmukhi": r"\x{A00}-\x{A7F}",
    "gujarati": r"\x{A80}-\x{AFF}",
    "odia": r"\x{B00}-\x{B7F}",
    "tamil": r"\x{B80}-\x{BFF}",
    "telugu": r"\x{C00}-\x{C7F}",
    "kannada": r"\x{C80}-\x{CFF}",
    "malayalam": r"\x{D00}-\x{D7F}",
    "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
}
KNOWN = "".join(SCRIPTS.values())


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda x: x != "")


#: rows and bytes that an Arrow function gets at once: texts may be long
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def batched(column: Column) -> Column:
    """column, after the session's Arrow batches are bounded (smaller settings stay)."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            own = (spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or "").rstrip("b")
            if not own.isdigit() or not 0 < int(own) <= most:
                spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return column


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(w: Column, n: int) -> Column:
    """n successive words, in text order; none where the text is shorter."""
    return let(w, lambda w: _grams(w, n))


def _grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda k: F.array_join(F.slice(w, k, n), " "))).otherwise(F.array().cast("array<string>"))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_share(text: Column, seed: int) -> Column:
    """A number in [0, 1] from the text's hash and the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), sha(text)), 256), 1, 16), 16, 10)
    return h.cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


@F.pandas_udf(StringType())
def _nfc(s):
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: below U+0300 nothing decomposes under NFC, combines or is the second of a pair
COMBINES = r"[\x{300}-\x{10FFFF}]"


def nfc(text: Column) -> Column:
    """NFC; a text without COMBINES is never sent to Python (the function gets null for it,
    as a branch alone does not keep it from being called)."""
    return F.coalesce(batched(_nfc(F.when(text.rlike(COMBINES), text))), text)


def normalize(text: Column, policy: str = "nfc") -> Column:
    """Composed, without CR, runs of blanks as one, outer white space off."""
    if policy not in ("nfc", "none"):
        raise ValueError(f"unknown policy {policy!r}")
    t = nfc(text) if policy == "nfc" else text
    return strip(F.regexp_replace(F.regexp_replace(t, "\r", ""), "[ \t]{2,}", " "))


def mask_contacts(text: Column) -> Column:
    """E-mails and phone numbers as marks; most texts hold neither sign nor digits of one."""
    t = let(text, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, EMAIL, "[email]")).otherwise(t))
    return let(t, lambda t: F.when(t.rlike(r"\p{Nd}(?:[ -]?\p{Nd}){8}"), F.regexp_replace(t, PHONE, "[phone]")).otherwise(t))


def letters(text: Column, script: str) -> Column:
    """By the runs of letters that go, which are fewer than the letters."""
    return let(text, lambda t: _letters(t, SCRIPTS[script]))


def _letters(t: Column, chars: str) -> Column:
    return (F.length(t) - F.length(F.regexp_replace(t, rf"[\p{{L}}&&[{chars}]]+", ""))).cast("long")


def known_letters(text: Column) -> Column:
    """Letters of any script the gate knows, in one pass."""
    return let(text, lambda t: _letters(t, KNOWN))


def top_script(text: Column) -> Column:
    """The script with most letters, of equal ones the one that comes first in the text;
    "common" without letters."""
    ranked = [F.struct(letters(text, s).alias("n"), (-F.regexp_instr(text, F.lit(rf"[\p{{L}}&&[{SCRIPTS[s]}]]"))).alias("first"), F.lit(s).alias("script")) for s in SCRIPTS]
    return let(F.greatest(*ranked), lambda x: F.when(x["n"] > 0, x["script"]).otherwise("common"))


def once(df, **columns: Column):
    """df with more columns that are computed once a row, whatever filters and joins read
    them: the optimiser moves nothing across the generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def profile(text: Column) -> dict[str, Column]:
    """Letters by script, letters outside every block (unknown), other visible (common)."""
    out = {s: letters(text, s) for s in SCRIPTS}
    every = count(text, r"\p{L}")
    known = out["latin"]
    for s in list(SCRIPTS)[1:]:
        known = known + out[s]
    out["unknown"] = every - known
    out["common"] = count(text, r"(?U)[^\s\x1c-\x1f]") - every
    return out


def repetition(text: Column) -> Column:
    """Distinct over all word pairs; null with fewer than two words."""
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return let(words(text), lambda w: F.when(F.size(w) >= 2, F.size(F.array_distinct(pairs(w))) / (F.size(w) - 1)))


# fixed values: what is taken out of wikitext, in this order; templates three levels deep
WIKITEXT = (
    (r"\r\n?", "\n"), (r"(?s)<!--.*?-->", ""), (r"(?si)<ref[^>/]*?>.*?</ref>", ""), (r"(?i)<ref[^>]*?/>", ""),
    (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""),
    (r"(?m)^\s*=+\s*(.*?)\s*=+\s*$", "$1"), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"\'{2,3}", ""),
    (r"<[^>]+>", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"),
)
#: markers of the work inside a Gutenberg file (fixed values)
GUTENBERG = ("*** START OF THE PROJECT GUTENBERG EBOOK", "*** END OF THE PROJECT GUTENBERG EBOOK")


def clean_wikitext(text: Column) -> Column:
    """Plain text of wikitext: every line stripped, outer white space off."""
    for pattern, by in WIKITEXT:
        text = F.regexp_replace(text, pattern, by)
    return strip(F.array_join(F.transform(F.split(text, "\n"), strip), "\n"))


def clean_plain(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\r\n?", "\n"))


def clean_gutenberg(text: Column) -> Column:
    """What lies between the line of the start marker and the end marker; the whole text
    where one is missing or the end comes first."""

    def body(t):
        start, end = F.locate(GUTENBERG[0], t), F.locate(GUTENBERG[1], t)
        line = F.call_function("locate", F.lit("\n"), t, F.greatest(start, F.lit(1)))
        inside = F.substring(t, line + 1, end - line - 1)
        return F.when((start > 0) & (end > start) & (line > 0), strip(F.when(end - line - 1 > 0, inside).otherwise(""))).otherwise(strip(t))

    return F.element_at(F.transform(F.array(F.regexp_replace(text, r"\r\n?", "\n")), lambda x: body(x)), 1)


def clean(text: Column, kind: Column) -> Column:
    """By kind: gutenberg, wikitext or plain; others are an error."""
    return (
        F.when(kind == "gutenberg", clean_gutenberg(text)).when(kind == "wikitext", clean_wikitext(text)).when(kind == "plain", clean_plain(text))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))))
    )


# fixed values: what samples hide of a text
SAMPLE_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+"
SAMPLE_URL = r"(?U)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
SAMPLE_NUMBER = r"\p{Nd}(?:[\p{Nd} \-]*\p{Nd}){6,}"


def mask_samples(text: Column) -> Column:
    """E-mails, URLs and numbers of seven digits or more as [email], [url], [n digits]."""
    t = F.regexp_replace(F.regexp_replace(text, SAMPLE_EMAIL, "[email]"), SAMPLE_URL, "[url]")
    # numbers go between marks; each is then replaced by the count of its digits
    parts = F.split(F.regexp_replace(F.translate(t, "\x01", "\x02"), f"({SAMPLE_NUMBER})", "\x01$1\x01"), "\x01")
    masked = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("["), F.regexp_count(x, F.lit(r"\p{Nd}")).cast("string"), F.lit(" digits]"))).otherwise(x))
    return F.array_join(masked, "")


def excerpt(text: Column, limit: int = 400) -> Column:
    """A masked window as one line, cut at ``limit`` characters with three dots."""
    parts = F.filter(F.transform(F.split(F.substring(text, 1, 4 * limit + 64), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")
    return let(mask_samples(F.array_join(parts, " / ")), lambda x: F.concat(F.substring(x, 1, limit), F.when(F.length(x) > limit, "...").otherwise("")))


@F.pandas_udf(StructType([StructField("digest16", StringType()), StructField("line8", StringType())]))
def _blake(s):
    import hashlib

    import pandas as pd

    raw = [None if x is None else x.encode() for x in s]
    return pd.DataFrame({
        "digest16": [None if x is None else hashlib.blake2b(x, digest_size=16).hexdigest() for x in raw],
        "line8": [None if x is None else hashlib.blake2b(x, digest_size=8).hexdigest() for x in raw],
    })


def blake(text: Column) -> Column:
    """blake2b digests of 16 bytes (documents) and 8 bytes (lines), as hex."""
    return batched(_blake(text))


def trim_text(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut after the last whole line where there is one."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.locate("\n", F.reverse(head)) + 1
    return F.when(F.length(text) <= most, text).otherwise(F.when(F.locate("\n", head) > 0, F.substring(head, F.lit(1), last - 1)).otherwise(head))


MOST_CHARS = 1200  # fixed value: a paragraph of more characters is cut into sentences


def wrapped(piece: str, most: int = MOST_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last blank that fits, else where the limit falls."""
    out = []
    piece = piece.strip()
    while len(piece) > most:
        at = max(piece.rfind(" ", 0, most + 1), piece.rfind("\t", 0, most + 1))
        head, piece = (piece[:at], piece[at + 1 :]) if at > 0 else (piece[:most], piece[most:])
        out.append(head.strip())
        piece = piece.lstrip()
    return [x for x in [*out, piece] if x]


def chunked(text: str) -> list[str]:
    """Paragraphs of a text; long ones as sentences, too long ones wrapped. No text is dropped."""
    import re

    out = []
    for line in text.splitlines():
        line = line.strip()
        if len(line) <= MOST_CHARS:
            out += [line] if line else []
        else:
            for piece in re.split(r"(?<=[।॥৷۔؟.!?])\s+", line):  # fixed value: what ends a sentence
                out += wrapped(piece)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _chunked(s):
    return s.map(lambda x: [] if x is None else chunked(x))


def documents_of(text: Column) -> Column:
    """Array of the documents of a text."""
    return batched(_chunked(text))
