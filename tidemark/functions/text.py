"""HTML, release and link expressions; whole texts, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of markup, and names of character references.
HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->"
BLOCK = r"(?i)</?(p|div|tr|li|h1|h2|h3|br)\b[^>]*>"
TAG = r"<[^>]*>"
REFERENCES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
    "hellip": "\u2026", "bull": "\u2022", "middot": "\u00b7", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "sect": "\u00a7", "para": "\u00b6", "deg": "\u00b0", "plusmn": "\u00b1", "times": "\u00d7",
    "frac12": "\u00bd", "frac14": "\u00bc", "frac34": "\u00be", "cent": "\u00a2", "pound": "\u00a3", "yen": "\u00a5", "euro": "\u20ac", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "", "laquo": "\u00ab", "raquo": "\u00bb",
    "agrave": "\u00e0", "aacute": "\u00e1", "acirc": "\u00e2", "auml": "\u00e4", "ccedil": "\u00e7", "egrave": "\u00e8", "eacute": "\u00e9", "ecirc": "\u00ea", "iacute": "\u00ed", "ntilde": "\u00f1", "oacute": "\u00f3", "ouml": "\u00f6", "uacute": "\u00fa", "uuml": "\u00fc", "szlig": "\u00df",
}
_REFERENCE = r"&(?=(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});)"


def _letter(code: Column) -> Column:
    """The character of a code point; null outside of Unicode."""
    units = lambda n: F.lpad(F.hex(n), 4, "0")
    rest = code - 0x10000
    pair = F.concat(units(F.floor(rest / 1024) + 0xD800), units(rest % 1024 + 0xDC00))
    whole = F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | (code < 1), None).when(code < 0x10000, units(code)).otherwise(pair)
    return F.decode(F.unhex(whole), "UTF-16BE")


def resolved_references(text: Column) -> Column:
    """Numeric and named character references resolved once, left to right; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])

    def one(part: Column, i: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).try_cast("long")
        char = F.when(name.startswith("#"), F.when(code == 160, " ").otherwise(_letter(code))).otherwise(F.element_at(names, name))
        return F.when(i == 0, part).when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substr(part, F.length(name) + 2)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, _REFERENCE), one), "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """Visible lines of a page: scripts and comments gone, blocks on their own line, spaces collapsed."""
    t = F.regexp_replace(html, HIDDEN, "")
    # Line ends of the source are spaces in HTML only inside a line, so they stay line ends here.
    t = F.regexp_replace(t, BLOCK, "\n")
    t = F.regexp_replace(t, TAG, "")
    t = resolved_references(t)
    t = F.regexp_replace(t, r"[ \t\f\r]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"^[ \n]+", ""), r"[ \n]+$", "")


def page_title(html: Column) -> Column:
    return visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: Terms that speak for a kind of document, with what each counts; a kind needs 2 at least.
KIND_TERMS = {
    "transcript": (("transcript", 2), ("conference call", 1), ("earnings call", 1), ("question-and-answer", 1)),
    "presentation": (("investor presentation", 2), ("earnings presentation", 2), ("slide", 1)),
    "earnings_release": (("earnings release", 2), ("financial results", 2), ("quarterly results", 2), ("full year results", 2), ("full-year results", 2)),
}


def kind_scores(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {kind: sum((F.when(F.contains(low, F.lit(term)), points).otherwise(0) for term, points in terms), F.lit(0)) for kind, terms in KIND_TERMS.items()}


def document_kind(text: Column) -> Column:
    """The kind with the highest score over the whole text, the first of equals; a transcript needs its word and a call."""
    scores = kind_scores(text)
    scores["transcript"] = F.when(scores["transcript"] >= 3, scores["transcript"]).otherwise(0)
    best = F.greatest(*scores.values())
    out = F.lit("official_release")
    for kind, score in reversed(scores.items()):
        out = F.when((score == best) & (best >= 2), kind).otherwise(out)
    return out


def table_rows(html: Column) -> Column:
    """Array of rows, each an array of visible cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), visible_text))


def links(html: Column) -> Column:
    """Array of (href, label) of the anchors of a page, in order."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(2))
    return F.arrays_zip(hrefs.alias("href"), labels.alias("label"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def normalize_ticker(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"[./]", "-"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)

