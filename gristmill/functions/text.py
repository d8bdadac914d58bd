"""Scalar text functions as Columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question and function words dropped from queries. They are compared with folded terms, so
# the accented entries never match and those words are kept.
STOPWORDS = (
    "le la les un une des du de d et ou a à au aux en dans sur pour par avec sans que qui quoi dont est sont ce cette ces"
    " il elle on je tu nous vous ils se sa son ses mon ma mes comment pourquoi quand où combien quel quelle quels quelles"
    " faire fait faut peut puis dois doit y n l s j c qu si plus moins être avoir"
).split()
# Characters of a query term; what a heading looks like, and how one can't end.
TERM_PATTERN = "[0-9a-zà-öø-ÿ]{2,}"
HEADING_PATTERN = r"^(?:#{1,6}\s+\S.*|\d+(?:\.\d+)*[.)]?\s+[A-ZÀ-Þ].{2,80}|[A-ZÀ-Þ][A-ZÀ-Þ0-9 ,'’\-]{6,70}|[A-ZÀ-Þ][^.!?]{3,60})$"
NOT_HEADING_END = r"(?iuU)[,;:]$|\b(et|ou|de|du|des|le|la|les|un|une|à|au)$"
WORD_EDGES = ".,;:()[]«»\"'"


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters with one base letter and their letters, then the marks to drop; and those that unfold to several."""
    one, several, marks = [], {}, []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c:
            if len(base) == 1:
                one.append((c, base))
            else:
                several[c] = base
    return "".join(c for c, _ in one) + "".join(marks), "".join(b for _, b in one), several


def fold(text: Column) -> Column:
    """Lower case without accents: compatibility decomposition less its combining marks.

    Texts of ASCII stop after ``lower``. Hangul syllables and characters beyond the basic plane stay as they are.
    """
    low = F.lower(text)
    source, target, several = _fold_tables()
    plain = F.translate(low, source, target)
    table = F.from_json(F.lit(_json(several)), "map<string,string>")
    wide = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges([ord(c) for c in several])) + "]"
    unfolded = F.when(plain.rlike(wide), F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")).otherwise(plain)
    return F.when(low.rlike("[^\\x00-\\x7f]"), unfolded).otherwise(low)


def _ranges(codes: list[int], gap: int = 64) -> list[tuple[int, int]]:
    """A few ranges that hold all codes; what lies between near ones is taken in."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _json(x: dict) -> str:
    import json

    return json.dumps(x)


def clean(text: Column) -> Column:
    """Soft hyphens out, words cut at a line end joined, runs of blanks to one, at most one empty line, ends stripped."""
    out = F.replace(text, F.lit("­"), F.lit(""))
    out = F.regexp_replace(out, r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, "\\n{3,}", "\n\n")
    return strip(out)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flatten(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def quality(text: Column) -> Column:
    """Share of white-space tokens that are words of two Latin letters or more once edge marks are off; blank: 0."""
    edge = "[" + "".join("\\" + c for c in WORD_EDGES) + "]*"
    words = F.regexp_count(text, F.lit(f"(?U)(?<!\\S){edge}[A-Za-zÀ-ÖØ-öø-ÿ]{{2,}}{edge}(?!\\S)"))
    tokens = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.when(tokens > 0, F.round(words / tokens, 3)).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    n, spaces = F.length(text), F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.greatest(F.lit(1), (F.floor(n / 4) + F.floor(spaces / 8)).cast("int"))


def is_heading(paragraph: Column) -> Column:
    return ~F.contains(paragraph, F.lit("\n")) & (F.length(paragraph) < 90) & paragraph.rlike(HEADING_PATTERN) & ~strip(paragraph).rlike(NOT_HEADING_END)


def blocks(text: Column) -> Column:
    """array<struct<text, is_heading>>: paragraphs of a page in order, lines joined by a space."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    return F.transform(paragraphs, lambda p: F.when(is_heading(p), F.struct(strip(F.regexp_replace(p, "^[# ]+|[# ]+$", "")).alias("text"), F.lit(True).alias("is_heading"))).otherwise(
        F.struct(strip(F.replace(p, F.lit("\n"), F.lit(" "))).alias("text"), F.lit(False).alias("is_heading"))))


def sentences_packed(text: Column, target: int = 550) -> Column:
    """Sentences packed in order up to ``target`` estimated tokens; a longer sentence stays whole."""
    parts = F.split(text, r"(?<=[.!?;:])\s+")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("some"))

    def step(a: Column, s: Column) -> Column:
        t = token_estimate(s)
        over = a["some"] & (a["n"] + t > target)
        return F.struct(
            F.when(over, F.array_append(a["out"], a["cur"])).otherwise(a["out"]).alias("out"),
            F.when(over | ~a["some"], s).otherwise(F.concat(a["cur"], F.lit(" "), s)).alias("cur"),
            F.when(over, t).otherwise(a["n"] + t).alias("n"), F.lit(True).alias("some"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["some"], F.array_append(a["out"], a["cur"])).otherwise(a["out"]))


def terms(query: Column) -> Column:
    """Terms of a question in order, duplicates kept; without the stop words unless nothing else is left."""
    raw = F.regexp_extract_all(F.lower(query), F.lit(f"({TERM_PATTERN})"), 1)
    kept = F.filter(raw, lambda t: ~fold(t).isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def term_spec(term: Column) -> Column:
    """struct<kind, key>: exact below 5 characters, else a prefix of at most 6; keys are folded."""
    n = F.length(term)
    return F.struct(F.when(n < 5, "x").when(n == 5, "p5").otherwise("p6").alias("kind"), fold(F.substring(term, 1, 6)).alias("key"))


def index_keys(token: Column) -> Column:
    """The keys under which a folded token is found: whole, and its prefixes of 5 and 6 characters."""
    keys = F.array(F.struct(F.lit("x").alias("kind"), token.alias("key")), F.struct(F.lit("p5").alias("kind"), F.substring(token, 1, 5).alias("key")), F.struct(F.lit("p6").alias("kind"), F.substring(token, 1, 6).alias("key")))
    return F.slice(keys, F.lit(1), F.when(F.length(token) >= 6, 3).when(F.length(token) == 5, 2).otherwise(1))


def index_tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit("([\\p{L}\\p{N}\\p{Co}]+)"), 1)


def html_to_text(html: Column) -> Column:
    """Code blocks and tags out, six entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    # The entities that are decoded, in this order.
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def snippet(text: Column, chars: int = 150) -> Column:
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def page_list(pages: Column) -> Column:
    """Up to four pages listed, more as first–last."""
    shown = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.when(F.size(pages) <= 4, shown).otherwise(F.concat(F.element_at(pages, 1), F.lit("–"), F.element_at(pages, -1)))
