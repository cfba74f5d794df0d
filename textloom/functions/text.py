"""Text functions as column expressions; Python only for HTML references and Unicode normal forms."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the cleaning rules.
PLACEHOLDERS = ["no abstract available", "n/a", "na", "none", "not provided", "abstract unavailable", "no abstract", "null"]
BOILERPLATE_PATTERNS = [r"copyright\s*©?", r"all rights reserved", r"published by", r"publisher['’]s note", r"springer nature remains neutral", r"elsevier"]
REFERENCE_PATTERNS = [r"^\s*\[\d+\]", r"\bdoi\s*:", r"\breferences\b", r"\bbibliography\b"]
COMMON_VERBS = (
    "is are was were be been being has have had do does did show shows shown study studies studied present presents presented "
    "propose proposes proposed find finds found demonstrate demonstrates demonstrated analyze analyzes analysed analyzed "
    "investigate investigates use uses used provide provides provided"
).split()
VERB_ENDINGS = ["ed", "ing", "izes", "ises"]
MOJIBAKE = [("ï»¿", " "), ("Ã©", "é"), ("Ã¨", "è"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("Ã¤", "ä"), ("â€“", "-"), ("â€”", "-"), ("â€˜", "'"), ("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"')]

#: White space as str.split() sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Runs of it but for a single space, which needs no replacing.
_UNEVEN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*+| [\s\x1c-\x1f]++"
#: A word boundary with letters and numbers of all scripts, and no marks, as word characters.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
#: The word begins with a letter, so the edge before it is the end of what is no word character.
WORD = rf"(?<![\p{{L}}\p{{N}}_])[a-zA-Z][a-zA-Z'-]*{EDGE}"
PLAIN_SIGNS = r""".,;:!?\-'"()"""


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def unescape_html(c: Column) -> Column:
    """html.unescape; only texts with an & travel to Python."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _UNEVEN, " "))


def clean_text(c: Column, unescape: bool = True) -> Column:
    """Decoded, without tags, LaTeX commands, long formulas and line breaks; null becomes the empty text."""
    x = F.coalesce(c.cast("string"), F.lit(""))
    x = unescape_html(x) if unescape else x
    broken = x
    for old, new in MOJIBAKE:
        broken = F.replace(broken, F.lit(old), F.lit(new))
    x = F.when(x.contains("Ã") | x.contains("â€") | x.contains("ï»¿"), broken).otherwise(x)
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"\\[a-zA-Z]+(\[[^\]]*\])?(\{[^{}]*\})?", " ")
    x = F.translate(x, "\u2028\u2029\n\r\t", "     ")
    x = F.regexp_replace(x, r"\$[^$]{10,}\$", " ")
    # the command rule above has removed \begin and \end already: bodies of environments stay, as the reference data have them
    x = F.regexp_replace(x, r"(?s)\\begin\{[^}]+\}.*?\\end\{[^}]+\}", " ")
    return squeeze(x)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def _count(c: Column, dropped: str) -> Column:
    """Characters outside a class; the class goes by runs, which is one replacement for each and not for each character."""
    return F.length(F.regexp_replace(c, dropped + "++", ""))


def text_stats(c: Column, own: Column | None = None) -> dict[str, Column]:
    """Eight statistics of a text; own: its words, if a column has them already."""
    n, own = F.length(c), words(c) if own is None else own
    share = lambda x, of: F.coalesce(F.try_divide(x.cast("double"), F.nullif(of, F.lit(0)).cast("double")), F.lit(0.0))
    return {
        "clean_length": n,
        "word_count": F.size(own),
        "alpha_chars": _count(c, r"\P{L}"),
        "alpha_ratio": share(_count(c, r"\P{L}"), n),
        "punct_ratio": share(_count(c, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]"), n),
        "lexical_diversity": share(F.size(F.array_distinct(own)), F.size(own)),
        "period_count": n - F.length(F.replace(c, F.lit("."))),
        "symbol_ratio": share(_count(c, rf"(?U)[\p{{L}}\p{{N}}\s\x1c-\x1f{PLAIN_SIGNS}]"), n),
    }


def has_verb_like_word(c: Column, own: Column | None = None) -> Column:
    own = words(c) if own is None else own
    ends = rf"({'|'.join(VERB_ENDINGS)})$"
    return F.arrays_overlap(own, F.array(*map(F.lit, COMMON_VERBS))) | F.exists(own, lambda w: (F.length(w) > 5) & w.rlike(ends))


def matches_any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def single_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z](?![\p{L}\p{N}_])"))


def duplicate_form(c: Column) -> Column:
    """Lower case, a-z 0-9 only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]++", " "))


def normal_line(c: Column) -> Column:
    """A line of a paper: no soft hyphens, single spaces, words split by a hyphen and a space joined."""
    return F.regexp_replace(squeeze(F.replace(c, F.lit("\u00ad"))), r"(?<=[A-Za-z])-\s+(?=[A-Za-z])", "")


def is_references_header(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^\s*(?:(?:\d+(?:\.\d+)*)?\s*(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list))\s*$")


def normal_paper(c: Column) -> Column:
    """A whole paper: line ends unified, words broken at line ends joined, single spaces."""
    x = F.regexp_replace(c, r"\r\n?", "\n")
    return squeeze(F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2"))


def sentences(c: Column) -> Column:
    """Cut after . ! or ? and white space; no blank sentences."""
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def word_count(c: Column) -> Column:
    """As many as str.split() gives."""
    x = squeeze(c)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x found once: an expression that stands in a lambda is found anew for each of its items."""
    return F.element_at(F.transform(F.array(x), use), 1)


def chunks(items: Column, size: int) -> Column:
    """Consecutive slices of an array."""

    def cut(xs: Column) -> Column:
        n = F.ceil(F.size(xs) / F.lit(size)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(xs, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return once(items, cut)


def even_subset(items: Column, limit: int) -> Column:
    """`limit` items at even steps; all if there are no more."""

    def some(xs: Column) -> Column:
        step = F.size(xs) / F.lit(float(limit))
        few = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(xs, F.floor(i * step).cast("int")))
        return F.when(xs.isNull() | (F.size(xs) <= limit), xs).otherwise(few)

    return once(items, some)


def windows(items: Column, size: int, least: int = 2) -> Column:
    """Consecutive slices of at least `least` items."""

    def cut(xs: Column) -> Column:
        n = F.size(xs)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(xs, i + 1, F.lit(size))))

    return F.filter(once(items, cut), lambda w: F.size(w) >= least)


def truncate(c: Column, limit: int, marker: str = "\n\n[TRUNCATED]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def squeeze_ends(c: Column) -> Column:
    """Without white space at the ends, as str.strip() does it."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
