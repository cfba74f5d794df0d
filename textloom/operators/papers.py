"""Papers from page JSON to paragraphs, by higher-order functions: one row per paper, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

KEPT_CLASSES = ["section-header", "text"]
PAGES_SCHEMA = "pages array<struct<boxes: array<struct<boxclass: string, textlines: array<struct<spans: array<struct<text: string>>>>>>>>"
_ITEM = "array<struct<text: string, kind: string>>"


def page_items(pages: Column) -> Column:
    """(text, kind) of the lines of kept boxes in reading order; lines without text are left out."""
    span_text = lambda s: F.trim(F.coalesce(s["text"], F.lit("")))
    empty = F.array().cast(_ITEM)

    def line(tl, kind):
        parts = F.filter(F.transform(F.coalesce(tl["spans"], F.array().cast("array<struct<text: string>>")), span_text), lambda x: x != "")
        return F.struct(t.normal_line(F.array_join(parts, " ")).alias("text"), kind.alias("kind"), F.size(parts).alias("n"))

    def box_lines(b):
        return F.coalesce(F.transform(b["textlines"], lambda tl: line(tl, b["boxclass"])), F.array().cast("array<struct<text: string, kind: string, n: int>>"))

    def page_lines(p):
        return F.flatten(F.transform(F.filter(F.coalesce(p["boxes"], F.array().cast("array<struct<boxclass: string, textlines: array<struct<spans: array<struct<text: string>>>>>>")), lambda b: b["boxclass"].isin(KEPT_CLASSES)), box_lines))

    lines = F.filter(F.flatten(F.transform(pages, page_lines)), lambda x: x["n"] > 0)
    return F.coalesce(F.transform(lines, lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"))), empty)


def cut_references(items: Column) -> Column:
    """All before the first header of a list of references."""
    at = F.array_position(F.transform(items, lambda x: t.is_references_header(x["text"])), True)
    return F.when(at > 0, F.slice(items, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(items)


_NEXT, _KIND = "\u0001", "\u0002"


def _once(items: Column, use) -> Column:
    """use(items) with the items made once, however often it names them."""
    return F.element_at(F.transform(F.array(items), use), 1)


def repair_hyphens(items: Column) -> Column:
    """Joins a text line that ends in a broken word to the text line behind it if that goes on in lower case.

    Each line looks at its neighbours only; lines are put together as one string and cut again, in time in proportion to them.
    """
    text_line = lambda x: F.coalesce(x["kind"] == "text", F.lit(False))
    goes_on = lambda x, y: text_line(x) & text_line(y) & x["text"].rlike(r"^.*\b[A-Za-z]+-\s*$") & y["text"].rlike("^[a-z]")

    def joined(xs):
        def line(x, i):
            plain = F.translate(x["text"], _NEXT + _KIND, "  ")
            head = F.when((i > 0) & goes_on(F.get(xs, i - 1), x), F.lit("")).otherwise(F.concat(F.lit(_NEXT), x["kind"], F.lit(_KIND)))
            return F.concat(head, F.when(F.coalesce(goes_on(x, F.get(xs, i + 1)), F.lit(False)), F.regexp_replace(plain, r"-\s*$", "")).otherwise(plain))

        whole = F.array_join(F.transform(xs, line), "")
        cut = F.filter(F.split(whole, _NEXT), lambda x: x != "")
        return F.transform(cut, lambda x: F.struct(F.substring_index(x, _KIND, -1).alias("text"), F.substring_index(x, _KIND, 1).alias("kind")))

    return _once(items, joined)


def paragraphs(items: Column) -> Column:
    """Consecutive text lines as one paragraph; headers stand alone and blank lines end a paragraph. One string is made and cut, as above."""

    def joined(xs):
        def line(x, i):
            own, before = F.trim(F.translate(x["text"], _NEXT, " ")), F.get(xs, i - 1)
            more = (i > 0) & (x["kind"] == "text") & (before["kind"] == "text") & (F.trim(before["text"]) != "")
            return F.when(own == "", "").when(F.coalesce(more, F.lit(False)), F.concat(F.lit(" "), own)).otherwise(F.concat(F.lit(_NEXT), own))

        return F.filter(F.split(F.array_join(F.transform(xs, line), ""), _NEXT), lambda x: x != "")

    return _once(items, joined)


def paper_text(pages: Column) -> Column:
    """The text of a paper: paragraphs joined by blank lines, without references."""
    return F.array_join(paragraphs(repair_hyphens(cut_references(page_items(pages)))), "\n\n")


def lines_as_pages(text: Column) -> Column:
    """A plain text as one page with one text box, for texts that come without layout."""
    spans = F.transform(F.split(text, "\n"), lambda x: F.struct(F.array(F.struct(x.alias("text"))).alias("spans")))
    return F.array(F.struct(F.array(F.struct(F.lit("text").alias("boxclass"), spans.alias("textlines"))).alias("boxes")))


def sentence_chunks(df: DataFrame, text_col: str, id_cols: list[str], chunk_size: int = 20, min_words: int = 100) -> DataFrame:
    """id columns, chunk (place), chunk_text, chunk_words of the chunks with enough words."""
    cut = t.chunks(t.sentences(t.normal_paper(F.col(text_col))), chunk_size)
    rows = df.select(*id_cols, F.posexplode(F.transform(cut, lambda c: F.array_join(c, " "))).alias("chunk", "chunk_text"))
    return rows.withColumn("chunk_words", t.word_count(F.col("chunk_text"))).where(F.col("chunk_words") >= min_words)
