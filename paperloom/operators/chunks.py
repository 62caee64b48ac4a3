"""Greedy chunks of a document. The fold runs inside the document's row and keeps only
chunk boundaries, so its cost grows with the number of pages or sentences, not with text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T


def _chunk_starts(sizes: Column, budget: int) -> Column:
    """Positions where a new chunk begins: an item opens one when it no longer fits."""
    kind = "struct<starts:array<int>,size:bigint,at:int>"
    zero = F.struct(F.array().alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("at")).cast(kind)

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["at"] == 0) | (acc["size"] + n > budget)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, n).otherwise(acc["size"] + n).alias("size"), (acc["at"] + 1).alias("at")).cast(kind)

    return F.aggregate(sizes, zero, step, lambda acc: acc["starts"])


def _cut(items: Column, starts: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(starts, lambda s, i: T.let(
        F.slice(items, s + 1, F.coalesce(F.get(starts, i + 1), F.size(items)) - s), make))


def split_sentences(text: Column) -> Column:
    """The sentences of a text in order, white space squeezed: it ends one after a full stop, an exclamation or a question mark."""
    return F.filter(F.split(T.squeeze(text), r"(?<=[.!?])\s+", -1), lambda s: F.trim(s) != "")


def sentence_rows(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep..., sentence_no, sentence; a text without sentences has no rows."""
    return docs.select(*keep, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "sentence"))


def chunk_pages(books: DataFrame, *keep: str, budget: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Pages grouped under a character budget: keep..., idx, text, first_page, last_page.

    Blank pages are skipped; a page over the budget still makes a chunk of its own.
    """
    shown = F.filter(F.transform("pages", lambda p: F.struct(p["page"].alias("page"), T.strip(p["text"]).alias("text"))),
                     lambda p: p["text"] != "")

    def pack(items: Column) -> Column:
        return T.let(_chunk_starts(F.transform(items, lambda p: F.length(p["text"]).cast("long")), budget), lambda starts: _cut(
            items, starts, lambda part: F.struct(
                F.array_join(F.transform(part, lambda p: p["text"]), "\n\n").alias("text"),
                F.get(part, F.lit(0))["page"].alias("first_page"), F.element_at(part, -1)["page"].alias("last_page"))))

    return books.select(*keep, F.posexplode(T.let(shown, pack)).alias("idx", "_c")).select(
        *keep, "idx", "_c.text", "_c.first_page", "_c.last_page")


def quarter_tokens(text: Column) -> Column:
    """Default token count: four characters to a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def page_sentences(pages: Column) -> Column:
    """Sentences of cleaned pages, split at '. ', final stops removed: array<struct<page,text>>."""
    def of_page(p: Column) -> Column:
        bare = F.transform(F.split(p["text"], r"\. ", -1), lambda s: T.strip(F.regexp_replace(T.strip(s), r"\.\z", "")))
        return F.transform(F.filter(bare, lambda s: s != ""), lambda s: F.struct(p["page"].alias("page"), s.alias("text")))
    return F.flatten(F.transform(pages, of_page))


def chunk_sentences(books: DataFrame, *keep: str, max_tokens: int = fixed.CHUNK_TOKENS,
                    token_count: Callable[[Column], Column] = quarter_tokens) -> DataFrame:
    """Sentences grouped under a token budget (one extra token each for the separator)."""
    def pack(items: Column) -> Column:
        sizes = F.transform(items, lambda s: token_count(s["text"]) + 1)
        return T.let(_chunk_starts(sizes, max_tokens), lambda starts: _cut(items, starts, lambda part: F.struct(
            F.concat(F.array_join(F.transform(part, lambda s: s["text"]), ". "), F.lit(".")).alias("text"),
            F.get(part, F.lit(0))["page"].alias("first_page"), F.element_at(part, -1)["page"].alias("last_page"))))

    return books.select(*keep, F.posexplode(T.let(page_sentences(F.col("pages")), pack)).alias("idx", "_c")).select(
        *keep, "idx", "_c.text", "_c.first_page", "_c.last_page")


def chunk_text(docs: DataFrame, *keep: str, text: str = "text", max_tokens: int = fixed.CHUNK_TOKENS) -> DataFrame:
    """The plain variant: sentences re-joined with '. ', the chunk measured as a whole."""
    kind = "struct<starts:array<int>,chars:bigint,at:int>"

    def pack(items: Column) -> Column:
        zero = F.struct(F.array().alias("starts"), F.lit(0).alias("chars"), F.lit(0).alias("at")).cast(kind)

        def step(acc: Column, s: Column) -> Column:
            n = F.length(s) + 2
            opens = (acc["at"] == 0) | (F.ceil((acc["chars"] + n) / 4) > max_tokens)
            return F.struct(
                F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
                F.when(opens, n).otherwise(acc["chars"] + n).alias("chars"), (acc["at"] + 1).alias("at")).cast(kind)

        starts = F.aggregate(items, zero, step, lambda acc: acc["starts"])
        return T.let(starts, lambda at: _cut(items, at, lambda part: T.strip(F.concat(F.array_join(part, ". "), F.lit(". ")))))

    chunks = F.filter(T.let(F.split(F.col(text), r"\. ", -1), pack), lambda c: c != "")
    return docs.select(*keep, F.posexplode(chunks).alias("idx", "chunk"))
