"""Lexical retrieval over pages, context building, and checks on what a model answers.

Page tables here are flat (doc, page, text), and one document may hold a third of all
pages: term counts are aggregated before every shuffle, per-term weights are joined back
through `scale.attach`, and only the top pages are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed, scale
from paperloom.functions import text as T
from paperloom.session import settle


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin([s for s in fixed.RETRIEVAL_STOP_WORDS if len(s) > 2]))


def page_terms(pages: DataFrame, doc: str) -> DataFrame:
    """How often each term stands on each page, counted inside the page's row."""
    counted = pages.select(doc, "page", F.explode(T.ranked_terms(terms(F.col("text")))).alias("_t"))
    return counted.select(doc, "page", F.col("_t.term").alias("term"), (-F.col("_t.rank_key")).alias("n"))


def term_stats(pages: DataFrame, doc: str) -> DataFrame:
    """Occurrences and number of pages per term of a document."""
    return page_terms(pages, doc).groupBy(doc, "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pages"))


def rank_pages(pages: DataFrame, questions: DataFrame, doc: str, limit: int = fixed.PAGE_LIMIT) -> DataFrame:
    """questions(doc, q_id, question): the best pages for each question about a document.

    Score: sum over distinct question terms of (1 + ln count) * ln(1 + N / (1 + df)). Where
    nothing matches, the opening pages stand in. Returns doc, q_id, page, rank, score.

    A term's weight is joined to the pages that hold it, and df is exactly the number of
    those pages, so heavy terms of a huge document are known beforehand and sliced.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    wanted = questions.select(doc, "q_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    # The terms asked go to the pages as a table of bits; no text leaves its page, only counts of terms that may be asked.
    words = pages.select(doc, "page", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("term"))
    counts = scale.sieve(words, wanted, [doc, "term"]).groupBy(doc, "page", "term").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("df"))
    totals = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("total"))
    weights = wanted.join(spread, [doc, "term"]).join(totals, doc).select(
        doc, "q_id", "term", "df", F.ln(1 + F.col("total") / (1 + F.col("df"))).alias("idf"))
    weighed = scale.attach(counts, weights, [doc, "term"], "df", F.col("page"), how="inner")
    scored = weighed.groupBy(doc, "q_id", "page").agg(F.round(F.sum((1 + F.ln("n")) * F.col("idf")), 9).alias("score"))
    # Spark keeps only each task's best `limit` rows before this window's shuffle.
    best = scored.withColumn("rank", F.row_number().over(
        Window.partitionBy(doc, "q_id").orderBy(F.col("score").desc(), "page"))).filter(F.col("rank") <= limit)
    # Pages are numbered 1..n, so the opening pages need no ordering.
    matched = weights.select(doc, "q_id").distinct()
    unmatched = questions.select(doc, "q_id").join(matched, [doc, "q_id"], "left_anti")
    opening = pages.filter(F.col("page") <= limit).select(doc, "page").join(unmatched, doc).select(
        doc, "q_id", "page", F.lit(0.0).alias("score"), F.col("page").cast("int").alias("rank"))
    return best.select(doc, "q_id", "page", "score", "rank").unionByName(opening)


def _fold_context(blocks: Column, budget: int, cut_last: bool) -> Column:
    """Blocks (array<struct<page,block>>) under a character budget, as struct<blocks,pages,used>."""
    kind = "struct<blocks:array<string>,pages:array<int>,used:int,done:boolean>"
    start = F.struct(F.array().alias("blocks"), F.array().alias("pages"), F.lit(0).alias("used"), F.lit(False).alias("done")).cast(kind)

    def add(acc: Column, b: Column) -> Column:
        size = F.length(b["block"])
        over = acc["used"] + size > budget
        if cut_last:
            body = F.when(over, F.substr(b["block"], F.lit(1), F.lit(budget) - acc["used"])).otherwise(b["block"])
            stop = over & (F.length(body) < fixed.CONTEXT_MIN_BLOCK)
        else:
            body, stop = b["block"], over
        grown = F.struct(
            F.concat(acc["blocks"], F.array(body)).alias("blocks"), F.concat(acc["pages"], F.array(b["page"])).alias("pages"),
            (acc["used"] + F.length(body)).alias("used"), (acc["used"] + F.length(body) >= budget).alias("done")).cast(kind)
        stopped = F.struct(acc["blocks"].alias("blocks"), acc["pages"].alias("pages"), acc["used"].alias("used"), F.lit(True).alias("done")).cast(kind)
        return F.when(acc["done"], acc).when(stop, stopped).otherwise(grown)

    return F.aggregate(blocks, start, add)


def labelled(pages: Column) -> Column:
    """Non-blank pages (array<struct<page,text>>) as labelled blocks."""
    shown = F.transform(pages, lambda p: F.struct(p["page"].cast("int").alias("page"), T.strip(p["text"]).alias("text")))
    return F.transform(F.filter(shown, lambda p: p["text"] != ""), lambda p: F.struct(
        p["page"].alias("page"), F.concat(F.lit("[p."), p["page"].cast("string"), F.lit("]\n"), p["text"]).alias("block")))


def context(pages: Column, budget: int = fixed.CONTEXT_CHARS, strict: bool = False) -> Column:
    """Labelled text of the pages in order: struct<text,pages,used>.

    The last block is cut to fit and dropped under 200 characters; in strict mode a block
    that does not fit ends the context.
    """
    return T.let(_fold_context(labelled(pages), budget, not strict), lambda c: F.struct(
        F.array_join(c["blocks"], "\n\n").alias("text"), c["pages"].alias("pages"), c["used"].alias("used")))


def ranked_context(pages: DataFrame, ranked: DataFrame, doc: str, budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """Context per question from its ranked pages; at most `limit` pages meet in one group.

    The ranking is written once, and only texts of pages that may be in it move.
    """
    ranked = settle(ranked)
    texts = ranked.join(scale.sieve(pages.select(doc, "page", "text"), ranked, [doc, "page"]), [doc, "page"])
    gathered = texts.groupBy(doc, "q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page", "text"))).alias("_p"))
    pairs = F.transform("_p", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text")))
    return gathered.select(
        doc, "q_id", context(pairs, budget)["text"].alias("context"), F.sort_array(F.transform("_p", lambda p: p["page"])).alias("allowed"))


# ------------------------------------------------------------------ checks on answers

def cited_pages(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(fixed.CITATION_PATTERN), F.lit(1)), lambda n: n.cast("int"))


def fabricated(cited: Column, allowed: Column) -> Column:
    return F.sort_array(F.array_except(cited, allowed))


def scrub_citations(answers: DataFrame, answer: str = "answer", allowed: str = "allowed") -> DataFrame:
    """Drop citations of pages that were not shown; add kept, dropped and the cleaned answer."""
    cited = F.array_distinct(cited_pages(F.col(answer)))
    judged = answers.withColumn("kept", F.sort_array(F.array_intersect(cited, F.col(allowed)))).withColumn(
        "dropped", fabricated(cited, F.col(allowed)))
    stripped = F.aggregate("dropped", F.col(answer), lambda text, page: F.regexp_replace(
        text, F.concat(F.lit(r"(?i)\[p\.\s*0*"), page.cast("string"), F.lit(r"\]")), F.lit("")))
    return judged.withColumn(answer, F.when(F.size("dropped") > 0, T.strip(
        F.regexp_replace(stripped, r"(?U)\s{2,}", " "))).otherwise(F.col(answer)))


def citation_note(dropped: Column, kept: Column) -> Column:
    return F.when(F.size(dropped) > 0, F.concat(
        F.lit("The model cited page(s) "), F.array_join(dropped.cast("array<string>"), ", "),
        F.lit(", which were not part of the retrieved content. Those citations were removed because they could not be verified."),
    )).when(F.size(kept) == 0, "The answer carries no page citations, so treat it with caution.")


def verify_citations(answers: DataFrame, pages: DataFrame, doc: str, kept: str = "kept") -> DataFrame:
    """One row per verified citation with an excerpt of its page."""
    cited = answers.select(doc, F.explode(kept).alias("page"))
    return cited.join(pages.select(doc, "page", "text"), [doc, "page"]).select(
        doc, "page", F.substring(T.squeeze(F.col("text")), 1, fixed.CITATION_EXCERPT).alias("excerpt"))


def quote_candidate(line: Column) -> Column:
    bare = F.btrim(T.strip(line), F.lit('"“”'))
    return T.strip(F.ltrim(bare, F.lit("-•")))


def verify_quotes(candidates: DataFrame, books: DataFrame, key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """candidates(key, lines array): quotes found word for word, with the first page that holds them.

    Lines and pages meet in one row per document (both keys are unique), so nothing is exploded
    before the check. A line is looked for as it stands, so marks that belong to the text stay; one found nowhere
    is looked for again without marks around it. Short lines and lines found nowhere are dropped; the first `limit` stay if it is given.
    """
    flat = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), F.lower(T.squeeze(p["text"])).alias("text")))
    joined = candidates.join(books.select(key, "pages"), key).withColumn("_flat", flat)

    def place(quote: Column) -> Column:
        return F.struct(quote.alias("quote"), F.when(F.length(quote) >= fixed.QUOTE_MIN_CHARS, T.let(F.lower(T.squeeze(quote)), lambda wanted: F.get(
            F.filter("_flat", lambda p: F.contains(p["text"], wanted)), F.lit(0))["page"])).alias("page"))

    placed = F.transform("lines", lambda line: T.let(place(T.strip(line)), lambda q: F.when(q["page"].isNotNull(), q).otherwise(place(quote_candidate(line)))))
    found = F.filter(placed, lambda q: q["page"].isNotNull())
    found = F.slice(found, 1, limit) if limit else found
    return joined.select(key, F.posexplode(found).alias("position", "_q")).select(key, "position", "_q.quote", "_q.page")
