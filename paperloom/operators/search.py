"""Phrase search and text replacement inside pages. Row-local: one row in, its hits out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T


def words(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per word with its offsets: keep..., word_no, start, end, word."""
    hits = pages.select(*keep, F.posexplode(T.find_all("text", T.WORD)).alias("word_no", "_w"))
    return hits.select(*keep, "word_no", F.col("_w.start").alias("start"),
                       (F.col("_w.start") + F.length("_w.value")).alias("end"), F.col("_w.value").alias("word"))


def search(pages: DataFrame, phrase: str, *keep: str, match_case: bool = False, whole_words: bool = False) -> DataFrame:
    """Every occurrence of a phrase with offsets and some context.

    Pages without the phrase are filtered out before any offset is computed.
    """
    if not phrase.strip():
        raise ValueError("Search text cannot be empty.")
    pattern = T.literal_regex(phrase, fold=not match_case, whole=whole_words)
    candidates = pages.filter(F.col("text").rlike(pattern))
    hits = candidates.select(*keep, "text", F.posexplode(T.find_all("text", pattern)).alias("hit", "_m"))
    start, length = F.col("_m.start"), F.length("_m.value")
    left = F.greatest(start - fixed.SEARCH_MARGIN, F.lit(0))
    right = F.least(start + length + fixed.SEARCH_MARGIN, F.length("text"))
    return hits.select(
        *keep, "hit", start.alias("start"), (start + length).alias("end"), F.col("_m.value").alias("match"),
        T.squeeze(F.substr("text", left + 1, right - left)).alias("context"),
    )


def cap_book_hits(books: DataFrame, phrase: str, *keep: str, cap: int = fixed.SEARCH_CAP, **options) -> DataFrame:
    """The first `cap` hits of each document in page order, cut inside the document's row."""
    pattern = T.literal_regex(phrase, fold=not options.get("match_case", False), whole=options.get("whole_words", False))
    found = F.expr("flatten(transform(pages, p_ -> transform(" + T.find_all_sql("p_.text", pattern)
                   + ", m_ -> named_struct('page', p_.page, 'start', m_.start, 'match', m_.value))))")
    candidates = books.filter(F.exists("pages", lambda p: p["text"].rlike(pattern)))
    return candidates.select(*keep, F.posexplode(F.slice(found, 1, cap)).alias("hit", "_m")).select(
        *keep, "hit", "_m.page", "_m.start", "_m.match")


def find_phrase(pages: DataFrame, phrase: str, *keep: str) -> DataFrame:
    """Runs of words equal to the phrase, outer punctuation forgiven, case ignored.

    Inner words must match exactly; the last word may differ by trailing punctuation and
    the first by leading punctuation.
    """
    wanted = phrase.lower().split()
    if not wanted:
        raise ValueError("Search text cannot be empty.")
    edge = F.lit(fixed.EDGE_PUNCTUATION)

    def fits(word: Column, i: int) -> Column:
        exact = F.lower(word) == wanted[i]
        if i == len(wanted) - 1:
            exact = exact | (F.rtrim(F.lower(word), edge) == F.rtrim(F.lit(wanted[i]), edge))
        if i == 0:
            exact = exact | (F.ltrim(F.lower(word), edge) == F.ltrim(F.lit(wanted[i]), edge))
        return exact

    def windows(tokens: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - len(wanted)), lambda k: _all(
            [fits(F.get(tokens, k + i), i) for i in range(len(wanted))]))
        return F.transform(places, lambda k: F.struct(
            k.alias("word_no"), F.array_join(F.slice(tokens, k + 1, len(wanted)), " ").alias("match")))

    # Each wanted word, without its own outer punctuation, must occur somewhere on the page.
    candidates = pages
    for word in wanted:
        candidates = candidates.filter(F.contains(F.lower("text"), F.lit(word.strip(fixed.EDGE_PUNCTUATION))))
    hits = T.let(T.word_list(F.col("text")), lambda t: F.when(F.size(t) >= len(wanted), windows(t)))
    return candidates.select(*keep, F.explode(hits).alias("_m")).select(*keep, "_m.word_no", "_m.match")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def nth_occurrence(pages: DataFrame, phrase: str, n: int, *keep: str) -> DataFrame:
    """The n-th (0-based) occurrence of a phrase on each page."""
    return search(pages, phrase, *keep).filter(F.col("hit") == n)


def replace_text(pages: DataFrame, find: str = "find", replacement: str = "replacement", occurrence: str = "occurrence"):
    """Per-row replacement (columns find, replacement, occurrence or null for all), then a check.

    Returns (ok, rejected): rejected rows are those where the old text survives a full
    replacement or the new text cannot be read back.
    """
    old, new, nth = F.col(find), F.col(replacement), F.col(occurrence)
    pattern = T.quoted(old)
    rejoined = T.let(F.regexp_extract_all("text", pattern, F.lit(0)), lambda hits: F.array_join(F.transform(
        F.split(F.col("text"), pattern, -1),
        lambda piece, i: F.when(i == F.size(hits), piece).otherwise(F.concat(
            piece, F.when(nth.isNull() | (nth == i), new).otherwise(F.coalesce(F.get(hits, i), F.lit(""))))),
    ), ""))
    edited = pages.withColumn("text", F.when(old == "", F.col("text")).otherwise(rejoined))
    body, was, now = (F.lower(T.squeeze(c)) for c in (F.col("text"), old, new))
    left_over = nth.isNull() & ~((new != "") & F.contains(now, was)) & F.contains(body, was)
    unread = (new != "") & ~F.contains(body, now)
    judged = edited.withColumn("problem", F.when(left_over, "still present").when(unread, "replacement not found"))
    return judged.filter(F.col("problem").isNull()).drop("problem"), judged.filter(F.col("problem").isNotNull())


def line_rects(words: Column) -> Column:
    """Merge word boxes (x,y,width,height) into one rectangle per line, in reading order.

    A word joins the first line whose y is closer than 0.6 of the word's height.
    """
    empty = F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")

    def add(lines: Column, word: Column) -> Column:
        # The place of the first such line, from 1, is found once a word; 0 stands for none.
        near = F.array_position(F.transform(lines, lambda r: F.abs(r["y"] - word["y"]) < word["height"] * 0.6), True)

        def grow(r: Column) -> Column:
            x = F.least(r["x"], word["x"])
            right = F.greatest(r["x"] + r["width"], word["x"] + word["width"])
            return F.struct(x.alias("x"), r["y"].alias("y"), (right - x).alias("width"),
                            F.greatest(r["height"], word["height"]).alias("height"))
        return T.let(near, lambda at: F.when(at == 0, F.concat(lines, F.array(word))).otherwise(
            F.transform(lines, lambda r, i: F.when(i + 1 == at, grow(r)).otherwise(r))))

    return F.aggregate(words, empty, add)


def words_in_span(hits: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Words (word_start, word_end, word) that overlap a hit (start, end) on the same page.

    A hit meets its page, not the page's words: only the text from the word the hit begins in to the word it ends in
    is cut into words.
    """
    low = F.greatest(F.least("start", "end"), F.lit(0))
    high = F.greatest("start", "end", F.lit(0))
    head = F.substr("text", F.lit(1), low)
    near = hits.join(pages.select(*keys, "text"), keys).withColumn("_from", F.length(head) - F.length(F.regexp_extract(head, T.WORD + r"\z", 0)))
    rest = F.regexp_extract(F.substr("text", high + 1), r"\A" + T.WORD, 0)
    window = F.concat(F.substr("text", F.col("_from") + 1, high - F.col("_from")), rest)
    found = near.withColumn("text", window).withColumn("_w", F.explode(T.find_all("text", T.WORD)))
    first = F.col("_from") + F.col("_w.start")
    placed = found.withColumns({"word_start": first, "word_end": first + F.length("_w.value"), "word": F.col("_w.value")})
    return placed.drop("text", "_from", "_w").filter((F.col("word_start") < F.col("end")) & (F.col("word_end") > F.col("start")))
