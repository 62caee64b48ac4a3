"""Statistics of text, one row per document and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T


def full_text(pages: Column) -> Column:
    """The pages' text joined the way the statistics see it."""
    return T.strip(F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n"))


def keyword_tokens(text: Column, min_length: int = 4) -> Column:
    bare = F.regexp_replace(text, fixed.LINK_PATTERN, " ")
    bare = T.let(bare, lambda b: F.when(
        F.contains(b, F.lit("@")), F.regexp_replace(b, fixed.ADDRESS_PATTERN, " ")).otherwise(b))
    # Words shorter than the minimum never count, so they are skipped by length afterwards.
    found = F.regexp_extract_all(F.lower(bare), F.lit(r"(?U)\b[a-z]+(?:'[a-z]+)?\b"), F.lit(0))
    stop = [w for w in fixed.KEYWORD_STOP_WORDS if len(w) >= min_length]
    return F.filter(found, lambda w: (F.length(w) >= min_length) & ~w.isin(stop))


def keywords(text: Column, k: int = 20, min_length: int = 4) -> Column:
    """Top-k words: array<struct<rank_key,first_at,term>>; rank_key is minus the count."""
    return F.slice(T.ranked_terms(keyword_tokens(text, min_length)), 1, k)


def lexicon_hits(text: Column, lexicon: list[str]) -> Column:
    """How many distinct lexicon words the text holds."""
    pattern = r"(?U)\b(?:" + "|".join(lexicon) + r")\b"
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))))


def sentiment(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lexicon sentiment: distinct positive and negative words, score and label."""
    counted = docs.withColumn("positive_words", lexicon_hits(F.col(text), fixed.POSITIVE_WORDS)).withColumn(
        "negative_words", lexicon_hits(F.col(text), fixed.NEGATIVE_WORDS))
    total = F.col("positive_words") + F.col("negative_words")
    score = F.when(total == 0, F.lit(0.0)).otherwise((F.col("positive_words") - F.col("negative_words")) / total)
    return (
        counted.withColumn("_score", score)
        .withColumn("sentiment", F.when(F.col("_score") > 0.1, "positive").when(F.col("_score") < -0.1, "negative").otherwise("neutral"))
        .withColumn("score", T.py_round(F.col("_score"), 2)).drop("_score")
    )


def readability(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words per sentence, mean word length, complexity clamped to 0..18 and its level."""
    body = F.col(text)
    counted = (
        docs.withColumn("_words", T.word_count(body))
        .withColumn("_sentences", F.regexp_count(body, F.lit(rf"(?U)[^.!?{T.SPACE}][^.!?]*")))
        .withColumn("_letters", F.length(F.regexp_replace(body, rf"(?U)[{T.SPACE}]+", "")))
        .withColumn("_long", F.length(body) - F.length(F.regexp_replace(body, rf"(?U)[^{T.SPACE}]{{7,}}", "")))
    )
    known = (F.col("_words") > 0) & (F.col("_sentences") > 0)
    per_sentence = F.col("_words") / F.col("_sentences")
    raw = F.lit(0.39) * per_sentence + F.lit(11.8) * (F.col("_long") / F.col("_words")) - F.lit(15.59)
    level = (
        F.when(F.col("_c") < 6, "Very Easy").when(F.col("_c") < 9, "Easy")
        .when(F.col("_c") < 12, "Medium").when(F.col("_c") < 14, "Hard").otherwise("Very Hard")
    )
    return (
        counted.withColumn("_c", F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(18.0), raw))))
        .withColumn("avg_words_per_sentence", F.when(known, T.py_round(per_sentence, 2)).otherwise(0.0))
        .withColumn("avg_word_length", F.when(known, T.py_round(F.col("_letters") / F.col("_words"), 2)).otherwise(0.0))
        .withColumn("complexity_score", F.when(known, T.py_round(F.col("_c"), 2)).otherwise(0.0))
        .withColumn("reading_level", F.when(known, level).otherwise("Unknown"))
        .drop("_words", "_sentences", "_letters", "_long", "_c")
    )


def doc_stats(books: DataFrame) -> DataFrame:
    """Words, characters and pages per document."""
    return (
        books.withColumn("full_text", full_text(F.col("pages")))
        .withColumn("word_count", T.word_count(F.col("full_text")))
        .withColumn("character_count", F.length("full_text"))
        .withColumn("page_count", F.size("pages"))
    )


def insights(books: DataFrame, k: int = 20) -> DataFrame:
    """Everything at once for each document: one scan, no shuffle. One without text comes back with `note` and zeros."""
    counted = doc_stats(books).withColumn("note", F.when(F.col("character_count") == 0, "The document holds no text."))
    scored = readability(sentiment(counted, "full_text"), "full_text")
    top = F.transform(keywords(F.col("full_text"), k), lambda t: t["term"])
    return scored.withColumn("keywords", top).drop("full_text", "pages")


def glossary_terms(pages: Column, minimum: int = 3, limit: int | None = None) -> Column:
    """Recurring capitalised phrases of a book: array<struct<rank_key,term>>, most frequent first."""
    found = F.flatten(F.transform(pages, lambda p: F.regexp_extract_all(p["text"], F.lit(fixed.TERM_PATTERN), F.lit(0))))
    kept = F.filter(found, lambda t: (F.length(t) >= 4) & ~t.isin(fixed.STOP_TERMS))
    often = F.filter(T.ranked_terms(kept), lambda t: t["rank_key"] <= -minimum)
    by_name = F.sort_array(F.transform(often, lambda t: F.struct(t["rank_key"].alias("rank_key"), t["term"].alias("term"))))
    return F.slice(by_name, 1, limit) if limit else by_name


def run_metrics(runs: DataFrame) -> DataFrame:
    """Compression and throughput of a summary run; 0 where undefined.

    Input columns: original, summary (text), seconds, chunks.
    """
    original, summary = F.length("original"), F.length("summary")
    return (
        runs.withColumn("original_characters", original).withColumn("summary_characters", summary)
        .withColumn("compression_ratio", F.when(summary > 0, T.py_round(original / summary, 2)).otherwise(0.0))
        .withColumn("original_words", T.word_count(F.col("original")))
        .withColumn("summary_words", T.word_count(F.col("summary")))
        .withColumn("processing_time_seconds", T.py_round(F.col("seconds"), 2))
        .withColumn("avg_time_per_chunk", F.when(
            F.col("chunks") > 0, T.py_round(F.col("seconds") / F.col("chunks"), 3)).otherwise(0.0))
    )


def ocr_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence per page, then the mean of page means; a zero page mean is reported as null."""
    usable = F.when(F.col("conf") >= 0, F.col("conf"))
    pages = words.groupBy(*keys, "page").agg(F.avg(usable).alias("_mean"))
    return pages.groupBy(*keys).agg(
        T.py_round(F.avg("_mean"), 1).alias("mean_confidence"),
        F.count(F.lit(1)).alias("page_count"),
        F.count(F.when(F.col("_mean") != 0, F.col("_mean"))).alias("pages_reported"),
    )


def clean_ocr_words(words: DataFrame) -> DataFrame:
    """Keep recognised words only: some text and a confidence of zero or more."""
    score = F.col("conf").cast("string").try_cast("double")
    return words.withColumn("text", T.strip(F.col("text"))).filter((F.col("text") != "") & (score >= 0))
