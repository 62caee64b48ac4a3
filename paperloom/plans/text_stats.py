"""Statistics, keywords, sentiment, readability and page profile over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T
from paperloom.operators import pages as P
from paperloom.operators import stats as S
from paperloom.plans.registry import query
from paperloom.plans.sqlparts import DOC_PAGES, FULL_TEXT, py_round, quoted
from paperloom.sources.tables import load, spread


def documents(spark, folder):
    return spread(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def books(spark, folder):
    return P.to_books(documents(spark, folder))


WORDS = "[\\p{L}\\p{N}\\p{M}_]+"

KEYWORD_SQL = FULL_TEXT + f""",
bare AS (
  SELECT doc_id, lower(regexp_replace(regexp_replace(body, '(?i)(?:https?://|www\\.|mailto:)\\S+', ' ', 'g'),
    '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.[\\p{{L}}\\p{{N}}_.-]+\\b', ' ', 'g')) AS body FROM full_text
),
tokens AS (
  SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(body, '{WORDS}') AS w FROM bare)
),
counted AS (
  SELECT doc_id, word, count(*) AS n, min(pos) AS first_at FROM tokens
  WHERE regexp_full_match(word, '[a-z]+') AND length(word) >= 4 AND word NOT IN ({quoted(fixed.KEYWORD_STOP_WORDS)})
  GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS rank FROM counted)"""

SENTIMENT_SQL = f"""
lex AS (
  SELECT doc_id,
    len(list_distinct(list_filter(w, lambda x: x IN ({quoted(fixed.POSITIVE_WORDS)})))) AS p,
    len(list_distinct(list_filter(w, lambda x: x IN ({quoted(fixed.NEGATIVE_WORDS)})))) AS n
  FROM (SELECT doc_id, regexp_extract_all(lower(body), '{WORDS}') AS w FROM full_text)
),
scored AS (SELECT doc_id, p, n, CASE WHEN p + n = 0 THEN 0.0 ELSE CAST(p - n AS DOUBLE) / (p + n) END AS s FROM lex)"""

SENTIMENT_COLUMNS = f"""p AS positive_words, n AS negative_words,
  CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN s < 0 THEN -1 ELSE 1 END * {py_round('abs(s)', 2)} AS score"""

READ_SQL = """
counts AS (
  SELECT doc_id, body, n_pages, len(w) AS words, list_sum(list_transform(w, lambda x: length(x))) AS letters,
    coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) > 6), lambda x: length(x))), 0) AS long_letters,
    len(list_filter(string_split_regex(body, '[.!?]+'), lambda x: trim(x, E' \\t\\n\\r') <> '')) AS sentences
  FROM (SELECT *, list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '') AS w FROM full_text)
),
complex AS (
  SELECT *, CASE WHEN words > 0 AND sentences > 0 THEN greatest(0.0::DOUBLE, least(18.0::DOUBLE,
    0.39::DOUBLE * (words::DOUBLE / sentences) + 11.8::DOUBLE * (long_letters::DOUBLE / words) - 15.59::DOUBLE)) END AS c
  FROM counts
)"""

READ_COLUMNS = f"""
  CASE WHEN c IS NULL THEN 0.0 ELSE {py_round('words::DOUBLE / sentences', 2)} END AS avg_words_per_sentence,
  CASE WHEN c IS NULL THEN 0.0 ELSE {py_round('letters::DOUBLE / words', 2)} END AS avg_word_length,
  CASE WHEN c IS NULL THEN 0.0 ELSE {py_round('c', 2)} END AS complexity_score,
  CASE WHEN c IS NULL THEN 'Unknown' WHEN c < 6 THEN 'Very Easy' WHEN c < 9 THEN 'Easy'
       WHEN c < 12 THEN 'Medium' WHEN c < 14 THEN 'Hard' ELSE 'Very Hard' END AS reading_level"""


@query("WITH " + FULL_TEXT + """
SELECT doc_id, len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '')) AS word_count,
  length(body) AS character_count, n_pages AS page_count FROM full_text""")
def doc_statistics(spark, folder):
    return S.doc_stats(books(spark, folder)).select("doc_id", "word_count", "character_count", "page_count")


@query("WITH " + KEYWORD_SQL + " SELECT doc_id, word, n, rank FROM ranked WHERE rank <= 20")
def doc_keywords(spark, folder):
    top = S.doc_stats(books(spark, folder)).select("doc_id", F.posexplode(S.keywords(F.col("full_text"))).alias("i", "t"))
    return top.select("doc_id", F.col("t.term").alias("word"), (-F.col("t.rank_key")).alias("n"), (F.col("i") + 1).alias("rank"))


@query("WITH " + FULL_TEXT + "," + SENTIMENT_SQL + f" SELECT doc_id, {SENTIMENT_COLUMNS} FROM scored")
def doc_sentiment(spark, folder):
    return S.sentiment(S.doc_stats(books(spark, folder)), "full_text").select(
        "doc_id", "positive_words", "negative_words", "sentiment", "score")


# Invented prose holds few lexicon words, so each document gets two, chosen by its id.
PLANTED_WORDS = "list_extract([{}], CAST(doc_id % {} AS INTEGER) + 1)"


@query("WITH full_text AS (SELECT doc_id, text || ' ' || "
       + PLANTED_WORDS.format(quoted(fixed.POSITIVE_WORDS), len(fixed.POSITIVE_WORDS)) + " || ', ' || "
       + PLANTED_WORDS.format(quoted(fixed.NEGATIVE_WORDS + fixed.POSITIVE_WORDS), len(fixed.NEGATIVE_WORDS + fixed.POSITIVE_WORDS))
       + " AS body FROM documents)," + SENTIMENT_SQL + f" SELECT doc_id, {SENTIMENT_COLUMNS} FROM scored")
def marked_sentiment(spark, folder):
    def pick(words):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % len(words)).cast("int") + 1)
    marked = documents(spark, folder).withColumn("text", F.concat(
        "text", F.lit(" "), pick(fixed.POSITIVE_WORDS), F.lit(", "), pick(fixed.NEGATIVE_WORDS + fixed.POSITIVE_WORDS)))
    return S.sentiment(marked).select("doc_id", "positive_words", "negative_words", "sentiment", "score")


@query("WITH " + FULL_TEXT + "," + READ_SQL + f" SELECT doc_id, {READ_COLUMNS} FROM complex")
def doc_readability(spark, folder):
    return S.readability(S.doc_stats(books(spark, folder)), "full_text").select(
        "doc_id", "avg_words_per_sentence", "avg_word_length", "complexity_score", "reading_level")


@query("WITH " + KEYWORD_SQL + "," + SENTIMENT_SQL + "," + READ_SQL + f""",
top AS (SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 20 GROUP BY doc_id)
SELECT complex.doc_id, words AS word_count, length(complex.body) AS character_count, n_pages AS page_count,
  coalesce(keywords, '') AS keywords, {SENTIMENT_COLUMNS}, {READ_COLUMNS}
FROM complex JOIN scored USING (doc_id) LEFT JOIN top USING (doc_id)""")
def doc_insights(spark, folder):
    return S.insights(books(spark, folder)).withColumn("keywords", F.array_join("keywords", " ")).select(
        "doc_id", "word_count", "character_count", "page_count", "keywords", "positive_words", "negative_words",
        "sentiment", "score", "avg_words_per_sentence", "avg_word_length", "complexity_score", "reading_level")


@query("WITH " + DOC_PAGES + " SELECT doc_id, page, text FROM doc_pages")
def split_pages(spark, folder):
    return P.to_pages(books(spark, folder), "doc_id")


@query("WITH " + DOC_PAGES + """,
counted AS (
  SELECT doc_id, t, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]{2,}){0,3}\\b')) AS t FROM (
      SELECT doc_id, regexp_replace(text, '[\\p{L}\\p{N}\\p{M}_]*[^\\x00-\\x7F\\s\\p{P}\\p{S}][\\p{L}\\p{N}\\p{M}_]*', '#', 'g') AS text FROM doc_pages))
  WHERE length(t) >= 4 AND t NOT IN (""" + quoted(fixed.STOP_TERMS) + """) GROUP BY ALL HAVING count(*) >= 3
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) AS rank FROM counted)
SELECT doc_id, t AS term, n, rank FROM ranked""")
def doc_glossary(spark, folder):
    terms = books(spark, folder).select("doc_id", F.posexplode(S.glossary_terms(F.col("pages"))).alias("i", "t"))
    return terms.select("doc_id", "t.term", (-F.col("t.rank_key")).alias("n"), (F.col("i") + 1).alias("rank"))


# Page sizes are derived from the page's own numbers: documents carry no geometry.
SIZED_SQL = DOC_PAGES + """,
sized AS (SELECT *, 400.0 + (doc_id % 7) * 50.25 AS width, 300.0 + (page % 5) * 100.125 AS height FROM doc_pages)"""


def sized_pages(spark, folder):
    return P.to_pages(books(spark, folder), "doc_id").withColumn(
        "width", F.lit(400.0) + (F.col("doc_id") % 7) * 50.25).withColumn(
        "height", F.lit(300.0) + (F.col("page") % 5) * 100.125)


@query("WITH " + SIZED_SQL + f"""
SELECT doc_id, page, {py_round('width::DOUBLE', 1)} AS width, {py_round('height::DOUBLE', 1)} AS height,
  CASE WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation,
  length(trim(text, E' \\t\\n\\r')) AS characters,
  CASE WHEN length(trim(text, E' \\t\\n\\r')) >= 20 THEN 'native' ELSE 'none' END AS text_layer FROM sized""")
def page_profile(spark, folder):
    return P.page_profile(sized_pages(spark, folder)).select(
        "doc_id", "page", "width", "height", "orientation", "characters", "text_layer")


@query("WITH " + DOC_PAGES + """
SELECT doc_id, page, c AS characters, c < 20 AS needs_ocr,
  CASE WHEN c < 20 THEN 'No extractable text; the page is probably an image.'
       ELSE c || ' characters of extractable text.' END AS reason
FROM (SELECT doc_id, page, length(trim(text, E' \\t\\n\\r')) AS c FROM doc_pages)""")
def ocr_need(spark, folder):
    return P.assess_pages(P.to_pages(books(spark, folder), "doc_id")).select(
        "doc_id", "page", "characters", "needs_ocr", "reason")


CLASS_SQL = DOC_PAGES + """,
classed AS (
  SELECT doc_id, count(*) AS page_count, count(*) FILTER (c >= 20) AS pages_with_text,
    coalesce(string_agg(page, ',' ORDER BY page) FILTER (c < 20), '') AS needing, sum(c) AS characters
  FROM (SELECT doc_id, page, length(trim(text, E' \\t\\n\\r')) AS c FROM doc_pages) GROUP BY doc_id
)"""
CLASS_COLUMN = """CASE WHEN page_count = 0 THEN 'empty' WHEN pages_with_text = page_count THEN 'native'
  WHEN pages_with_text = 0 THEN 'no_text_layer' ELSE 'mixed' END AS classification"""


@query("WITH " + CLASS_SQL + f" SELECT doc_id, page_count, pages_with_text, needing, {CLASS_COLUMN} FROM classed")
def text_layer_classes(spark, folder):
    return P.classify_books(books(spark, folder)).select(
        "doc_id", "page_count", "pages_with_text", F.array_join("needing", ",").alias("needing"), "classification")


@query("WITH " + CLASS_SQL + f"""
SELECT doc_id, lang, page_count, pages_with_text, characters, {CLASS_COLUMN}
FROM classed JOIN documents USING (doc_id)""")
def ingest_profile(spark, folder):
    docs = spread(load(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")
    profiled = P.classify_books(P.to_books(docs))
    return profiled.select(
        "doc_id", "lang", "page_count", "pages_with_text",
        T.sum_of(F.transform("pages", lambda p: F.length(T.strip(p["text"])))).alias("characters"), "classification")


@query(f"""
SELECT doc_id, length(text) AS original_characters, length(s) AS summary_characters,
  CASE WHEN length(s) > 0 THEN {py_round('length(text)::DOUBLE / length(s)', 2)} ELSE 0.0 END AS compression_ratio,
  len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS original_words,
  len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) AS summary_words,
  {py_round('(n_chars / 640.0::DOUBLE)', 2)} AS processing_time_seconds, doc_id % 5 AS chunks,
  CASE WHEN doc_id % 5 > 0 THEN {py_round('((n_chars / 640.0::DOUBLE) / (doc_id % 5)::DOUBLE)', 3)} ELSE 0.0 END AS avg_time_per_chunk
FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '' ELSE string_split(text, chr(10))[1] END AS s FROM documents)""")
def run_metrics(spark, folder):
    runs = load(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("original"), (F.col("n_chars") / 640.0).alias("seconds"),
        (F.col("doc_id") % 5).alias("chunks"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.substring_index("text", "\n", 1)).alias("summary"))
    return S.run_metrics(runs).drop("original", "summary", "seconds")
