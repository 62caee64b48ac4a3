"""Retrieval, chunks, model runs with a deterministic model, and comparisons."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from paperloom.functions import fixed, scale
from paperloom.functions import text as T
from paperloom.operators import chunks as C
from paperloom.operators import diff as D
from paperloom.operators import model_map as MM
from paperloom.operators import pages as P
from paperloom.operators import retrieval as Q
from paperloom.operators import versions as V
from paperloom.plans.registry import query
from paperloom.plans.sqlparts import CONV_PAGES, DOC_PAGES, py_round, quoted
from paperloom.plans.text_stats import books, documents
from paperloom.sources.tables import load

STRIP = "trim({}, E' \\t\\n\\r')"


# ------------------------------------------------------------------ ranking
# Each conversation is a document of turns; its last turn is the question.

def conv_pages(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "text")


def questions(spark, folder):
    return load(spark, folder, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumn(
        "q_id", F.col("conv_id")).withColumn("question", F.when(F.col("conv_id") % 10 == 3, "what is it?").otherwise(F.col("question")))


TERMS_SQL = CONV_PAGES + f""",
page_terms AS (
  SELECT conv_id, page, term, count(*) AS n FROM (SELECT conv_id, page, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conv_pages)
  WHERE length(term) > 2 AND term NOT IN ({quoted(fixed.RETRIEVAL_STOP_WORDS)}) GROUP BY ALL
)"""
RANK_SQL = TERMS_SQL + f""",
questions AS (SELECT conv_id, CASE WHEN conv_id % 10 = 3 THEN 'what is it?' ELSE arg_max(text, turn) END AS question FROM conversations GROUP BY conv_id),
wanted AS (SELECT DISTINCT conv_id, term FROM (SELECT conv_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM questions)
  WHERE length(term) > 2 AND term NOT IN ({quoted(fixed.RETRIEVAL_STOP_WORDS)})),
df AS (SELECT conv_id, term, count(*) AS df FROM page_terms GROUP BY ALL),
totals AS (SELECT conv_id, count(*) AS total FROM conv_pages GROUP BY conv_id),
scores AS (
  SELECT conv_id, page, round(sum((1 + ln(n)) * ln(1 + total::DOUBLE / (1 + df))), 9) AS score
  FROM wanted JOIN page_terms USING (conv_id, term) JOIN df USING (conv_id, term) JOIN totals USING (conv_id) GROUP BY ALL
),
ranked AS (SELECT conv_id, page, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, page) AS rank FROM scores),
best AS (SELECT * FROM ranked WHERE rank <= 6
  UNION ALL SELECT conv_id, page, 0.0, page FROM conv_pages WHERE page <= 6 AND conv_id NOT IN (SELECT conv_id FROM scores))"""


@query("WITH " + TERMS_SQL + " SELECT conv_id, term, sum(n) AS occurrences, count(*) AS pages FROM page_terms GROUP BY ALL")
def term_statistics(spark, folder):
    return Q.term_stats(conv_pages(spark, folder), "conv_id")


@query("WITH " + RANK_SQL + " SELECT conv_id, page, rank, CAST(round(score * 1000) AS BIGINT) AS score_milli FROM best")
def page_ranking(spark, folder):
    ranked = Q.rank_pages(conv_pages(spark, folder), questions(spark, folder), "conv_id")
    return ranked.select("conv_id", "page", "rank", F.round(F.col("score") * 1000).cast("long").alias("score_milli"))


@query("WITH " + RANK_SQL + f""",
blocks AS (SELECT conv_id, rank, page, '[p.' || page || ']' || chr(10) || {STRIP.format('text')} AS block FROM best JOIN conv_pages USING (conv_id, page) WHERE {STRIP.format('text')} <> ''),
running AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM blocks),
fitted AS (SELECT *, CASE WHEN used + length(block) > 1500 THEN block[1:CAST(1500 - used AS INTEGER)] ELSE block END AS body FROM running WHERE used < 1500)
SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY rank) AS context FROM fitted WHERE used + length(block) <= 1500 OR length(body) >= 200 GROUP BY conv_id""")
def question_context(spark, folder):
    pages = conv_pages(spark, folder)
    ranked = Q.rank_pages(pages, questions(spark, folder), "conv_id")
    return Q.ranked_context(pages, ranked, "conv_id", 1500).select("conv_id", "context").filter(F.col("context") != "")


@query("WITH " + DOC_PAGES + f""",
blocks AS (SELECT doc_id, page, length('[p.' || page || ']' || chr(10) || {STRIP.format('text')}) AS n FROM doc_pages WHERE {STRIP.format('text')} <> ''),
running AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS upto FROM blocks)
SELECT doc_id, count(*) AS pages, max(upto) AS used FROM running WHERE upto <= 2000 GROUP BY doc_id""")
def strict_context(spark, folder):
    made = books(spark, folder).select("doc_id", Q.context(F.col("pages"), 2000, strict=True).alias("c"))
    return made.select("doc_id", F.size("c.pages").alias("pages"), F.col("c.used").alias("used")).filter(F.col("pages") > 0)


# ------------------------------------------------------------------ answers

# Answers cite two pages of the conversation and one that does not exist.
ANSWERS_SQL = CONV_PAGES + """,
allowed AS (SELECT conv_id, list(page ORDER BY page) AS allowed FROM conv_pages GROUP BY conv_id),
answers AS (SELECT conv_id, allowed, 'It holds [p.1] and' || CASE WHEN conv_id % 3 = 0 THEN '  [P. ' || 90 + conv_id % 7 || '] or' ELSE '' END || ' more [p. 2].' AS answer FROM allowed)"""


def answers(spark, folder):
    i = F.col("conv_id")
    shown = load(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    fake = F.when(i % 3 == 0, F.concat(F.lit("  [P. "), (i % 7 + 90).cast("string"), F.lit("] or"))).otherwise("")
    return shown.select("conv_id", F.sequence(F.lit(1), (F.col("_last") + 1).cast("int")).alias("allowed"),
                        F.concat(F.lit("It holds [p.1] and"), fake, F.lit(" more [p. 2].")).alias("answer"))


@query("WITH " + ANSWERS_SQL + """
SELECT conv_id, CASE WHEN conv_id % 3 <> 0 AND len(allowed) >= 2 THEN answer ELSE trim(regexp_replace(
  regexp_replace(CASE WHEN len(allowed) < 2 THEN replace(answer, '[p. 2]', '') ELSE answer END, '(?i)\\[p\\.\\s*9\\d\\]', ''), '\\s{2,}', ' ', 'g')) END AS answer,
  CASE WHEN len(allowed) >= 2 THEN '1,2' ELSE '1' END AS kept,
  array_to_string(list_filter([CASE WHEN len(allowed) < 2 THEN 2 END, CASE WHEN conv_id % 3 = 0 THEN 90 + conv_id % 7 END], lambda x: x IS NOT NULL), ',') AS dropped
FROM answers""")
def scrubbed_citations(spark, folder):
    checked = Q.scrub_citations(answers(spark, folder))
    return checked.select("conv_id", "answer", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


@query("WITH " + ANSWERS_SQL + """
SELECT conv_id, page, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240) AS excerpt FROM conv_pages WHERE page <= 2""")
def verified_citations(spark, folder):
    return Q.verify_citations(Q.scrub_citations(answers(spark, folder)), conv_pages(spark, folder), "conv_id")


@query("WITH " + ANSWERS_SQL + """
SELECT conv_id, array_to_string(list_sort(list_filter([1, 2, 90 + conv_id % 7], lambda x: NOT list_contains(allowed, x))), ',') AS fabricated FROM answers""")
def fabricated_pages(spark, folder):
    made_up = F.array(F.lit(1), F.lit(2), (F.col("conv_id") % 7 + 90).cast("int"))
    return answers(spark, folder).select("conv_id", F.array_join(Q.fabricated(made_up, F.col("allowed")), ",").alias("fabricated"))


# Candidates: the second line word for word, the third in capitals with marks around, one changed.
@query("WITH " + DOC_PAGES + f""",
cands AS (
  SELECT doc_id, 1 AS n, {STRIP.format("l[2]")} AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, 2, {STRIP.format("translate(l[3], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")} FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
),
flat AS (SELECT doc_id, page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM doc_pages),
placed AS (SELECT doc_id, n, c, min(page) AS page FROM cands JOIN flat USING (doc_id)
  WHERE length(c) >= 20 AND contains(body, lower(trim(regexp_replace(c, '\\s+', ' ', 'g')))) AND c[1] NOT IN ('-', '"') AND c[-1] <> '"' GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS position, c AS quote, page FROM placed""")
def verified_quotes(spark, folder):
    lines = F.split("text", "\n", -1)
    plain = lambda c: F.when(~T.strip(c).rlike(r'\A[-"]|"\z'), c)
    made = documents(spark, folder).select("doc_id", F.array_compact(F.array(
        plain(F.get(lines, F.lit(1))), F.concat(F.lit(' - "'), plain(F.translate(F.get(lines, F.lit(2)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), F.lit('"')),
        F.lit("An invented sentence found nowhere at all."))).alias("lines"))
    made = made.withColumn("lines", F.transform("lines", lambda c: F.regexp_replace(c, '^ - "(.*)"$', '"$1"')))
    return Q.verify_quotes(made, books(spark, folder))


# ------------------------------------------------------------------ chunks

def chunk_sql(items: str, budget: int) -> str:
    """Greedy chunks by recursion over numbered items (doc_id, k, n, page, text)."""
    return items + f""",
chunked AS (
  SELECT doc_id, k, n AS size, 0 AS idx FROM items WHERE k = 1
  UNION ALL SELECT i.doc_id, i.k, CASE WHEN c.size + i.n > {budget} THEN i.n ELSE c.size + i.n END, CASE WHEN c.size + i.n > {budget} THEN c.idx + 1 ELSE c.idx END
  FROM chunked c JOIN items i ON i.doc_id = c.doc_id AND i.k = c.k + 1
)"""


@query("WITH RECURSIVE " + chunk_sql(DOC_PAGES + f""",
items AS (SELECT doc_id, page, t AS text, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k
  FROM (SELECT doc_id, page, {STRIP.format('text')} AS t FROM doc_pages) WHERE t <> '')""", 3000) + """
SELECT doc_id, idx, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text, min(page) AS first_page, max(page) AS last_page,
  CASE WHEN min(page) = max(page) THEN 'p. ' || min(page) ELSE 'pp. ' || min(page) || '–' || max(page) END AS label
FROM chunked JOIN items USING (doc_id, k) GROUP BY ALL""")
def page_chunks(spark, folder):
    return C.chunk_pages(books(spark, folder), "doc_id", budget=3000).withColumn("label", T.page_label(F.col("first_page"), F.col("last_page")))


CLEANED_SQL = DOC_PAGES + """,
marked AS (SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) ORDER BY page) AS raw FROM doc_pages GROUP BY doc_id),
cleaned AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_\\s.,!?;:()-]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM doc_pages)"""


def marked(spark, folder):
    return books(spark, folder).select("doc_id", F.array_join(F.transform("pages", lambda p: F.concat(
        F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])), "\n").alias("raw"))


@query("WITH " + CLEANED_SQL + " SELECT doc_id, page, text FROM cleaned WHERE text <> ''")
def cleaned_pages(spark, folder):
    return marked(spark, folder).select("doc_id", F.explode(P.split_on_markers(F.col("raw"))).alias("p")).select("doc_id", "p.page", "p.text")


@query("WITH " + CLEANED_SQL + """
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(raw, '--- Page \\d+ ---', '', 'g'), '[^\\p{L}\\p{N}\\p{M}_\\s.,!?;:()-]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM marked""")
def cleaned_text(spark, folder):
    return marked(spark, folder).select("doc_id", P.clean_text(F.col("raw")).alias("text"))


@query("WITH RECURSIVE " + chunk_sql(CLEANED_SQL + """,
pieces AS (SELECT doc_id, page, i, trim(regexp_replace(trim(s[i]), '\\.$', '')) AS text
  FROM (SELECT doc_id, page, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, page, string_split(text, '. ') AS s FROM cleaned WHERE text <> ''))),
items AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 1 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS k FROM pieces WHERE text <> '')""", 300) + """
SELECT doc_id, idx, string_agg(text, '. ' ORDER BY k) || '.' AS text, min(page) AS first_page, max(page) AS last_page FROM chunked JOIN items USING (doc_id, k) GROUP BY ALL""")
def sentence_chunks(spark, folder):
    cleaned = marked(spark, folder).select("doc_id", P.split_on_markers(F.col("raw")).alias("pages"))
    return C.chunk_sentences(cleaned, "doc_id", max_tokens=300)


@query("WITH RECURSIVE items AS (" + """
  SELECT doc_id, i AS k, s[i] AS text, length(s[i]) + 2 AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents))),
chunked AS (
  SELECT doc_id, k, n AS size, 0 AS idx FROM items WHERE k = 1
  UNION ALL SELECT i.doc_id, i.k, CASE WHEN ceil((c.size + i.n) / 4.0) > 200 THEN i.n ELSE c.size + i.n END, CASE WHEN ceil((c.size + i.n) / 4.0) > 200 THEN c.idx + 1 ELSE c.idx END
  FROM chunked c JOIN items i ON i.doc_id = c.doc_id AND i.k = c.k + 1
)
SELECT doc_id, idx, trim(string_agg(text, '. ' ORDER BY k) || '. ', E' \\t\\n\\r') AS chunk FROM chunked JOIN items USING (doc_id, k) GROUP BY ALL""")
def plain_chunks(spark, folder):
    return C.chunk_text(documents(spark, folder), "doc_id", max_tokens=200)


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_no, s[i] AS sentence FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents))""")
def sentences(spark, folder):
    return C.sentence_rows(documents(spark, folder), "doc_id")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN octet_length(encode(text)) || ' ' || substr(sha256(text), 1, 16) END AS recognised, CASE WHEN doc_id % 5 = 0 THEN 'not a picture' END AS reason FROM documents""")
def recognised_files(spark, folder):
    """Bytes put to a recognition function; every fifth file cannot be read and says why."""
    def recognise(data: bytes) -> str:
        if data.startswith(b"\xff"):
            raise ValueError("not a picture")
        return f"{len(data)} {hashlib.sha256(data).hexdigest()[:16]}"

    body = F.col("text").cast("binary")
    files = documents(spark, folder).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("ff")), body)).otherwise(body).alias("content"))
    return MM.ocr_map(files, recognise).select("doc_id", "recognised", "reason")


# ------------------------------------------------------------------ model runs

FIRST_LINE = "trim(regexp_extract({}, '[^\\n]*\\S[^\\n]*'), E' \\t\\n\\r')"


# A turn is blanked in every twelfth conversation, so some questions find nothing to read.
BLANKED_SQL = RANK_SQL.replace(CONV_PAGES, CONV_PAGES.replace("role, text FROM", "role, CASE WHEN conv_id % 12 = 5 THEN '' ELSE text END AS text FROM"))


@query("WITH " + BLANKED_SQL + f""",
blocks AS (SELECT conv_id, rank, page, '[p.' || page || ']' || chr(10) || {STRIP.format('text')} AS block FROM best JOIN conv_pages USING (conv_id, page) WHERE {STRIP.format('text')} <> ''),
bodies AS (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body FROM blocks GROUP BY conv_id),
cited AS (SELECT conv_id, arg_min(page, rank) AS first FROM blocks GROUP BY conv_id)
SELECT conv_id, CASE WHEN body IS NOT NULL THEN '[p.' || first || '] ' || length(body) || ' ' || substr(sha256(body), 1, 16) END AS answer,
  coalesce(CAST(first AS VARCHAR), '') AS kept, CASE WHEN body IS NOT NULL THEN '777' ELSE '' END AS dropped,
  CASE WHEN body IS NULL THEN 'The document holds no text to answer from.'
    ELSE 'The model cited page(s) 777, which were not part of the retrieved content. Those citations were removed because they could not be verified.' END AS note
FROM questions LEFT JOIN bodies USING (conv_id) LEFT JOIN cited USING (conv_id)""")
def answered_questions(spark, folder):
    """The model cites the first page shown and one that was not, and digests the whole context it got."""
    def citing(system, user):
        body = user.split(fixed.FENCE_OPEN + "\n", 1)[-1].split("\n" + fixed.FENCE_CLOSE, 1)[0]
        return f"{body.split(chr(10), 1)[0]} [p. 777] {len(body)} {hashlib.sha256(body.encode()).hexdigest()[:16]}", 1

    pages = conv_pages(spark, folder).withColumn("text", F.when(F.col("conv_id") % 12 == 5, "").otherwise(F.col("text")))
    done = MM.ask(questions(spark, folder), pages, "conv_id", model=citing)
    return done.select("conv_id", "answer", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"), "note")


SUMMARY_SQL = "WITH RECURSIVE " + chunk_sql(DOC_PAGES + f""",
items AS (SELECT doc_id, page, t AS text, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k
  FROM (SELECT doc_id, page, {STRIP.format('text')} AS t FROM doc_pages) WHERE t <> '')""", 3000) + f""",
sections AS (
  SELECT doc_id, idx, {FIRST_LINE.format("string_agg(text, chr(10) || chr(10) ORDER BY k)")} AS summary,
    CASE WHEN min(page) = max(page) THEN 'p. ' || min(page) ELSE 'pp. ' || min(page) || '–' || max(page) END AS label FROM chunked JOIN items USING (doc_id, k) GROUP BY ALL
)"""


@query(SUMMARY_SQL + """
SELECT doc_id, idx AS section, label AS pages, length(summary) AS summary_characters, 'Success' AS status, summary FROM sections""")
def summary_sections(spark, folder):
    from paperloom.operators import exports as X

    sections, _ = MM.summarise(books(spark, folder), budget=3000)
    return X.summary_rows(sections)


@query(SUMMARY_SQL + """,
totals AS (SELECT doc_id, count(*) AS page_count FROM doc_pages GROUP BY doc_id)
SELECT doc_id, count(*) AS section_count, page_count,
  CASE WHEN count(*) = 1 THEN min(summary) ELSE 'Section 1 (' || arg_min(label, idx) || '): ' || arg_min(summary, idx) END AS combined,
  page_count || ' page(s) summarised in ' || count(*) || ' section(s).' AS note
FROM sections JOIN totals USING (doc_id) GROUP BY doc_id, page_count""")
def summaries(spark, folder):
    _, merged = MM.summarise(books(spark, folder), budget=3000)
    return merged.select("doc_id", "section_count", "page_count", "combined", "note")


BAR = "-" * 60


@query(SUMMARY_SQL + f""",
totals AS (SELECT doc_id, count(*) AS page_count FROM doc_pages GROUP BY doc_id),
merged AS (SELECT doc_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(summary) ELSE 'Section 1 (' || arg_min(label, idx) || '): ' || arg_min(summary, idx) END AS combined,
  string_agg(chr(10) || 'Section ' || idx || ' (' || label || ')' || chr(10) || summary, chr(10) ORDER BY idx) AS parts FROM sections GROUP BY doc_id)
SELECT doc_id, 'PDF SUMMARY REPORT' || chr(10) || '{"=" * 60}' || chr(10) || 'Document      : ' || doc_id || chr(10) || 'Summary type  : detailed' || chr(10) || 'Pages         : ' || page_count
  || chr(10) || 'Sections      : ' || n || chr(10) || 'Model         : ' || chr(10) || 'Generated     : 2024-01-01T00:00:00+00:00' || chr(10) || chr(10) || 'SUMMARY' || chr(10) || '{BAR}' || chr(10) || combined
  || chr(10) || chr(10) || 'SECTION SUMMARIES' || chr(10) || '{BAR}' || chr(10) || parts AS body
FROM merged JOIN totals USING (doc_id)""")
def summary_reports(spark, folder):
    from paperloom.operators import exports as X

    sections, merged = MM.summarise(books(spark, folder), budget=3000)
    return X.export_summary(sections, merged, "detailed", "2024-01-01T00:00:00+00:00")


def json_model(system: str, user: str) -> tuple[str, int]:
    """A deterministic reply with an object in it: digest and length of the text it got; fenced for some, broken for others."""
    told, tokens = upper_model(system, user)
    size, digest = told.split()
    body = '{"document_type": "%s", "topics": ["a", null, "%s"], "key_points": [{"point": "x", "page": 1}, "odd"]}' % (digest, size)
    if int(size) % 3 == 0:
        return "Here:\n```json\n" + body + "\n```", tokens
    return (body[:-2], tokens) if int(size) % 5 == 4 else ("So: " + body + " done", tokens)


@query("WITH " + DOC_PAGES + f""",
shown AS (SELECT doc_id, page, '[p.' || page || ']' || chr(10) || {STRIP.format('text')} AS block FROM doc_pages WHERE {STRIP.format('text')} <> ''),
bodies AS (SELECT doc_id, count(*) AS pages_used, string_agg(block, chr(10) || chr(10) ORDER BY page) AS body FROM shown GROUP BY doc_id),
totals AS (SELECT doc_id, count(*) AS page_count FROM doc_pages GROUP BY doc_id),
judged AS (SELECT *, body IS NULL OR length(body) % 3 <> 0 AND length(body) % 5 = 4 AS parse_error FROM totals LEFT JOIN bodies USING (doc_id))
SELECT doc_id, CAST(coalesce(pages_used, 0) AS INTEGER) AS pages_used, CAST(page_count AS INTEGER) AS page_count, parse_error, CASE WHEN parse_error THEN '' ELSE substr(sha256(body), 1, 16) END AS document_type,
  CASE WHEN parse_error THEN '' ELSE 'a,' || length(body) END AS topics, CASE WHEN parse_error THEN 0 ELSE 1 END AS key_points, CASE WHEN body IS NULL THEN 'The document holds no text to analyse.' END AS reason FROM judged""")
def analysed_documents(spark, folder):
    done = MM.analyse(books(spark, folder), model=json_model)
    return done.select("doc_id", "pages_used", "page_count", "parse_error", "document_type", F.array_join("topics", ",").alias("topics"),
                       F.size("key_points").alias("key_points"), "reason")


REPLIES_SQL = """
replies AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure: ```json' || chr(10) || props || ' ```' WHEN 1 THEN 'x ' || props || ' y' WHEN 2 THEN props ELSE 'none ' || event_id END AS reply FROM events)"""


@query("WITH " + REPLIES_SQL + """
SELECT e.event_id, CASE WHEN e.event_id % 4 = 3 THEN 'none ' || e.event_id ELSE props END AS json_text, e.event_id % 4 <> 3 AS parsed,
  CASE WHEN e.event_id % 4 <> 3 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events e""")
def parsed_replies(spark, folder):
    i = F.col("event_id")
    replies = load(spark, folder, "events").select("event_id", F.when(i % 4 == 0, F.concat(F.lit("Sure: ```json\n"), "props", F.lit(" ```")))
        .when(i % 4 == 1, F.concat(F.lit("x "), "props", F.lit(" y"))).when(i % 4 == 2, F.col("props"))
        .otherwise(F.concat(F.lit("none "), i.cast("string"))).alias("reply"))
    parsed = replies.withColumn("json_text", MM.parse_json(F.col("reply"))).withColumn("v", F.try_parse_json("json_text"))
    return parsed.select("event_id", "json_text", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.k", "int").alias("k"))


@query("WITH " + DOC_PAGES + f""",
first_page AS (SELECT doc_id, page FROM doc_pages WHERE {STRIP.format('text')} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1),
line AS (SELECT doc_id, page, {FIRST_LINE.format('text')} AS q FROM doc_pages JOIN first_page USING (doc_id, page))
SELECT doc_id, 0 AS position, q AS quote, (SELECT min(page) FROM doc_pages d WHERE d.doc_id = line.doc_id AND contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))))) AS page
FROM line WHERE length(q) >= 20""")
def key_quotes(spark, folder):
    def second_line(system, user):
        body = user.split(fixed.FENCE_OPEN, 1)[-1].split("]\n", 1)[-1]
        return MM.first_line(system, body)
    return MM.key_quotes(books(spark, folder), model=second_line)


# Every eleventh turn is blank and comes back refused.
@query(f"""SELECT conv_id, turn, CASE WHEN blank THEN NULL ELSE {FIRST_LINE.format('text')} END AS output, CASE WHEN blank THEN NULL ELSE false END AS injection_detected,
  CASE WHEN blank THEN 'No text was selected.' END AS reason FROM (SELECT *, {STRIP.format('text')} = '' OR conv_id % 11 = 3 AS blank FROM conversations)""")
def passage_summaries(spark, folder):
    return acted(blanked_turns(spark, folder), "summarize")


def blanked_turns(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 11 == 3, " \n").otherwise(F.col("text")).alias("text"))


def acted(passages, mode, **more):
    results, refused = MM.act(passages, mode, **more)
    return results.select("conv_id", "turn", "output", "injection_detected", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("conv_id", "turn", F.lit(None).cast("string").alias("output"), F.lit(None).cast("boolean").alias("injection_detected"), "reason"))


ACTIONS = {
    "explain": "Explain the passage in plain language.", "rewrite": "Rewrite the passage more clearly without changing its meaning.", "shorten": "Shorten the passage without losing meaning.",
    "summarize": "Summarise the passage in two or three sentences.", "translate": "Translate the passage into Latin. Output only the translation.",
}


@query("WITH a(mode, instruction) AS (VALUES " + ", ".join(f"('{m}', '{i}')" for m, i in ACTIONS.items()) + f"""),
p AS (SELECT *, {STRIP.format('text')} = '' OR conv_id % 11 = 3 AS blank FROM conversations)
SELECT conv_id, turn, mode, CASE WHEN NOT blank THEN instruction || ' ' || length(text) || ' ' || substr(sha256(text), 1, 16) END AS output, CASE WHEN blank THEN 'No text was selected.' END AS reason FROM p, a""")
def passage_actions(spark, folder):
    """All five actions on every turn; the model tells what it was asked and digests the whole passage."""
    def telling(system, user):
        return f"{user.split(chr(10), 1)[0]} {upper_model(system, user)[0]}", 1
    done = None
    for mode in ACTIONS:
        more = {"language": "Latin"} if mode == "translate" else {}
        one = acted(blanked_turns(spark, folder), mode, model=telling, **more).select("conv_id", "turn", F.lit(mode).alias("mode"), "output", "reason")
        done = one if done is None else done.unionByName(one)
    return done


def upper_model(system: str, user: str) -> tuple[str, int]:
    """Deterministic translator: length and digest of the whole page; for a term list, 'term = TERM' lines."""
    body = user.split(fixed.FENCE_OPEN + "\n", 1)[-1].split("\n" + fixed.FENCE_CLOSE, 1)[0]
    if user.startswith("Translate each term"):
        return "\n".join(f"{t.lower()} = {t.upper()}" for t in body.split("\n")), 1
    return f"{len(body)} {hashlib.sha256(body.encode()).hexdigest()[:16]}", 1


@query("WITH " + DOC_PAGES + f"""
SELECT doc_id, page, CASE WHEN body = '' THEN '' ELSE length(body) || ' ' || substr(sha256(body), 1, 16) END AS translated, body = '' AS blank
FROM (SELECT doc_id, page, {STRIP.format('text')} AS body FROM doc_pages)""")
def translated_pages(spark, folder):
    done = MM.translate(books(spark, folder), "Capitals", model=upper_model)
    return done.select("doc_id", "page", "translated", (F.col("original") == "").alias("blank"))


# Glossary replies per part name: one exact line, one by unique prefix, one unknown.
@query("""SELECT p_partkey, upper(p_name) AS full_name, CASE WHEN starts_with(lower(p_name), lower(p_brand)) THEN NULL ELSE upper(p_brand) END AS brand FROM part""")
def glossary_replies(spark, folder):
    replies = load(spark, folder, "part").select(
        "p_partkey", F.array("p_name", "p_brand").alias("terms"),
        F.concat(F.lit("  "), F.upper("p_name"), F.lit("  =  "), F.upper("p_name"), F.lit("\nno pair here\nzzz = q\n"),
                 F.substring("p_brand", 1, 7), F.lit("= "), F.upper("p_brand")).alias("reply"), "p_name", "p_brand")
    made = MM.parse_glossary(replies, "p_partkey")
    return made.select("p_partkey", F.try_element_at("glossary", F.col("p_name")).alias("full_name"), F.try_element_at("glossary", F.col("p_brand")).alias("brand"))


@query("""
WITH live AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 AND TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 120 AS INTEGER)) + INTERVAL 24 HOUR >= TIMESTAMP '2024-01-04')
SELECT doc_id % 10 AS batch_id, count(*) AS total, count(*) AS succeeded, 0 AS failed, count(*) FILTER (sha256(text) IN (SELECT h FROM live)) AS from_cache FROM documents GROUP BY ALL""")
def cached_batches(spark, folder):
    from paperloom.operators import lifecycle as L

    done = batched(spark, folder)
    return L.batch_outcome(done.select((F.col("doc_id") % 10).alias("batch_id"), "source", F.lit(None).cast("string").alias("error")))


@query(f"""
WITH live AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 AND TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 120 AS INTEGER)) + INTERVAL 24 HOUR >= TIMESTAMP '2024-01-04')
SELECT doc_id, CASE WHEN h IS NULL THEN {FIRST_LINE.format('text')} ELSE 'stored' END AS result, CASE WHEN h IS NULL THEN 'processed' ELSE 'cache' END AS source
FROM documents LEFT JOIN live ON h = sha256(text)""")
def batch_results(spark, folder):
    return batched(spark, folder).select("doc_id", "result", "source")


def batched(spark, folder):
    docs = documents(spark, folder).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    cache = docs.filter(F.col("doc_id") % 3 == 0).select(
        "content_hash", F.lit("stored").alias("result"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 120).cast("int"))).alias("created_at"))

    def run(misses):
        return MM.model_map(misses.select("content_hash", F.col("text").alias("prompt"))).withColumn("result", F.col("reply"))
    return MM.process_batch(docs, cache, ["content_hash"], F.lit("2024-01-04").cast("timestamp"), run)


# ------------------------------------------------------------------ comparisons
# Documents that open with the same line are versions of one another; each is compared with
# the one before it.

def version_pairs(spark, folder):
    rows = load(spark, folder, "documents").select(F.substring_index("text", "\n", 1).alias("title"), "doc_id")
    before = scale.previous(rows, ["title"], "doc_id", ["doc_id"], "before_")
    return before.filter(F.col("before_doc_id").isNotNull()).select(
        F.col("doc_id").alias("pair_id"), F.col("before_doc_id").alias("old_id"), F.col("doc_id").alias("new_id"))


@query()
def version_diffs(spark, folder):
    diffs = D.compare(D.pair_up(version_pairs(spark, folder), books(spark, folder)))
    return D.diff_summary(diffs)


EDITED_SQL = "WITH " + DOC_PAGES + """,
p AS (SELECT doc_id AS pair_id, page, page % 4 = 1 AS touched, page = 3 AND doc_id % 2 = 0 AS gone, doc_id % 2 = 0 AND page > 3 AS moved,
  length(trim(regexp_replace('Sheet ' || page || ': ' || text, '\\s+', ' ', 'g'))) AS n FROM doc_pages),
s AS (SELECT *, touched AND 2.0 * n / (2 * n + 20) < 0.45 AS apart FROM p),
e AS (SELECT pair_id, CASE WHEN gone OR apart THEN 'removed' WHEN touched THEN 'changed' ELSE 'unchanged' END AS status,
  CAST(page AS INT) AS old_page, CAST(CASE WHEN gone OR apart THEN NULL WHEN moved THEN page - 1 ELSE page END AS INT) AS new_page,
  CASE WHEN gone OR apart THEN 0.0 WHEN touched THEN """ + py_round("(2.0::DOUBLE * n / (2 * n + 20))", 3) + """ ELSE 1.0 END AS similarity FROM s
UNION ALL SELECT pair_id, 'added', NULL, CAST(CASE WHEN moved THEN page - 1 ELSE page END AS INT), 0.0 FROM s WHERE apart)"""


def edited(spark, folder):
    """Numbered sheets; the revision drops one sheet of every other document and dates every fourth."""
    original = books(spark, folder).withColumn("pages", F.transform("pages", lambda p: F.struct(
        p["page"].alias("page"), F.concat(F.lit("Sheet "), p["page"].cast("string"), F.lit(": "), p["text"]).alias("text"))))
    revised = P.renumber(F.transform(
        F.filter("pages", lambda p: ~((p["page"] == 3) & (F.col("doc_id") % 2 == 0))),
        lambda p: F.struct(p["page"].alias("page"), F.when(p["page"] % 4 == 1, F.concat(p["text"], F.lit(" Added 12 July 2024."))).otherwise(p["text"]).alias("text"))))
    return D.compare(original.select(F.col("doc_id").alias("pair_id"), F.col("pages").alias("old_pages"), revised.alias("new_pages")))


@query(EDITED_SQL + " SELECT pair_id, status, old_page, new_page, similarity FROM e")
def edited_diffs(spark, folder):
    return edited(spark, folder).select("pair_id", "status", "old_page", "new_page", D.shown_similarity(F.col("similarity")).alias("similarity"))


@query(EDITED_SQL + " SELECT pair_id, status, coalesce(new_page, old_page) AS page FROM e WHERE status <> 'unchanged'")
def edited_pages(spark, folder):
    return D.changed_pages(edited(spark, folder))


@query(EDITED_SQL + """,
t AS (SELECT pair_id, count(old_page) AS old_page_count, count(new_page) AS new_page_count, count_if(status = 'changed') AS changed, count_if(status = 'added') AS added,
  count_if(status = 'removed') AS removed FROM e GROUP BY pair_id)
SELECT *, changed + added + removed = 0 AS identical, CASE WHEN changed + added + removed = 0 THEN 'No textual differences were found between these documents.'
  ELSE concat_ws(', ', CASE WHEN changed > 0 THEN changed || ' page(s) changed' END, CASE WHEN added > 0 THEN added || ' added' END, CASE WHEN removed > 0 THEN removed || ' removed' END) || '.' END AS summary
FROM t""")
def edited_summaries(spark, folder):
    return D.diff_summary(edited(spark, folder))


@query(EDITED_SQL + """
SELECT pair_id, string_agg(CASE status WHEN 'added' THEN 'Page ' || new_page || ' (added)' WHEN 'removed' THEN 'Page ' || old_page || ' (removed)' ELSE 'Page ' || new_page || ' (changed)' END, ',' ORDER BY status, old_page, new_page) AS told
FROM e WHERE status <> 'unchanged' GROUP BY pair_id""")
def edited_explanations(spark, folder):
    """The places a model is told of: every page that differs, named once."""
    lines = D.explanation_lines(edited(spark, folder)).select("pair_id", F.explode("lines").alias("line")).select(
        "pair_id", F.regexp_extract("line", r"^Page (\d+) \((\w+)\)", 0).alias("place"), F.regexp_extract("line", r"\((\w+)\)", 1).alias("status"),
        F.regexp_extract("line", r"^Page (\d+)", 1).cast("int").alias("page")).distinct()
    return lines.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "page", "place"))), lambda x: x["place"]), ",").alias("told"))


@query("""
WITH d AS (SELECT conv_id, turn, 'Due 1' || turn || '/03/20' || 10 + conv_id % 50 || ' or ' || 1 + turn || ' May 2020.' AS o, 'Due 1' || turn || '/03/20' || 10 + conv_id % 49 || ' or ' || 2 + turn || ' May 2020.' AS n FROM conversations)
SELECT conv_id, turn, '1' || turn || '/03/20' || 10 + conv_id % 50 AS before, '1' || turn || '/03/20' || 10 + conv_id % 49 AS after, n AS context FROM d WHERE conv_id % 50 <> conv_id % 49
UNION ALL SELECT conv_id, turn, 1 + turn || ' May 2020', 2 + turn || ' May 2020', n FROM d""")
def date_changes(spark, folder):
    t, c = F.col("turn"), F.col("conv_id")

    def sentence(year, day):
        return F.concat(F.lit("Due 1"), t.cast("string"), F.lit("/03/20"), (year + 10).cast("string"), F.lit(" or "), (t + day).cast("string"), F.lit(" May 2020."))
    changes = load(spark, folder, "conversations").select("conv_id", "turn", F.lit("changed").alias("kind"), sentence(c % 50, 1).alias("old"), sentence(c % 49, 2).alias("new"))
    found = D.value_changes(changes, "conv_id", "turn")
    return found.filter(F.col("value_kind") == "date").select("conv_id", "turn", "before", "after", "context")


@query("WITH " + DOC_PAGES + """,
s AS (SELECT doc_id AS pair_id, doc_id % 50 AS a, doc_id % 20 AS d FROM doc_pages WHERE page % 5 = 1),
v AS (SELECT pair_id, 'number' AS value_kind, CAST(a + 1 AS VARCHAR) AS before, CAST(a + 8 AS VARCHAR) AS after, a, d FROM s
  UNION ALL SELECT pair_id, 'number', CAST(d + 1 AS VARCHAR), CAST(d + 3 AS VARCHAR), a, d FROM s
  UNION ALL SELECT pair_id, 'date', (d + 1) || ' May 2024', (d + 3) || ' May 2024', a, d FROM s)
SELECT pair_id, value_kind, before, after, 'The sum is ' || (a + 8) || ' due ' || (d + 3) || ' May 2024.' AS context FROM v""")
def value_changes(spark, folder):
    """Every fifth page states an amount and a day; the revision moves both."""
    def stated(amount, day):
        return F.transform("pages", lambda p: F.struct(p["page"].alias("page"), F.when(p["page"] % 5 == 1, F.concat(
            p["text"], F.lit(". The sum is "), (F.col("doc_id") % 50 + amount).cast("string"), F.lit(" due "), (F.col("doc_id") % 20 + day).cast("string"),
            F.lit(" May 2024."))).otherwise(p["text"]).alias("text")))
    paired = books(spark, folder).select(F.col("doc_id").alias("pair_id"), stated(1, 1).alias("old_pages"), stated(8, 3).alias("new_pages"))
    changes = D.compare(paired).select("pair_id", F.explode("changes").alias("c")).select("pair_id", "c.kind", "c.old", "c.new")
    return D.value_changes(changes, "pair_id")


@query()
def explained_diffs(spark, folder):
    diffs = D.compare(D.pair_up(version_pairs(spark, folder), books(spark, folder)))
    return D.explain_diffs(diffs).select("pair_id", "line_count", "reply", "failed")
