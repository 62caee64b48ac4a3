"""Page edits, labels, geometry, files, uploads and export forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T
from paperloom.operators import exports as X
from paperloom.operators import lifecycle as L
from paperloom.operators import pages as P
from paperloom.operators import search as S
from paperloom.operators import stats as ST
from paperloom.plans.records import choose, choose_sql
from paperloom.plans.registry import query
from paperloom.plans.sqlparts import DOC_PAGES, py_round
from paperloom.plans.text_stats import SIZED_SQL, books, documents, sized_pages
from paperloom.sources import tables as IO
from paperloom.session import scratch_path
from paperloom.sources.tables import load

STRIP = "trim({}, E' \\t\\n\\r')"
COUNTED = DOC_PAGES + """,
sized_docs AS (SELECT doc_id, count(*) AS n FROM doc_pages GROUP BY doc_id)"""


def flat(ok, refused):
    """Edited pages and refused documents in one table."""
    pages = P.to_pages(ok, "doc_id").withColumn("reason", F.lit(None).cast("string"))
    return pages.unionByName(refused.select("doc_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "reason"))


def edits(spark, folder, **columns):
    """One instruction per document, computed from its own page count."""
    counted = books(spark, folder).select("doc_id", F.size("pages").alias("n"))
    for name, value in columns.items():
        counted = counted.withColumn(name, value)
    return counted.drop("n")


def up_to(n):
    return F.sequence(F.lit(1), n)


# ------------------------------------------------------------------ page edits

@query("WITH " + COUNTED + """
SELECT doc_id, CAST(n - page + 1 AS INTEGER) AS page, text, NULL AS reason FROM doc_pages JOIN sized_docs USING (doc_id) WHERE doc_id % 5 <> 0 OR n = 1
UNION ALL SELECT doc_id, NULL, NULL, 'A reorder must list every page exactly once (' || n - 1 || ' given, ' || n || ' expected).' FROM sized_docs WHERE doc_id % 5 = 0 AND n > 1""")
def reordered_pages(spark, folder):
    """Reversed; every fifth document's list forgets the first page and names another twice."""
    n = F.col("n")
    order = F.when((F.col("doc_id") % 5 == 0) & (n > 1), F.concat(F.reverse(F.sequence(F.lit(2), n)), F.array(n))).otherwise(F.reverse(up_to(n)))
    return flat(*P.reorder(books(spark, folder), edits(spark, folder, selection=order)))


@query("WITH " + COUNTED + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS page, text, NULL AS reason FROM doc_pages JOIN sized_docs USING (doc_id) WHERE page % 3 <> 1 AND n > 1
UNION ALL SELECT doc_id, NULL, NULL, 'A document must keep at least one page.' FROM sized_docs WHERE n = 1""")
def deleted_pages(spark, folder):
    return flat(*P.delete_pages(books(spark, folder), edits(spark, folder, selection=F.filter(up_to(F.col("n")), lambda p: p % 3 == 1))))


@query("WITH " + COUNTED + """
SELECT doc_id, CAST(CASE WHEN page = n THEN 1 ELSE 2 END AS INTEGER) AS page, text, NULL AS reason FROM doc_pages JOIN sized_docs USING (doc_id) WHERE page IN (1, n) AND doc_id % 6 <> 0
UNION ALL SELECT doc_id, NULL, NULL, 'Page ' || n + 1 || ' is out of range; the document has ' || n || ' page(s).' FROM sized_docs WHERE doc_id % 6 = 0""")
def extracted_pages(spark, folder):
    n = F.col("n")
    chosen = F.when(F.col("doc_id") % 6 == 0, F.array(F.lit(1), n + 1)).otherwise(F.array(n, F.lit(1), n))
    return flat(*P.extract_pages(books(spark, folder), edits(spark, folder, selection=chosen)))


@query("WITH " + DOC_PAGES + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, c) AS INTEGER) AS page, text, NULL AS reason
FROM (SELECT *, unnest(CASE WHEN page % 2 = 1 THEN [0, 1] ELSE [0] END) AS c FROM doc_pages)""")
def duplicated_pages(spark, folder):
    return flat(*P.duplicate_pages(books(spark, folder), edits(spark, folder, selection=F.filter(up_to(F.col("n")), lambda p: p % 2 == 1))))


# Each document takes pages from the document seven ids on.
@query("WITH " + COUNTED + """,
src AS (SELECT a.doc_id, a.n, b.doc_id AS source, b.n AS m FROM sized_docs a JOIN sized_docs b ON b.doc_id = a.doc_id + 7),
good AS (SELECT * FROM src WHERE doc_id % 4 <> 3),
placed AS (
  SELECT g.doc_id, p.page AS a, 0 AS b, p.text FROM good g JOIN doc_pages p ON p.doc_id = g.doc_id
  UNION ALL SELECT g.doc_id, g.n // 2, CASE WHEN p.page = g.m THEN 1 ELSE 2 END, p.text FROM good g JOIN doc_pages p ON p.doc_id = g.source AND p.page IN (1, g.m) AND NOT (p.page = 1 AND g.m = 1)
  UNION ALL SELECT g.doc_id, g.n // 2, k, p.text FROM good g JOIN doc_pages p ON p.doc_id = g.source AND g.m = 1, (VALUES (1), (2)) t(k)
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS INTEGER) AS page, text, NULL AS reason FROM placed
UNION ALL SELECT doc_id, NULL, NULL, 'Cannot insert after page ' || n + 1 || '; the document has ' || n || ' page(s). Use 0 to insert at the beginning.' FROM sized_docs WHERE doc_id % 4 = 3
UNION ALL SELECT doc_id, NULL, NULL, 'The source document was not found.' FROM sized_docs WHERE doc_id % 4 <> 3 AND doc_id + 7 NOT IN (SELECT doc_id FROM sized_docs)""")
def inserted_pages(spark, folder):
    n = F.col("n")
    other = books(spark, folder).select((F.col("doc_id") - 7).alias("doc_id"), F.size("pages").alias("m"))
    made = edits(spark, folder, after=F.when(F.col("doc_id") % 4 == 3, n + 1).otherwise(F.floor(n / 2).cast("int")), source=F.col("doc_id") + 7)
    made = made.join(other, "doc_id", "left").withColumn("selection", F.array(F.col("m"), F.lit(1))).drop("m")
    ok, refused = P.insert_pages(books(spark, folder), made)
    return flat(ok, refused)


@query("WITH " + COUNTED + """,
src AS (SELECT a.doc_id, a.n, b.doc_id AS source, b.n AS m FROM sized_docs a JOIN sized_docs b ON b.doc_id = a.doc_id + 7),
good AS (SELECT * FROM src WHERE n >= 2 AND m >= 2)
SELECT g.doc_id, p.page, CASE WHEN p.page = 1 THEN s2.text WHEN p.page = n THEN s1.text ELSE p.text END AS text, NULL AS reason
FROM good g JOIN doc_pages p ON p.doc_id = g.doc_id JOIN doc_pages s1 ON s1.doc_id = g.source AND s1.page = 1 JOIN doc_pages s2 ON s2.doc_id = g.source AND s2.page = 2
UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN m < 2 THEN 'The source document has ' || m || ' page(s); page 2 was requested.'
  ELSE '1 page(s) are being replaced but 2 replacement page(s) were supplied. The counts must match.' END FROM src WHERE n < 2 OR m < 2
UNION ALL SELECT doc_id, NULL, NULL, 'The source document was not found.' FROM sized_docs WHERE doc_id + 7 NOT IN (SELECT doc_id FROM sized_docs)""")
def replaced_pages(spark, folder):
    made = edits(spark, folder, targets=F.array(F.col("n"), F.lit(1)), selection=F.array(F.lit(2), F.lit(1)), source=F.col("doc_id") + 7)
    return flat(*P.replace_pages(books(spark, folder), made))


@query("WITH " + COUNTED + """,
good AS (SELECT doc_id, n, doc_id % 4 AS c FROM sized_docs WHERE doc_id % 4 <> 0)
SELECT doc_id, CAST(CASE WHEN page > 1 THEN page + c ELSE page END AS INTEGER) AS page, text, NULL AS reason FROM good JOIN doc_pages USING (doc_id)
UNION ALL SELECT doc_id, CAST(1 + k AS INTEGER), '', NULL FROM (SELECT doc_id, unnest(range(1, c + 1)) AS k FROM good)
UNION ALL SELECT doc_id, NULL, NULL, 'Between 1 and 100 blank pages can be added at once.' FROM sized_docs WHERE doc_id % 4 = 0""")
def blank_pages(spark, folder):
    return flat(*P.insert_blank(books(spark, folder), edits(spark, folder, after=F.lit(1), count=(F.col("doc_id") % 4).cast("int"))))


@query("WITH " + DOC_PAGES + """
SELECT doc_id // 3 AS request_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id DESC, page) AS page, doc_id, page AS source_page, text, NULL AS reason FROM doc_pages WHERE doc_id // 3 % 10 <> 4
UNION ALL SELECT DISTINCT doc_id // 3, NULL, NULL, NULL, NULL, '1 of the documents to merge do not exist.' FROM documents WHERE doc_id // 3 % 10 = 4""")
def merged_documents(spark, folder):
    """Three neighbours each, last one first; every tenth request names a document that is not there."""
    request = F.floor(F.col("doc_id") / 3)
    known = documents(spark, folder).select(request.alias("request_id"), (2 - F.col("doc_id") % 3).alias("ord"), "doc_id")
    absent = known.filter(F.col("request_id") % 10 == 4).select("request_id", F.lit(3).cast("long").alias("ord"), (-1 - F.col("request_id")).alias("doc_id")).distinct()
    merged, refused = P.merge_books(known.unionByName(absent), books(spark, folder))
    nothing = [F.lit(None).cast(merged.schema[c].dataType).alias(c) for c in ("page", "doc_id", "source_page", "text")]
    return merged.withColumn("reason", F.lit(None).cast("string")).unionByName(refused.select("request_id", *nothing, "reason"))


@query("WITH " + COUNTED + """
SELECT doc_id, 1 AS part, page, text, NULL AS reason FROM doc_pages JOIN sized_docs USING (doc_id) WHERE page <= (n + 1) // 2
UNION ALL SELECT doc_id, 2, CAST(page - n // 2 AS INTEGER), text, NULL FROM doc_pages JOIN sized_docs USING (doc_id) WHERE page > n // 2 AND n > 1
UNION ALL SELECT doc_id, 2, NULL, NULL, 'Range 2-1 is invalid for a 1-page document.' FROM sized_docs WHERE n = 1""")
def split_documents(spark, folder):
    """Two overlapping halves of each document."""
    n = F.col("n")
    half = F.floor(n / 2).cast("int")
    counted = books(spark, folder).select("doc_id", F.size("pages").alias("n"))
    ranges = counted.select("doc_id", F.lit(1).alias("part"), F.lit(1).alias("first"), F.floor((n + 1) / 2).cast("int").alias("last")).unionByName(
        counted.select("doc_id", F.lit(2).alias("part"), F.when(n == 1, 2).otherwise(half + 1).alias("first"), n.alias("last")))
    ok, refused = P.split_ranges(books(spark, folder), ranges)
    pages = P.to_pages(ok, "doc_id", "part").withColumn("reason", F.lit(None).cast("string"))
    return pages.unionByName(refused.select("doc_id", "part", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "reason"))


@query("WITH " + SIZED_SQL + """
SELECT doc_id, page, CASE WHEN page % 4 <> 0 THEN ((doc_id % 4) * 90 + (page % 4 - 2) * 90 + 720) % 360 END AS new_rotation,
  CASE WHEN page % 4 = 0 THEN 'Rotation must be a multiple of 90 degrees.' END AS reason FROM sized""")
def rotated_pages(spark, folder):
    turned = sized_pages(spark, folder).withColumn("rotation", (F.col("doc_id") % 4).cast("int") * 90).withColumn(
        "degrees", F.when(F.col("page") % 4 == 0, 45).otherwise((F.col("page") % 4 - 2) * 90))
    return P.rotate_geometry(turned).select("doc_id", "page", "new_rotation", "reason")


@query("WITH " + SIZED_SQL + """,
b AS (SELECT doc_id, page, width, height, doc_id % 5 * 100.0 - 50 AS l, page % 4 * 100.0 - 30 AS b, 500.0 - page % 3 * 300 AS r, 600.0 AS t FROM sized)
SELECT doc_id, page, CASE WHEN ok THEN greatest(0, l) END AS new_l, CASE WHEN ok THEN greatest(0, b) END AS new_b, CASE WHEN ok THEN least(width, r) END AS new_r, CASE WHEN ok THEN least(height, t) END AS new_t, reason
FROM (SELECT *, reason IS NULL AS ok FROM (SELECT *, CASE WHEN r <= l OR t <= b THEN 'Crop box must have positive width and height.'
  WHEN least(width, r) <= greatest(0, l) OR least(height, t) <= greatest(0, b) THEN 'Crop box does not overlap page ' || page || '.' END AS reason FROM b))""")
def cropped_pages(spark, folder):
    i, page = F.col("doc_id"), F.col("page")
    boxed = sized_pages(spark, folder).select(
        "doc_id", "page", F.lit(0.0).alias("ml"), F.lit(0.0).alias("mb"), F.col("width").alias("mr"), F.col("height").alias("mt"),
        (i % 5 * 100.0 - 50).alias("l"), (page % 4 * 100.0 - 30).alias("b"), (500.0 - page % 3 * 300).alias("r"), F.lit(600.0).alias("t"))
    return P.crop_geometry(boxed).select("doc_id", "page", "new_l", "new_b", "new_r", "new_t", "reason")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS view_x, 800 - (l_quantity + 12) AS view_y, l_quantity AS view_width, 12.0 AS view_height FROM lineitem""")
def view_rectangles(spark, folder):
    q = F.col("l_quantity")
    words = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("x0"), q.alias("y0"), (q * 2).alias("x1"), (q + 12).alias("y1"), F.lit(800.0).alias("height"))
    return P.view_rect(words).select("l_orderkey", "l_linenumber", "l_partkey", "view_x", "view_y", "view_width", "view_height")


@query("WITH " + COUNTED + """
SELECT doc_id, page, page // 2 + 2 || ' of ' || (n + 1) // 2 + 1 AS label FROM doc_pages JOIN sized_docs USING (doc_id) WHERE page % 2 = 1""")
def odd_page_labels(spark, folder):
    chosen = F.filter(F.transform("pages", lambda p: p["page"]), lambda p: p % 2 == 1)
    return P.page_labels(books(spark, folder), chosen, "{page} of {total}", 2)


@query("WITH " + DOC_PAGES + """
SELECT doc_id, page, 'CASE-' || CASE WHEN length(k) < 6 THEN lpad(k, 6, '0') ELSE k END || '/x' AS label
FROM (SELECT doc_id, page, CAST(row_number() OVER (ORDER BY doc_id, page) + 99 AS VARCHAR) AS k FROM doc_pages)""")
def bates_numbers(spark, folder):
    return P.bates(books(spark, folder), "CASE-", "/x", 100, 6)


@query("SELECT o_custkey, o_orderkey, o_orderkey % 4 + 1 || ',' || CASE WHEN o_custkey % 4 = o_orderkey % 4 THEN '' ELSE o_custkey % 4 + 1 || ',' END || '9' AS selection FROM orders")
def unique_selections(spark, folder):
    a, b = F.col("o_orderkey") % 4 + 1, F.col("o_custkey") % 4 + 1
    picked = load(spark, folder, "orders").select("o_custkey", "o_orderkey", P.dedupe_selection(F.array(a, b, a, F.lit(9).cast("long"), b)).alias("s"))
    return picked.select("o_custkey", "o_orderkey", F.array_join("s", ",").alias("selection"))


@query("WITH " + DOC_PAGES + """,
e AS (SELECT doc_id, page - 1 AS i, length(text) % 3 AS d FROM doc_pages),
up AS (SELECT a.doc_id, a.i, a.d, max(b.i) AS p, (SELECT max(c.i) FROM e c WHERE c.doc_id = a.doc_id AND c.i < a.i AND c.d < a.d - 1) AS stop
  FROM e a LEFT JOIN e b ON b.doc_id = a.doc_id AND b.i < a.i AND b.d = a.d - 1 GROUP BY ALL)
SELECT doc_id, i AS position, d AS depth, CASE WHEN p IS NOT NULL AND (stop IS NULL OR stop < p) THEN p END AS parent FROM up""")
def outline_parents(spark, folder):
    entries = F.transform("pages", lambda p: F.struct((F.length(p["text"]) % 3).alias("depth"), p["text"].alias("title")))
    outlined = books(spark, folder).select("doc_id", entries.alias("e")).select("doc_id", "e", L.nest_outline(F.col("e")).alias("parents"))
    return outlined.select("doc_id", F.posexplode(F.arrays_zip("e", "parents")).alias("position", "z")).select(
        "doc_id", "position", F.col("z.e.depth").alias("depth"), F.col("z.parents").alias("parent"))


# ------------------------------------------------------------------ recognised words
# Words of a page with made-up boxes and scores derived from their place.

@query("WITH " + DOC_PAGES + f""",
w AS (SELECT doc_id, page, unnest(range(len(t))) AS i FROM (SELECT doc_id, page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM doc_pages)),
m AS (SELECT doc_id, page, avg(CASE WHEN (doc_id + page + i) % 7 <> 0 THEN ((doc_id + page * 3 + i) % 20) * 5.0 END) AS mean FROM w WHERE doc_id % 3 <> 0 OR page <> 1 OR i < 0 GROUP BY ALL)
SELECT doc_id, {py_round('avg(mean)', 1)} AS mean_confidence, count(*) AS page_count, count(*) FILTER (mean <> 0) AS pages_reported FROM m GROUP BY doc_id""")
def ocr_confidence(spark, folder):
    words = S.words(P.to_pages(books(spark, folder), "doc_id"), "doc_id", "page").filter((F.col("doc_id") % 3 != 0) | (F.col("page") != 1))
    i = F.col("doc_id") + F.col("page") + F.col("word_no")
    scored = words.withColumn("conf", F.when(i % 7 == 0, -1.0).otherwise(((F.col("doc_id") + F.col("page") * 3 + F.col("word_no")) % 20) * 5.0))
    return ST.ocr_confidence(scored, ["doc_id"])


@query("""SELECT l_orderkey, l_partkey, l_quantity AS conf FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey % 5 <> 0""")
def recognised_words(spark, folder):
    words = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, " \t").otherwise(" w ").alias("text"),
        F.when(F.col("l_partkey") % 10 == 0, "n/a").when(F.col("l_partkey") % 5 == 0, "-1").otherwise(F.col("l_quantity").cast("string")).alias("conf"))
    return ST.clean_ocr_words(words).select("l_orderkey", "l_partkey", F.col("conf").cast("double").alias("conf"))


@query("WITH " + DOC_PAGES + """,
w AS (SELECT doc_id, page, i, length(t[i]) AS n FROM (SELECT doc_id, page, t, unnest(range(1, len(t) + 1)) AS i FROM (
  SELECT doc_id, page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM doc_pages)))
SELECT doc_id, page, CAST((i - 1) // 24 AS INTEGER) AS hit, CAST((i - 1) // 8 % 3 AS INTEGER) AS line_no, min((i - 1) % 8 * 40.0) AS x,
  max((i - 1) % 8 * 40.0 + n * 5.0) - min((i - 1) % 8 * 40.0) AS width, 10.0 AS height FROM w GROUP BY ALL""")
def line_rectangles(spark, folder):
    """Runs of 24 words stand for hits: eight words to a line, lines 20 apart, words of one line shifted by a hair."""
    words = F.transform(T.word_list(F.col("text")), lambda w, i: F.struct(
        ((i % 8) * 40.0).alias("x"), (F.floor(i / 8) * 20.0 + (i % 2) * 0.5).cast("double").alias("y"), (F.length(w) * 5.0).alias("width"), F.lit(10.0).alias("height")))
    # Asked of the text: asked of the words, the page would be cut into words twice.
    boxes = P.to_pages(books(spark, folder), "doc_id").filter(~T.is_blank(F.col("text"))).select("doc_id", "page", words.alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 24).cast("int")), lambda k: F.slice("w", k * 24 + 1, 24))
    hits = boxes.select("doc_id", "page", F.posexplode(runs).alias("hit", "run"))
    lined = hits.select("doc_id", "page", "hit", F.posexplode(S.line_rects(F.col("run"))).alias("line_no", "r"))
    return lined.select("doc_id", "page", "hit", "line_no", "r.x", "r.width", "r.height")


@query("WITH " + DOC_PAGES + """,
w AS (SELECT doc_id, page, i, t[i] AS word, sum(length(g[i]) + length(t[i])) OVER (PARTITION BY doc_id, page ORDER BY i) - length(t[i]) AS s FROM (SELECT doc_id, page, t, g, unnest(range(1, len(t) + 1)) AS i FROM (
  SELECT doc_id, page, regexp_extract_all(text, '\\S+') AS t, string_split_regex(text, '\\S+') AS g FROM doc_pages)))
SELECT doc_id, page, CAST(s AS INTEGER) AS start, word FROM w WHERE s < 30 AND s + length(word) > 20""")
def words_under_spans(spark, folder):
    pages = P.to_pages(books(spark, folder), "doc_id")
    spans = pages.select("doc_id", "page", F.lit(20).alias("start"), F.lit(30).alias("end"))
    found = S.words_in_span(spans, pages, ["doc_id", "page"])
    return found.select("doc_id", "page", F.col("word_start").alias("start"), "word")


# ------------------------------------------------------------------ files and uploads

@query()
def scanned_files(spark, folder):
    return IO.scan_files(spark, f"{folder}/*.parquet")


@query("""
SELECT p_partkey, p_name || chr(31) || p_brand || chr(31) || '"' || p_type || '", ' || p_size AS cells FROM part""")
def csv_rows(spark, folder):
    """Parts written as CSV, cells with commas and quotes among them, and read back as rows of cells."""
    path = scratch_path(spark, "csv")
    part = load(spark, folder, "part").select(F.col("p_partkey").cast("string"), "p_name", "p_brand", F.concat(F.lit('"'), "p_type", F.lit('", '), F.col("p_size").cast("string")).alias("kind"))
    part.write.option("escape", '"').option("quoteAll", True).csv(path)
    rows = IO.read_csv_rows(spark, path)
    return rows.select(F.get("cells", F.lit(0)).cast("long").alias("p_partkey"), F.array_join(F.slice("cells", 2, 3), "\x1f").alias("cells"))


HEADS = ["255044462d312e37", "6a756e6b0a255044462d", "89504e470d0a1a0a", "ffd8ff", "474946383961", "424d", "49492a00", "7b5c727466", "d0cf11e0a1b11ae1",
         "4d5a", "7f454c46", "2321", "504b0304", "52494646000000005745425056", "00ff00", "20203c21444f43545950452068746d6c3e", ""]
EXTENSIONS = ["pdf", "exe", "csv", "MD", "htm", "txt"]
FORMAT_SQL = f"""
files AS (
  SELECT doc_id, {choose_sql(HEADS, 'doc_id')} || hex(encode(text)) AS h, 'scan ' || doc_id || '.' || {choose_sql(EXTENSIONS, 'doc_id // 17')} AS filename FROM documents
),
sniffed AS (SELECT *, lower(string_split(filename, '.')[-1]) AS ext, ltrim(lower(h), '20') AS lh FROM files),
formats AS (SELECT *, CASE
  WHEN length(h) = 0 THEN 'empty' WHEN contains(lower(h)[1:2048], '255044462d') THEN 'pdf'
  WHEN starts_with(h, '4d5a') OR starts_with(h, '7f454c46') OR starts_with(h, '2321') THEN 'blocked' WHEN starts_with(h, '504b0304') THEN 'zip'
  WHEN starts_with(h, '89504e470d0a1a0a') THEN 'png' WHEN starts_with(h, 'ffd8ff') THEN 'jpg' WHEN starts_with(h, '474946383961') THEN 'gif'
  WHEN starts_with(lower(h), '424d') THEN 'bmp' WHEN starts_with(h, '49492a00') THEN 'tiff' WHEN starts_with(h, 'd0cf11e0a1b11ae1') THEN 'ole'
  WHEN starts_with(h, '52494646000000005745425') THEN 'webp' WHEN starts_with(h, '00ff00') THEN 'unknown'
  WHEN ext = 'csv' THEN 'csv' WHEN ext = 'md' THEN 'md' WHEN ext = 'htm' THEN 'html' WHEN doc_id % 17 = 15 THEN 'html' ELSE 'txt' END AS format FROM sniffed)"""


def raw_files(spark, folder):
    i = F.col("doc_id")
    return documents(spark, folder).select(
        "doc_id", F.unhex(F.concat(choose(HEADS, i), F.hex(F.col("text").cast("binary")))).alias("content"),
        F.concat(F.lit("scan "), i.cast("string"), F.lit("."), choose(EXTENSIONS, F.floor(i / 17))).alias("filename"))


@query("WITH " + FORMAT_SQL + " SELECT doc_id, filename, format, format NOT IN ('blocked', 'zip', 'ole', 'unknown', 'empty') AS convertible FROM formats")
def file_formats(spark, folder):
    return IO.detect_format(raw_files(spark, folder)).select("doc_id", "filename", "format", "convertible")


@query(f"""
WITH n AS (SELECT p_partkey, list_extract(['C:\\up\\', '/tmp/', ''], p_partkey % 3 + 1) || list_extract(['con', 'report: v', 'a.b', '..', 'lpt1.x'], p_partkey % 5 + 1) || CASE WHEN p_partkey % 11 = 0 THEN repeat('y', 220) ELSE '' END
    || list_extract(['.pdf', '.JPEG', '', '.exe'], p_partkey % 4 + 1) AS filename, CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 17 = 0 THEN 209715201 ELSE p_size * 1000 END AS size,
    list_extract(['pdf', 'jpg', 'zip', 'md'], CAST(p_partkey % 7 % 4 AS INTEGER) + 1) AS format FROM part),
c AS (SELECT *, trim(regexp_replace(string_split(replace(filename, '\\', '/'), '/')[-1], '[^A-Za-z0-9._ -]', '_', 'g'), '. ') AS base FROM n),
d AS (SELECT *, CASE WHEN contains(base, '.') THEN regexp_extract(base, '^(.*)\\.[^.]*$', 1) ELSE '' END AS stem FROM c),
e AS (SELECT *, CASE WHEN base = '' THEN 'document.pdf' WHEN upper(stem) IN ('CON', 'LPT1') OR upper(base) IN ('CON', 'LPT1') THEN 'file_' || base ELSE base END AS named FROM d),
f AS (SELECT *, CASE WHEN length(named) > 200 THEN CASE WHEN contains(named, '.') AND string_split(named, '.')[-1] <> '' THEN regexp_extract(named, '^(.*)\\.[^.]*$', 1)[1:190] || '.' || string_split(named, '.')[-1] ELSE named[1:200] END ELSE named END AS safe FROM e),
g AS (SELECT *, size > 0 AND size <= 209715200 AND format <> 'zip' AS ok, lower(string_split(safe, '.')[-1]) AS ext FROM f)
SELECT p_partkey, ok, CASE WHEN size = 0 THEN 'The uploaded file is empty.' WHEN size > 209715200 THEN 'File exceeds the 200 MB limit.' WHEN format = 'zip' THEN 'refused' ELSE 'ok' END AS message,
  CASE WHEN NOT ok THEN safe WHEN contains(safe, '.') AND (ext = format OR format = 'jpg' AND ext = 'jpeg' OR format = 'md' AND ext = 'markdown') THEN safe
    ELSE CASE WHEN contains(safe, '.') THEN regexp_extract(safe, '^(.*)\\.[^.]*$', 1) ELSE safe END || '.' || format END AS safe_name FROM g""")
def upload_checks(spark, folder):
    i = F.col("p_partkey")
    manifest = load(spark, folder, "part").select(
        "p_partkey", F.concat(choose(["C:\\up\\", "/tmp/", ""], i), choose(["con", "report: v", "a.b", "..", "lpt1.x"], i),
                              F.when(i % 11 == 0, F.repeat(F.lit("y"), F.lit(220))).otherwise(""), choose([".pdf", ".JPEG", "", ".exe"], i)).alias("filename"),
        F.when(i % 13 == 0, 0).when(i % 17 == 0, (200 << 20) + 1).otherwise(F.col("p_size") * 1000).alias("size"),
        choose(["pdf", "jpg", "zip", "md"], i % 7).alias("format"))
    judged = IO.validate_manifest(manifest.withColumn("convertible", F.col("format") != "zip").withColumn("reason", F.lit("refused")))
    return judged.select("p_partkey", "ok", "message", "safe_name")


# ------------------------------------------------------------------ exports

@query("WITH " + DOC_PAGES + """
SELECT doc_id, string_agg(rtrim('--- Page ' || page || ' ---' || chr(10) || text, E' \\t\\n\\r'), chr(10) || chr(10) ORDER BY page) AS body FROM doc_pages GROUP BY doc_id""")
def exported_text(spark, folder):
    return X.export(books(spark, folder), "txt").select("doc_id", "body")


LINES_SQL = DOC_PAGES + f""",
all_lines AS (SELECT doc_id, page, i - 1 AS line_no, {STRIP.format('l[i]')} AS line FROM (SELECT doc_id, page, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT doc_id, page, string_split(text, chr(10)) AS l FROM doc_pages))),
shown AS (SELECT * FROM all_lines WHERE line <> '')"""
HEADING = """(len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) <= 9 AND NOT regexp_matches(line, '[.,;:]$')
  AND regexp_matches(line, '[\\p{Lu}\\p{Ll}]') AND (NOT regexp_matches(line, '\\p{Ll}') OR NOT regexp_matches(line, '(^|[^\\p{Lu}\\p{Ll}])\\p{Ll}') AND NOT regexp_matches(line, '[\\p{Lu}\\p{Ll}]\\p{Lu}')))"""


@query("WITH " + LINES_SQL + f"""
SELECT doc_id, page, CAST(line_no AS INTEGER) AS line_no, CASE WHEN {HEADING} THEN '## ' || line ELSE line END AS markdown
FROM (SELECT doc_id, page, line_no, CASE WHEN (doc_id + line_no) % 3 = 0 THEN rtrim(line, '.') ELSE line END AS line FROM shown)""")
def markdown_lines(spark, folder):
    """Every third line loses its stop, so that some can be headings."""
    lines = X.page_lines(books(spark, folder), "doc_id").withColumn("line", F.when(
        (F.col("doc_id") + F.col("line_no")) % 3 == 0, F.rtrim(F.col("line"), F.lit("."))).otherwise(F.col("line")))
    return lines.filter(F.col("line") != "").select("doc_id", "page", "line_no", X.marked_line(F.col("line")).alias("markdown"))


@query("WITH " + LINES_SQL + f""",
parts AS (SELECT doc_id, page, -1 AS line_no, chr(10) || '<!-- page ' || page || ' -->' || chr(10) AS part FROM doc_pages
  UNION ALL SELECT doc_id, page, line_no, CASE WHEN {HEADING} THEN '## ' || line ELSE line END || chr(10) FROM shown)
SELECT doc_id, {STRIP.format("string_agg(part, chr(10) ORDER BY page, line_no)")} AS body FROM parts GROUP BY doc_id""")
def exported_markdown(spark, folder):
    return X.export(books(spark, folder), "md").select("doc_id", "body")


@query("WITH " + LINES_SQL + f""",
paragraphs AS (SELECT doc_id, page, string_agg('<p>' || replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>', '' ORDER BY line_no) AS p FROM shown GROUP BY ALL)
SELECT doc_id, '{fixed.HTML_HEAD}' || string_agg('<section class="page" id="page-' || page || '"><h2>Page ' || page || '</h2>' || coalesce(p, '') || '</section>', '' ORDER BY page) || '</body></html>' AS body
FROM doc_pages LEFT JOIN paragraphs USING (doc_id, page) GROUP BY doc_id""")
def exported_html(spark, folder):
    return X.export(books(spark, folder), "html").select("doc_id", "body")


# Every page's lines, parted into words, stand for one detected table.
def page_tables(spark, folder):
    found = F.transform("pages", lambda p: F.struct(
        p["page"].alias("page"), F.lit(1).alias("index"), F.transform(F.split(p["text"], "\n", -1), T.word_list).alias("rows")))
    return books(spark, folder).select("doc_id", found.alias("tables"))


@query("WITH " + DOC_PAGES + """
SELECT doc_id, page, text, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS words, 1 AS tables,
  array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_filter(string_split_regex(l, '\\s+'), lambda x: x <> ''), chr(31))), chr(30)) AS cells FROM doc_pages""")
def exported_json(spark, folder):
    """The written JSON, read again: text, words and tables of every page."""
    bodies = X.export_json(books(spark, folder), page_tables(spark, folder))
    pages = bodies.select("doc_id", F.explode(F.from_json("body", "pages array<struct<page:int,text:string,words:array<string>,tables:array<array<array<string>>>>>")["pages"]).alias("p"))
    rows = F.transform(F.get("p.tables", F.lit(0)), lambda r: F.array_join(r, "\x1f"))
    return pages.select("doc_id", "p.page", "p.text", F.array_join("p.words", " ").alias("words"), F.size("p.tables").alias("tables"), F.array_join(rows, "\x1e").alias("cells"))


def one_table_per_row(spark, folder):
    return page_tables(spark, folder).select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.page", "t.index", "t.rows")


@query("WITH " + DOC_PAGES + """,
r AS (SELECT doc_id, page, k, list_filter(string_split_regex(l[k], '\\s+'), lambda x: x <> '') AS cells FROM (SELECT doc_id, page, l, unnest(range(1, len(l) + 1)) AS k FROM (
  SELECT doc_id, page, string_split(text, chr(10)) AS l FROM doc_pages))),
q AS (SELECT doc_id, page, k, array_to_string(list_transform(cells, lambda c: CASE WHEN contains(c, ',') OR contains(c, '"') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',') AS line FROM r)
SELECT doc_id, page, CAST(k AS INTEGER) AS line_no, coalesce(line, '') AS line FROM q
UNION ALL SELECT doc_id, page, 0, '# Page ' || page || ' — table 1' FROM doc_pages
UNION ALL SELECT doc_id, page, CAST(max(k) + 1 AS INTEGER), '' FROM q GROUP BY doc_id, page""")
def exported_tables(spark, folder):
    return X.export_tables(one_table_per_row(spark, folder)).select("doc_id", "page", "line_no", "line")


@query("WITH " + DOC_PAGES + """,
r AS (SELECT doc_id, page, k, list_filter(string_split_regex(l[k], '\\s+'), lambda x: x <> '') AS cells FROM (SELECT doc_id, page, l, unnest(range(1, len(l) + 1)) AS k FROM (
  SELECT doc_id, page, string_split(text, chr(10)) AS l FROM doc_pages))),
q AS (SELECT doc_id, page, k, array_to_string(list_transform(cells, lambda c: CASE WHEN contains(c, ',') OR contains(c, '"') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',') AS line FROM r),
t AS (SELECT doc_id, page, '# Page ' || page || ' — table 1' || chr(10) || string_agg(coalesce(line, ''), chr(10) ORDER BY k) || chr(10) AS body FROM q GROUP BY doc_id, page)
SELECT doc_id, 'csv' AS target, 'structural' AS fidelity, sha256(string_agg(body, chr(10) ORDER BY page)) AS digest FROM t GROUP BY doc_id
UNION ALL SELECT doc_id, 'txt', 'text-only', sha256(string_agg(rtrim('--- Page ' || page || ' ---' || chr(10) || text, E' \\t\\n\\r'), chr(10) || chr(10) ORDER BY page)) FROM doc_pages GROUP BY doc_id""")
def written_exports(spark, folder):
    """Documents written in two forms with the fidelity each declares, read back."""
    found = X.write_exports(books(spark, folder), ["csv", "txt"], scratch_path(spark, "exports"), page_tables(spark, folder))
    return found.select("doc_id", "target", "fidelity", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN ' 1,2' || l_partkey WHEN 1 THEN '-' || l_partkey || '.50' WHEN 2 THEN l_partkey || 'x' WHEN 3 THEN chr(7) || l_partkey WHEN 4 THEN '-,' ELSE '.5' END AS cell FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN CAST('12' || l_partkey AS BIGINT) WHEN 3 THEN l_partkey END AS whole,
  CASE l_partkey % 6 WHEN 1 THEN -(l_partkey + 0.5)::DOUBLE END AS real, CASE l_partkey % 6 WHEN 2 THEN l_partkey || 'x' WHEN 4 THEN '-,' WHEN 5 THEN '.5' END AS word FROM c""")
def coerced_cells(spark, folder):
    p = F.col("l_partkey")
    s = p.cast("string")
    cell = (F.when(p % 6 == 0, F.concat(F.lit(" 1,2"), s)).when(p % 6 == 1, F.concat(F.lit("-"), s, F.lit(".50"))).when(p % 6 == 2, F.concat(s, F.lit("x")))
            .when(p % 6 == 3, F.concat(F.lit("\x07"), s)).when(p % 6 == 4, "-,").otherwise(".5"))
    typed = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.coerce_cell(cell).alias("v"))
    return typed.select("l_orderkey", "l_linenumber", "l_partkey", F.col("v.i").cast("long").alias("whole"), F.col("v.d").alias("real"), F.col("v.s").alias("word"))


@query("SELECT conv_id, turn, text || '|' || chr(9) AS clean FROM conversations")
def xml_safe_text(spark, folder):
    talk = load(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("\x01\x08"), "text", F.lit("|\x0b\t\ufffe")).alias("t"))
    return talk.select("conv_id", "turn", X.xml_safe(F.col("t")).alias("clean"))


# Whole turns as light markup: their first line is a heading of one to four marks, a list follows.
@query("""
WITH m AS (SELECT conv_id, turn, repeat('#', CAST(turn % 4 + 1 AS INTEGER)) || ' ' || text || chr(10) || chr(10) || chr(10) || '- one ' || chr(10) || '* two' || chr(10) || chr(10) || '  ' || chr(10) AS t FROM conversations),
b AS (SELECT conv_id, turn, i, regexp_replace(l[i], '^\\n+|\\n+$', '', 'g') AS b FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, string_split(t, chr(10) || chr(10)) AS l FROM m))),
n AS (SELECT conv_id, turn, i, list_transform(string_split(b, chr(10)), lambda x: rtrim(x, E' \\t\\r')) AS ls FROM b WHERE trim(b, E' \\t\\n\\r') <> ''),
k AS (SELECT *, list_filter(ls, lambda x: x <> '') AS shown, ltrim(ls[1], E' \\t\\r') AS first FROM n),
h AS (SELECT *, length(regexp_extract(first, '^#*')) AS level, trim(regexp_replace(first, '^#*', ''), E' \\t\\r') AS title, list_bool_and(list_transform(shown, lambda x: ltrim(x, E' \\t\\r')[1:2] IN ('- ', '* '))) AS listed FROM k),
r AS (SELECT *, level BETWEEN 1 AND 3 AND title <> '' AS headed, trim(array_to_string(CASE WHEN level BETWEEN 1 AND 3 AND title <> '' THEN ls[2:] ELSE ls END, chr(10)), E' \\t\\n\\r') AS rest FROM h),
o AS (SELECT conv_id, turn, i, 0 AS part, 'list' AS kind, 0 AS level, array_to_string(list_transform(shown, lambda x: trim(ltrim(x, E' \\t\\r')[3:], E' \\t\\r')), chr(10)) AS body FROM r WHERE listed
  UNION ALL SELECT conv_id, turn, i, 0, 'heading', level, title FROM r WHERE NOT listed AND headed
  UNION ALL SELECT conv_id, turn, i, 1, 'paragraph', 0, rest FROM r WHERE NOT listed AND rest <> '')
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, part) - 1 AS INTEGER) AS block_no, kind, CAST(level AS INTEGER) AS level, body FROM o""")
def typed_blocks(spark, folder):
    marked = load(spark, folder, "conversations").select("conv_id", "turn", F.concat(
        F.repeat(F.lit("#"), (F.col("turn") % 4 + 1).cast("int")), F.lit(" "), "text", F.lit("\n\n\n- one \n* two\n\n  \n")).alias("text"))
    return X.block_types(marked, "conv_id", "turn")


