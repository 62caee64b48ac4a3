"""Line deduplication with content-defined chunks.

Lines are hashed; a rolling hash over each line hash and the next one decides whether a
chunk may begin there (15 lines of 16 may). A chunk runs from its boundary to the next one at
least `LEAST_LINES` lines on, so chunks overlap and a passage is covered to its edges wherever it stands:
an insertion moves only the chunks that touch it. A chunk that occurs again anywhere in the
corpus stays at its first place (smallest id, then position); elsewhere its lines are removed.
Hashes alone find repeats; then only chunks with a repeated hash are put together and compared byte by
byte (their smallest and greatest text must be the same string); where bytes differ under one
hash, nothing is removed.

Null text stays null, empty text stays empty. Rows equal in id and text count as one
document: both keep or lose the same lines. A null id comes before all others. An empty
table gives an empty table; other columns pass through under any name. Very long texts are one row as any
other, without recursion. No Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scale
from paperloom.llm.common import stash

LEAST_LINES = 2
BELOW = "f"  # a boundary's rolling hash is below this


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc, mark, lines, spans): the document's row, its id, a key of id and text, its lines and the chunks in them.

    Each step is a projection of its own, so that later ones read its result.
    """
    mark = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    lined = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc"), F.unhex(mark).alias("mark"), F.split(F.col(text), "\n", -1).alias("lines"))
    hashed = lined.withColumn("hashes", F.transform("lines", lambda line: F.md5(line.cast("binary"))))
    begun = hashed.withColumn("begins", F.filter(F.transform("hashes", lambda h, i: F.when(
        F.md5(F.concat(h, F.coalesce(F.get("hashes", i + 1), F.lit(""))).cast("binary")) < BELOW, i)), lambda i: i.isNotNull()))

    def end(begin: Column, n: Column) -> Column:
        """The next boundary far enough on: boundaries grow by one at least, so it is among the next LEAST_LINES."""
        found = F.size("lines")
        for ahead in range(LEAST_LINES, 0, -1):
            at = F.get("begins", n + ahead)
            found = F.when(at >= begin + LEAST_LINES, at).otherwise(found)
        return found
    spans = F.transform("begins", lambda b, n: F.struct(b.alias("first"), end(b, n).alias("stop")))
    return begun.withColumn("spans", F.filter(spans, lambda s: s["stop"] - s["first"] >= LEAST_LINES)).drop("hashes", "begins")


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chunk: place, hash and text."""
    # Chunks are put together inside the row, so that no row of a chunk carries all lines of its document. Lines are
    # fetched by number: a slice copies the whole array first.
    held = F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["stop"].alias("stop"), F.array_join(
        F.transform(F.sequence(s["first"], s["stop"] - 1), lambda i: F.get("lines", i)), "\n").alias("body")))
    # An outer explode: before a plain one Spark filters by the array's size, and pushes that down to the table, where
    # every hash of a document is made again for each of its lines.
    rows = chunked(docs.select(key, text), key, text).select("doc", "mark", held.alias("held")).select("doc", "mark", F.explode_outer("held").alias("s")).filter("s IS NOT NULL")
    return rows.select(F.struct("doc", "mark", "s.first", "s.stop").alias("place"), F.unhex(F.md5(F.col("s.body").cast("binary"))).alias("hash"), F.col("s.body").alias("body"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(hash, place, first): every place but the first of chunks found at two places or more, all with the same bytes."""
    every = chunks(docs, key, text)
    found = stash(every.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter(
        F.col("first") != F.col("last")).select("hash", "first"), "line-hashes")
    held = stash(scale.sieve(every, found, ["hash"]).join(found, "hash"), "line-repeats")
    same = held.groupBy("hash").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter(F.col("low") == F.col("high")).select("hash")
    return held.filter(~F.col("place").eqNullSafe(F.col("first"))).join(same, "hash", "left_semi").select("hash", "place", "first")


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """`docs` without repeated chunks; `removed` names a column for the number of chunks taken out."""
    gone = repeats(docs, key, text).groupBy(F.col("place.mark").alias("mark")).agg(F.collect_set(F.struct("place.first", "place.stop")).alias("gone"))
    # Lines covered by removed chunks, laid down once: a chunk's lines are numbers from first to stop.
    gone = gone.select("mark", F.size("gone").alias("times"), F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["stop"] - 1)))).alias("out"))
    rows = chunked(docs, key, text).select("row", "mark").join(gone, "mark", "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out")), lambda i: F.get("lines", i))
    rest = rows.withColumn("lines", F.split(F.col(f"row.{text}"), "\n", -1)).withColumn("body", F.when(F.col("out").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(kept, "\n")))
    columns = [F.col("body").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rest.select(*columns, *([F.coalesce("times", F.lit(0)).alias(removed)] if removed else []))


def remaining(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents without repeated chunks; those of which nothing is left go, `size` follows the text."""
    times = "removed"
    while times in docs.columns:
        times += "_"
    rest = dedupe(docs, key, text, removed=times).filter((F.col(times) == 0) | (F.col(text) != ""))
    if size in docs.columns:
        rest = rest.withColumn(size, F.when(F.col(times) == 0, F.col(size)).otherwise(F.length(text)).cast(docs.schema[size].dataType))
    return rest.drop(times)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the chunks removed, and length and digest of what is left."""
    return dedupe(docs.select(key, text), key, text, removed="n_removed").select(
        F.col(key).alias("doc_id"), F.col("n_removed").cast("long").alias("n_removed"),
        F.length(text).cast("long").alias("n_chars"), F.md5(F.col(text).cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(0) || coalesce(text, '')) AS k FROM documents),
l AS (SELECT DISTINCT doc_id, k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
r AS (SELECT *, md5(md5(line) || coalesce(lead(md5(line)) OVER w, '')) < 'f' AS begins, count(*) OVER (PARTITION BY doc_id, k) AS n FROM l WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
s AS (SELECT doc_id, k, i, n, lead(i) OVER w AS one, lead(i, 2) OVER w AS two FROM r WHERE begins WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
c AS (SELECT doc_id, k, i, CASE WHEN one >= i + 2 THEN one ELSE coalesce(two, n) END AS stop FROM s),
b AS (SELECT c.doc_id, c.k, c.i, c.stop, string_agg(line, chr(10) ORDER BY l.i) AS body FROM c JOIN l ON l.doc_id = c.doc_id AND l.k = c.k AND l.i >= c.i AND l.i < c.stop WHERE c.stop - c.i >= 2 GROUP BY ALL),
g AS (SELECT doc_id, k, i, stop FROM b QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, k, i) > 1),
o AS (SELECT DISTINCT doc_id, k, unnest(range(i, stop)) AS i FROM g),
n AS (SELECT doc_id, k, count(*) AS n_removed FROM g GROUP BY doc_id, k),
t AS (SELECT l.doc_id, l.k, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (o.i IS NULL), '') AS kept FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.k = l.k AND o.i = l.i GROUP BY l.doc_id, l.k)
SELECT d.doc_id, coalesce(n.n_removed, 0) AS n_removed, length(CASE WHEN d.text IS NULL THEN NULL ELSE t.kept END) AS n_chars, md5(CASE WHEN d.text IS NULL THEN NULL ELSE t.kept END) AS text_md5
FROM d LEFT JOIN t ON d.doc_id = t.doc_id AND d.k = t.k LEFT JOIN n ON n.doc_id = d.doc_id AND n.k = d.k
"""
