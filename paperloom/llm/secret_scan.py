"""Credentials in text, judged by how widely the corpus repeats them.

Every text yields candidates: values assigned to telling names, access-key ids, long hex
runs and bare mixed tokens. Hashes of their values are counted over the whole corpus by
distinct owners and distinct repositories (two roll-ups with partial sums). A value that
many owners carry is a copied example; one held by few owners that mixes letters and digits
looks live. Named, keyed and hex candidates are always reported; a bare token is added only
when it looks live and lies outside the others.

Null text counts as empty. A null owner is an owner of its own, a null repository likewise.
Rows equal in id and text are reported each, with equal results. No Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.llm.common import stash

NAME = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
VALUE = r"[A-Za-z0-9+/_.=-]"
#: Kinds in report order: pattern, shortest value.
KINDS = (
    ("assign", rf"{NAME}{VALUE}++", 6),
    ("access", r"AKIA[A-Z0-9]{16,}+", 20),
    ("hex", r"[0-9a-f]{24,}+", 24),
    ("bare", rf"(?<!{VALUE}){VALUE}{{20,}}+", 20),
)
BASE = 3  # the first kinds, always reported
WIDELY = 3  # a value under at least so many owners is a copied example
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|x{6,}|0{8,}|1234567|abcdef(?:gh|0)"
DISTINCT = 5  # a value of fewer different characters is a placeholder too


def candidates(text: str) -> Column:
    """array<struct<start,kind_no,kind,end,value_hash,lively>> of one row, by start, then kind."""
    groups = []
    for number, (kind, pattern, shortest) in enumerate(KINDS):
        value = f"regexp_replace(h.value, {T.literal('^' + NAME)}, '')" if kind == "assign" else "h.value"
        lively = (f"v rlike '[0-9]' and v rlike '[A-Za-z]' and not v rlike {T.literal(PLACEHOLDER)} "
                  f"and size(array_distinct(filter(split(v, ''), x -> x <> ''))) >= {DISTINCT}")
        made = T.let_sql(value, "v", (
            f"named_struct('start', h.start, 'kind_no', {number}, 'kind', '{kind}', 'end', h.start + length(h.value), "
            f"'size', length(v), 'value_hash', md5(v), 'lively', {lively})"))
        groups.append(f"filter(transform({T.find_all_sql(text, pattern)}, h -> {made}), c -> c.size >= {shortest})")
    return F.expr(f"array_sort(concat({', '.join(groups)}))")


def row_key(key: Column, body: Column) -> Column:
    """Names a row by id and text."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit("\x00"), body).cast("binary"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document with its candidates: key, row_key, found (all) and the owner's columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), body.alias("_text"),
    ).select(
        "key", "owner", "repository",
        row_key(F.col("key"), F.col("_text")).alias("row_key"),
        candidates("_text").alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate hash."""
    seen = found.select("owner", "repository", F.explode("found.value_hash").alias("value_hash"))
    by_repository = seen.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("times").alias("times"))
    return by_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("times").alias("times"))


def spans_by_row(found: DataFrame, widely: int = WIDELY) -> DataFrame:
    """(row_key, spans): array<struct<start,kind_no,kind,end,owners,repositories,live>>, reported ones only.

    Rows without a candidate are absent; rows with the same key have one entry.
    """
    owned = found.select("row_key", F.explode("found").alias("c")).select("row_key", "c.*").join(ownership(found), "value_hash")
    live = F.col("lively") & (F.col("owners") < widely)
    spans = owned.select("row_key", F.struct("start", "kind_no", "kind", "end", "owners", "repositories", live.alias("live")).alias("s")).groupBy(
        "row_key").agg(F.array_sort(F.collect_set("s")).alias("all"))
    return spans.select("row_key", F.expr(
        f"filter(all, s -> s.kind_no < {BASE} or (s.live and not exists(all, b -> b.kind_no < {BASE} and b.start < s.end and s.start < b.end)))"
    ).alias("spans"))


def judged(docs: DataFrame, widely: int = WIDELY, **columns: str) -> DataFrame:
    """Per document: key and spans, empty where nothing is reported."""
    found = stash(scan(docs, **columns), "secret-candidates")
    rows = found.select("key", "row_key").join(spans_by_row(found, widely), "row_key", "left")
    empty = F.array().cast(rows.schema["spans"].dataType)
    return rows.select("key", F.coalesce("spans", empty).alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", widely: int = WIDELY, **columns: str) -> DataFrame:
    """The documents with live-looking secrets masked; `size` follows the text."""
    found = stash(scan(docs, key=key, text=text, **columns), "secret-candidates")
    live = spans_by_row(found, widely).select(
        F.col("row_key").alias("_ss_key"), F.filter("spans", lambda s: s["live"]).alias("_ss_spans")).filter(F.size("_ss_spans") > 0)
    rows = docs.withColumn("_ss_key", row_key(F.col(key), F.coalesce(F.col(text), F.lit("")))).join(live, "_ss_key", "left")
    hit = F.col("_ss_spans").isNotNull()
    done = rows.withColumn(text, F.when(hit, masked(F.col(text), F.col("_ss_spans"))).otherwise(F.col(text)))
    if size in docs.columns:
        done = done.withColumn(size, F.when(hit, F.length(text)).otherwise(F.col(size)).cast(docs.schema[size].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts, digest of the base spans and the list of all spans per document."""
    rows = judged(docs, **options)
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.kind = '{kind}')))").alias(f"n_{kind}") for kind, _, _ in KINDS[:BASE]]
    return rows.select(
        F.col("key").alias("doc_id"), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_not_live"))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """`text` with the live spans replaced; overlapping spans are replaced together."""
    live = F.filter(spans, lambda s: s["live"])
    step = F.aggregate(
        live, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(
                F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).alias("parts"))))
    return F.when(F.size(live) == 0, text).otherwise(T.let(step, lambda done: F.concat(
        F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))))


def _found_sql(number: int) -> str:
    """Matches of one kind in SQL: the pieces between matches give the places."""
    kind, pattern, shortest = KINDS[number]
    plain = {"assign": NAME.replace("*+", "*") + VALUE + "+", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "bare": VALUE + "+"}[kind].replace("'", "''")
    value = f"regexp_replace(m, '^{NAME.replace('*+', '*')}', '')".replace("[\\\"']", "[\\\"'']") if kind == "assign" else "m"
    return f"""SELECT doc_id, source, {number} AS kind_no, '{kind}' AS kind, start, start + length(m) AS stop, {value} AS v FROM (
      SELECT doc_id, source, m, CAST(sum(gap + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start FROM (
        SELECT doc_id, source, i, ms[i] AS m, length(gs[i]) AS gap FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, source, regexp_extract_all(t, '{plain}') AS ms, string_split_regex(t, '{plain}') AS gs FROM d))))
      WHERE length({value}) >= {shortest}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found_sql(n) for n in range(len(KINDS)))}),
o AS (SELECT v, count(DISTINCT source) AS owners FROM f GROUP BY v),
j AS (SELECT f.*, owners < {WIDELY} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{PLACEHOLDER}')
  AND len(list_distinct(string_split(v, ''))) >= {DISTINCT} AS live FROM f JOIN o USING (v)),
k AS (SELECT *, kind || ':' || start || ':' || stop AS s FROM j WHERE kind_no < {BASE} OR live AND NOT EXISTS (
  SELECT 1 FROM j b WHERE b.doc_id = j.doc_id AND b.kind_no < {BASE} AND b.start < j.stop AND j.start < b.stop))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind_no) FILTER (kind_no < {BASE}), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, kind_no), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_not_live
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
