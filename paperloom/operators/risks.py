"""Risk scanning: injected instructions, links, attachments, raw tokens, and the roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T

SEVERITY_RANK = {name: i for i, name in enumerate(fixed.SEVERITIES)}


def injection_hits(text: str, cap: int | None = None) -> Column:
    """array<struct<position,pattern_no,category,excerpt>> of one text column.

    All hits by position; `cap` keeps the first ones in pattern order instead.
    """
    left = f"greatest(m_.start - {fixed.INJECTION_MARGIN}, 0)"
    right = f"least(m_.start + length(m_.value) + {fixed.INJECTION_MARGIN}, length({text}))"
    excerpt = T.squeeze_sql(f"substr({text}, {left} + 1, {right} - {left})")
    parts = [
        f"transform({T.find_all_sql(text, _flagged(pattern))}, m_ -> named_struct('position', m_.start, "
        f"'pattern_no', {number}, 'category', '{category}', 'excerpt', {excerpt}))"
        for number, (pattern, category) in enumerate(fixed.INJECTION_PATTERNS)
    ]
    ordered = f"if(size(all_) >= {cap}, slice(all_, 1, {cap}), sort_array(all_))" if cap else "sort_array(all_)"
    return F.expr(T.let_sql(f"concat({', '.join(parts)})", "all_", ordered))


def _flagged(pattern: str) -> str:
    return ("(?iumU)" if pattern.startswith("^") else "(?iuU)") + pattern


def any_injection(text: Column) -> Column:
    test = F.lit(False)
    for pattern, _ in fixed.INJECTION_PATTERNS:
        test = test | text.rlike(_flagged(pattern))
    return test


def scan_injection(docs: DataFrame, *keep: str, text: str = "text", cap: int | None = None) -> DataFrame:
    """One row per suspicious passage; documents without any never reach the offset step."""
    hits = docs.filter(any_injection(F.col(text))).select(
        *keep, F.posexplode(injection_hits(text, cap)).alias("hit", "_h"))
    return hits.select(*keep, "hit", "_h.position", "_h.category", "_h.excerpt")


def injection_summary(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """detected, count and categories in the order seen, per document."""
    hits = F.when(any_injection(F.col(text)), injection_hits(text)).otherwise(
        F.array().cast("array<struct<position:int,pattern_no:int,category:string,excerpt:string>>"))
    scanned = docs.select(*keep, hits.alias("_h"))
    categories = F.array_join(F.array_distinct(F.transform("_h", lambda h: h["category"])), ", ")
    count = F.size("_h")
    return scanned.select(
        *keep, (count > 0).alias("detected"), count.alias("matches"), categories.alias("categories"),
        F.when(count == 0, "No prompt-injection patterns detected.").otherwise(F.concat(
            count.cast("string"), F.lit(" passage(s) matched prompt-injection patterns ("), categories,
            F.lit("). The text was still processed, but as data only — the model was instructed not to follow it."),
        )).alias("summary"))


def fence(text: Column, preamble: bool = True) -> Column:
    """Wrap untrusted text so that it cannot close its own wrapper."""
    body = text
    for marker in (fixed.FENCE_OPEN, fixed.FENCE_CLOSE):
        body = F.replace(body, F.lit(marker), F.lit(fixed.FENCE_REMOVED))
    body = F.regexp_replace(body, fixed.FENCE_NEAR_MISS, fixed.FENCE_REMOVED)
    block = F.concat(F.lit(fixed.FENCE_OPEN + "\n"), body, F.lit("\n" + fixed.FENCE_CLOSE))
    return F.concat(F.lit(fixed.FENCE_PREAMBLE + "\n\n"), block) if preamble else block


# ------------------------------------------------------------------ links and names

def classify_url(url: Column, flag_bare_com: bool = True) -> Column:
    """Why a link is worth flagging, or null; the first matching rule decides.

    The suffix list holds .com and is tested on the whole URL, so a bare host under .com is
    flagged; pass flag_bare_com=False to test the path only.
    """
    low = F.lower(url)
    rest = F.when(F.contains(low, F.lit("://")), F.substr(low, F.instr(low, "://") + 3)).otherwise(low)
    authority = F.substring_index(rest, "/", 1)
    after_user = F.substring_index(authority, "@", -1)
    host = F.substring_index(after_user, ":", 1)
    port = F.when(F.contains(after_user, F.lit(":")), F.substring_index(authority, ":", -1)).otherwise(F.lit(""))
    bare = F.substring_index(low, "?", 1)
    suffixes = "|".join(s.replace(".", r"\.") for s in fixed.RISKY_DOWNLOADS)
    download = bare.rlike(rf"(?:{suffixes})\z")
    if not flag_bare_com:
        download = download & F.contains(rest, F.lit("/"))
    reasons = fixed.URL_REASONS
    return (
        F.when(F.contains(authority, F.lit("@")), reasons["authority"])
        .when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), reasons["ip"])
        .when(host.startswith("xn--") | F.contains(host, F.lit(".xn--")), reasons["punycode"])
        .when(host.isin(fixed.SHORTENERS), reasons["shortener"])
        .when(download, reasons["download"])
        .when(port.rlike(r"^\d+$") & ~port.isin(fixed.ORDINARY_PORTS), F.concat(F.lit(reasons["port"]), port))
    )


def urls_of(text: Column, cap: int | None = None) -> Column:
    """Distinct URLs of a text in the order first seen, trailing punctuation trimmed; the first `cap` if given."""
    found = F.regexp_extract_all(text, F.lit(fixed.URL_PATTERN), F.lit(0))
    urls = F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(fixed.URL_TRAILING))))
    return F.slice(urls, 1, cap) if cap else urls


def doc_urls(docs: DataFrame, *keep: str, text: str = "text", cap: int | None = None) -> DataFrame:
    return docs.select(*keep, F.posexplode(urls_of(F.col(text), cap)).alias("position", "url"))


def safe_attachment_name(name: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(T.strip(name), r"\\", "/"), "/"), -1)
    return T.let(
        F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._ -]", "_"), r"^[. ]+|[. ]+\z", ""),
        lambda n: F.when(n == "", "attachment").otherwise(n))


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    return F.lower(name).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")


def classify_attachment(files: DataFrame, name: str = "name") -> DataFrame:
    clean = safe_attachment_name(F.col(name))
    return files.withColumn("safe_name", clean).withColumn(
        "risky", ends_with_any(F.col("safe_name"), fixed.RISKY_ATTACHMENTS)).withColumn(
        "severity", F.when(ends_with_any(F.col(name), fixed.RISKY_DOWNLOADS), "high").otherwise("medium"))


def link_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(T.strip(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def filter_links(links: DataFrame, url: str = "url"):
    """(allowed, refused): only web and mail links may be added."""
    judged = links.withColumn("scheme", link_scheme(F.col(url)))
    ok = F.col("scheme").isin(fixed.SAFE_SCHEMES)
    return judged.filter(ok), judged.filter(~ok)


def remove_links(links: DataFrame, page: int | None = None, index: int | None = None) -> DataFrame:
    """Mark links for removal by page and position (all when neither is given)."""
    gone = F.lit(True)
    if page is not None:
        gone = gone & (F.col("page") == page)
    if index is not None:
        gone = gone & (F.col("position") == index)
    return links.withColumn("removed", gone)


def raw_sweep(files: DataFrame, content: str = "content", known: str = "known_ids") -> DataFrame:
    """Risky tokens present in the bytes and not reported otherwise: one finding per file."""
    labels = [
        F.when(F.contains(F.col(content), F.lit(token).cast("binary")) & ~F.array_contains(known, finding), F.lit(label))
        for token, finding, label in fixed.RAW_TOKENS
    ]
    missed = F.sort_array(F.array_compact(F.array(*labels)))
    return files.withColumn("missed", missed).filter(F.size("missed") > 0).withColumn(
        "missed", F.array_join("missed", ", "))


# ------------------------------------------------------------------ findings

def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    return ranks[severity]


def risk_rollup(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per severity, the highest severity, its label and a headline.

    Aggregated in two steps by Spark (before and after the shuffle), so a document with a
    third of all findings costs one small row per task.
    """
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES]
    rolled = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("findings"), F.max(severity_rank(F.col("severity"))).alias("_rank"), *counts)
    return with_risk_labels(rolled).drop("_rank")


def with_risk_labels(rolled: DataFrame) -> DataFrame:
    level = F.coalesce(F.get(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), F.col("_rank")), F.lit("none"))
    labels = F.create_map(*[F.lit(x) for pair in fixed.RISK_LABELS.items() for x in pair])
    parts = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in reversed(fixed.SEVERITIES)])), ", ")
    return rolled.withColumn("risk_level", level).withColumn("risk_label", labels[F.col("risk_level")]).withColumn(
        "headline", F.when(F.col("findings") == 0, fixed.CLEAN_HEADLINE).otherwise(F.concat(
            F.col("findings").cast("string"), F.lit(" indicator(s) detected — "), parts, F.lit("."))))


def by_severity(findings: DataFrame, *then: str) -> DataFrame:
    """All findings, the gravest first."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *then)


def finding_locations(findings: DataFrame, keys: list[str], shown: int | None = None) -> DataFrame:
    """Distinct locations in order and their number; with `shown`, the first ones and how many more there are."""
    distinct = findings.select(*keys, "location").filter(F.col("location").isNotNull()).distinct()
    gathered = distinct.groupBy(*keys).agg(F.sort_array(F.collect_list("location")).alias("_all"))
    listed, count = F.array_join("_all", ", "), F.size("_all")
    if shown:
        listed = F.concat(F.array_join(F.slice("_all", 1, shown), ", "), F.when(count > shown, F.concat(
            F.lit(" (+"), (count - shown).cast("string"), F.lit(" more)"))).otherwise(""))
    return gathered.select(*keys, listed.alias("locations"), count.cast("long").alias("location_count"))


def url_findings(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Suspicious links as findings: keep..., finding_id, severity, location, reason."""
    links = doc_urls(docs, *keep, text=text).withColumn("reason", classify_url(F.col("url"))).filter(F.col("reason").isNotNull())
    return links.select(*keep, F.lit("suspicious_urls").alias("finding_id"), F.lit("medium").alias("severity"),
                        F.col("url").alias("location"), "reason")


def security_report(docs: DataFrame, scans: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document with its roll-up; scanned=false where no scan ran."""
    rolled = risk_rollup(findings, key)
    seen = docs.join(scans.select(key, F.lit(True).alias("_seen")), key, "left").join(rolled, key, "left")
    return (
        seen.withColumn("scanned", F.coalesce("_seen", F.lit(False)))
        .withColumn("findings", F.coalesce("findings", F.lit(0)))
        .withColumn("risk_level", F.when(F.col("scanned"), F.coalesce("risk_level", F.lit("none"))))
        .withColumn("headline", F.when(F.col("scanned"), F.coalesce("headline", F.lit(fixed.CLEAN_HEADLINE))))
        .drop("_seen")
    )
