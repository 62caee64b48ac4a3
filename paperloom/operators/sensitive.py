"""Sensitive values: detection, review, masking and the check that nothing survives."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed, scale
from paperloom.functions import text as T
from paperloom.session import settle


def luhn_sql(value: str) -> str:
    """Card checksum over the digits of a value; 13 to 19 digits."""
    weighed = "if(k_ % 2 = 0, int(c_), int(c_) * 2 - if(int(c_) > 4, 9, 0))"
    total = f"aggregate(transform(split(reverse(d_), ''), (c_, k_) -> {weighed}), 0, (a_, w_) -> a_ + w_)"
    return T.let_sql(f"regexp_replace({value}, '[^0-9]', '')", "d_",
                     f"if(length(d_) between 13 and 19, {total} % 10 = 0, false)")


def luhn_ok(column: str) -> Column:
    return F.expr(luhn_sql(column))


def with_detectors(kinds: Sequence[str] | None = None, terms: Sequence[str] = (), regex: str | None = None) -> list[tuple[str, str]]:
    """The patterns to run, in order. An empty `kinds` means all built-in kinds.

    Unknown kinds and expressions that do not compile are refused here, before any job starts.
    """
    chosen = list(kinds) if kinds else list(fixed.DETECTORS)
    unknown = [k for k in chosen if k not in fixed.DETECTORS]
    if unknown:
        raise ValueError(f"Unknown detector(s): {', '.join(unknown)}")
    patterns = [(k, "(?U)" + fixed.DETECTORS[k]) for k in chosen]
    patterns += [("custom_term", T.literal_regex(t.strip())) for t in terms if t.strip()]
    if regex:
        try:
            re.compile(regex)
        except re.error as exc:
            raise ValueError(f"Invalid regular expression: {exc}") from exc
        patterns.append(("custom_regex", "(?iuU)" + regex))
    return patterns


def _hits_sql(text: str, patterns: list[tuple[str, str]]) -> str:
    """All hits of a text, before overlaps are removed, in an order that decides overlaps."""
    order = {kind: n for n, (kind, _) in enumerate(dict(patterns).items())}
    parts = []
    for kind, pattern in patterns:
        test = f"length({T.strip_sql('h_.value')}) >= {fixed.MIN_HIT_LENGTH}"
        if kind == "credit_card":
            test += " and " + luhn_sql("h_.value")
        parts.append(
            f"transform(filter({T.find_all_sql(text, pattern)}, h_ -> {test}), h_ -> named_struct("
            f"'start', h_.start, 'neg_length', -length(h_.value), 'rank', {order[kind]}, 'kind', '{kind}', 'value', h_.value))")
    return f"sort_array(concat({', '.join(parts)}))"


def kept_hits_sql(text: str, patterns: list[tuple[str, str]]) -> str:
    """Keep the earliest hit, the longest on ties; drop what overlaps a kept one.

    Kept hits are disjoint and sorted, so only the last kept end matters.
    """
    kind = "struct<kept:array<struct<start:int,neg_length:int,rank:int,kind:string,value:string>>,reach:int>"
    return (
        f"aggregate({_hits_sql(text, patterns)}, cast(named_struct('kept', array(), 'reach', 0) as {kind}), "
        f"(a_, x_) -> if(x_.start >= a_.reach, cast(named_struct('kept', concat(a_.kept, array(x_)), "
        f"'reach', x_.start - x_.neg_length) as {kind}), a_), a_ -> a_.kept)"
    )


def detect(pages: DataFrame, *keep: str, kinds=None, terms=(), regex=None) -> DataFrame:
    """Candidates for masking: keep..., kind, value, start, end. Nothing is changed.

    One cheap filter removes pages where no pattern can match before offsets are computed.
    """
    patterns = with_detectors(kinds, terms, regex)
    candidate = F.lit(False)
    for _, pattern in patterns:
        candidate = candidate | F.col("text").rlike(pattern)
    kept = F.expr(kept_hits_sql("text", patterns))
    found = pages.filter(candidate).select(*keep, F.explode(kept).alias("_h"))
    return found.select(*keep, "_h.kind", "_h.value", F.col("_h.start").alias("start"),
                        (F.col("_h.start") - F.col("_h.neg_length")).alias("end"))


def targets_per_page(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct terms to mask on each page. A page is bounded, so its term list is too."""
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_set("value")).alias("terms"))


def mask_sql(text: str, terms: str) -> str:
    """Blank every case-insensitive occurrence of each term with as many spaces."""
    quote = r"concat('(?iu)\\Q', replace(t_, '\\E', '\\E\\\\E\\Q'), '\\E')"
    return (f"aggregate(filter({terms}, t_ -> {T.strip_sql('t_')} <> ''), {text}, "
            f"(body_, t_) -> regexp_replace(body_, {quote}, repeat(' ', length(t_))))")


def survivors_sql(text: str, terms: str) -> str:
    """Terms that can still be read in the text."""
    return f"filter({terms}, t_ -> t_ <> '' and contains(lower({text}), lower(t_)))"


def mask_pages(pages: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with their targets blanked; pages without targets pass through."""
    joined = pages.join(targets, keys, "left")
    masked = F.when(F.col("terms").isNull(), F.col("text")).otherwise(F.expr(mask_sql("text", "terms")))
    return joined.withColumn("text", masked)


def verify_mask(masked: DataFrame, text: str = "text", terms: str = "terms"):
    """(ok, rejected): rejected pages still hold a target."""
    judged = masked.withColumn("remaining", F.expr(survivors_sql(text, f"coalesce({terms}, array())")))
    return (judged.filter(F.size("remaining") == 0).drop("remaining"), judged.filter(F.size("remaining") > 0))


def redact_versions(books: DataFrame, versions: DataFrame, decisions: DataFrame, key: str = "doc_id", label: str = "redacted", **detectors):
    """Redaction to the end: detect, apply the review, mask, check, and append a version of each changed document.

    books(key, pages) are the newest versions' pages, versions(key, version, ..) what is stored, decisions(key, page,
    start, kind, approved) the review; a hit without a decision, or with a null one, is not masked. Null keys and
    pages meet null ones. Returns (appended, refused, reviewed):

    appended: key, version (one after the newest), label, content_hash, size_bytes, hit_count, pages.
    refused: key and reason, for documents in which a masked value can still be read, or without a stored version.
    reviewed: every hit found with its decision.

    Hits are found in the document's row. Only hits and decisions are shuffled; text moves for
    documents that change, and for those once.
    """
    each = books.select(key, F.explode("pages").alias("_p")).select(key, F.col("_p.page").alias("page"), F.col("_p.text").alias("text"))
    hits = detect(each, key, "page", **detectors)
    judged = decisions.groupBy(key, "page", "start", "kind").agg(F.bool_and(F.coalesce("approved", F.lit(False))).alias("approved"))
    reviewed = settle(scale.null_safe_join(hits, judged, [key, "page", "start", "kind"], "left").withColumn("approved", F.coalesce("approved", F.lit(False))))
    targets = targets_per_page(reviewed.filter("approved"), [key, "page"]).groupBy(key).agg(F.collect_list(F.struct("page", "terms")).alias("_t"))
    counts = reviewed.filter("approved").groupBy(key).agg(F.count(F.lit(1)).alias("hit_count"))
    wanted = settle(scale.null_safe_join(targets, counts, [key]))
    touched = scale.null_safe_join(scale.sieve(books.select(key, "pages"), wanted, [key]), wanted, [key])
    own = "coalesce(get(filter(_t, x_ -> x_.page <=> p_.page), 0).terms, array())"
    cleaned = T.let_sql(own, "terms_", T.let_sql(mask_sql("p_.text", "terms_"), "clean_",
        f"named_struct('page', p_.page, 'text', clean_, 'left', size({survivors_sql('clean_', 'terms_')}))"))
    newest = versions.groupBy(key).agg(F.max("version").alias("_newest"))
    masked = scale.null_safe_join(touched.withColumn("_m", F.expr(f"transform(pages, p_ -> {cleaned})")), newest, [key], "left")
    left = F.aggregate("_m", F.lit(0), lambda n, p: n + p["left"])
    body = F.array_join(F.transform("_m", lambda p: p["text"]), "\f")
    done = settle(masked.select(
        key, (F.col("_newest") + 1).alias("version"), F.lit(label).alias("label"), F.sha2(body.cast("binary"), 256).alias("content_hash"),
        F.octet_length(body).cast("long").alias("size_bytes"), "hit_count", F.transform("_m", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"))).alias("pages"),
        F.when(left > 0, "A masked value can still be read.").when(F.col("_newest").isNull(), "There is no stored version to follow.").alias("reason")))
    return done.filter(F.col("reason").isNull()).drop("reason"), done.filter(F.col("reason").isNotNull()).select(key, "reason"), reviewed


def redact(books: DataFrame, review: str | None = None, key: str = "doc_id", **detectors):
    """Detect, keep what the review approves, mask and verify: whole documents, one pass.

    Detection and masking stay in the document's row, so nothing is shuffled. `review` is
    a SQL condition on h (kind, value, start). Returns (ok, rejected) books with `hit_count`.
    """
    patterns = with_detectors(detectors.get("kinds"), detectors.get("terms", ()), detectors.get("regex"))
    hits = kept_hits_sql("p_.text", patterns)
    if review:
        hits = f"filter({hits}, h -> {review})"
    cleaned = T.let_sql(f"transform({hits}, h_ -> h_.value)", "terms_", T.let_sql(
        mask_sql("p_.text", "terms_"), "clean_",
        f"named_struct('page', p_.page, 'text', clean_, 'hits', size(terms_), 'left', size({survivors_sql('clean_', 'terms_')}))"))
    count = "aggregate(pages, 0L, (a_, p_) -> a_ + p_.{})"
    judged = books.withColumn("pages", F.expr(f"transform(pages, p_ -> {cleaned})")).withColumns(
        {"hit_count": F.expr(count.format("hits")), "_left": F.expr(count.format("left"))})
    plain = judged.withColumn("pages", F.expr("transform(pages, p_ -> named_struct('page', p_.page, 'text', p_.text))"))
    return plain.filter(F.col("_left") == 0).drop("_left"), plain.filter(F.col("_left") > 0).select(key, "hit_count")
