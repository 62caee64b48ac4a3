"""Version histories, content reuse and snapshot writes.

A version table holds (doc, seq, content_hash, size_bytes): `seq` is a unique
non-negative integer that grows with time. One lineage may hold a third of all rows, so
numbering and look-back go through the bucketed helpers and per-key facts through
partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed, scale


def number_versions(rows: DataFrame, doc: str = "doc", seq: str = "seq", existing: DataFrame | None = None) -> DataFrame:
    """Add `version`: 1, 2, 3... per document, after the highest number already stored."""
    numbered = scale.numbered(rows, [doc], seq, "version")
    if existing is None:
        return numbered
    top = existing.groupBy(doc).agg(F.max("version").alias("_top"))
    sizes = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    joined = scale.attach(numbered, sizes.join(top, doc, "left"), [doc], "_n", F.col(seq))
    return joined.withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top", "_n")


def version_counts(versions: DataFrame, doc: str = "doc") -> DataFrame:
    return versions.groupBy(doc).agg(F.count(F.lit(1)).alias("versions"), F.max("version").alias("latest"))


def latest(versions: DataFrame, doc: str = "doc") -> DataFrame:
    """The newest version of each document: one partial aggregate, no sort."""
    rest = [c for c in versions.columns if c != doc]
    picked = versions.groupBy(doc).agg(F.max_by(F.struct(*rest), F.col("version")).alias("_v"))
    return picked.select(doc, *[F.col(f"_v.{c}").alias(c) for c in rest])


def version_at(versions: DataFrame, asked: DataFrame, doc: str = "doc"):
    """asked(doc, version): the rows of given versions, and what was asked for in vain: (found, refused)."""
    wanted = asked.select(doc, "version").distinct()
    held = versions.withColumn("_held", F.lit(True))
    joined = scale.null_safe_join(wanted, held, [doc, "version"], "left")
    found = joined.filter("_held").drop("_held").select(*versions.columns)
    return found, joined.filter(F.col("_held").isNull()).select(doc, "version", F.concat(
        F.lit("There is no version "), F.coalesce(F.col("version").cast("string"), F.lit("without a number")), F.lit(" of this document.")).alias("reason"))


def as_of(versions: DataFrame, asked: DataFrame, doc: str = "doc", at: str = "at", created: str = "created_at", bits: int = 40) -> DataFrame:
    """asked(doc, at): the newest version of the document at a time, null before its first one: doc, at, version.

    Versions are numbered 1, 2, 3... as they were created, so the number wanted is how many had been by
    then: a running count over versions and questions in order of time, in buckets of time (2**bits
    microseconds), so neither a long history nor many questions about one document meet in one task.
    """
    # A version created at the very moment counts: questions come half a step later.
    events = versions.select(doc, (F.unix_micros(created) * 2).alias("_time"), F.lit(1).alias("_one"), F.lit(None).cast("timestamp").alias(at)).unionByName(
        asked.select(doc, at).distinct().select(doc, (F.unix_micros(at) * 2 + 1).alias("_time"), F.lit(0).alias("_one"), at))
    counted = scale.running_before(events, [doc], "_time", F.col("_one"), "version", bits=bits)
    return counted.filter(F.col("_one") == 0).select(doc, at, F.when(F.col("version") > 0, F.col("version")).alias("version"))


def history(versions: DataFrame, doc: str = "doc", seq: str = "seq") -> DataFrame:
    """Every version with `current` set on the newest and a short hash."""
    joined = scale.attach(versions, version_counts(versions, doc), [doc], "versions", F.col(seq))
    return joined.withColumn("current", F.col("version") == F.col("latest")).withColumn(
        "short_hash", F.substring("content_hash", 1, 16)).drop("versions", "latest")


def mark_reuse(versions: DataFrame, doc: str = "doc", seq: str = "seq") -> DataFrame:
    """Add first_version (first holder of the same bytes in the same document) and reused."""
    keys = [doc, "content_hash"]
    first = versions.groupBy(*keys).agg(F.min("version").alias("first_version"), F.count(F.lit(1)).alias("_copies"))
    return scale.attach(versions, first, keys, "_copies", F.col(seq)).withColumn(
        "reused", F.col("version") > F.col("first_version")).drop("_copies")


def restore(versions: DataFrame, requests: DataFrame, doc: str = "doc"):
    """requests(doc, version): copy an earlier version forward as a new one.

    Returns (appended, refused): the current version and missing versions are refused.
    """
    newest = version_counts(versions, doc).select(doc, "latest")
    asked = requests.select(doc, F.col("version").alias("wanted")).join(newest, doc, "left")
    found = asked.join(
        versions.select(doc, F.col("version").alias("wanted"), "content_hash", "size_bytes"), [doc, "wanted"], "left")
    judged = found.withColumn("reason", F.when(F.col("wanted") == F.col("latest"), F.concat(
        F.lit("Version "), F.col("wanted").cast("string"), F.lit(" is already the current version."))).when(
        F.col("content_hash").isNull(), F.concat(F.lit("Version "), F.col("wanted").cast("string"), F.lit(" does not exist."))))
    appended = judged.filter(F.col("reason").isNull()).select(
        doc, (F.col("latest") + 1).alias("version"), "content_hash", "size_bytes",
        F.concat(F.lit("restored-v"), F.col("wanted").cast("string")).alias("label"))
    return appended, judged.filter(F.col("reason").isNotNull()).select(doc, F.col("wanted").alias("version"), "reason")


def size_change(versions: DataFrame, doc: str = "doc", seq: str = "seq") -> DataFrame:
    """Bytes saved against the version before, as a percentage floored at 0."""
    before = scale.previous(versions, [doc], seq, ["size_bytes"], "before_")
    saved = F.greatest(F.lit(0.0), (F.col("before_size_bytes") - F.col("size_bytes")) * 100.0 / F.col("before_size_bytes"))
    return before.withColumn("percent_saved", F.when(F.col("before_size_bytes") > 0, saved).otherwise(0.0))


def exact_duplicates(docs: DataFrame, scope: str, content: str, order: str) -> DataFrame:
    """Content held more than once in a scope: hash, number of copies, first holder.

    Only hashes are shuffled, and copies are counted before the shuffle.
    """
    hashed = docs.select(scope, F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"), order)
    return hashed.groupBy(scope, "content_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min(order).alias("first_holder")).filter(F.col("copies") > 1)


def cache_key(name: Column, content_hash: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws("_", name, content_hash, kind).cast("binary"))


def storage_key(workspace: Column, doc: Column, version: Column, kind: Column) -> Column:
    safe = F.regexp_replace(kind, "[^a-zA-Z0-9_-]", "")
    return F.concat_ws("/", workspace.cast("string"), doc.cast("string"), F.concat(
        F.lit("v"), version.cast("string"), F.lit("-"), F.when(safe == "", "file").otherwise(safe)))


def storage_key_ok(key: Column) -> Column:
    return key.rlike(fixed.STORAGE_KEY_PATTERN)


def drop_prefix(objects: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Everything not under a key prefix; an empty prefix is refused."""
    safe = "".join(c for c in prefix if c.isascii() and (c.isalnum() or c in "/_-")).strip("/")
    if not safe:
        raise ValueError("refusing to delete an empty prefix")
    return objects.filter(~(F.col(key).startswith(safe + "/") | (F.col(key) == safe)))


def replace_rows(target: DataFrame, new: DataFrame, keys: list[str], replaced: DataFrame | None = None) -> DataFrame:
    """A snapshot in which all rows of the given keys are exchanged for the new rows.

    `replaced` lists the keys that were worked on (default: the keys of `new`), so a key
    whose new result is empty still loses its old rows.
    """
    gone = (replaced if replaced is not None else new).select(*keys).distinct()
    return target.join(gone, keys, "left_anti").unionByName(new)


def apply_patches(target: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """Change only the supplied fields; the last patch per key and field wins.

    Null means "not supplied". Patches are folded before the join, so many patches on one
    key cost one row.
    """
    fields = [c for c in patches.columns if c not in (key, order)]
    folded = patches.groupBy(key).agg(*[
        F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fields])
    joined = target.join(folded, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns])


def cache_misses(docs: DataFrame, cache: DataFrame, keys: list[str], now: Column, hours: int = fixed.CACHE_HOURS) -> DataFrame:
    """Documents with no live cached result."""
    return docs.join(live_cache(cache, now, hours).select(*keys).distinct(), keys, "left_anti")


def live_cache(cache: DataFrame, now: Column, hours: int = fixed.CACHE_HOURS) -> DataFrame:
    """Cached rows not yet expired; an entry exactly at its limit still counts."""
    return cache.filter(F.col("created_at") + F.make_interval(hours=F.lit(hours)) >= now)


def merge_metadata(docs: DataFrame, current: str = "metadata", changes: str = "changes") -> DataFrame:
    """Set given fields, drop those set to nothing, refuse unknown names."""
    unknown = F.sort_array(F.array_except(F.map_keys(changes), F.array(*[F.lit(f) for f in fixed.METADATA_FIELDS])))
    kept = F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(changes), k))
    given = F.map_filter(changes, lambda _, v: v.isNotNull() & (v != ""))
    return docs.withColumn("merged", F.when(F.size(unknown) == 0, F.map_concat(kept, given))).withColumn(
        "unknown", F.array_join(unknown, ", "))
