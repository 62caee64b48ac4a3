"""Corpus tables and raw files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T
from paperloom.functions.python_side import compatibility_form, unescape_entities


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One corpus table; Catalyst prunes its columns and pushes filters to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a unique key when the scan has fewer splits than there are cores.

    Only small inputs in few files qualify; a large table already has many splits and
    is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


RANGE_BYTES = 64 << 20


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raw files with size, SHA-256 and digest by ranges: name, length, content_hash, range_hash, accepted.

    A file of up to `range_bytes` comes from Spark's reader whole. A larger one is never held: its bytes
    are read in pieces, once in order for the SHA-256 of the whole (one task a file), and range by
    range in as many tasks for `range_hash`. That is the SHA-256 of the concatenated binary SHA-256
    digests of the file's consecutive ranges; it can be checked, or made again after a change, in parallel.

    `max_bytes` sets a ceiling: files above it are listed as not accepted, without being read. There is none by default.
    Empty files are not listed: Spark's reader leaves them out.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    # The `length` filters reach the source, and only the first branch asks for the content.
    small = files.filter(fits & (F.col("length") <= range_bytes)).select(
        name, "length", F.sha2("content", 256).alias("content_hash"), F.sha2(F.unhex(F.sha2("content", 256)), 256).alias("range_hash"), F.lit(True).alias("accepted"))
    large = files.filter(fits & (F.col("length") > range_bytes)).select("path", "length")
    ranges = large.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    stops = F.least(F.col("start") + range_bytes, F.col("length"))
    parts = ranges.select("path", "length", "start", stops.alias("stop")).unionByName(large.select("path", "length", F.lit(-1).cast("long").alias("start"), F.col("length").alias("stop")))
    digests = parts.repartition("path", "start").mapInPandas(_digest_ranges, "path string, length long, start long, digest binary").groupBy("path", "length").agg(
        F.max(F.when(F.col("start") < 0, F.lower(F.hex("digest")))).alias("content_hash"),
        F.sort_array(F.collect_list(F.when(F.col("start") >= 0, F.struct("start", "digest")))).alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["digest"]))
    read = digests.select(name, "length", "content_hash", F.sha2(joined, 256).alias("range_hash"), F.lit(True).alias("accepted"))
    nothing = F.lit(None).cast("string")
    refused = files.filter(~fits).select(name, "length", nothing.alias("content_hash"), nothing.alias("range_hash"), F.lit(False).alias("accepted"))
    return small.unionByName(read).unionByName(refused)


def _digest_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the bytes [start, stop) of files (from 0 where start is negative), read in pieces of a megabyte."""
    from pyarrow.fs import FileSystem

    for frame in frames:
        digests = []
        for path, start, stop in zip(frame["path"], frame["start"], frame["stop"], strict=True):
            system, place = FileSystem.from_uri(path)
            total, at = hashlib.sha256(), max(start, 0)
            with system.open_input_file(place) as data:
                data.seek(at)
                while at < stop:
                    piece = data.read(min(1 << 20, stop - at))
                    if not piece:
                        raise OSError(f"{path} ended before byte {stop}")
                    total.update(piece)
                    at += len(piece)
            digests.append(total.digest())
        yield frame[["path", "length", "start"]].assign(digest=digests)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as arrays of cells; rows with no visible cell are dropped, a leading BOM is ignored."""
    rows = spark.read.option("header", False).option("quote", '"').option("escape", '"').csv(path)
    cells = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in rows.columns])
    return rows.select(F.transform(cells, lambda c: F.regexp_replace(c, "^﻿", "")).alias("cells")).filter(
        F.exists("cells", lambda c: ~T.is_blank(c))
    )


def starts_with(content: Column, signature: str) -> Column:
    size = len(signature) // 2
    return F.substring(content, 1, size) == F.unhex(F.lit(signature))


def detect_format(files: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    """Add format, label, convertible and reason, judged from the leading bytes."""
    data = F.col(content)
    name = F.col(filename)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    head = F.lower(F.regexp_replace(
        F.decode(F.substring(data, 1, 512), "ISO-8859-1"), r"^[\t-\r ]+", ""
    ))
    textual = (
        F.when(extension.isin("csv", "tsv"), "csv")
        .when(extension.isin("md", "markdown"), "md")
        .when(extension.isin("html", "htm"), "html")
        .when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
        .otherwise("txt")
    )
    # Any byte string without a zero byte decodes as Latin-1, so the zero byte decides.
    has_zero = F.position(F.lit("00"), F.regexp_replace(F.hex(F.substring(data, 1, fixed.TEXT_SAMPLE)), "(..)", "$1 ")) > 0

    kind = F.when(F.length(data) == 0, "empty").when(
        F.position(F.unhex(F.lit(fixed.PDF_SIGNATURE)), F.substring(data, 1, fixed.PDF_WINDOW)) > 0, "pdf"
    )
    blocked = F.when(F.lit(False), F.lit(""))
    for signature, description in fixed.HOSTILE_SIGNATURES:
        kind = kind.when(starts_with(data, signature), "blocked")
        blocked = blocked.when(starts_with(data, signature), description)
    kind = kind.when(starts_with(data, fixed.ZIP_SIGNATURE), "zip")
    for signature, found in fixed.FORMAT_SIGNATURES:
        kind = kind.when(starts_with(data, signature), found)
    kind = (
        kind.when(starts_with(data, "52494646") & (F.substring(data, 9, 4) == F.unhex(F.lit("57454250"))), "webp")
        .when(has_zero, "unknown")
        .otherwise(textual)
    )
    labels = F.create_map(*[F.lit(x) for pair in fixed.FORMAT_LABELS.items() for x in pair])
    reasons = F.create_map(*[F.lit(x) for pair in fixed.REFUSED_FORMATS.items() for x in pair])
    found = files.withColumn("format", kind).withColumn("_blocked", blocked)
    return (
        found.withColumn("label", F.when(F.col("format") == "blocked", F.col("_blocked")).otherwise(labels[F.col("format")]))
        .withColumn("convertible", ~F.col("format").isin("blocked", *fixed.REFUSED_FORMATS))
        .withColumn("reason", F.when(
            F.col("format") == "blocked",
            F.concat(F.lit("This is "), F.col("_blocked"), F.lit(", not a document.")),
        ).otherwise(F.coalesce(F.try_element_at(reasons, F.col("format")), F.lit(""))))
        .drop("_blocked")
    )


def safe_filename(name: Column, fallback: str = "document.pdf") -> Column:
    """The last path component with unusual characters replaced, never a reserved device name."""
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    cleaned = F.regexp_replace(F.replace(compatibility_form(base), F.lit("\x00"), F.lit("")), r"[^A-Za-z0-9._ -]", "_")
    trimmed = F.regexp_replace(cleaned, r"^[. ]+|[. ]+\z", "")

    def finish(n: Column) -> Column:
        stem = F.regexp_extract(n, r"(?s)^(.*)\.[^.]*\z", 1)
        reserved = F.upper(stem).isin(fixed.RESERVED_NAMES) | F.upper(n).isin(fixed.RESERVED_NAMES)
        named = F.when(reserved, F.concat(F.lit("file_"), n)).otherwise(n)

        def shorten(m: Column) -> Column:
            suffix = F.when(F.contains(m, F.lit(".")), F.element_at(F.split(m, r"\."), -1)).otherwise(F.lit(""))
            front = F.regexp_extract(m, r"(?s)^(.*)\.[^.]*\z", 1)
            cut = F.when(suffix != "", F.concat(F.substring(front, 1, 190), F.lit("."), suffix)).otherwise(
                F.substring(m, 1, 200)
            )
            return F.when(F.length(m) > 200, cut).otherwise(m)
        return T.let(named, shorten)

    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(fallback)).otherwise(
        T.let(trimmed, lambda n: F.when(n == "", F.lit(fallback)).otherwise(finish(n)))
    )


def align_extension(name: Column, detected: Column) -> Column:
    """Give a name the extension its content warrants."""
    accepted = F.when(F.lit(False), F.array(F.lit("")))
    for kind in fixed.STORED_FORMATS:
        allowed = [kind, *fixed.EXTENSION_ALIASES.get(kind, [])]
        accepted = accepted.when(detected == kind, F.array(*[F.lit(a) for a in allowed]))
    has_dot = F.contains(name, F.lit("."))
    current = F.lower(F.element_at(F.split(name, r"\."), -1))
    base = F.when(has_dot, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*\z", 1)).otherwise(name)
    renamed = F.concat(F.when(base == "", F.lit("document")).otherwise(base), F.lit("."), detected)
    return F.when(accepted.isNull(), name).when(has_dot & F.array_contains(accepted, current), name).otherwise(renamed)


def validate_manifest(manifest: DataFrame, max_mb: int = fixed.UPLOAD_LIMIT_MB) -> DataFrame:
    """Judge uploads (filename, size, format, convertible, reason): ok, message and stored name."""
    safe = safe_filename(F.col("filename"))
    empty, large = F.col("size") == 0, F.col("size") > (max_mb << 20)
    return (
        manifest.withColumn("_safe", safe)
        .withColumn("ok", ~empty & ~large & F.col("convertible"))
        .withColumn("message", F.when(empty, "The uploaded file is empty.")
                    .when(large, f"File exceeds the {max_mb} MB limit.")
                    .when(~F.col("convertible"), F.col("reason")).otherwise("ok"))
        .withColumn("safe_name", F.when(F.col("ok"), align_extension(F.col("_safe"), F.col("format"))).otherwise(F.col("_safe")))
        .drop("_safe")
    )


def html_to_text(html: Column, unescape: bool = True) -> Column:
    """Readable text of a web page; script and style content is dropped.

    Entities are decoded in Arrow batches; everything else is a chain of built-in replacements.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?is)<br\s*/?>", "\n")
    bare = F.regexp_replace(bare, r"(?is)</(p|div|li|tr|h[1-6])>", "\n\n")
    bare = F.regexp_replace(bare, r"(?is)<li\b[^>]*>", "- ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    if unescape:
        bare = unescape_entities(bare)
    lines = F.transform(F.split(bare, "\n", -1), T.strip)
    return T.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))

