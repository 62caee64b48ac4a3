"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import scratch_path

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stashed_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing left to run reads, and let the executors drop shuffle files of finished jobs.

    Spark drops those once the driver's collector has found that nothing refers to them.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(table.stashed_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.java.lang.System.gc()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a public-domain mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def rank_encoding(path: str | None, pattern: str | None):
    """The byte-level BPE of a rank file, one per Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    file = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Bounded(dict):
    """A memo of `make(key)` in two generations of `most` entries: memory stays bounded and keys in use stay."""

    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def word_encoder(vocabulary: str | None = None, pattern: str | None = None):
    """Text to ids as little-endian unsigned 32-bit bytes, remembering the ids of words.

    A space after a character that is not white space always starts a pre-token, so most
    texts fall into words that can be encoded one by one. Others are encoded whole.
    """
    encoding = rank_encoding(vocabulary, pattern)
    single, several = encoding._encode_single_piece, encoding.encode_ordinary
    words = Bounded(lambda word: array("I", single(" " + word) if word.isalpha() else several(" " + word)).tobytes())
    doubled = re.compile(r"\s ").search

    def encode(text: str) -> bytes:
        if doubled(text):
            return array("I", several(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", several(first)).tobytes() + b"".join(map(words.__getitem__, rest))

    return encode


@lru_cache(maxsize=4)
def added_tokens(path: str | None) -> dict[str, int]:
    """Strings that a tokeniser's JSON file adds to its vocabulary, with their ids: they are found in any text before it is split."""
    import json

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    for token in added:
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"the added token {token['content']!r} takes in more than itself, which is not supported")
    return {token["content"]: token["id"] for token in added}


def tokenizer_encoder(tokenizer: str | None = None, vocabulary: str | None = None, pattern: str | None = None):
    """Text to ids as a tokeniser's JSON file gives them at its defaults: its added tokens parted off, the rest by ranks."""
    encode, added = word_encoder(vocabulary, pattern), added_tokens(tokenizer)
    if not added:
        return encode
    parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split
    ids = {token: array("I", [number]).tobytes() for token, number in added.items()}

    def encode_all(text: str) -> bytes:
        found = parts(text)
        return encode(text) if len(found) == 1 else b"".join(ids[p] if n % 2 else encode(p) if p else b"" for n, p in enumerate(found))

    return encode_all


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node that points nowhere itself."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return several.isEmpty() and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, label), label being the smallest node.

    Alternating large-star and small-star steps; each step is one aggregate and one join,
    written to the shared folder, until only stars around their smallest node are left.
    """
    now = stash(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                .filter("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stash(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stash(small, "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
