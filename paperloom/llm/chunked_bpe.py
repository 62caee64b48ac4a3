"""Byte-level BPE in overlapping chunks.

A text of up to `chunk_chars` is one chunk and is encoded where it lies. A longer one is
cut into chunks that overlap; every chunk is split by the pattern on its own, and two
neighbours meet at the first pre-token boundary both found in their overlap. From such a
point on both splits agree, because the pattern never looks back; points behind white space
are passed over, as white space looks one character ahead. Each chunk then encodes its
share, and the shares are strung together. A text in which some overlap
has no common boundary (one pre-token longer than the overlap) is encoded whole.

Null text counts as empty: no ids, and digests of the empty string. Repeated rows give
repeated results; equal long texts are encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import rank_encoding, stash, word_encoder

CHUNK_CHARS = 1 << 15
OVERLAP = 1 << 10
#: A match closer than this to the end of a chunk may come out differently with more text behind it.
UNSURE = 4


class Coder:
    """Splits by the pattern, encodes whole texts or shares of chunks, decodes."""

    def __init__(self, vocabulary: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import regex

        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        encoding = rank_encoding(vocabulary, pattern)
        self.encode = word_encoder(vocabulary, pattern)
        size = max(encoding.n_vocab, encoding.max_token_value + 1)
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in encoding._mergeable_ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i).encode() for i in range(size)]

    def starts(self, chunk: str, last: bool) -> np.ndarray:
        """Boundaries where the text may be parted: certain, and not behind white space."""
        sure = len(chunk) if last else len(chunk) - UNSURE
        found, before = [], 0
        for match in self.pattern.finditer(chunk):
            if match.end() > sure:
                break
            if before and not chunk[before - 1].isspace():
                found.append(before)
            before = match.end()
        return np.array(found, np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def id_text(self, ids: bytes) -> bytes:
        return b" ".join(map(self.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: What to return of a text's ids: names and types of columns, and the values from (coder, ids).
IDS = ("ids binary", lambda coder, ids: (ids,))
DIGESTS = ("n_tokens long, ids_sha256 string, decoded_sha256 string", lambda coder, ids: (
    len(ids) // 4, hashlib.sha256(coder.id_text(ids)).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))


def _finished(result, coder, kept: list, names: list[str], all_ids) -> pa.RecordBatch:
    """A batch of the kept columns and the result columns."""
    fields = [part.split() for part in result[0].split(", ")]
    types = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    values = [result[1](coder, ids) for ids in all_ids]
    columns = zip(*values, strict=True) if values else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [*kept, *(pa.array(list(c), types[kind]) for c, (_, kind) in zip(columns, fields, strict=True))], [*names, *(n for n, _ in fields)])


def _short(coder_args, result):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*coder_args)
        for batch in batches:
            ids = (coder.encode(text or "") for text in batch.column(batch.num_columns - 1).to_pylist())
            yield _finished(result, coder, batch.columns[:-1], batch.schema.names[:-1], ids)
    return run


def _cut(size: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = -(-len(text) // size)
                for k in range(count):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key], pa.string()), pa.array([k], pa.int64()), pa.array([count], pa.int64()),
                        pa.array([text[k * size:(k + 1) * size + overlap]], pa.string())], ["text_key", "k", "n", "chunk"])
    return run


def _edges(coder_args, size: int, overlap: int):
    """Boundaries in the first and the last overlap of each chunk, as offsets into the document."""
    def run(batches):
        coder = Coder(*coder_args)
        for batch in batches:
            keys, ks, ns, chunks = (c.to_pylist() for c in batch.columns)
            heads, tails = [], []
            for k, n, chunk in zip(ks, ns, chunks, strict=True):
                starts = coder.starts(chunk, k == n - 1)
                heads.append((starts[starts < overlap] + k * size).tolist())
                tails.append((starts[starts >= size] + k * size).tolist())
            wide = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(heads, wide), pa.array(tails, wide)],
                ["text_key", "k", "n", "head", "tail"])
    return run


def _shares(coder_args, size: int):
    def run(batches):
        coder = Coder(*coder_args)
        for batch in batches:
            keys, ks, chunks, begins, ends = (c.to_pylist() for c in batch.columns)
            ids = [coder.encode(c[b - k * size:None if e is None else e - k * size])
                   for k, c, b, e in zip(ks, chunks, begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ks, pa.int64()), pa.array(ids, pa.binary())], ["text_key", "k", "ids"])
    return run


def _strung(coder_args, result):
    def run(batches):
        coder = Coder(*coder_args)
        for batch in batches:
            ids = (b"".join(p["ids"] for p in sorted(own, key=lambda p: p["k"])) for own in batch.column(1).to_pylist())
            yield _finished(result, coder, [batch.column(0)], ["text_key"], ids)
    return run


def encode_long(texts: DataFrame, coder_args=(None, None), chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, result=IDS) -> DataFrame:
    """(text_key, text) of distinct texts to text_key and the result, every chunk being a row of its own."""
    if overlap >= chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    chunks = stash(texts.mapInArrow(_cut(chunk_chars, overlap), "text_key string, k long, n long, chunk string"), "bpe-chunks")
    chunks = chunks.repartition(F.col("text_key"), F.col("k"))
    edges = chunks.mapInArrow(_edges(coder_args, chunk_chars, overlap), "text_key string, k long, n long, head array<long>, tail array<long>")
    order = Window.partitionBy("text_key").orderBy("k")
    meets = edges.select("text_key", "k", "n", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(
        F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))).alias("begin"))
    meets = stash(meets.select("text_key", "k", "begin", F.lead("begin").over(order).alias("end"),
                               F.min(F.col("begin").isNotNull()).over(Window.partitionBy("text_key")).alias("met")), "bpe-meets")
    shares = chunks.join(meets.filter("met"), ["text_key", "k"]).select("text_key", "k", "chunk", "begin", "end").mapInArrow(
        _shares(coder_args, chunk_chars), "text_key string, k long, ids binary")
    strung = shares.groupBy("text_key").agg(F.collect_list(F.struct("k", "ids")).alias("parts")).mapInArrow(
        _strung(coder_args, result), f"text_key string, {result[0]}")
    whole = texts.join(meets.filter(~F.col("met")).select("text_key").distinct(), "text_key", "left_semi").select("text_key", "text").mapInArrow(
        _short(coder_args, result), f"text_key string, {result[0]}")
    return strung.unionByName(whole)


def encode(
    docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None, pattern: str | None = None,
    chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, result=IDS,
) -> DataFrame:
    """`keep` columns and the result for every row: `ids` (binary, little-endian unsigned 32-bit) or their digests."""
    args = (vocabulary, pattern)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    long_text = F.length("_text") > chunk_chars
    short = rows.filter(~long_text).mapInArrow(_short(args, result), f"{kept}, {result[0]}")
    keyed = rows.filter(long_text).withColumn("_key", F.sha2("_text", 256))
    texts = keyed.select(F.col("_key").alias("text_key"), F.col("_text").alias("text")).dropDuplicates(["text_key"])
    done = encode_long(texts, args, chunk_chars, overlap, result)
    return short.unionByName(keyed.drop("_text").join(done.withColumnRenamed("text_key", "_key"), "_key").drop("_key"))
