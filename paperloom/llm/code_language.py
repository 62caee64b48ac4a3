"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier weighs hashed byte
n-grams (one to four bytes, case folded for A-Z): the log-odds that a text carries the bit,
from counts of the n-grams in the languages on either side. Counts are taken over all rows
marked for learning, in parallel; a table of `buckets` numbers per language reaches the
driver, whatever the size of the corpus. Decoding adds up, bit by bit, the logistic loss of
each codeword, weighted by how well the bit's classifier separates the languages, and takes
the codeword with the smallest loss. A text whose two best codewords lie close together is
flagged as ambiguous.

Null text, or text without a letter, gives `und` with score 0; so does every text when
nothing was learned. Texts are used whole. Rows are independent; repeated rows repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SHIFT = np.uint64(64 - 15)
AMBIGUOUS = 0.6  # a lower score is ambiguous
REJECTED = 0.4  # below this no language is clearly likelier than the rest
UNDETERMINED = "und"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LATIN = re.compile("[A-Za-z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and (LATIN(text) is not None or any(map(str.isalpha, text)))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text, by bucket."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(FOLD), np.uint8).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    code = np.zeros(len(data), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        if len(data) < order:
            break
        # The code of n bytes from here on, built from the code of n - 1 bytes.
        code = code[:len(data) - order + 1] * np.uint64(256) + data[order - 1:]
        if order in ORDERS:
            spread = (code + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((spread >> SHIFT).astype(np.int64), minlength=BUCKETS)
    return total


def codewords(languages: list[str]) -> np.ndarray:
    """One row of +1/-1 bits per language, at least half of the bits differing between any two of up to 64.

    Rows of a Hadamard matrix without its constant column, repeated with shuffled columns
    when more languages need more bits; every language also has a bit of its own.
    """
    size = 4
    while size < len(languages) + 1:
        size *= 2
    hadamard = np.array([[1]])
    while len(hadamard) < size:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    rows = hadamard[:len(languages), 1:]
    own = np.where(np.eye(len(languages), dtype=bool), 1, -1)
    bits = np.hstack([rows, own])
    return bits[:, [len(set(column)) > 1 for column in bits.T]]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """N-gram counts per language over all rows that have a language and a letter."""
    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(body):
                    counts = ngram_counts(body)
                    if name in totals:
                        totals[name] += counts
                    else:
                        totals[name] = counts
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
                ["lang", "bucket", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).collect()
    found = {}
    for row in sorted(packed, key=lambda r: r["lang"]):
        counts = np.zeros(BUCKETS)
        for bucket, n in row["counts"]:
            counts[bucket] = n
        found[row["lang"]] = counts
    return found


class Codes:
    """Bit classifiers and codewords of the languages learned."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = list(counts)
        if len(self.languages) < 2:
            return
        shares = np.array([c + 0.5 for c in counts.values()])
        shares /= shares.sum(axis=1, keepdims=True)
        self.bits = codewords(self.languages)
        one, other = (np.array([shares[column == side].mean(axis=0) for column in self.bits.T]) for side in (1, -1))
        self.weights = np.log(one / other)
        # A classifier's margin on a language's own n-grams: where to put its middle, how far to trust it.
        means = shares @ self.weights.T
        low = np.array([m[c == -1].max() for m, c in zip(means.T, self.bits.T, strict=True)])
        high = np.array([m[c == 1].min() for m, c in zip(means.T, self.bits.T, strict=True)])
        self.middle, self.scale = (low + high) / 2, np.maximum((high - low) / 2, 1e-3)
        self.trust = self.scale / self.scale.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        counts = ngram_counts(text)
        used = np.flatnonzero(counts)
        margin = (self.weights[:, used] @ counts[used] / counts.sum() - self.middle) / self.scale
        loss = (np.log1p(np.exp(-np.clip(2 * margin, -20, 20) * self.bits)) * self.trust).sum(axis=1)
        closeness = np.exp(-4 * (loss - loss.min()))
        best = int(loss.argmin())
        return self.languages[best], float(closeness[best] / closeness.sum())


def identify(docs: DataFrame, keep: list, learned: dict[str, np.ndarray], text: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """`keep` columns (names or expressions) with lang_pred, score and ambiguous."""
    codes = Codes(learned)

    def run(batches):
        for batch in batches:
            found = [codes.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[0] != UNDETERMINED and f[1] < ambiguous for f in found], pa.bool_()),
            ], [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, ambiguous boolean")


def held_out(key: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    learned = learn(docs.filter(~held_out(F.col(key))), lang, text)
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return identify(rows, ["doc_id", "held_out"], learned)


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = REJECTED) -> DataFrame:
    """The documents that are in some language: not `und`, and with a score of at least `least`."""
    learned = learn(docs.filter(~held_out(F.col(key))), lang, text)
    judged = identify(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")], learned, text)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("doc.*")
