"""A training corpus from `documents`: language, repeated lines, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads as its docs.
All but the last return the columns of documents, with any further ones; none has a name of its own to clash with them.

Every stage works on whole texts of any length, row by row or by hashes of them, gives an empty
table for an empty one, and treats rows that repeat an id as rows of their own unless it says otherwise.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import code_language, coordinate_join, line_chunks, packing, secret_scan
from paperloom.llm.common import stash
from paperloom.session import ship
from paperloom.sources.tables import load


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; texts without letters or without a likely language go.

    Null, empty and letterless texts are rejected. `lang` may be null: only non-null ones are learnt from, and without any
    every document is rejected. Ties go to the first language by name. Repeated rows fare alike.
    """
    return code_language.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, and documents of which nothing is left.

    A chunk stays at its smallest id (null first), then place. Null and empty texts stay as they are. Rows equal in id and
    text lose the same lines. `n_chars` follows the text where lines went.
    """
    return line_chunks.remaining(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8.

    It is the one with the smallest id; texts without words are linked with nothing and stay. Of rows equal in id and text
    one stays; null ids come first.
    """
    return coordinate_join.survivors(docs, words=5, share=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; every document stays.

    Null texts stay null. Null sources count as one owner. Overlapping spans are masked from the first on; `n_chars` follows the text.
    """
    return secret_scan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null and empty texts give one piece with the closing id. Pieces of equal length are interchangeable and numbered by task.
    """
    return packing.pack(docs)


def shipped(stage):
    """The stage, with this package sent to the executors first."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(stage.__name__, shipped(stage)) for stage in (language_id, line_dedup, near_dedup, secret_scans, best_fit_packing)]
#: The language and packing stages have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
