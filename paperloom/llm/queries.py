"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import (
    chunked_bpe, code_language, coordinate_join, fertility, html_trees, line_chunks, orchard, packing, personal_data, secret_scan, sharding, topk, whitening,
)
from paperloom.sources.tables import load

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query(secret_scan.ORACLE)
def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(load(spark, folder, "documents"))


@query(line_chunks.ORACLE)
def op2_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.report(load(spark, folder, "documents"))


@query()
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.report(load(spark, folder, "documents"))


@query()
def op4_code_language(spark: SparkSession, folder: str) -> DataFrame:
    return code_language.report(load(spark, folder, "documents"))


@query()
def op5_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judge(load(spark, folder, "documents"))


@query(coordinate_join.ORACLE)
def op6_coordinate_join(spark: SparkSession, folder: str) -> DataFrame:
    return coordinate_join.link(load(spark, folder, "documents"), words=2)


@query()
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"))


@query()
def op8_html_trees(spark: SparkSession, folder: str) -> DataFrame:
    return html_trees.extract_pages(load(spark, folder, "pages"), ["page_id", "url"])


@query(topk.ORACLE)
def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(load(spark, folder, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query()
def op10_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return chunked_bpe.encode(load(spark, folder, "documents"), ["doc_id"], result=chunked_bpe.DIGESTS)


@query(orchard.ORACLE)
def op11_orchard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.cluster(load(spark, folder, "embeddings"))


@query()
def op12_cholesky_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(load(spark, folder, "embeddings"))


@query(sharding.ORACLE)
def op13_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(load(spark, folder, "documents"))
