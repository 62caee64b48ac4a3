"""Exact top-k inner products, a block of documents at a time.

Vectors become integers, floor(256 * x). Rows in id order form blocks of `block` vectors;
a block keeps the largest and smallest value of every component ("term"), and its rows as a
forward index. For a query the bound of a block is the sum over terms of the best product
the block can offer. Queries travel in batches. A first pass takes, for each batch, the
blocks with the highest bounds of any of its queries and scores them, which fixes a k-th
score per query. In the second pass a block is scored for a batch only if its bound still
reaches the k-th score of some query there, blocks in falling order of bound within a task,
and a task stops once no bound reaches. Ties go to the smaller id.

Vectors that are null or empty, or hold a null, a NaN or an infinity, take no part; nor do rows
without id. Vectors of different lengths do not meet. Rows that repeat an id are separate
candidates; a query never meets a row with its own id. Fewer than k candidates give as many
results as there are.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import stash

BLOCK = 2048
BATCH = 2048
FIRST = 4  # blocks of the first pass
SLICE = 8  # blocks of a task of the second pass
SUMMARIES = 1024  # block summaries that meet a query batch in one place
EXACT = 2 ** 53


def quantised(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, v array<long>) of the vectors that take part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), wide.alias("w")).filter(
        F.col("vec_id").isNotNull() & (F.size("w") > 0)
        & ~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", F.size("w").alias("dim"), F.transform("w", lambda x: F.floor(x * 256)).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of up to `size`, in id order within a range of ids."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches):
        held, number = [], count()
        for frame in batches:
            held.append(frame)
            while sum(map(len, held)) >= size:
                whole = pd.concat(held)
                yield from one(whole.iloc[:size], number)
                held = [whole.iloc[size:]]
        if held:
            yield from one(pd.concat(held), number)

    def one(frame, number):
        for dim, own in frame.groupby("dim"):
            matrix = np.array(own["v"].tolist(), np.int64).reshape(len(own), dim)
            ids = own["vec_id"].to_numpy(np.int64)
            yield pd.DataFrame({
                "block": [f"{TaskContext.get().partitionId()}-{next(number)}"], "dim": [dim], "ids": [ids.tobytes()], "rows": [matrix.tobytes()],
                "high": [matrix.max(axis=0).tolist()], "low": [matrix.min(axis=0).tolist()]})

    ranged = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    return ranged.mapInPandas(pack, "block string, dim int, ids binary, rows binary, high array<long>, low array<long>")


def matrix_of(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can leave its exact range."""
    most = lambda m: float(np.abs(m.astype(float)).max(initial=0))
    if most(queries) * most(rows) * max(1, queries.shape[1]) < EXACT:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bound of every (query, block) pair."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
    return np.take_along_axis(scores, top, axis=1), ids[top]


NONE = -(2 ** 62)  # below every score


def scored(batch: pd.Series, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of one query batch over some blocks, given in falling order of bound, ending early."""
    query_ids = np.frombuffer(batch["ids"], np.int64)
    queries = matrix_of(batch["rows"], batch["dim"])
    floor = np.frombuffer(batch["kth"], np.int64) if batch["kth"] else np.full(len(query_ids), NONE)
    high, low = np.array(found["high"].tolist(), np.int64).reshape(len(found), -1), np.array(found["low"].tolist(), np.int64).reshape(len(found), -1)
    limit = bounds(queries, high, low)
    scores, ids = np.full((len(query_ids), 0), NONE), np.zeros((len(query_ids), 0), np.int64)
    order = np.argsort(-limit.max(axis=0), kind="stable")
    for at in order:
        reached = np.maximum(floor, scores[:, k - 1] if scores.shape[1] >= k else NONE)
        open_ = limit[:, at] >= reached
        if not open_.any():
            continue
        own = np.frombuffer(found["ids"].iloc[at], np.int64)
        here = products(queries, matrix_of(found["rows"].iloc[at], batch["dim"]))
        here[query_ids[:, None] == own[None, :]] = NONE
        here[~open_] = NONE
        part, part_ids = best(here, own, k)
        all_scores, all_ids = np.hstack([scores, part]), np.hstack([ids, part_ids])
        by = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        scores, ids = np.take_along_axis(all_scores, by, axis=1), np.take_along_axis(all_ids, by, axis=1)
    width = scores.shape[1]
    out = pd.DataFrame({"query_id": np.repeat(query_ids, width), "at": np.repeat(np.arange(len(query_ids)), width), "vec_id": ids.ravel(), "score": scores.ravel()})
    return out[out["score"] != NONE]


HIT = "batch string, at long, query_id long, vec_id long, score long"


def score_groups(pairs: DataFrame, batches: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Score the given (batch, part, block) pairs; one task per batch and part."""
    found = pairs.join(index, "block").select("batch", "part", "dim", "ids", "rows", "high", "low", F.lit(None).cast("binary").alias("kth"), F.lit(False).alias("asks"))
    nothing = F.lit(None).cast("array<long>")
    asked = pairs.select("batch", "part").distinct().join(batches, "batch").select(
        "batch", "part", "dim", "ids", "rows", nothing.alias("high"), nothing.alias("low"), "kth", F.lit(True).alias("asks"))

    def run(frame):
        asks, blocks_ = frame[frame["asks"]], frame[~frame["asks"]].reset_index(drop=True)
        out = scored(asks.iloc[0], blocks_, k)
        out.insert(0, "batch", frame["batch"].iloc[0])
        return out[["batch", "at", "query_id", "vec_id", "score"]]

    return found.unionByName(asked).groupBy("batch", "part").applyInPandas(run, HIT)


def search(table: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query row against all rows."""
    rows = quantised(table, key, vector)
    index = stash(blocks(rows, block), "topk-blocks")
    batches = stash(blocks(rows.filter(is_query(F.col("vec_id"))), batch).withColumnRenamed("block", "batch").withColumn(
        "kth", F.lit(None).cast("binary")), "topk-queries")
    # A block's summary is one row of two numbers per term; every batch meets every summary, not every row.
    summaries = index.select("block", "dim", "high", "low")
    # All vectors may have one length, so summaries are dealt into shares of SUMMARIES; a batch goes once to each share.
    shares = max(1, -(-summaries.count() // SUMMARIES))
    dealt = summaries.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    each = batches.select("batch", "dim", "rows", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    facing = each.join(dealt, ["dim", "share"]).select("batch", "dim", "rows", "block", "high", "low")

    def limits(frames):
        for frame in frames:
            for name, own in frame.groupby("batch"):
                dim = int(own["dim"].iloc[0])
                queries = matrix_of(own["rows"].iloc[0], dim)
                high, low = (np.array(own[c].tolist(), np.int64).reshape(len(own), -1) for c in ("high", "low"))
                limit = bounds(queries, high, low)
                yield pd.DataFrame({"batch": name, "block": own["block"], "most": limit.max(axis=0), "limits": [c.tobytes() for c in limit.T]})

    limited = stash(facing.mapInPandas(limits, "batch string, block string, most long, limits binary"), "topk-bounds")
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("most"), "block"))
    ranked = limited.select("batch", "block", "most", rank.alias("nth"))
    first = stash(score_groups(ranked.filter(F.col("nth") <= FIRST).select("batch", "block", F.lit(0).cast("long").alias("part")), batches, index, k), "topk-first")

    def kth(frame):
        kept = frame.sort_values(["at", "score"], ascending=[True, False]).groupby("at").nth(k - 1)
        floor = np.full(int(frame["n"].iloc[0]), NONE)
        floor[kept["at"].to_numpy(np.int64)] = kept["score"].to_numpy(np.int64)
        return pd.DataFrame({"batch": [frame["batch"].iloc[0]], "kth": [floor.tobytes()]})

    sized = batches.select("batch", (F.octet_length("ids") / 8).cast("long").alias("n"))
    floors = first.join(sized, "batch").groupBy("batch").applyInPandas(kth, "batch string, kth binary")
    known = stash(batches.drop("kth").join(floors, "batch", "left"), "topk-floors")

    def reaching(frames):
        for frame in frames:
            keep = [kth is None or bool((np.frombuffer(limit, np.int64) >= np.frombuffer(kth, np.int64)).any())
                    for limit, kth in zip(frame["limits"], frame["kth"], strict=True)]
            yield frame.loc[keep, ["batch", "block", "most"]]

    rest = limited.join(ranked.select("batch", "block", "nth"), ["batch", "block"]).filter(F.col("nth") > FIRST).join(
        known.select("batch", "kth"), "batch").select("batch", "block", "most", "limits", "kth").mapInPandas(reaching, "batch string, block string, most long")
    order = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("most"), "block"))
    second = score_groups(rest.select("batch", "block", (order / SLICE).cast("long").alias("part")), known, index, k)
    place = F.row_number().over(Window.partitionBy("query_id", "batch", "at").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(second).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
