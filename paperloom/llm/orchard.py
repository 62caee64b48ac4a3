"""Centroid clustering with Orchard's search for the nearest centroid.

Vectors become integers, floor(256 * x). Every round sends the centroids (a table of fixed
size) to the tasks, with each centroid's list of the others sorted by distance from it. A
vector starts at the most central centroid and walks along its list; centroids already seen
are marked and not measured again; as soon as a closer one is found (or one as close with a
smaller number) the walk goes on in that one's list; it stops at the first neighbour that is
strictly further from the current centroid than twice the vector's distance to it: by the
triangle inequality nothing behind it can be as near. All distances are exact integers.

A task adds up its vectors per cluster and puts out one row of sums per cluster and
dimension, so no cluster is gathered anywhere, however many rows it holds; the driver sees
the totals, clusters x dimensions numbers. The table is read once a round and nothing but
the last assignment (id, cluster, distance) is written.

Left out are vectors that are null, have another length than `dim`, or hold a null, a NaN or
an infinity. Rows without id are clustered but never start a centroid. Rows that repeat an id
are vectors of their own; of equal hashes the smaller vector comes first. Ties between
centroids go to the smaller number, and equal centroids leave the larger number empty; an
empty centroid stays where it is. Fewer vectors with ids than centroids give as many
centroids as there are, none at all (an empty table) no rows. Components beyond +-2**26 after
scaling are refused with an error, because squared distances would leave the range of a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stash
from paperloom.llm.vectors import keyed, whole_vectors

CLUSTERS = 40
ROUNDS = 5
DIM = 64
SCALE = 256
LARGEST = 1 << 26
EXACT = 1 << 53


def scaled(matrix: np.ndarray) -> np.ndarray:
    """floor(256 * x) as integers."""
    floors = np.floor(matrix * SCALE)
    if floors.size and np.abs(floors).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances do not fit a long")
    return floors.astype(np.int64)


def starting_centroids(rows: DataFrame, clusters: int, dim: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of `seed:id`, in ascending order of hash."""
    def smallest(batches):
        held = []
        for batch in batches:
            for ids, matrix in whole_vectors(batch, dim):
                for number, vector in zip(ids.to_pylist(), scaled(matrix).tolist(), strict=True):
                    if number is not None:
                        held.append((hashlib.sha256(f"{seed}:{number}".encode()).hexdigest(), vector))
            held = sorted(held)[:clusters]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([v for _, v in held], pa.list_(pa.int64()))], ["hash", "v"])

    chosen = rows.mapInArrow(smallest, "hash string, v array<long>").orderBy("hash", "v").limit(clusters).collect()
    return np.array([r["v"] for r in chosen], np.int64).reshape(-1, dim)


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    apart = left - right
    return np.einsum("ij,ij->i", apart, apart)


class Neighbours:
    """Centroids, their neighbour lists in order of distance, and the most central of them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        number = len(centroids)
        apart = np.array([squared(centroids, c) for c in centroids], np.int64).reshape(number, number)
        own = apart.copy()
        np.fill_diagonal(own, -1)  # a centroid leads its own list; the walk begins behind it
        self.order = np.argsort(own, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.start = int(apart.astype(float).sum(axis=1).argmin()) if number else 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of every vector, its squared distance, and how many distances were measured."""
        rows = len(vectors)
        # Where no partial sum can leave the exact range of a double, floating point is exact and faster.
        most = max(np.abs(vectors).max(initial=0), np.abs(self.centroids).max(initial=0))
        if 4 * int(most) ** 2 * vectors.shape[1] < EXACT:
            vectors, centroids = vectors.astype(float), self.centroids.astype(float)
        else:
            centroids = self.centroids
        current = np.full(rows, self.start)
        distance = squared(vectors, centroids[current]).astype(np.int64)
        seen = np.zeros((rows, len(self.centroids)), bool)
        seen[:, self.start] = True
        place = np.zeros(rows, np.int64)
        walking = np.arange(rows) if self.order.shape[1] else np.zeros(0, np.int64)
        measured = rows
        while len(walking):
            at, step = current[walking], place[walking]
            # Four times the squared distance is twice the distance, squared.
            within = self.apart[at, step] <= 4 * distance[walking]
            walking, at, step = walking[within], at[within], step[within]
            ahead = self.order[at, step]
            place[walking] = step + 1
            fresh = ~seen[walking, ahead]
            look, other = walking[fresh], ahead[fresh]
            seen[look, other] = True
            measured += len(look)
            found = squared(vectors[look], centroids[other]).astype(np.int64)
            closer = (found < distance[look]) | ((found == distance[look]) & (other < current[look]))
            jump = look[closer]
            current[jump], distance[jump], place[jump] = other[closer], found[closer], 0
            walking = walking[place[walking] < self.order.shape[1]]
        return current, distance, measured


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of every non-empty cluster: number of vectors and their sum, exact."""
    number, dim = centroids.shape

    def add(batches):
        search = Neighbours(centroids)
        sums, counts = np.zeros((number, dim), np.int64), np.zeros(number, np.int64)
        for batch in batches:
            for _, matrix in whole_vectors(batch, dim):
                vectors = scaled(matrix)
                nearest, _, _ = search.nearest(vectors)
                order = np.argsort(nearest, kind="stable")
                own, first = np.unique(nearest[order], return_index=True)
                if len(own):
                    sums[own] += np.add.reduceat(vectors[order], first, axis=0)
                    counts += np.bincount(nearest, minlength=number)
        own = np.flatnonzero(counts)
        # Place dim of a cluster's row of sums holds the count.
        values = np.hstack([sums[own], counts[own, None]])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(own, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(dim + 1, dtype=np.int32), len(own))), pa.array(values.ravel())], ["cluster", "place", "part"])

    parts = rows.mapInArrow(add, "cluster int, place int, part long")
    totals = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).collect()
    found: dict[int, list[int]] = {}
    for r in totals:
        found.setdefault(r["cluster"], [0] * (dim + 1))[r["place"]] = int(r["total"])
    return {c: (values[dim], values[:dim]) for c, values in found.items()}


def fit(rows: DataFrame, clusters: int, rounds: int, dim: int, seed: int) -> np.ndarray:
    """The centroids after the rounds."""
    centroids = starting_centroids(rows, clusters, dim, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (count, total) in cluster_sums(rows, centroids).items():
            moved[c] = [t // count for t in total]
        if (moved == centroids).all():
            break  # every further round would change nothing
        centroids = moved
    return centroids


def cluster(table: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    rows = keyed(table, key, vector)
    centroids = fit(rows, clusters, rounds, dim, seed)
    schema = "vec_id long, cluster int, distance long"

    def assign(batches):
        if not len(centroids):
            return
        search = Neighbours(centroids)
        for batch in batches:
            for ids, matrix in whole_vectors(batch, dim):
                nearest, distance, _ = search.nearest(scaled(matrix))
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = stash(rows.mapInArrow(assign, schema), "clusters")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    facts = [(c, total, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in sums.items()]
    told = table.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = 2) -> str:
    """The rounds written out one after another, every vector held against every centroid."""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
  ORDER BY sha256('{seed}:' || vec_id), v LIMIT {clusters})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
  SELECT r, vec_id, kept.v, c, CAST(list_sum(list_transform(range(1, {dim} + 1), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))) AS BIGINT) AS d FROM kept CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM (
  SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dim} + 1)) AS p FROM a{i}) GROUP BY c, p) GROUP BY c)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN s{i} USING (c))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE = _oracle()
