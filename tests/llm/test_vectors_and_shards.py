"""Clustering, whitening and sharding against plain Python, on small and awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import orchard, sharding, whitening

NAN, INF = float("nan"), float("inf")


def awkward(dim, rows=200, seed=4):
    """Clustered vectors, copies, repeated ids, and rows that take no part."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    out = [(i, (centres[i % 6] + 0.3 * draw.normal(size=dim)).tolist()) for i in range(rows)]
    out += [(rows + i, out[0][1]) for i in range(60)] + [(3, out[7][1]), (3, out[3][1]), (None, out[9][1])]
    return out + [(900, None), (901, [None] + [0.0] * (dim - 1)), (902, [NAN] * dim), (903, [INF] + [0.0] * (dim - 1)), (904, []), (905, [1.0] * (dim - 1)), (None, None)]


def table_of(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, cluster int, w string, n int").repartition(3)


def sound(rows, dim):
    return [(i, np.array(v)) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]


def lloyd(rows, dim, clusters, rounds, scale=256):
    """(id, cluster, distance, cluster inertia, inertia, digest) by holding every vector against every centroid."""
    kept = [(i, [int(x) for x in np.floor(scale * v)]) for i, v in sound(rows, dim)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [list(v) for _, v in first[:clusters]]
    if not centroids:
        return Counter()
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            own = defaultdict(list)
            for (_, v), (_, n) in zip(kept, found, strict=True):
                own[n].append(v)
            for n, vs in own.items():
                centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    inertia = Counter()
    for d, n in found:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, found, strict=True))


@pytest.mark.parametrize("dim, clusters, rounds", [(8, 12, 4), (3, 40, 5), (8, 500, 2), (8, 1, 3), (8, 0, 1)])
def test_clusters(spark, dim, clusters, rounds):
    rows = awkward(dim)
    got = orchard.cluster(table_of(spark, rows), clusters=clusters, rounds=rounds, dim=dim)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == lloyd(rows, dim, clusters, rounds)


def test_clusters_of_little(spark):
    table = table_of(spark, awkward(8))
    assert orchard.cluster(table.limit(0)).count() == 0 and orchard.cluster(table, dim=64).count() == 0
    alone = [(None, [0.5, 1.0]), (None, [0.25, 1.0])]
    assert orchard.cluster(table_of(spark, alone), dim=2).count() == 0
    assert orchard.cluster(table_of(spark, [(1, [0.5, -1.0]), (1, [0.5, -1.0])]), dim=2).select("distance").distinct().collect()[0][0] == 0
    with pytest.raises(Exception, match="beyond"):
        orchard.cluster(table_of(spark, [(1, [1e12, 0.0])]), dim=2)


def test_orchard_search_is_exact_and_measures_less():
    draw = np.random.default_rng(5)
    centroids = (1000 * draw.normal(size=(60, 3))).astype(np.int64)
    centroids[10] = centroids[50]
    vectors = np.vstack([(1000 * draw.normal(size=(3000, 3))).astype(np.int64), centroids, (centroids[:30] + centroids[30:]) // 2])
    search = orchard.Neighbours(centroids)
    nearest, distance, measured = search.nearest(vectors)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (nearest == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.5 * len(vectors) * len(centroids)
    large, near = vectors * 60_000, search
    near = orchard.Neighbours(centroids * 60_000)
    assert (near.nearest(large)[0] == nearest).all()  # beyond the exact range of doubles


def whitened(rows, dim):
    """n, eigenvalues, components and x-vectors by a covariance in plain numpy."""
    x = np.array([np.floor(1024 * v) + 100000 for _, v in sound(rows, dim)])
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], axes[:, ::-1].T


@pytest.mark.parametrize("dim", [12, 5])
def test_whitening(spark, dim):
    rows = awkward(dim)
    got = whitening.whiten(table_of(spark, rows)).collect()
    kept = sound(rows, dim)
    x, values, axes = whitened(rows, dim)
    side = min(8, dim)
    assert Counter(r.vec_id for r in got) == Counter({i: n * side for i, n in Counter(i for i, _ in kept).items()})
    exact = [int(sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(v, x.sum(axis=0), strict=True))) for v in x]
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip([i for i, _ in kept], exact, strict=True))
    unique = {i: v for (i, _), v in zip(kept, x, strict=True) if i is not None and i != 3}
    for c in range(1, side + 1):
        own = [r for r in got if r.component == c and r.vec_id in unique]
        want = np.array([(unique[r.vec_id] - x.mean(axis=0)) @ axes[c - 1] for r in own]) / np.sqrt(values[c - 1])
        have = np.array([r.whitened for r in own])
        assert np.allclose(have, want, atol=1e-8) or np.allclose(have, -want, atol=1e-8)
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and r.n == len(x) and r.identity_error < 1e-9 for r in own)


def test_whitening_of_little_and_of_flat_tables(spark):
    draw = np.random.default_rng(6)
    assert whitening.whiten(table_of(spark, awkward(8)).limit(0)).count() == 0
    assert whitening.whiten(table_of(spark, [(1, [0.5, 1.0])])).count() == 0
    assert whitening.whiten(table_of(spark, [(1, [0.5, 1.0])] * 5)).count() == 0
    flat = [(i, [*(v := draw.normal(size=2)).tolist(), 7.0, 7.0]) for i in range(50)]
    got = whitening.whiten(table_of(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-9 for r in got)
    # Scales ten orders of magnitude apart: the covariance has a condition number that one Cholesky factor cannot hold.
    steep = [(i, (draw.normal(size=6) * 10.0 ** np.array([0, 2, 4, 6, 8, 9])).tolist()) for i in range(300)]
    got = whitening.whiten(table_of(spark, steep)).collect()
    assert {r.component for r in got} == set(range(1, 7)) and max(r.identity_error for r in got) < 1e-6


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(2, 10 ** 9, [10 ** 14, 10 ** 14])
    assert model.deviations(np.array([[100_000, 100_001], [100_000, 400_000]])) == [10 ** 18, None]


def minimax(sizes, shards):
    """Least capacity over all ways to cut the list, by dynamic programming."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    best = ends.copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[k], ends[i] - ends[k]) for k in range(i + 1)) for i in range(len(ends))])
    return int(best[-1])


def dealt(spark, rows, shards):
    table = spark.createDataFrame([(*r, "b", 3, 4) for r in rows], "doc_id long, text string, bucket string, size int, shard int").repartition(3)
    got = sharding.shard(table, shards).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = {}
    for r in got:
        if len(texts[r.doc_id]) == 1:
            body = texts[r.doc_id][0] or ""
            assert place.setdefault(body, r.shard) == r.shard
    groups = Counter()
    for _, t in rows:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    full = Counter()
    for r in got:
        full[r.shard] += r["size"]
    if rows:
        assert max(full.values()) == minimax([groups[g] for g in sorted(groups)], shards)
    order = [(hashlib.md5(b.encode()).hexdigest(), s) for b, s in place.items()]
    assert [s for _, s in sorted(order)] == sorted(s for _, s in order)  # shards are ranges of the order
    return full


def test_shards(spark):
    draw = random.Random(7)
    text = lambda: "é" * draw.randint(0, 40) + str(draw.random()) * draw.randint(0, 9)
    rows = [(i, text()) for i in range(150)] + [(1000 + i, f"copy {i % 3}" * 10) for i in range(30)]
    rows += [(2000, None), (2001, ""), (None, None), (None, "a text"), (None, "a text"), (5, "other"), (5, "other"), (3000, "long" * 2000)]
    full = dealt(spark, rows, 24)
    assert len(full) == 24  # one huge group leaves no shard empty
    even = dealt(spark, [(i, f"{i:0100d}") for i in range(240)], 24)
    assert set(even.values()) == {1080}
    dealt(spark, rows, 1)
    dealt(spark, rows[:5], 24)
    dealt(spark, [(i, "same") for i in range(40)], 24)
    dealt(spark, [], 24)


def test_cells_open_only_where_needed(spark, monkeypatch):
    """With one digit a level the search has to cut cells several times and still ends at the same cuts."""
    draw = random.Random(9)
    rows = spark.createDataFrame([(i, "x" * draw.randint(1, 300) + str(i)) for i in range(3000)], "doc_id long, text string")
    measured = sharding.measured(rows, "doc_id", "text", 8).cache()
    want = sharding.partition(measured, 24)
    monkeypatch.setattr(sharding, "DIGITS", 1)
    monkeypatch.setattr(sharding, "FINER", 1)
    assert sharding.partition(measured, 24) == want and want == sorted(want)
    assert measured.groupBy("group").agg(F.sum("size")).count() == 3000
