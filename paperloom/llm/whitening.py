"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers x = floor(1024 * c) + 100000. The first pass counts vectors and adds
up each dimension exactly. Then A, the rows x - S/n, is orthogonalised without ever being
moved: a pass adds up the Gram matrix of A, the driver takes the Cholesky factor R1 of it with
a shift that keeps it positive definite whatever its condition; the next pass solves the rows
through R1 (Q = A R1^-1, row by row, in the task) and adds up the Gram matrix of Q, which
gives R2, and so on; the factors are composed, R = .. R2 R1. The last pass measures how
orthogonal Q has become: its Gram matrix W gives A'A = R' W R, so the singular values of
W^(1/2) R and its right vectors are those of A, at the precision of the rows and not of their
squares. Components are the right vectors, eigenvalues their squared singular values over n.
One more pass measures the covariance of the whitened rows.

Tasks put out sums of fixed size (dimensions squared), added up by place in a shuffle; the
driver gets one matrix a pass, whatever the number of rows or tasks. Nothing is written.

Left out are vectors that are null or empty, or hold a null, a NaN or an infinity, and those
whose length is not the most frequent one (of equally frequent lengths, the greatest). Rows
without id and rows that repeat an id count as vectors of their own. Directions in which the
rows do not vary beyond rounding have no whitened value and are left out, so one vector, or
equal vectors only, or an empty table give no rows. Equal eigenvalues come in any order. Signs are
chosen so that a component's greatest entry is positive. `deviation` is null where its exact
value does not fit a long (more than about 10 million vectors of usual spread).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.vectors import keyed, whole_vectors

COMPONENTS = 8
PASSES = 3
SCALE, OFFSET = 1024, 100_000
LARGEST = 1 << 50
UNIT = np.finfo(float).eps / 2


def scaled(matrix: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as integers."""
    floors = np.floor(matrix * SCALE)
    if floors.size and np.abs(floors).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST} after scaling: sums would not be exact")
    return floors.astype(np.int64) + OFFSET


def summed(rows: DataFrame, make, whole: bool = False) -> dict[int, list[float | int]]:
    """Add up by place what `make(batches)` yields for a task: (dimension, vector of numbers)."""
    kind, exact = ("long", "decimal(20,0)") if whole else ("double", "double")

    def run(batches):
        for dim, values in make(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(values), dim, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["dim", "place", "part"])

    totals = rows.mapInArrow(run, f"dim int, place int, part {kind}").groupBy("dim", "place").agg(F.sum(F.col("part").cast(exact)).alias("total")).collect()
    found: dict[int, dict] = {}
    for r in totals:
        found.setdefault(r["dim"], {})[r["place"]] = r["total"]
    return {dim: [places[i] for i in range(len(places))] for dim, places in found.items()}


def moments(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Dimension of the fit, number of vectors and exact sum of every dimension; (0, 0, []) without vectors."""
    def make(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in whole_vectors(batch):
                dim = matrix.shape[1]
                total = held.setdefault(dim, np.zeros(dim + 1, np.int64))
                total += np.append(scaled(matrix).sum(axis=0), len(matrix))
        yield from held.items()

    found = {dim: [int(v) for v in values] for dim, values in summed(rows, make, whole=True).items() if values[-1]}
    if not found:
        return 0, 0, []
    dim = max(found, key=lambda d: (found[d][-1], d))
    return dim, found[dim][-1], found[dim][:-1]


def gram(rows: DataFrame, dim: int, mean: np.ndarray, solve) -> np.ndarray:
    """Gram matrix of the centred rows after `solve`, which turns a matrix of rows into another."""
    def make(batches):
        total = None
        for batch in batches:
            for _, matrix in whole_vectors(batch, dim):
                q = solve(scaled(matrix) - mean)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield dim, total.ravel()

    flat = summed(rows, make)[dim]
    side = int(round(len(flat) ** 0.5))
    made = np.array(flat).reshape(side, side)
    return (made + made.T) / 2


def solver(factors: list[np.ndarray]):
    """Rows through all factors in turn: Q = A R1^-1 R2^-1 .."""
    def solve(centred: np.ndarray) -> np.ndarray:
        for r in factors:
            centred = np.linalg.solve(r.T, centred.T).T
        return centred
    return solve


def shifted_cholesky(matrix: np.ndarray, n: int, always: bool) -> np.ndarray:
    """Upper factor R with R'R = matrix + shift; the shift is as small as rounding allows, and grows until the factor exists."""
    dim = len(matrix)
    shift = 11 * (n * dim + dim * (dim + 1)) * UNIT * np.linalg.norm(matrix, 2)
    if not always:
        try:
            return np.linalg.cholesky(matrix).T
        except np.linalg.LinAlgError:
            pass
    shift = min(shift, np.trace(matrix) / dim) or 1.0
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 16


class Whitening:
    """A fitted whitening: everything a task needs to turn rows into whitened ones."""

    def __init__(self, dim: int, n: int, sums: list[int]):
        self.dim, self.n, self.sums = dim, n, sums
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(0)
        self.vectors, self.eigenvalues, self.explained = np.zeros((0, dim)), np.zeros(0), np.zeros(0)
        self.identity_error = 0.0

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.vectors.T / np.sqrt(self.eigenvalues)

    def deviations(self, vectors: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        limit = float(self.n) * float(np.abs(vectors).max(initial=0)) + max(map(abs, self.sums), default=0)
        if limit < 2 ** 62:
            apart = self.n * vectors - np.array(self.sums, np.int64)
            if float(np.abs(apart).max(initial=0)) ** 2 * self.dim < 2 ** 62:
                return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in vectors.tolist()]
        return [e if e < 2 ** 63 else None for e in exact]


def fit(rows: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> Whitening:
    """Fit over all rows (id, w); `passes` Gram passes in all."""
    dim, n, sums = moments(rows)
    model = Whitening(dim, n, sums)
    if not n:
        return model
    factors: list[np.ndarray] = []
    variance = None
    for number in range(passes):
        made = gram(rows, dim, model.mean, solver(factors))
        if number == 0:
            variance = np.trace(made)
            if variance <= 0:
                return model
        if number < passes - 1:
            factors.append(shifted_cholesky(made, n, always=number == 0))
    # A'A = R' W R with W the last Gram matrix, near the identity where A has full rank.
    composed = np.eye(dim)
    for r in factors:
        composed = r @ composed
    values, axes = np.linalg.eigh(made)
    _, singular, right = np.linalg.svd((np.sqrt(np.clip(values, 0, None))[:, None] * axes.T) @ composed)
    sound = singular > singular[0] * dim * np.sqrt(n) * 8 * UNIT
    vectors = right[sound][:components]
    peak = np.abs(vectors).argmax(axis=1)
    model.vectors = vectors * np.sign(vectors[np.arange(len(vectors)), peak])[:, None]
    model.eigenvalues = singular[sound][:components] ** 2 / n
    model.explained = singular[sound][:components] ** 2 / variance
    model.identity_error = identity_error(rows, model)
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    side = len(model.eigenvalues)

    def make(batches):
        total = np.zeros(side * side + side)
        for batch in batches:
            for _, matrix in whole_vectors(batch, model.dim):
                white = model.project(scaled(matrix))
                total += np.append((white.T @ white).ravel(), white.sum(axis=0))
        yield model.dim, total

    flat = np.array(summed(rows, make)[model.dim]) / model.n
    mean = flat[side * side:]
    return float(np.abs(flat[:side * side].reshape(side, side) - np.outer(mean, mean) - np.eye(side)).max())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, passes: int = PASSES) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    rows = keyed(table, key, vector)
    model = fit(rows, components, passes)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches):
        side = len(model.eigenvalues)
        if not side:
            return
        for batch in batches:
            for ids, matrix in whole_vectors(batch, model.dim):
                vectors = scaled(matrix)
                each = pa.array(np.repeat(np.arange(len(vectors)), side))
                number = len(vectors) * side
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, side + 1, dtype=np.int32), len(vectors))), pa.array(np.full(number, model.n)),
                    pa.array(model.deviations(vectors), pa.int64()).take(each), pa.array(model.project(vectors).ravel()),
                    pa.array(np.tile(model.explained, len(vectors))), pa.array(np.full(number, model.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
