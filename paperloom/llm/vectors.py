"""Batches of vector rows as numpy matrices, for operators that work on embeddings inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, w array<double>): the two columns that count, under names of their own."""
    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("w"))


def whole_vectors(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The batch's (ids, double matrix), one for each length, of vectors without null, NaN or infinity.

    Null and empty vectors are left out, and with `dim` those of any other length.
    """
    ids, vectors = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in ([dim] if dim else sorted(set(sizes.tolist()) - {0})):
        rows = pa.array(np.flatnonzero(sizes == size))
        if not len(rows):
            continue
        matrix = vectors.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        sound = np.isfinite(matrix).all(axis=1)
        yield ids.take(rows).filter(pa.array(sound)), matrix[sound]
