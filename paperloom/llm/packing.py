"""Best-fit packing from a configuration linear program.

Every document becomes ids, as the tokeniser's JSON file gives them (tokens it adds are found in the
text), then one closing id; only a document longer than a sequence is cut, into full-length pieces from its end, so that just its first piece may be shorter.
What a packer needs to know of the pieces is how many there are of each length, at most
`capacity` numbers. On that histogram the driver solves the configuration program: weights
on lengths (multiplicative weights) price the best filling of one sequence by a knapsack
table, each priced filling covers part of the lengths still wanted, and the fractional
counts are rounded down. What rounding leaves is filled longest first with the longest
piece that fits. The k-th piece of a length then belongs to a known place, so pieces find
their sequence by a bounded table and no group of pieces meets in one task.

Null text counts as empty: one piece holding the closing id. Rows that repeat an id are
packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import stash, tokenizer_encoder

CAPACITY = 2048
CLOSING_ID = 0
ROUNDS = 300


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with `total` ids."""
    head = total % capacity
    edges = ([0] if head else []) + list(range(head, total, capacity))
    return [(a, b - a) for a, b in zip(edges, [*edges[1:], total], strict=True)]


def pieces_of(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, numbered within its task and length by `slot`."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()
    out = "piece int, start long, length long, ids_crc32 long, part long, slot long"

    def run(batches):
        encode, part, seen = tokenizer_encoder(tokenizer, vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows, piece, start, length, crc, slot = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = encode(value or "") + closing
                for number, (begin, size) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * begin:4 * (begin + size)]))
                    slot.append(seen[size])
                    seen[size] += 1
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, long)), pa.array(piece, pa.int32()), pa.array(start, long), pa.array(length, long),
                pa.array(crc, long), pa.array([part] * len(rows), long), pa.array(slot, long),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "slot"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {out}")


def best_filling(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of highest price that fits: a knapsack table over room."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            values = best[room - lengths[:n]] + prices[:n]
            top = int(values.argmax())
            if values[top] > best[room]:
                best[room], last[room] = values[top], top
    filling, room = defaultdict(int), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            filling[int(lengths[last[room]])] += 1
            room -= int(lengths[last[room]])
    return dict(filling)


def fractional(counts: dict[int, int], capacity: int, rounds: int, share: float = 0.5, rate: float = 0.3) -> list[tuple[dict[int, int], float]]:
    """Fillings and how often to use each, by multiplicative weights on the lengths.

    A length starts with a weight a little above proportion, as long pieces are hard to
    place late; every filling that covers part of what is wanted of it lowers the weight.
    """
    lengths = np.array(sorted(counts))
    wanted = np.array([counts[x] for x in lengths.tolist()], float)
    spot = {x: i for i, x in enumerate(lengths.tolist())}
    covered, weights = np.zeros(len(lengths)), lengths.astype(float) ** 1.1
    chosen: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        missing = covered < 1
        if not missing.any():
            break
        filling = best_filling(lengths[missing], weights[missing], capacity)
        most = min(wanted[spot[x]] / n for x, n in filling.items())
        step = max(share * most, min(1.0, most))
        for x, n in filling.items():
            gain = n * step / wanted[spot[x]]
            covered[spot[x]] += gain
            weights[spot[x]] *= np.exp(-rate * gain)
        chosen[tuple(sorted(filling.items()))] += step
    return [(dict(k), v) for k, v in chosen.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, list[tuple[int, int]]]]:
    """How many sequences get which filling: (copies, [(length, pieces)]), covering `counts` exactly."""
    left = {x: n for x, n in counts.items() if n > 0}
    made: list[tuple[int, list[tuple[int, int]]]] = []

    def use(filling: dict[int, int], copies: int) -> None:
        made.append((copies, sorted(filling.items(), reverse=True)))
        for x, n in filling.items():
            left[x] -= n * copies
            if not left[x]:
                del left[x]

    if capacity in left:
        use({capacity: 1}, left[capacity])
    if left:
        for filling, times in sorted(fractional(dict(left), capacity, rounds), key=lambda f: -sum(x * n for x, n in f[0].items())):
            copies = min([int(times + 1e-9), *(left.get(x, 0) // n for x, n in filling.items())])
            if copies:
                use(filling, copies)
    while left:
        order = sorted(left)
        filling, room = defaultdict(int), capacity
        while (n := bisect_right(order, room)) > 0:
            x = order[n - 1]
            take = min(left[x], room // x)
            filling[x] = take
            room -= take * x
            order = order[:n - 1]
        use(dict(filling), min(left[x] // n for x, n in filling.items()))
    return made


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ranges of pieces by number: (first number, pieces a sequence, first sequence, offset)."""
    found, number, sequence = defaultdict(list), defaultdict(int), 0
    for copies, filling in made:
        offset = 0
        for length, n in filling:
            found[length].append((number[length], n, sequence, offset))
            number[length] += n * copies
            offset += n * length
        sequence += copies
    return dict(found)


def place(pieces: DataFrame, table: dict[int, list[tuple[int, int, int, int]]]) -> DataFrame:
    """Sequence and offset of each piece, from its length and its number within the length."""
    arrays = {length: np.array(rows, np.int64).T for length, rows in table.items()}
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            length, number = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    size = int(length[own[0]])
                    first, n, base, start = arrays[size]
                    at = np.searchsorted(first, number[own], "right") - 1
                    step, within = np.divmod(number[own] - first[at], n[at])
                    sequence[own], offset[own] = base[at] + step, start[at] + within * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    rows = pieces.select(*columns, F.col("length").alias("_length"), "number")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None, tokenizer: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Pieces of every document with the sequence and offset they are packed at."""
    pieces = stash(pieces_of(docs, text, key, capacity, vocabulary, tokenizer), "pieces")
    counts = stash(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most `capacity` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("base") + F.col("slot"))
    return place(numbered, table)
