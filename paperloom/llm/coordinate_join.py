"""Near-duplicates by an inverted join on signature coordinates.

Every document's set of word shingles (ASCII-lower-cased words, distinct) is reduced to a
signature: `coordinates` minima under independent hashes, and two bits for each of `BINS`
bins of one further hash. Equal sets are collapsed first and numbered. A set is posted under its
coordinate-value pairs; two sets are candidates if they share at least `matches` of them,
so they must share one of the `coordinates - matches + 1` pairs that are rarest in the
corpus (prefix filter): only those are posted, pairs that occur once are skipped, and
frequent pairs are skipped whenever rarer ones suffice. A set stays in a list (of up to `BLOCK` sets) if
one of fitting size there shares `MET` of the pairs with it, fewer than a couple of candidates does. Collisions of candidates are then
counted over the bins; a pair stays if its share of equal bins is no further below the
similarity than chance explains (`SPREADS` standard deviations), and is confirmed on the
full sets.

Groups never expand into all pairs. In the first rounds each posting list names one centre,
the member whose pairs are most frequent (an original rather than one of its copies; another one
each round), and members are held against their best centres only; linked sets merge into components. What is
left, couples within a posting list that are still in different components, is counted
completely inside the lists, in blocks of bounded size: over the bins, then over 16 bits of every
shingle. A unit puts out the couples that join its components, not those between components
it has already joined. So no link between components is lost.

Null or blank text has an empty set: linked with nothing, its own component. Rows without
id form components but have no name to give: the smallest id reachable names a component,
and only if no member has an id is it null. Repeated rows fall into one component; each is
kept if its id is the component's. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import MULTIPLIER, components, discard, mixed, stash

COORDINATES = 16
MATCHES = 6  # a pair at the threshold of 0.8 has fewer with a chance of 1 in 30,000
MET = 4  # equal coordinates of two members that keep each other in a list; a pair at the threshold has fewer with a chance of 1 in 4 million
ROUNDS = 2
BLOOM_BITS = 1 << 26
BINS = 1024
SPREADS = 4.0
BLOCK = 2048  # members of a posting list compared at once
SLICE = 256  # pairs of a centre confirmed in one task
PRECISION = 6  # bytes of a shingle's hash that two sets are compared by
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order.

    Polynomial prefix sums give each word's value at once: (sum to its end - sum to its
    start) divided by the power at its start, all modulo 2**64.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~BLANK[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    powers = np.full(len(raw) + 1, MULTIPLIER)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(len(raw) + 1, _INVERSE)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mixed(FOLD[raw] + np.uint64(1))) * powers[:-1])))
    return mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `words` words; of the whole if it has fewer."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    value = np.full(len(hashes) - width + 1, np.uint64(width))
    for i in range(width):
        value = mixed(value * MULTIPLIER + hashes[i:len(hashes) - width + 1 + i])
    return np.unique(value)


def minima(values: np.ndarray, coordinates: int) -> np.ndarray:
    """Smallest image of the set under each of the coordinate hashes, upper 32 bits."""
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * MULTIPLIER)
    odd, shift = seeds[:coordinates] | np.uint64(1), seeds[coordinates:]
    least = np.full(coordinates, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 4096):
        part = values[at:at + 4096, None] * odd + shift
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def fingerprints(values: np.ndarray) -> np.ndarray:
    """16 bits of a hash of every element, sorted. Two sets have at most as many elements in common as fingerprints."""
    return np.sort((mixed(values * MULTIPLIER + np.uint64(77)) >> np.uint64(48)).astype("<u2"))


def binned(prints: np.ndarray) -> bytes:
    """Two bits per bin of the fingerprints: 0 if none falls there, else 1 to 3, made from the smallest that does."""
    bins = prints >> (16 - BINS.bit_length() + 1)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    found = np.zeros(BINS, np.uint8)
    found[bins[first]] = (prints[first] & (2 ** 16 // BINS - 1)) % 3 + 1
    lanes = found.reshape(-1, 4)
    return (lanes[:, 0] | lanes[:, 1] << 2 | lanes[:, 2] << 4 | lanes[:, 3] << 6).tobytes()


def squeezed(values: np.ndarray) -> bytes:
    """A set's fingerprints as steps from one to the next: a byte each, 255 standing for a longer one kept behind them."""
    steps = np.diff(fingerprints(values), prepend=np.uint16(0))
    short = np.minimum(steps, 255).astype(np.uint8)
    return len(steps).to_bytes(4, "little") + short.tobytes() + steps[short == 255].astype("<u2").tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    number = int.from_bytes(data[:4], "little")
    short = np.frombuffer(data, np.uint8, number, 4)
    steps = short.astype(np.int64)
    steps[short == 255] = np.frombuffer(data, "<u2", offset=4 + number)
    return np.cumsum(steps).astype("<u2")


def counted(prints: np.ndarray) -> np.ndarray:
    """Fingerprints made different from one another by how often each came before."""
    again = np.arange(len(prints)) - np.searchsorted(prints, prints)
    return prints.astype(np.uint64) << np.uint64(32) | again.astype(np.uint64)


def nearly(one: np.ndarray, two: np.ndarray, share: int) -> tuple[bool, bool]:
    """Whether two sets, given by counted fingerprints, can be similar enough, and whether that is as good as sure.

    Different elements share a fingerprint with a chance of 1 in 65,536; that more do than six standard
    deviations above the mean and three allow isn't to be expected once in 10 million couples.
    """
    common, both = len(np.intersect1d(one, two, assume_unique=True)), len(one) + len(two)
    chance = (len(one) - common) * (len(two) - common) / 65536
    least = common - int(chance + 6 * chance ** 0.5 + 3)
    return 100 * common >= share * (both - common), 100 * least >= share * (both - least)


LOW = np.uint64(0x5555555555555555)


def unpacked(bins: list[bytes]) -> np.ndarray:
    """The bins of several sets, 32 to a word."""
    return np.frombuffer(b"".join(bins), np.uint64).reshape(-1, BINS // 32)


def alike(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated equal bins of rows of two tables, and whether so many allow the similarity.

    `sizes` are the sizes of both sets together. A bin filled on both sides by different elements looks
    equal in one case of three, which the estimate takes off. The bins draw from the union without putting
    back; at the similarity asked for the union has sizes / (1 + similarity) elements.
    """
    full_left, full_right = ((w | w >> np.uint64(1)) & LOW for w in (left, right))
    apart = left ^ right
    equal = full_left & full_right & ~(apart | apart >> np.uint64(1))
    looks, both, used = (np.bitwise_count(w).sum(axis=-1, dtype=np.int64) for w in (equal, full_left & full_right, full_left | full_right))
    hits = 1.5 * looks - 0.5 * both
    s = share / 100
    undrawn = np.clip(1 - used * (1 + s) / sizes, 0, 1)
    spread = s * (1 - s) * used * undrawn + 0.5 * np.maximum(both - s * used, 0)
    return hits, hits >= s * used - SPREADS * np.sqrt(spread)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes()).digest()


def shortened(values: np.ndarray) -> bytes:
    """The low bytes of every hash: two sets meet by them, so they need to tell apart the shingles of two texts only."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :PRECISION].tobytes()


def lengthened(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, PRECISION)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :PRECISION] = short
    return wide.view("<u8").ravel()


def signatures(docs: DataFrame, key: str, text: str, words: int, coordinates: int) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set (null if empty), signature (minima) and bins."""
    def run(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([minima(s, coordinates).tobytes() if len(s) else None for s in sets], pa.binary()),
                pa.array([binned(fingerprints(s)) if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "signature", "bins"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, signature binary, bins binary")


def postings(sets: DataFrame, coordinates: int, matches: int, share: int, block: int = BLOCK) -> DataFrame:
    """(posting, node, size, weight): each set under its rarest coordinate-value pairs that occur more than once.

    `weight` is how often the set's pairs occur in all, so the most central of a group weighs most. In a list
    of at most `block` sets those stay that another one meets there (`met`); longer lists stay as they are,
    their groups merge before anything is counted in them.
    """
    def spread(batches):
        place = (np.arange(coordinates, dtype=np.int64) << 32)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, coordinates).astype(np.int64) + place
            rows = pa.array(np.repeat(np.arange(len(values)), coordinates))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(values.ravel())], ["node", "size", "posting"])

    every = sets.select("node", F.col("n_shingles").cast("int"), "signature").mapInArrow(spread, "node long, size int, posting long")
    times = every.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = every.join(times, "posting").groupBy("node").agg(
        F.first("size").alias("size"), F.sum("n").alias("weight"), F.array_sort(F.collect_list(F.struct("n", "posting"))).alias("found"))
    # Pairs that occur once are the rarest of all; they take the first places of the prefix and meet nobody.
    room = F.size("found") - F.lit(matches - 1)
    prefix = shared.filter(room > 0).select("node", "size", "weight", F.slice("found", 1, F.greatest(room, F.lit(1))).alias("posted"))
    lists = stash(prefix.select("node", "size", "weight", F.explode("posted").alias("f")).select("f.posting", "f.n", "node", "size", "weight"), "lists")
    short, long = (lists.filter(f"n {side} {block}").drop("n") for side in ("<=", ">"))
    kept = stash(met(short, sets, coordinates, min(MET, matches), share).unionByName(long), "postings")
    discard(lists)
    return kept


def shared_values(sets: DataFrame, coordinates: int) -> DataFrame:
    """(node, short): 16 bits of every coordinate's value."""
    def run(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, 2 * coordinates)[:, ::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], ["node", "short"])

    return sets.select("node", "signature").mapInArrow(run, "node long, short binary")


def units(batches, keys: tuple) -> Iterator[dict]:
    """Rows come unit after unit: the columns of each; a unit is held until the next one begins."""
    held: dict = {}
    now = None
    for batch in batches:
        columns = batch.to_pydict()
        places = list(zip(*(columns[k] for k in keys), strict=True))
        at = 0
        while at < len(places):
            stop = at
            while stop < len(places) and places[stop] == places[at]:
                stop += 1
            if places[at] != now:
                if held:
                    yield held
                now, held = places[at], {c: [] for c in columns}
            for c in columns:
                held[c] += columns[c][at:stop]
            at = stop
    if held:
        yield held


def met(lists: DataFrame, sets: DataFrame, coordinates: int, least: int, share: int) -> DataFrame:
    """Memberships beside which, in the same list, stands one of fitting size with `least` equal coordinates or more.

    lists: posting, node, size, weight. A list is held whole. Sets that have one coordinate in common by chance, of which
    there are ever more in a growing corpus, leave the list here, where no more than 16 bits a coordinate move.
    """
    placed = lists.join(shared_values(sets, coordinates), "node").select(*lists.columns, "short")
    dealt = placed.repartition("posting").sortWithinPartitions("posting")
    types = pa.schema([(c, pa.int32() if c == "size" else pa.int64()) for c in lists.columns])

    def beside(rows: dict) -> list:
        size, values = np.array(rows["size"]), np.frombuffer(b"".join(rows["short"]), "<u2").reshape(-1, coordinates)
        good = []
        for at in range(0, len(size), 64):
            part = size[at:at + 64, None]
            near = (values[at:at + 64, None] == values).sum(axis=-1) >= least
            near &= 100 * np.minimum(part, size) >= share * np.maximum(part, size)
            # Every member meets itself.
            good += (np.flatnonzero(near.sum(axis=1) > 1) + at).tolist()
        return good

    def run(batches):
        found: dict = {c: [] for c in types.names}
        for rows in units(batches, ("posting",)):
            good = beside(rows) if len(rows["node"]) > 1 else []
            for c in found:
                found[c] += [rows[c][k] for k in good]
            if len(found["node"]) > 10000:
                yield pa.RecordBatch.from_pydict(found, types)
                found = {c: [] for c in types.names}
        yield pa.RecordBatch.from_pydict(found, types)

    return dealt.mapInArrow(run, lists.schema)


def open_lists(labelled: DataFrame, share: int) -> DataFrame:
    """Memberships that may still meet a member of another component whose size allows the similarity.

    Sizes fall into bands as wide as the similarity allows two sizes to differ, so partners are in the same or the
    next band; of each list and band one row of labels decides.
    """
    banded = labelled.withColumn("band", F.floor(F.log("size") / F.log(F.lit(100 / share))).cast("int"))
    near = Window.partitionBy("posting").orderBy("band").rangeBetween(-1, 1)
    labels = banded.groupBy("posting", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    apart = labels.select("posting", "band", F.min("low").over(near).alias("low"), F.max("high").over(near).alias("high")).filter("low <> high")
    return banded.join(apart, ["posting", "band"], "left_semi").drop("band")


def collided(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) with `hits`, their equal bins, of those that may be similar enough. `pairs` is read twice."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sifted(sets.select("node", "n_shingles", "bins"), nodes)
    one = sets.select(F.col("node").alias("a"), F.col("bins").alias("bins_a"), F.col("n_shingles").alias("size_a"))
    two = sets.select(F.col("node").alias("b"), F.col("bins").alias("bins_b"), F.col("n_shingles").alias("size_b"))

    def run(batches):
        for batch in batches:
            left, right = (unpacked(batch.column(i).to_pylist()) for i in (2, 3))
            hits, good = alike(left, right, batch.column(4).to_numpy(), share)
            rows = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hits[good])], ["a", "b", "hits"])

    return pairs.join(one, "a").join(two, "b").select(
        "a", "b", "bins_a", "bins_b", (F.col("size_a") + F.col("size_b")).alias("sizes")).mapInArrow(run, "a long, b long, hits double")


def within_lists(lists: DataFrame, sets: DataFrame, texts, share: int, block: int = BLOCK) -> DataFrame:
    """Couples (a, b) of the same posting list that join all components with similar members there.

    lists (read several times): posting, node, label; `texts(wanted, make)` makes the wanted sets again from their texts. Members with up to `block` shingles a member on average are one unit of work; of a
    longer list, every two blocks are. A unit counts what every two members of different components
    have in common, first over bins, then over the fingerprints of the whole sets. Once a couple as good as
    sure joins two components, further couples between them are not put out.
    """
    blocks = F.ceil(F.col("total") / (block * 512)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    sizes = lists.groupBy("posting").agg(F.sum(F.greatest(F.col("size"), F.lit(512))).alias("total"))
    wanted = sets.select("node", "n_shingles", "digest", "holder").join(lists.select("node").distinct(), "node")
    held = texts(wanted, squeezed).join(wanted, ["digest", "holder"]).groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("values").alias("prints"))
    placed = lists.select("posting", "node", "label").join(sizes, "posting").join(held, "node").withColumn("own", own)
    unit = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "posting", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n_shingles", "prints")
    dealt = unit.repartition(F.col("posting"), F.col("i"), F.col("j")).sortWithinPartitions("posting", "i", "j")

    def couples(rows: dict):
        labels, number, size, nodes = (np.array(rows[c]) for c in ("label", "own", "n_shingles", "node"))
        if (labels == labels[0]).all():
            return []
        prints = [unsqueezed(p) for p in rows["prints"]]
        bins = unpacked([binned(p) for p in prints])
        whole = lru_cache(maxsize=None)(lambda at: counted(prints[at]))
        split = rows["i"][0] != rows["j"][0]
        above: dict = {}

        def top(label):
            while label in above:
                label = above[label]
            return label

        found = []
        for at in range(len(number)):
            # The later rows of another label and of a size that allows it; of two blocks, only across them.
            later = np.arange(at + 1, len(number))
            fits = (labels[later] != labels[at]) & (100 * np.minimum(size[later], size[at]) >= share * np.maximum(size[later], size[at]))
            later = later[fits & (number[later] != number[at])] if split else later[fits]
            if not len(later):
                continue
            for near in later[alike(bins[later], bins[at], size[later] + size[at], share)[1]].tolist():
                one, two = top(labels[at]), top(labels[near])
                if one == two:
                    continue
                possible, sure = nearly(whole(at), whole(near), share)
                if possible:
                    found.append((min(nodes[at], nodes[near]), max(nodes[at], nodes[near])))
                if sure:
                    above[max(one, two)] = min(one, two)
        return found

    def run(batches):
        for rows in units(batches, ("posting", "i", "j")):
            yield from put_out(couples(rows))

    def put_out(found):
        if found:
            a, b = zip(*sorted(set(found)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # Several lists may name a couple.
    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, full: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs whose full sets are similar enough.

    `a` may be the centre of many: its pairs are cut into slices of SLICE, by their number, and its set is
    sent once to each. It comes first in its slice, so a task holds one set besides the batch it reads.
    """
    place = sets.select("node", "digest", "holder")
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    sliced = pairs.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slices")).alias("slice"))
    centres = sliced.select("a", "slice").distinct().join(place.withColumnRenamed("node", "a"), "a").select("a", "slice", F.lit(None).cast("long").alias("b"), "digest", "holder")
    asked = sliced.join(place.withColumnRenamed("node", "b"), "b").select("a", "slice", "b", "digest", "holder")
    held = centres.unionByName(asked).join(full, ["digest", "holder"]).select("a", "slice", "b", "values")
    dealt = held.repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b"))

    def run(batches):
        now, centre = None, None
        for batch in batches:
            found_a, found_b = [], []
            for a, part, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    if now != (a, part):
                        now, centre = (a, part), lengthened(data)
                elif now == (a, part):
                    own = lengthened(data)
                    common = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * common >= share * (len(centre) + len(own) - common):
                        found_a.append(a)
                        found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def marks(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size with a bit for every value (a hash) of the column, built in the JVM."""
    place = F.pmod(column, F.lit(bits)) + 1
    maps = rows.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bitmap")).collect()
    width = 4096
    table = np.zeros(max(bits // 8, width), np.uint8)
    for row in maps:
        table[(row["bucket"] - 1) * width:row["bucket"] * width] = np.frombuffer(row["bitmap"], np.uint8)
    return table


def marked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows whose bit is set."""
    return np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def sifted(sets: DataFrame, nodes: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """The sets of the given nodes and few others: what a later join need not move is held back by a bitmap."""
    shared = sets.sparkSession.sparkContext.broadcast(marks(nodes.select(F.xxhash64("node").alias("at")), "at", bits))

    def run(batches):
        for batch in batches:
            rows = pa.array(marked(shared.value, batch.column(batch.num_columns - 1).to_numpy()))
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns[:-1]], batch.schema.names[:-1])

    return sets.withColumn("_at", F.pmod(F.xxhash64("node"), F.lit(bits))).mapInArrow(run, sets.schema)


def full_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame, make=shortened, bits: int = BLOOM_BITS) -> DataFrame:
    """(digest, holder, values) of the wanted sets, made again from the texts that hold them; `make` says what of them.

    `holder` is the hash of the id of one row that has the set. A filter of fixed size (`bits`),
    built in the JVM from the holders, goes to all tasks: a text it does not let through is not
    read further. Rows that come through by chance, or repeat a row, find no partner or a partner twice.
    """
    table = marks(wanted.select("holder"), "holder", bits)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        held, done = shared.value, set()
        for batch in batches:
            holders = batch.column(0)
            likely = pa.array(marked(held, holders.to_numpy() % bits))
            made = []
            for holder, t in zip(holders.take(likely).to_pylist(), batch.column(1).take(likely).to_pylist(), strict=True):
                found = shingles(t, words)
                if len(found):
                    digest = set_key(found)
                    if (digest, holder) not in done:
                        done.add((digest, holder))
                        made.append((digest, holder, make(found)))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["digest", "holder", "values"])

    texts = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(key).alias("holder"), F.col(text).alias("text"))
    return texts.mapInArrow(run, "digest binary, holder long, values binary")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, share: int = 80, coordinates: int = COORDINATES,
         matches: int = MATCHES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    rows = stash(signatures(docs, key, text, words, coordinates), "signatures")
    sets = rows.filter("digest is not null").groupBy("digest").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bins").alias("bins"),
        F.min(F.xxhash64("doc_id")).alias("holder"))
    # Numbers stand for the sets from here on; written once, so they stay as they are.
    sets = stash(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    posted = postings(sets, coordinates, matches, share)
    links, labels = None, sets.select("node", F.col("node").alias("label")).limit(0)
    labelled = posted.withColumn("label", F.col("node"))
    used = None
    fits = 100 * F.least("size", "size_a") >= share * F.greatest("size", "size_a")
    for turn in range(rounds + 1):
        open_ = open_lists(labelled, share)
        if turn < rounds:
            fresh = open_ if used is None else open_.join(used, "node", "left_anti")
            centres = fresh.groupBy("posting").agg(F.max(F.struct("weight", "node", "label", "size")).alias("c")).select(
                "posting", F.col("c.node").alias("a"), F.col("c.label").alias("label_a"), F.col("c.size").alias("size_a"))
            tried = stash(open_.join(centres, "posting").filter((F.col("label") != F.col("label_a")) & fits).select("a", F.col("node").alias("b")).distinct(), "pairs")
            near = collided(tried, sets, share)
            # The best centre of each member is enough here; the last turn misses nothing.
            near = near.groupBy("b").agg(F.max_by("a", F.struct("hits", "a")).alias("a")).select("a", "b")
        else:
            tried = stash(open_, "open-lists")
            near = within_lists(tried, sets, lambda wanted, make: full_sets(docs, key, text, words, wanted, make), share)
        near = stash(near, "near")
        discard(tried)
        if near.isEmpty():
            continue
        if turn < rounds:
            own = near.select(F.col("a").alias("node"))
            used = stash((own if used is None else own.unionByName(used)).distinct(), "centres")
        wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        full = stash(full_sets(docs, key, text, words, wanted.join(sets.select("node", "holder"), "node")), "full-sets")
        found = stash(confirmed(near, full, sets, share), "links")
        discard(full, near)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if turn < rounds:
            before = labelled
            labelled = stash(posted.join(labels, "node", "left").select(
                "posting", "node", "size", "weight", F.coalesce("label", "node").alias("label")), "labelled")
            if hasattr(before, "stashed_at"):
                discard(before)
    # Sets, not rows, find their component's name: the smallest id of any row of any of its sets.
    least = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    labelled = sets.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label")).join(least, "digest")
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "label").select("digest", "component_id")
    result = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").withColumn(
        "component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component: the smallest id; of rows equal in id and text, one. Columns of any name pass through."""
    mark = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    named = docs.select(F.struct(F.col(key).alias("id"), mark.alias("mark")).alias("place"), F.col(text).alias("body"))
    chosen = link(named, "place", "body", **options).filter("kept").select(F.col("doc_id.mark").alias("mark")).distinct()
    kept = docs.select(mark.alias("mark"), F.struct("*").alias("row")).join(chosen, "mark", "left_semi")
    # Rows equal in id and text are one as far as the operator can tell: any of them stays, the pick is partial before the shuffle.
    return kept.groupBy("mark").agg(F.first("row").alias("row")).select("row.*")


#: The operator on `documents` with two-word shingles: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) AS g FROM l),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, two.b FROM reach JOIN two ON reach.y = two.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
