"""Shards of near equal bytes: minimax contiguous partition of ordered groups.

Rows with equal texts form a group that stays together. Groups are ordered by the MD5 of their
text, so the order is independent of source and id, and any range of it is a like share of
the corpus. The shards are contiguous ranges of that order. The smallest capacity for which
`shards` ranges suffice is found by binary search; a capacity is checked greedily, each range
taking groups as long as they fit. Under that capacity the cuts are then set from left to
right at the group boundary nearest to an even share of what is left, as far as the rest
still fits; so one huge group does not leave later shards empty.

The driver never holds the groups. It holds sums of cells, ranges of the order: first the
4-digit prefixes of the hash, at most 65,536. The search runs on the cells' boundaries, which are group
boundaries; every look-up that falls inside a cell of several groups is noted, the noted
cells are cut by two more digits in one aggregate over the rows, and the search is
repeated until no look-up falls inside an open cell: then it is exact. Look-ups are bounded
by the steps of the binary search times shards. A row's shard follows from comparing its hash with the cuts, without a join,
so a text that a third of all rows share costs nothing more.

Places in a shard go by the MD5 of id and text, so a shard is in random order and its rows
can be numbered in buckets of that hash, with one small sum per bucket carried over.

Main path: SQL functions only. Null text counts as empty: 8 bytes, in the group of the empty
text. Rows without id and repeated rows are rows as any other; rows that agree in id and text
take neighbouring places in any order. Fewer groups than shards leave shards empty; an empty table gives no rows.
Ties between two cuts at the same distance go to the earlier one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import stash

SHARDS = 24
OVERHEAD = 8
DIGITS, FINER = 4, 2  # hash digits of the first cells, and more digits each time
PLACES = 3  # hash digits of a bucket of places


class Cells:
    """Sums of ranges of groups in order, with the boundaries between them."""

    def __init__(self):
        self.found: dict[str, tuple[int, str, str]] = {}

    def replace(self, old: set[str], new: list[tuple[str, int, str, str]]) -> None:
        for prefix in old:
            del self.found[prefix]
        for prefix, size, first, last in new:
            self.found[prefix] = (size, first, last)
        self.prefixes = sorted(self.found)
        self.ends = [0]
        for prefix in self.prefixes:
            self.ends.append(self.ends[-1] + self.found[prefix][0])
        self.open: set[str] = set()

    @property
    def total(self) -> int:
        return self.ends[-1]

    def _note(self, cell: int) -> None:
        prefix = self.prefixes[cell]
        _, first, last = self.found[prefix]
        if first != last:
            self.open.add(prefix)

    def down(self, size: int) -> int:
        """The greatest boundary not above `size`."""
        at = bisect_right(self.ends, size) - 1
        if self.ends[at] != size and at < len(self.prefixes):
            self._note(at)
        return self.ends[at]

    def up(self, size: int) -> int:
        """The least boundary not below `size`."""
        at = bisect_left(self.ends, size)
        if self.ends[at] != size:
            self._note(at - 1)
        return self.ends[at]

    def last_key(self, boundary: int) -> str:
        """The greatest hash before a boundary."""
        return self.found[self.prefixes[bisect_left(self.ends, boundary) - 1]][2]


def fits(cells: Cells, capacity: int, shards: int) -> bool:
    """Whether greedy ranges of the capacity cover everything."""
    at = 0
    for _ in range(shards):
        if at == cells.total:
            break
        at = cells.down(min(at + capacity, cells.total))
    return at == cells.total


def smallest_capacity(cells: Cells, shards: int) -> int:
    """Binary search for the least capacity that fits."""
    low, high = -(-cells.total // shards), cells.total
    while low < high:
        middle = (low + high) // 2
        if fits(cells, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(cells: Cells, shards: int) -> list[int]:
    """Boundaries after each shard but the last."""
    capacity = smallest_capacity(cells, shards)
    least = [cells.total]  # from right to left: where a shard may begin at the earliest so that the rest fits
    for _ in range(shards - 1):
        least.append(cells.up(max(least[-1] - capacity, 0)))
    made, at = [], 0
    for shard in range(1, shards):
        goal = at + (cells.total - at) // (shards - shard + 1)
        below, above = cells.down(goal), cells.up(goal)
        best = above if below == at or above - goal < goal - below else below
        at = max(min(best, cells.down(min(at + capacity, cells.total))), least[shards - shard])
        made.append(at)
    return made


def measured(docs: DataFrame, key: str, text: str, overhead: int) -> DataFrame:
    """(id, group, size, crc, place) of every row; only the text's hash and size go on."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.md5(body.cast("binary")).alias("group"), (F.octet_length(body).cast("long") + overhead).alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    return rows.withColumn("place", F.md5(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), "group").cast("binary")))


def partition(rows: DataFrame, shards: int) -> list[str]:
    """The last group hash of every shard but the last, empty where nothing lies before the cut."""
    def summed(part: DataFrame, prefix):
        return [(r["prefix"], int(r["size"]), r["first"], r["last"]) for r in part.groupBy(prefix.alias("prefix")).agg(
            F.sum(F.col("size").cast("decimal(38,0)")).alias("size"), F.min("group").alias("first"), F.max("group").alias("last")).collect()]

    cells = Cells()
    cells.replace(set(), summed(rows, F.substring("group", 1, DIGITS)))
    if not cells.total:
        return [""] * (shards - 1)
    while True:
        made = cuts(cells, shards)
        asked = cells.open
        if not asked:
            return [cells.last_key(cut) if cut else "" for cut in made]
        finer: list[tuple[str, int, str, str]] = []
        for digits in sorted({len(p) for p in asked}):
            own = [p for p in asked if len(p) == digits]
            finer += summed(rows.filter(F.substring("group", 1, digits).isin(own)), F.substring("group", 1, digits + FINER))
        cells.replace(set(asked), finer)


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    rows = stash(measured(docs, key, text, overhead), "sharded")
    number = F.lit(0)
    for last in partition(rows, shards):
        number = number + (F.col("group") > last).cast("int") if last else number + F.lit(1)
    placed = rows.select("id", "size", "crc", "group", "place", number.alias("shard"), F.substring("place", 1, PLACES).alias("bucket"))
    # One row for each shard and bucket (shards x 4096 at most), so its running sum is small and may be sent to all.
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place", "id")) - 1
    return placed.withColumn("inside", inside.cast("long")).join(F.broadcast(starts), ["shard", "bucket"]).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _oracle(shards: int = SHARDS, overhead: int = OVERHEAD) -> str:
    """The search as recursion, one look-up a step, over the list of all group boundaries; CRC from its rule, byte by byte."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
r AS MATERIALIZED (SELECT doc_id, md5(body) AS g, CAST(octet_length(encode(body)) AS BIGINT) + {overhead} AS size, md5(concat_ws(' ', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(body))) AS place FROM d),
bits AS (SELECT i AS x, 0 AS step, CAST(i AS BIGINT) AS v FROM range(256) t(i) UNION ALL
  SELECT x, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
table_ AS MATERIALIZED (SELECT list(v ORDER BY x) AS t FROM bits WHERE step = 8),
u AS MATERIALIZED (SELECT DISTINCT body FROM d),
crc AS MATERIALIZED (SELECT md5(body) AS g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(body)), '..'),
    lambda h: CAST((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM u, table_),
p AS MATERIALIZED (SELECT list_prepend(CAST(0 AS BIGINT), list(e ORDER BY e)) AS b, max(e) AS total FROM (SELECT CAST(sum(sum(size)) OVER (ORDER BY g) AS BIGINT) AS e FROM r GROUP BY g)),
search AS (SELECT (total + {shards - 1}) // {shards} AS low, total AS high, 0 AS shard, CAST(0 AS BIGINT) AS pos FROM p UNION ALL
  SELECT CASE WHEN shard = {shards} AND pos < total THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN shard <= {shards} AND pos = total THEN (low + high) // 2 ELSE high END,
    CASE WHEN shard = {shards} OR pos = total THEN 0 ELSE shard + 1 END,
    CASE WHEN shard = {shards} OR pos = total THEN 0 ELSE list_max(list_filter(b, lambda x: x <= pos + (low + high) // 2)) END FROM search, p WHERE low < high),
c AS MATERIALIZED (SELECT min(low) AS capacity FROM search WHERE low = high),
back AS (SELECT 0 AS n, total AS pos FROM p UNION ALL SELECT n + 1, list_min(list_filter(b, lambda x: x >= greatest(pos - capacity, 0))) FROM back, p, c WHERE n < {shards - 1}),
least AS MATERIALIZED (SELECT list(pos ORDER BY n) AS l FROM back),
goals AS (SELECT 0 AS shard, CAST(0 AS BIGINT) AS pos FROM p UNION ALL
  SELECT shard + 1, greatest(least(CASE WHEN below = pos OR above - goal < goal - below THEN above ELSE below END, reach), l[{shards} - shard]) FROM (
    SELECT *, list_max(list_filter(b, lambda x: x <= goal)) AS below, list_min(list_filter(b, lambda x: x >= goal)) AS above, list_max(list_filter(b, lambda x: x <= pos + capacity)) AS reach FROM (
      SELECT shard, pos, b, l, capacity, pos + (total - pos) // ({shards} - shard) AS goal FROM goals, p, c, least WHERE shard < {shards - 1}))),
cut AS MATERIALIZED (SELECT list(pos ORDER BY shard) AS cuts FROM goals WHERE shard > 0),
ends AS (SELECT g, CAST(sum(sum(size)) OVER (ORDER BY g) AS BIGINT) AS e FROM r GROUP BY g),
placed AS (SELECT r.*, CAST(len(list_filter(cuts, lambda x: x < e)) AS INT) AS shard FROM r JOIN ends USING (g), cut)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed JOIN crc USING (g)
"""


ORACLE = _oracle()
