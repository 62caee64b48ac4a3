"""Keyed numbering, running sums and look-back that survive hot keys.

A plain window puts all rows of a key in one task. Here the order column (a unique
non-negative integer within the key) is cut into buckets of 2**bits ids: each bucket
is handled on its own, and only one small row per bucket takes part in the carry,
which is itself bucketed once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
LEVELS = 2
HOT_SHARE = 1000  # a key is hot when it holds more than 1/HOT_SHARE of all rows


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys of the left side are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def running_before(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str,
    bits: int = BITS, levels: int = LEVELS,
) -> DataFrame:
    """Add `name`: the sum of `value` over earlier rows of the same key (0 at the start)."""
    valued = df.withColumn("_value", value.cast("long"))
    if levels == 0:
        scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        before = scope.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return valued.withColumn(name, F.coalesce(F.sum("_value").over(before), F.lit(0))).drop("_value")
    bucket = f"_bucket{levels}"
    bucketed = valued.withColumn(bucket, F.shiftright(F.col(order).cast("long"), bits))
    totals = bucketed.groupBy(*keys, bucket).agg(F.sum("_value").alias("_total"))
    carried = running_before(totals, keys, bucket, F.col("_total"), f"_carry{levels}", bits, levels - 1)
    scope = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumn("_local", F.coalesce(F.sum("_value").over(scope), F.lit(0)))
    return (
        null_safe_join(local, carried.drop("_total"), [*keys, bucket])
        .withColumn(name, F.col("_local") + F.col(f"_carry{levels}"))
        .drop("_value", bucket, "_local", f"_carry{levels}")
    )


def numbered(df: DataFrame, keys: list[str], order: str, name: str, **kw) -> DataFrame:
    """Add `name`: 1, 2, 3... within the key, in `order`."""
    return running_before(df, keys, order, F.lit(1), name, **kw).withColumn(name, F.col(name) + 1)


def previous(
    df: DataFrame, keys: list[str], order: str, columns: list[str], prefix: str = "prev_",
    bits: int = BITS, levels: int = LEVELS,
) -> DataFrame:
    """Add prev_* copies of `columns` from the row just before in the same key (null at the start)."""
    packed = df.withColumn("_row", F.struct(*columns))
    filled = _look_back(packed, keys, order, bits, levels)
    for column in columns:
        filled = filled.withColumn(prefix + column, F.col(f"_prev.{column}"))
    return filled.drop("_row", "_prev")


def _look_back(df: DataFrame, keys: list[str], order: str, bits: int, levels: int) -> DataFrame:
    if levels == 0:
        scope = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumn("_prev", F.lag("_row").over(scope.orderBy(order)))
    bucket = f"_bucket{levels}"
    bucketed = df.withColumn(bucket, F.shiftright(F.col(order).cast("long"), bits))
    last = bucketed.groupBy(*keys, bucket).agg(F.max_by("_row", order).alias("_row"))
    carried = _look_back(last, keys, bucket, bits, levels - 1).drop("_row").withColumnRenamed("_prev", f"_edge{levels}")
    local = bucketed.withColumn(
        "_near", F.lag("_row").over(Window.partitionBy(*keys, bucket).orderBy(order))
    )
    return (
        null_safe_join(local, carried, [*keys, bucket])
        .withColumn("_prev", F.coalesce("_near", f"_edge{levels}"))
        .drop(bucket, "_near", f"_edge{levels}")
    )


def attach(
    fact: DataFrame, per_key: DataFrame, keys: list[str], weight: str, spread: Column,
    slices: int = 64, how: str = "left",
) -> DataFrame:
    """Join per-key values back onto the rows they came from.

    `weight` is the per-key row count. At most HOT_SHARE keys can each hold more than
    1/HOT_SHARE of the rows, so the list of hot keys has a fixed bound and is broadcast;
    their rows are cut into `slices` by `spread`, and their values copied once per slice.
    """
    total = per_key.agg(F.sum(weight)).scalar()
    hot = per_key.filter(F.col(weight) * HOT_SHARE > total).select(*keys).distinct()
    flagged = null_safe_join(fact, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    salted = flagged.withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(slices))).otherwise(F.lit(0))
    ).drop("_hot")
    copies = per_key.withColumn("_salt", F.explode(
        F.when(F.col(weight) * HOT_SHARE > total, F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
        .otherwise(F.array(F.lit(0).cast("long")))
    ))
    return null_safe_join(salted, copies, [*keys, "_salt"], how).drop("_salt")


def sieve(rows: DataFrame, wanted: DataFrame, columns: list[str], bits: int = 1 << 22) -> DataFrame:
    """Rows whose `columns` may occur in `wanted`, and few others, without moving or joining them.

    The wanted values set bits of a table of fixed size (512 KB by default), built by partial aggregates and
    sent along as one value. However many values there are, none of their rows is lost: a full table lets more
    rows through to the join that decides, nothing else.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_place"), F.lit(64)).cast("int"))
    marked = wanted.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    every = rows.sparkSession.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = marked.unionByName(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"]).alias("_table")).scalar()
    mine = F.get(table, F.shiftright(place, 6).cast("int"))
    return rows.filter(F.call_function("shiftright", mine, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows evenly by keys that hold little each before work that costs far more than moving them.

    An explicit partition count keeps adaptive execution from folding small inputs into one task.
    """
    session = df.sparkSession
    slices = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(slices, *keys)
