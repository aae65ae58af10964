"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_KEYS of all rows, so there are
# never more than HOT_KEYS hot keys, whatever the table.
HOT_KEYS = 2000
# of short keys with a number each, so many are sent to every task
SENT_KEYS = 100_000


def hot_keys(counts: DataFrame, count: str, limit: int = HOT_KEYS) -> DataFrame:
    """The rows of a per-key count table that are hot; at most ``limit``."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.where(F.col(count) * limit > total)


def lookup(big: DataFrame, attributes: DataFrame, key: str, spread: str,
           count: str) -> DataFrame:
    """Attach ``attributes`` (one row per key, with its row count) to every row.

    Hot keys are looked up in a broadcast of at most ``HOT_KEYS`` rows and do
    not move; the others meet in an ordinary equi-join.  In that join a hot
    row travels under a spare key made from ``spread`` so that it lands
    anywhere but on one task.
    """
    names = [c for c in attributes.columns if c != key]
    hot = hot_keys(attributes, count).select(
        F.col(key), F.struct(*names).alias("_hot"))
    cold = attributes.select(F.col(key).alias("_key"), F.struct(*names).alias("_cold"))
    marked = big.join(F.broadcast(hot), key, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(
            F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(spread), F.lit(100_000)).cast("string"))))
    joined = marked.join(cold, "_key", "left").withColumn("_a", F.coalesce("_hot", "_cold"))
    return (joined.where(F.col("_a").isNotNull())
            .select(*big.columns, *[F.col("_a").getField(n).alias(n) for n in names]))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: str,
                rows_per_task: int = 200_000) -> DataFrame:
    """Inner equi-join that cuts every large key group into slices, on both sides.

    A key with ``n`` rows on a side gets ``n / rows_per_task`` slices there (rows
    are dealt by a hash); each pair of slices meets once, so the rows of one
    side are repeated once per slice of the other.  No row is lost and no task
    gets a whole hot key of either side.
    """
    keys = list(keys)

    def large(side: DataFrame, name: str) -> DataFrame:
        # only keys above the limit: fewer than rows / rows_per_task of them
        counts = side.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_task)
        return counts.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(name))

    slices = large(big, "_bigs").join(large(small, "_smalls"), keys, "full")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))

    def deal(side: DataFrame, own: str, other: str, mine: str, theirs: str, by: list) -> DataFrame:
        return (side.join(slices, keys, "left")
                .withColumn(mine, F.pmod(F.xxhash64(*by), one(own)).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), one(other) - 1))).drop("_bigs", "_smalls"))

    rest = [c for c in small.columns if c not in keys] or keys
    left = deal(big, "_bigs", "_smalls", "_i", "_j", [F.col(spread)])
    right = deal(small, "_smalls", "_bigs", "_j", "_i", [F.col(c) for c in rest])
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")
