"""Global order and exact quantiles without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialise

# monotonically_increasing_id keeps the row number in the low 33 bits and the
# partition number above them.
_ROW_BITS = 33


def position(df: DataFrame, order: Sequence[Column], name: str = "position",
             within: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based place of every row in a total order.

    Rows are range-partitioned on the order, sorted inside each partition and
    written once; a place is then the row's offset in its partition plus the
    rows of the partitions before it.  The only window without a key runs over
    one row per partition.  ``within`` restarts the count for each group; a
    group may span many partitions.
    """
    full_order = [F.col(c) for c in within] + list(order)
    placed = materialise(
        df.repartitionByRange(*full_order)
        .sortWithinPartitions(*full_order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_id"),
        name,
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # one row per partition of the table just written
    placed = placed.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_before") + F.col("_row") + 1).cast("bigint"))
    if within:
        starts = placed.groupBy(*within).agg(F.min(name).alias("_start"))
        placed = placed.join(starts, list(within)).withColumn(
            name, (F.col(name) - F.col("_start") + 1).cast("bigint"))
        placed = placed.drop("_start")
    return placed.drop("_part", "_row", "_before")


def exact_quantiles(df: DataFrame, cols: Sequence[str],
                    probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of many columns, one row per column.

    Returns ``(measure, q0, q1, ...)``.  Values are first counted (so repeats
    cost nothing) and then range-partitioned, which balances the distinct
    values.  The rank of a value is a running count inside its partition plus
    the rows of the partitions before it.
    """
    values = (
        df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
        .unpivot([], list(cols), "measure", "value")
        .where(F.col("value").isNotNull())
        .groupBy("measure", "value").agg(F.count("*").alias("n"))
    )
    placed = materialise(values.repartitionByRange("measure", "value")
                         .withColumn("part", F.spark_partition_id()), "values")
    every = Window.partitionBy("measure").orderBy("part")
    # at most columns x partitions rows
    totals = placed.groupBy("measure", "part").agg(F.sum("n").alias("total")).select(
        "measure", "part",
        F.coalesce(F.sum("total").over(every.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("before"),
        F.sum("total").over(every.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("rows"))
    running = Window.partitionBy("measure", "part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = placed.join(F.broadcast(totals), ["measure", "part"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(running))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    picks = []
    for i, p in enumerate(probabilities):
        place = (F.col("rows") - 1) * F.lit(float(p))
        picks += [at_rank(F.floor(place)).alias(f"lo{i}"),
                  at_rank(F.ceil(place)).alias(f"hi{i}"),
                  F.max(place - F.floor(place)).alias(f"part{i}")]
    out = ranked.groupBy("measure").agg(*picks)
    return out.select("measure", *[
        (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}")
        for i in range(len(probabilities))])
