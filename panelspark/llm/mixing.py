"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import text_key, text_or_empty, words
from panelspark.operators.ordering import position
from panelspark.session import materialise

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def offset_of(seed: int) -> float:
    """The one random offset in [0, 1) that a seed stands for."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16) / 2**32


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """``(_key, source_size, target)``: words wanted from each source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...  They share
    the sum of all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight, until none is above.  Each round
    is one row of sums, so neither the driver nor a task sees all sources.
    """
    sources = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    ranked = position(sources, [F.col("source").asc_nulls_last()], "rank")
    ranked = materialise(ranked.select(
        "_key", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(
            F.col("rank") - 1, F.lit(len(WEIGHTS))).cast("int") + 1).cast("double").alias("weight")), "sources")
    cap = F.lit(float(most)) * F.col("source_size")
    share, capped_before = 0.0, -1
    while True:
        capped = cap < F.lit(share) * F.col("weight")
        n, total, used, weight = ranked.agg(
            F.count_if(capped), F.sum("source_size"), F.sum(F.when(capped, cap)),
            F.sum(F.when(~capped, F.col("weight")))).first()
        if n == capped_before or not weight:
            break
        capped_before, share = n, (total - (used or 0.0)) / weight
    return ranked.select("_key", "source_size", F.least(cap, F.lit(share) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 20, most: int = MOST_COPIES) -> DataFrame:
    """How often the mix takes every row: ``(doc_id, text_key, source, size, source_size, target, copies, taken)``.

    A source's rows, in order of size, are laid end to end, each as long as its
    expected copies (the source's target over its size); with one random offset
    a row is taken once per whole number that its stretch crosses.  Rows of all
    sizes are so taken in proportion and the words come out near the target.
    The order is global inside a source over range partitions, so a source with
    most of the rows is no single task.

    Null texts have size 0, the null source is a source.  Sources without words
    get nothing.  Repeated rows are rows of their own.  An empty table stays empty.
    """
    sizes = materialise(docs.select(
        "doc_id", text_key().alias("text_key"), "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
        F.size(words(text_or_empty())).cast("bigint").alias("size")), "sizes")
    targets = source_targets(sizes, most)
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = position(sizes, [F.col("size"), tie, F.col("doc_id"), F.col("text_key")], "place", within=["_key"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
                  ).otherwise(F.lit(0.0))
    copies = _crossed(F.col("place"), rate, offset_of(seed))
    return (placed.join(targets, "_key").withColumn("copies", copies)
            .select("doc_id", "text_key", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def _crossed(place: Column, rate: Column, offset: float) -> Column:
    """Whole numbers between the two ends of the place-th stretch of length ``rate``."""
    return F.floor(F.lit(offset) + place * rate) - F.floor(F.lit(offset) + (place - 1) * rate)


def take_mix(docs: DataFrame, seed: int = 20, most: int = MOST_COPIES) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it."""
    taken = mix_sources(docs, seed, most).where("copies > 0")
    # rows that repeat in full are one row that is taken as often as all of them
    times = taken.groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"),
                       F.col("source").alias("from"))
    first = rows.withColumn("nth", F.monotonically_increasing_id()).groupBy("id", "key", "from").agg(
        F.min_by("row", "nth").alias("row"))
    return (first.join(times, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
                       & F.col("from").eqNullSafe(F.col("source")))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
