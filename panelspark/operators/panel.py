"""Filters, totals, rankings, trends and summaries of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column, normalise_key, row_total
from panelspark.operators.clean import measure_names, project_measure
from panelspark.operators.ordering import exact_quantiles, position


def _sum(c: Column) -> Column:
    """Sum of whole numbers; nothing sums to 0."""
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))


def filter_panel(df: DataFrame, entity: str, period: str, *, at=None, of=None,
                 measure: str | None = None, normalise: str | None = "and") -> DataFrame:
    """Rows of one period and/or one entity, and one measure if named.

    A text argument is brought to the same spelling as the column
    (``normalise_key``; None compares them as they are).
    """
    if at is not None:
        df = df.where(as_column(period) == F.lit(at))
    if of is not None and normalise and isinstance(of, str):
        df = df.where(normalise_key(entity, normalise) == normalise_key(F.lit(of), normalise))
    elif of is not None:
        df = df.where(as_column(entity) == F.lit(of))
    return project_measure(df, entity, period, measure) if measure is not None else df


def filter_panel_long(df: DataFrame, entity: str, period: str, *, at=None, of=None,
                      measure: str | None = None, names: Mapping[str, str] = {}) -> DataFrame:
    """The same on ``(entity, period, measure, value)`` rows; a measure code may be given."""
    df = filter_panel(df, entity, period, at=at, of=of)
    if measure is not None:
        df = df.where(F.col("measure") == F.lit(names.get(measure, measure)))
    return df


def at_period(df: DataFrame, period: str, at=None) -> DataFrame:
    """Rows of the given period, else of the latest one in the table."""
    if at is not None:
        return df.where(as_column(period) == F.lit(at))
    latest = df.agg(F.max(as_column(period))).scalar()
    return df.where(as_column(period) == latest)


def total_by_entity(df: DataFrame, entity: str, measures: Sequence[str]) -> DataFrame:
    """Sum of the measures for each entity; rows without an entity are left out."""
    return (df.where(as_column(entity).isNotNull())
            .groupBy(as_column(entity)).agg(_sum(row_total(measures)).alias("total")))


def rank_entities(df: DataFrame, entity: str, measures: Sequence[str]) -> DataFrame:
    """Entities by falling total, equal totals by name, with their place."""
    totals = total_by_entity(df, entity, measures)
    return position(totals, [F.col("total").desc(), as_column(entity).asc()], "place")


def sum_by_period(df: DataFrame, period: str, measures: Sequence[str]) -> DataFrame:
    return (df.where(as_column(period).isNotNull())
            .groupBy(as_column(period)).agg(*[_sum(as_column(m)).alias(m) for m in measures]))


def mean_by_entity(df: DataFrame, entity: str, measures: Sequence[str]) -> DataFrame:
    """Mean of every measure for each entity, and the total of those means."""
    means = (df.where(as_column(entity).isNotNull())
             .groupBy(as_column(entity)).agg(*[F.avg(as_column(m)).alias(m) for m in measures]))
    return means.withColumn("total", row_total(measures, "double"))


def grand_totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``(measure, total)``, one row per measure."""
    return (df.agg(*[_sum(as_column(m)).alias(m) for m in measures])
            .unpivot([], [as_column(m) for m in measures], "measure", "total"))


def total_and_mean(df: DataFrame, measure: str) -> DataFrame:
    return df.agg(_sum(as_column(measure)).alias("total"),
                  F.avg(as_column(measure)).alias("mean"))


def summary_table(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of every measure."""
    parts = []
    for m in measures:
        c = as_column(m).cast("double")
        parts.append(F.struct(
            F.lit(m).alias("measure"), F.count(c).alias("count"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")))
    basic = df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
    quartiles = exact_quantiles(df, measures, [0.25, 0.5, 0.75]).toDF("measure", "p25", "p50", "p75")
    return basic.join(quartiles, "measure", "left").select(
        "measure", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quantiles(df: DataFrame, cols: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation, one row per column."""
    return exact_quantiles(df, cols, probabilities)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair as ``(m1, m2, r)``; null for a constant column.

    One aggregation gives all pairs; the mirror half is added afterwards.
    """
    pairs = []
    for a, b in combinations_with_replacement(cols, 2):
        x, y = as_column(a).cast("double"), as_column(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = (F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
        pairs.append(F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.try_divide(
            F.covar_pop(x, y), F.when(spread > 0, spread)).alias("r")))
    half = df.agg(F.array(*pairs).alias("rows")).select(F.inline("rows"))
    return half.select(F.inline(F.when(
        F.col("m1") == F.col("m2"), F.array(F.struct("m1", "m2", "r"))).otherwise(
        F.array(F.struct("m1", "m2", "r"),
                F.struct(F.col("m2").alias("m1"), F.col("m1").alias("m2"), "r")))))


def extreme_periods(df: DataFrame, period: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Period of the largest and of the smallest value; the first one on ties."""
    p, v = as_column(period), as_column(value)
    return df.groupBy(*by).agg(F.max_by(p, F.struct(v, -p)).alias("highest_period"),
                               F.min_by(p, F.struct(v, p)).alias("lowest_period"))


def trend(df: DataFrame, period: str, measures: Sequence[str]) -> DataFrame:
    """Change from the first to the last period in percent, best and worst period."""
    long = (sum_by_period(df, period, measures)
            .unpivot([as_column(period)], [as_column(m) for m in measures], "measure", "value"))
    p = as_column(period)
    return long.groupBy("measure").agg(
        F.min_by("value", p).alias("first_value"), F.max_by("value", p).alias("last_value"),
        F.max_by(p, F.struct(F.col("value"), -p)).alias("highest_period"),
        F.min_by(p, F.struct(F.col("value"), p)).alias("lowest_period"),
    ).withColumn("change_percent", F.try_divide(
        (F.col("last_value") - F.col("first_value")) * F.lit(100.0), F.col("first_value")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(as_column(col)).distinct()


def top_entities(df: DataFrame, entity: str, period: str, measure: str, at,
                 n: int = 5, lowest: bool = False) -> DataFrame:
    """The ``n`` entities with the largest (smallest) measure in a period.

    An unknown measure gives no rows.
    """
    if measure not in df.columns:
        return df.select(as_column(entity), F.lit(None).cast("bigint").alias(measure)).where("false")
    m = as_column(measure)
    return (at_period(df, period, at).select(as_column(entity), m)
            .orderBy(m.asc() if lowest else m.desc(), as_column(entity)).limit(n))


def top_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
               name: str = "place") -> DataFrame:
    """The first ``n`` rows of every group.

    Each task keeps ``n`` rows of a group before the shuffle, so a group that
    holds most of the table costs no more than a small one.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def top_entities_by_period(df: DataFrame, entity: str, period: str, measure: str,
                           n: int = 5, lowest: bool = False) -> DataFrame:
    """``top_entities`` for all periods at once."""
    m = as_column(measure)
    return top_within(df.select(as_column(entity), as_column(period), m), [period],
                      [m.asc() if lowest else m.desc(), as_column(entity)], n)


def compare_entities(df: DataFrame, entity: str, period: str, measure: str, at=None) -> DataFrame:
    """All entities in a period (default: the latest) by falling measure."""
    rows = at_period(df, period, at).select(as_column(entity), as_column(measure).alias(measure))
    return position(rows, [as_column(measure).desc(), as_column(entity).asc()], "place")


def named_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
               names: Mapping[str, str]) -> DataFrame:
    """Long panel whose measure column holds full names."""
    return measure_names(df.unpivot([as_column(k) for k in keys],
                                    [as_column(m) for m in measures], "measure", "value"), names)
