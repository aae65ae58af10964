"""Cleaning and scaling of wide tables.

Statistics of a whole table reach the rows as a one-row scalar subquery, so
scaling adds no join and no window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.columns import as_column, normalise_key, row_total
from panelspark.operators.ordering import exact_quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, in table order; starts no job."""
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def normalise_keys(df: DataFrame, col: str, mode: str = "strip_symbols") -> DataFrame:
    return df.withColumn(col, normalise_key(col, mode))


def lower_all(df: DataFrame) -> DataFrame:
    """Lower-case the column names and every text cell."""
    return df.select([
        (F.lower(as_column(f.name)) if isinstance(f.dataType, T.StringType)
         else as_column(f.name)).alias(f.name.lower()) for f in df.schema])


def fill_missing(df: DataFrame, cols: Sequence[str] | None = None, value: float = 0) -> DataFrame:
    return df.fillna(value, list(cols) if cols is not None else None)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace columns in place, keeping the column order."""
    return df.select([new[c].alias(c) if c in new else as_column(c) for c in df.columns])


def _with_statistics(df: DataFrame, cols: Sequence[str],
                     aggregates: Callable[[Column], Sequence[Column]],
                     formula: Callable[..., Column]) -> DataFrame:
    """Rewrite each column with a formula over its value and its table-wide aggregates."""
    parts = []
    for c in cols:
        parts += [a.alias(f"{c}_{i}") for i, a in enumerate(aggregates(as_column(c)))]
    stats = df.agg(*parts).select(F.struct("*").alias("s")).scalar()
    width = len(aggregates(as_column(cols[0])))
    marked = df.withColumn("_s", stats)
    return marked.select([
        formula(as_column(c), *[F.col("_s").getField(f"{c}_{i}") for i in range(width)]).alias(c)
        if c in cols else as_column(c) for c in df.columns])


def winsorise_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Clip each column to its quartiles plus/minus ``k`` interquartile ranges."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.75])
    lows, highs = (F.col("q0") - k * (F.col("q1") - F.col("q0")),
                   F.col("q1") + k * (F.col("q1") - F.col("q0")))
    # one row, two numbers per column
    limits = quartiles.agg(*[
        F.max(F.when(F.col("measure") == c, F.struct(lows.alias("lo"), highs.alias("hi")))).alias(c)
        for c in cols]).select(F.struct("*").alias("s")).scalar()
    marked = df.withColumn("_s", limits)
    new = []
    for c in df.columns:
        if c not in cols:
            new.append(as_column(c))
            continue
        edge = F.col("_s").getField(c)
        value = as_column(c).cast("double")
        new.append(F.when(value.isNotNull(), F.greatest(
            edge.getField("lo"), F.least(edge.getField("hi"), value))).alias(c))
    return marked.select(new)


def log1p(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: F.log1p(as_column(c)) for c in cols})


def minmax_by_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale each column to 0..1; a constant column becomes null."""
    return _with_statistics(
        df, cols, lambda c: [F.min(c), F.max(c)],
        lambda c, lo, hi: F.try_divide((c - lo).cast("double"), (hi - lo).cast("double")))


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    return _with_statistics(
        df, cols, lambda c: [F.avg(c), F.stddev_pop(c)],
        lambda c, mean, dev: F.when(c.isNotNull(), F.coalesce(
            F.try_divide(c - mean, F.when(dev > 0, dev)), F.lit(0.0))))


def with_total(df: DataFrame, cols: Sequence[str], name: str = "total",
               to: str = "bigint") -> DataFrame:
    return df.withColumn(name, row_total(cols, to))


def project_measure(df: DataFrame, entity: str, period: str, measure: str,
                    name: str | None = None) -> DataFrame:
    """Entity, period and one measure; an unknown measure is an error."""
    if measure not in df.columns:
        raise ValueError(f"unknown measure: {measure}")
    return df.select(as_column(entity), as_column(period), as_column(measure).alias(name or measure))


def measure_names(df: DataFrame, names: Mapping[str, str], col: str = "measure") -> DataFrame:
    """Replace measure codes by full names; unknown codes stay."""
    full = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(col, F.coalesce(F.try_element_at(full, F.col(col)), F.col(col)))


def to_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.unpivot([as_column(k) for k in keys], [as_column(m) for m in measures],
                      "measure", "value")


def to_wide(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
            measure: str = "measure", value: str = "value") -> DataFrame:
    """One column per named measure; naming them saves the pass that finds them."""
    return df.groupBy(*keys).pivot(measure, list(measures)).agg(F.sum(value))
