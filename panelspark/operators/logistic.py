"""Multinomial logistic regression by full-batch gradient steps.

Coefficients are a table with a row per label.  A step sends them to the rows
in slices of bounded size and brings back one sum per label; the driver holds
neither rows nor the whole of the coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column
from panelspark.operators.metrics import label_codes
from panelspark.session import materialise

# numbers that one pass sends to the tasks
SLICE_NUMBERS = 1 << 20


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _log_sum(values: Column) -> Column:
    most = F.array_max(values)
    return most + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - most)))


class _Slices:
    """A coefficient table ``(label_id, at)`` as constants of bounded size, one per pass."""

    def __init__(self, table: DataFrame, labels: int, width: int, numbers: int) -> None:
        step = max(1, numbers // width)
        self.parts = [
            table.where((F.col("label_id") >= low) & (F.col("label_id") < low + step)).agg(
                F.sort_array(F.collect_list(F.struct("label_id", "at")))).scalar()
            for low in range(0, labels, step)]

    def with_log_sum(self, rows: DataFrame) -> DataFrame:
        """Add the logarithm of the sum of all labels' exponentials as ``total``."""
        for n, part in enumerate(self.parts):
            rows = rows.withColumn("_part", part)
            own = _log_sum(F.transform("_part", lambda c: _dot(c["at"], F.col("x"))))
            if n:  # the rows so far are written, so that a task holds one slice
                rows = materialise(rows.withColumn("total", _log_sum(F.array(F.col("total"), own))).drop("_part"), "log_sums")
            else:
                rows = rows.withColumn("total", own).drop("_part")
        return rows


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, steps: int = 50,
                 slice_numbers: int = SLICE_NUMBERS) -> DataFrame:
    """``(label, weights)``: a weight per feature and the intercept last.

    Minimises the mean cross entropy plus half the squared weights over the
    number of rows (a unit inverse strength on the summed loss; the intercept is
    free) with Nesterov's steps.  They are taken in standardised features with
    the penalty rescaled, so the minimum is that of the raw ones.  A step
    reads the rows once and works out one number per row and label, as softmax
    asks for; one row per label and task is shuffled.  Rows with a null label or
    feature are left out.
    """
    vector = F.array(*[as_column(f).cast("double") for f in features])
    # read for its labels and its scale
    raw = materialise(train.select(as_column(label).alias("label"), vector.alias("x")).where(
        F.col("label").isNotNull() & ~F.exists("x", lambda v: v.isNull())), "raw_rows")
    codes = materialise(label_codes(raw, "label"), "label_codes")
    labels, width = codes.count(), len(features) + 1
    if not labels:
        return codes.select("label", F.array().cast("array<double>").alias("weights"))
    scale = raw.agg(F.count("*").alias("n"), *[f(F.col("x")[j]).alias(f"{name}{j}") for j in range(width - 1)
                                               for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = scale["n"]
    means = [float(scale[f"m{j}"]) for j in range(width - 1)]
    spreads = [float(scale[f"s{j}"]) or 1.0 for j in range(width - 1)]
    penalty = [1.0 / (n * s * s) for s in spreads] + [0.0]
    # the curvature of the loss is at most half the mean squared length, one per feature that varies and one for the intercept
    pace = 1.0 / (0.5 * width + max(penalty))
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    scaled = F.concat(F.transform(F.arrays_zip(F.col("x").alias("v"), numbers(means).alias("m"), numbers(spreads).alias("s")),
                                  lambda z: (z["v"] - z["m"]) / z["s"]), numbers([1.0]))
    coded = raw.join(codes, "label")  # adaptive execution broadcasts few labels and splits a frequent one
    rows = materialise(coded.select("label_id", scaled.alias("x")), "scaled_rows")
    own = rows.groupBy("label_id").agg(F.array(*[F.sum(F.col("x")[j]) for j in range(width)]).alias("own"))
    zero = numbers([0.0] * width)
    table = materialise(own.select("label_id", "own", zero.alias("w"), zero.alias("at")), "coefficients")
    for step in range(1, steps + 1):
        slices = _Slices(table.select("label_id", "at"), labels, width, slice_numbers)
        known = slices.with_log_sum(rows)
        sums = None
        for part in slices.parts:
            shares = F.transform("_part", lambda c: F.struct(
                c["label_id"].alias("label_id"), F.exp(_dot(c["at"], F.col("x")) - F.col("total")).alias("p")))
            found = known.withColumn("_part", part).select("x", F.explode(shares).alias("c")).groupBy(F.col("c.label_id").alias("label_id")).agg(
                F.array(*[F.sum(F.col("c.p") * F.col("x")[j]) for j in range(width)]).alias("g"))
            sums = found if sums is None else sums.unionByName(found)
        moved = F.array(*[
            F.col("at")[j] - pace * ((F.col("g")[j] - F.col("own")[j]) / n + penalty[j] * F.col("at")[j]) for j in range(width)])
        ahead = step / (step + 3.0)
        table = materialise(table.join(sums, "label_id").withColumn("new", moved).select(
            "label_id", "own", F.col("new").alias("w"),
            F.zip_with("new", "w", lambda a, b: a + ahead * (a - b)).alias("at")), "coefficients")
    weights = [F.col("w")[j] / spreads[j] for j in range(width - 1)]
    intercept = F.col("w")[width - 1]
    for j, m in enumerate(means):
        intercept = intercept - weights[j] * m
    return materialise(table.join(codes, "label_id").select(
        "label", F.array(*weights, intercept).alias("weights")), "logistic_model")


def predict_logistic(rows: DataFrame, model: DataFrame, features: Sequence[str],
                     slice_numbers: int = SLICE_NUMBERS) -> DataFrame:
    """Add the label with the largest score as ``predicted``; the first in the alphabet on ties.

    A row with a null feature gets no label.
    """
    codes = label_codes(model, "label")
    table = materialise(model.join(codes, "label").select(
        "label_id", F.struct("label", "weights").alias("at")), "numbered_model")
    parts = _Slices(table, table.count(), len(features) + 1, slice_numbers).parts
    x = F.concat(F.array(*[as_column(f).cast("double") for f in features]), F.array(F.lit(1.0)))
    out = rows.withColumn("_x", x).withColumn("_best", F.lit(None).cast("struct<score:double,after:bigint,label:string>"))
    for n, part in enumerate(parts):
        out = out.withColumn("_part", part)
        scored = F.transform("_part", lambda c: F.struct(
            _dot(c["at"]["weights"], F.col("_x")).alias("score"), (-c["label_id"]).alias("after"),
            c["at"]["label"].cast("string").alias("label")))
        best = F.array_max(F.filter(F.concat(scored, F.array("_best")), lambda s: s["score"].isNotNull()))
        out = out.withColumn("_best", best).drop("_part")
        if n + 1 < len(parts):
            out = materialise(out, "best_so_far")
    return out.withColumn("predicted", F.col("_best.label")).drop("_x", "_best")


def logistic_classify(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                      steps: int = 50) -> DataFrame:
    """``test`` with ``predicted``, the label that the regression on ``train`` gives it."""
    return predict_logistic(test, fit_logistic(train, features, label, steps), features)
