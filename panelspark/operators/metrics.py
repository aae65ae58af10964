"""Labels, splits, classifiers on numbers, and quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column
from panelspark.operators.ordering import position


def encode_labels(df: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    """Add the 0-based place of each label among the distinct labels in order."""
    codes = label_codes(df, label, name)
    return df.join(codes, label)


def label_codes(df: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    distinct = df.select(as_column(label)).where(as_column(label).isNotNull()).distinct()
    return position(distinct, [as_column(label)], name).withColumn(name, F.col(name) - 1)


def decode_labels(df: DataFrame, codes: DataFrame, name: str = "label_id") -> DataFrame:
    return df.join(codes, name)


def in_test(key: str | Column, share: float = 0.2, seed: int = 42) -> Column:
    """Whether a row belongs to the held-out part; depends on its key alone.

    Unlike a random split the answer does not change with the partitioning or
    when a lost task runs again.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), as_column(key).cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return number % 10_000 < round(share * 10_000)


def split_train_test(df: DataFrame, key: str, share: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    held_out = in_test(key, share, seed)
    return df.where(~held_out), df.where(held_out)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where that is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _per_label(predictions: DataFrame) -> DataFrame:
    """``(c, support, predicted, tp)`` of every label, from confusion counts."""
    confusion = predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = confusion.select(F.inline(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))))
    return (sides.where(F.col("c").isNotNull()).groupBy("c")
            .agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")]))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by true support.

    ``predictions(label, predicted)``; an undefined figure is 0.
    """
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * precision * recall, precision + recall)
    weight = F.col("support")
    return _per_label(predictions).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        _ratio(F.sum(precision * weight), F.sum(weight)).alias("precision"),
        _ratio(F.sum(recall * weight), F.sum(weight)).alias("recall"),
        _ratio(F.sum(f1 * weight), F.sum(weight)).alias("f1"))


def label_metrics(shares: DataFrame, truth: DataFrame, cut: float = 0.5) -> DataFrame:
    """One-against-rest figures of every label at once.

    ``shares(query_id, label, share)``: a row is positive for a label when the
    share of its votes reaches ``cut``.  ``truth(query_id, label)``.
    """
    actual = truth.withColumnRenamed("label", "actual")
    positive = shares.where(F.col("share") >= cut).join(actual, "query_id").groupBy("label").agg(
        F.count("*").alias("predicted"),
        F.count_if(F.col("label") == F.col("actual")).alias("tp"))
    support = truth.groupBy("label").agg(F.count("*").alias("support"))
    total = truth.agg(F.count("*")).scalar()
    counts = support.join(positive, "label", "full").fillna(0)
    precision, recall = (_ratio(F.col("tp"), F.col("predicted")),
                         _ratio(F.col("tp"), F.col("support")))
    wrong = F.col("predicted") + F.col("support") - 2 * F.col("tp")
    return counts.select(
        "label", _ratio(total - wrong, total).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"))


def model_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows whose prediction is right; no prediction is a wrong one."""
    right = F.coalesce((F.col("label") == F.col("predicted")).cast("int"), F.lit(0))
    return predictions.agg(F.avg(right).alias("accuracy"))
