"""Clustering of points, choice of k, projection and profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column
from panelspark.functions.fixed_values import NO_DOMINANT_MEASURE
from panelspark.operators import kmeans as many
from panelspark.operators.blocks import meet
from panelspark.operators.kernels import distance_sums
from panelspark.operators.ordering import position
from panelspark.operators.panel import top_within

Centres = list[list[float]]
# iterations of a k-means fit, in sweeps as in the final clustering
ITERATIONS = 300
# of a power iteration that has not settled before
POWER_STEPS = 5000


def squared_distance(cols: Sequence[str], centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, x in zip(cols, centre):
        total = total + (as_column(c) - F.lit(float(x))) * (as_column(c) - F.lit(float(x)))
    return total


def nearest_centroid(df: DataFrame, cols: Sequence[str], centres: Centres,
                     name: str = "cluster") -> DataFrame:
    """Add the number of the nearest centre, the lowest on ties.

    The few centres become literals of one generated expression: no join.
    """
    options = [F.struct(squared_distance(cols, c).alias("d"), F.lit(i).alias("i"))
               for i, c in enumerate(centres)]
    best = options[0] if len(options) == 1 else F.least(*options)
    return df.withColumn(name, best["i"])


def centre_table(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean of every column in every cluster."""
    return df.groupBy(cluster).agg(*[F.avg(as_column(c)).alias(c) for c in cols])


def lloyd_step(df: DataFrame, cols: Sequence[str], centres: Centres) -> DataFrame:
    """New centres of the clusters that the given centres attract."""
    return centre_table(nearest_centroid(df, cols, centres), cols)


def seed_rows(df: DataFrame, order: Sequence[Column], cols: Sequence[str], k: int) -> Centres:
    """The first ``k`` rows in an order, as centres."""
    rows = df.orderBy(*order).select([as_column(c) for c in cols]).limit(k).collect()
    return [[float(x) for x in r] for r in rows]


def kmeans_lloyd(df: DataFrame, cols: Sequence[str], keys: Sequence[str], k: int = 2,
                 max_iter: int = 100, tol: float = 1e-4, seed: int = 42,
                 seeds: Centres | None = None) -> tuple[DataFrame, Centres]:
    """Lloyd's iterations; stops when no coordinate of any centre moves by ``tol``.

    Starts from ``seeds``, or from ``k`` rows picked by a hash of their keys.
    Only the centres pass through the driver.  An empty cluster keeps its centre.
    """
    df = df.persist()
    draw = F.xxhash64(F.lit(seed), *[as_column(c) for c in keys])
    centres = seeds or seed_rows(df, [draw, *[as_column(c) for c in keys]], cols, k)
    for _ in range(max_iter):
        moved = {r[0]: [float(x) for x in r[1:]] for r in lloyd_step(df, cols, centres).collect()}
        new = [moved.get(i, old) for i, old in enumerate(centres)]
        still = all(abs(a - b) < tol for x, y in zip(new, centres) for a, b in zip(x, y))
        if still:
            break
        centres = new
    df.unpersist()
    return nearest_centroid(df, cols, centres), centres


def kmeans(df: DataFrame, key: str, cols: Sequence[str], k: int, seed: int = 42,
           max_iter: int = ITERATIONS, tol: float = 1e-4) -> tuple[DataFrame, Centres]:
    """k-means from a k-means++ start drawn by hashes of ``key``; keys travel with their rows.

    Where there are fewer than ``k`` different rows there are that many clusters.
    """
    points = many.written(df, cols)
    start = many.draw_seeds(points, key, k, seed)
    centres = many.lloyd_many(points, {k: start}, max_iter, tol)[k]
    return many.label(points, centres).drop(many.VECTOR), centres


def silhouette(df: DataFrame, key: str, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with exact Euclidean distances, as one row.

    All distances are needed, so the points meet in blocks and only the sum per
    point and cluster leaves a task.
    """
    points = df.select(F.col(key).cast("bigint").alias("query_id"), F.col(cluster).cast("int").alias("cluster"),
                       F.array(*[as_column(c).cast("double") for c in cols]).alias("features"))
    sizes = points.groupBy("cluster").agg(F.count("*").alias("n"))
    width = F.lit(len(cols))
    sums = meet(points.withColumnRenamed("query_id", "rep_id"), points.select("query_id", "features"),
                "rep_id", "query_id", width, width, distance_sums(),
                "query_id bigint, cluster int, distance double")
    sums = sums.groupBy("query_id", "cluster").agg(F.sum("distance").alias("distance"))
    mine = points.select("query_id", F.col("cluster").alias("own"))
    same = F.col("cluster") == F.col("own")
    per_point = (sums.join(sizes, "cluster").join(mine, "query_id")
                 .groupBy("query_id").agg(
                     F.max(F.when(same, F.try_divide("distance", F.col("n") - 1))).alias("a"),
                     F.min(F.when(~same, F.col("distance") / F.col("n"))).alias("b"),
                     F.max(F.when(same, F.col("n"))).alias("n")))
    value = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_point.agg(F.avg(value).alias("silhouette"))


def sweep_k(df: DataFrame, key: str, cols: Sequence[str], ks: Sequence[int] = range(2, 11),
            exact: bool = False, seed: int = 42, max_iter: int = ITERATIONS, tol: float = 1e-4) -> DataFrame:
    """``(k, inertia, silhouette, reason)`` for each k.

    Every k is fitted as ``kmeans`` fits it; one scan per iteration serves all k.
    The silhouette is the figure on squared distances, which needs no two rows
    to meet; ``exact`` asks for all Euclidean distances.  One cluster has
    silhouette 0.  A k that is not below the number of rows, or above the number
    of different ones, has no figures, and the reason says so.
    """
    spark = df.sparkSession
    points = many.written(df, cols)
    rows, wanted = points.count(), sorted(set(ks))
    seeds = many.draw_seeds(points, key, max([k for k in wanted if k < rows], default=0), seed)
    reasons = {k: f"only {rows} rows" if k >= rows else f"only {len(seeds)} different rows" for k in wanted if k >= rows or k > len(seeds)}
    centres = many.lloyd_many(points, {k: seeds[:k] for k in wanted if k not in reasons}, max_iter, tol)
    figures = many.curve_figures(points, centres) if centres else {}
    if exact:
        figures = {k: (inertia, silhouette(many.label(points, centres[k]), key, cols).first()[0] if k > 1 else 0.0)
                   for k, (inertia, _) in figures.items()}
    curve = [(k, *figures.get(k, (None, None)), reasons.get(k)) for k in wanted]
    return spark.createDataFrame(curve, "k int, inertia double, silhouette double, reason string")


def knee(curve: DataFrame, x: str = "k", y: str = "inertia") -> DataFrame:
    """The bend of a falling convex curve; null where the curve is flat."""
    ends = curve.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"),
                              F.min(y).alias("y0"), F.max(y).alias("y1")).alias("e")).scalar()
    e = F.col("_e")
    gap = (1 - F.try_divide(F.col(y) - e["y0"], e["y1"] - e["y0"])
           - F.try_divide((F.col(x) - e["x0"]).cast("double"), (e["x1"] - e["x0"]).cast("double")))
    scored = curve.withColumn("_e", ends).select(F.col(x), gap.alias("gap"))
    return scored.where(F.col("gap").isNotNull()).agg(
        F.max_by(x, F.struct(F.col("gap"), -F.col(x))).alias(x))


def choose_k(curve: DataFrame, fallback: int = 5) -> DataFrame:
    """k at the knee and at the best silhouette; the fallback where there is no knee."""
    best = curve.agg(F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("silhouette_k"))
    bend = knee(curve).scalar()
    return best.select(bend.alias("knee_k"), "silhouette_k",
                       F.coalesce(bend, F.lit(fallback)).alias("k"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the products of every two columns over a task's rows; the last column is 1 in every row."""
    total = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns] + [np.ones(batch.num_rows)])
        total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])


def covariance(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Population covariances, in one scan; the driver gets a number per pair of columns."""
    numbers = df.select(*[as_column(c).cast("double") for c in cols]).dropna()
    sums = numbers.mapInArrow(_products, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((len(cols) + 1, len(cols) + 1))
    for r in sums:
        total[r["i"], r["j"]] = r["s"]
    n = max(total[-1, -1], 1.0)
    return total[:-1, :-1] / n - np.outer(total[:-1, -1], total[:-1, -1]) / (n * n)


def principal_axes(cov: np.ndarray, count: int = 2, steps: int = POWER_STEPS, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvectors and eigenvalues of a covariance matrix by power iteration.

    Each is taken out of the matrix before the next is sought.  The sign is
    fixed so that the largest loading of each component is positive.
    """
    rest, axes, values = cov.copy(), [], []
    for _ in range(count):
        v = 1.0 / np.arange(1, len(cov) + 1)
        v /= math.sqrt(v @ v)
        for _ in range(steps):
            w = rest @ v
            size = math.sqrt(w @ w)
            if size == 0:
                break
            w /= size
            moved = abs(w - v).max()
            v = w
            if moved <= tol:
                break
        value = v @ rest @ v
        axes.append(v * (1.0 if v[abs(v).argmax()] >= 0 else -1.0))
        values.append(value)
        rest = rest - value * np.outer(v, v)
    return np.array(axes), np.array(values)


def pca2(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """First two principal components ``pc1, pc2`` of standardised columns.

    The covariances are one aggregation; rows are projected where they are.
    """
    axes, _ = principal_axes(covariance(df, cols))
    project = lambda axis: sum((as_column(c) * F.lit(float(x)) for c, x in zip(cols, axis)), F.lit(0.0))
    return df.withColumn("pc1", project(axes[0])).withColumn("pc2", project(axes[1]))


def explained_variance(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Shares of the whole variance that the two components hold."""
    cov = covariance(df, cols)
    whole = float(np.trace(cov))
    return [float(v) / whole if whole else 0.0 for v in principal_axes(cov)[1]]


def top_by_component(df: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` rows of each cluster with the largest first component."""
    return top_within(df, ["cluster"], [F.col("pc1").desc(), *[as_column(k) for k in keys]], n)


def cluster_members(df: DataFrame, entity: str, total: str = "total") -> DataFrame:
    """``(cluster, place, entity, total)`` by falling total in each cluster."""
    rows = df.select("cluster", as_column(entity), as_column(total))
    return position(rows, [as_column(total).desc(), as_column(entity)], "place", within=["cluster"])


def cluster_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Size of each cluster and the measures whose mean lies above zero.

    ``df`` holds standardised measures and ``cluster``.  Members are a table of
    their own (``cluster_members``), because a cluster may hold most entities.
    """
    centres = df.groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.avg(as_column(c)).alias(c) for c in cols])
    # rounded, as a mean of zero may come out a hair off
    names = F.concat_ws(", ", *[F.when(F.round(as_column(c), 9) > 0, F.lit(c)) for c in cols])
    return centres.select("cluster", "size", F.coalesce(
        F.nullif(names, F.lit("")), F.lit(NO_DOMINANT_MEASURE)).alias("dominant"))


