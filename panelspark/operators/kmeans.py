"""k-means for one or many k at once.

Starts are k-means++ draws made by hashes, so a start can be repeated in plain
SQL; the first k draws serve as the start for every smaller k.  One scan moves the
centres of all k; the driver holds centres only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column
from panelspark.session import materialise

Centres = list[list[float]]
VECTOR = "_x"


def with_vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn(VECTOR, F.array(*[as_column(c).cast("double") for c in cols]))


def _literal(centres: Centres) -> Column:
    """The centres as one constant: a single small expression, whatever their number."""
    return F.from_json(F.lit(json.dumps(centres)), F.lit("array<array<double>>"))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _squares(centres: Centres) -> Column:
    """Squared distances of a row's vector to each of the centres."""
    return F.transform(_literal(centres), lambda c: _squared(F.col(VECTOR), c))


def _nearest(centres: Centres) -> Column:
    """Number of the nearest centre, the lowest on ties."""
    squares = _squares(centres)
    return (F.array_position(squares, F.array_min(squares)) - 1).cast("int")


def uniform(seed: int, step: int, key: str) -> Column:
    """A number between 0 and 1 that depends on the row's key: the same in every run and in SQL."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), as_column(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def draw_seeds(points: DataFrame, key: str, k: int, seed: int = 42) -> Centres:
    """Up to ``k`` rows as centres: the next one with a chance in proportion to the squared distance from those drawn.

    Each draw is one aggregation: the least of ``-ln(u) / weight`` falls on a row
    with just that chance.  Fewer come back where there are fewer different rows.
    """
    centres: Centres = []
    for step in range(k):
        weight = F.array_min(_squares(centres)) if centres else F.lit(1.0)
        race = F.struct((-F.ln(uniform(seed, step, key)) / F.col("weight")).alias("race"), as_column(key))
        drawn = points.withColumn("weight", weight).where("weight > 0").agg(F.min_by(VECTOR, race)).first()[0]
        if drawn is None:
            break
        centres.append([float(x) for x in drawn])
    return centres


def _attracted(centres: dict[int, Centres]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: number and sum of the vectors that each centre of each set attracts, one row per centre and task.

    Distances are added up one coordinate at a time; the lowest centre wins on ties.
    """
    sets = {k: np.array(c, dtype=np.float64) for k, c in centres.items()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros((len(c), c.shape[1] + 1)) for k, c in sets.items()}
        for batch in batches:
            values = batch.column(0).flatten()
            if values.null_count:
                raise ValueError("k-means needs a number in every column of every row")
            x = np.asarray(values, dtype=np.float64).reshape(batch.num_rows, -1)
            for k, c in sets.items():
                squares = np.zeros((len(x), len(c)))
                for j in range(c.shape[1]):
                    squares += (x[:, j, None] - c[None, :, j]) ** 2
                own = np.where(np.isnan(squares), np.inf, squares).argmin(axis=1)
                for j in range(c.shape[1]):
                    totals[k][:, j] += np.bincount(own, x[:, j], minlength=len(c))
                totals[k][:, -1] += np.bincount(own, minlength=len(c))
        for k, t in totals.items():
            held = np.flatnonzero(t[:, -1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), k), pa.int32()), pa.array(held, pa.int32()), pa.array(t[held, -1].astype(np.int64)),
                 pa.array(t[held, :-1].tolist(), pa.list_(pa.float64()))], ["k", "i", "n", "s"])

    return kernel


def lloyd_many(points: DataFrame, starts: dict[int, Centres], max_iter: int, tol: float = 1e-4) -> dict[int, Centres]:
    """Lloyd's iterations for several sets of centres, one scan per iteration for all of them.

    A set whose centres all move by ``tol`` or less is done.  An empty cluster keeps its centre.
    """
    centres, open_ = dict(starts), set(starts)
    width = len(next(iter(starts.values()))[0]) if starts else 0
    for _ in range(max_iter):
        if not open_:
            break
        moved = points.select(VECTOR).mapInArrow(
            _attracted({k: centres[k] for k in open_}), "k int, i int, n bigint, s array<double>").groupBy("k", "i").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s")).collect()
        new = {k: list(centres[k]) for k in open_}
        for r in moved:
            new[r["k"]][r["i"]] = [float(x) / r["n"] for x in r["s"]]
        for k in list(open_):
            if all(abs(a - b) <= tol for x, y in zip(new[k], centres[k]) for a, b in zip(x, y)):
                open_.discard(k)
            else:
                centres[k] = new[k]
    return centres


def label(points: DataFrame, centres: Centres, name: str = "cluster") -> DataFrame:
    return points.withColumn(name, _nearest(centres))


def curve_figures(points: DataFrame, centres: dict[int, Centres]) -> dict[int, tuple[float, float]]:
    """``{k: (inertia, silhouette)}`` in two scans for all k; the silhouette is on squared distances.

    The mean squared distance of a row to a cluster follows from the cluster's
    mean and its mean squared length, so no two rows ever meet.
    """
    width = len(next(iter(centres.values()))[0])
    length = F.aggregate(VECTOR, F.lit(0.0), lambda s, x: s + x * x)
    own = F.array(*[F.struct(F.lit(k).alias("k"), _nearest(c).alias("i")) for k, c in sorted(centres.items())])
    rows = points.select(VECTOR, length.alias("length"), F.explode(own).alias("own")).groupBy("own").agg(
        F.count("*").alias("n"), F.avg("length").alias("length"),
        F.array(*[F.avg(F.col(VECTOR)[j]) for j in range(width)]).alias("mean")).collect()
    found = {k: {} for k in centres}
    for r in rows:
        found[r["own"]["k"]][r["own"]["i"]] = r
    parts = []
    for k, kept in sorted(centres.items()):
        clusters = F.array(*[F.struct(
            F.lit(i).alias("i"), F.lit(r["n"]).alias("n"), F.lit(float(r["length"])).alias("length"),
            F.array(*[F.lit(float(x)) for x in r["mean"]]).alias("mean")) for i, r in sorted(found[k].items())])
        mine = _nearest(kept)
        apart = F.transform(clusters, lambda c: F.struct(c["i"].alias("i"), c["n"].alias("n"), F.greatest(F.lit(0.0), length - 2 * F.aggregate(
            F.zip_with(F.col(VECTOR), c["mean"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) + c["length"]).alias("d")))
        parts.append(F.struct(F.lit(k).alias("k"), F.array_min(_squares(kept)).alias("square"), mine.alias("mine"), apart.alias("apart")))
    one = points.select(VECTOR, F.explode(F.array(*parts)).alias("p")).select("p.*")
    self_ = F.filter("apart", lambda c: c["i"] == F.col("mine"))[0]
    b = F.array_min(F.transform(F.filter("apart", lambda c: c["i"] != F.col("mine")), lambda c: c["d"]))
    scored = one.select("k", "square", F.try_divide(self_["d"] * self_["n"], self_["n"] - 1).alias("a"), b.alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    out = scored.groupBy("k").agg(F.sum("square").alias("inertia"), F.avg(value).alias("silhouette")).collect()
    return {r["k"]: (r["inertia"], r["silhouette"]) for r in out}


def written(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The table with its vectors, written once for all scans of a fit, in a piece for every core."""
    return materialise(with_vector(df, cols).repartition(df.sparkSession.sparkContext.defaultParallelism), "kmeans_points")
