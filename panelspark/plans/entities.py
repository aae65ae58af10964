"""From a wide panel to clustered entities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import clean, cluster, panel
from panelspark.operators.ordering import position
from panelspark.session import materialise


@dataclass(frozen=True)
class EntityClusters:
    """The k curve, the entities with their cluster, and the cluster profiles."""

    curve: DataFrame
    members: DataFrame
    profile: DataFrame


def prepare_entities(df: DataFrame, entity: str, measures: Sequence[str]) -> DataFrame:
    """One row per entity: mean of the clipped, log-scaled measures, and their total."""
    rows = clean.normalise_keys(df, entity, "and")
    rows = clean.fill_missing(rows, measures)
    rows = materialise(rows, "filled")  # read for its limits and for its rows
    rows = clean.log1p(clean.winsorise_iqr(rows, measures), measures)
    return panel.mean_by_entity(rows, entity, measures)


def entity_clusters(df: DataFrame, entity: str, measures: Sequence[str],
                    ks: Sequence[int] = range(2, 11), exact: bool = False,
                    seed: int = 42) -> EntityClusters:
    """Prepare, choose k by the best silhouette, cluster and describe.

    The silhouette is the one-pass figure; ``exact`` asks for all distances.
    """
    means = materialise(position(
        prepare_entities(df, entity, measures), [F.col(entity)], "row"), "entities")
    points = materialise(clean.standardise(means, measures), "points")
    curve = cluster.sweep_k(points, "row", measures, ks, exact, seed)
    best = curve.agg(F.max_by("k", F.struct(F.col("silhouette"), -F.col("k")))).first()[0]
    labelled, _ = cluster.kmeans(points, "row", measures, best, seed)
    labelled = materialise(labelled, "labelled")
    members = cluster.cluster_members(labelled, entity)
    return EntityClusters(curve, members, cluster.cluster_profile(labelled, measures))
