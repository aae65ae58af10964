"""Queries that keep arriving, labelled batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from panelspark.operators.similar import centroids
from panelspark.operators.text import TextIndex
from panelspark.plans.text import classify_texts


def answer_stream(queries: DataFrame, docs: DataFrame, index: TextIndex, k: int, path: str,
                  attributes: Sequence[str] = (), stop_words: Sequence[str] = ()) -> DataStreamWriter:
    """Label a stream of ``(query_id, text)`` against a fixed index.

    A batch overwrites its own folder, so one that runs again after a failure
    leaves its answers once.  The labels' mean vectors are computed once.
    """
    means = centroids(index)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        (classify_texts(rows, docs, index, k, attributes, stop_words, means)
         .write.mode("overwrite").parquet(f"{path}/batch={number}"))
        rows.unpersist()

    return queries.writeStream.foreachBatch(write)
