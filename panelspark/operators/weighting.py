"""Inverse document frequencies at the documents, and the vectors that follow.

The commonest terms are sent to the documents' tasks and looked up where the
postings lie.  Only rarer terms travel to the vocabulary, and what they bring
back meets its document by a hash of the small side: no document is ever
taken apart into rows and put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import joins

# terms of up to so many characters may be sent to every task
SENT_LENGTH = 64
# what a vector keeps of its document
KEPT = ("rep_id", "copies", "sole_label")


def commonest(vocab: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Up to ``limit`` terms of ``vocab(term, df, idf)`` by ``df``, and whether that is all of them.

    The limit falls between two steps of a histogram, so no ranking of the whole vocabulary is needed.
    """
    step, short = F.floor(F.log2("df") * 4).cast("int"), F.length("term") <= SENT_LENGTH
    counts = vocab.groupBy(F.when(short, step).alias("step")).agg(F.count("*").alias("n")).collect()
    held, least = 0, None
    for at, n in sorted(((r["step"], r["n"]) for r in counts if r["step"] is not None), reverse=True):
        if held + n > limit:
            break
        held, least = held + n, at
    chosen = vocab.where(short & (step >= least)) if least is not None else vocab.where(F.lit(False))
    return chosen, held == sum(r["n"] for r in counts)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    lists = batch.column(name)
    return lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _unsent(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: the terms of each document that were not sent and their places in it, a row each."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0]
        for batch in batches:
            terms, length = _flat(batch, "terms")
            away = np.flatnonzero(~np.asarray(pc.is_in(terms, value_set=known)))
            row, first = np.repeat(np.arange(batch.num_rows), length), np.cumsum(length) - length
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep_id").take(pa.array(row[away])), pa.array((away - first[row[away]]).astype(np.int32)), terms.take(pa.array(away))],
                ["rep_id", "place", "term"])

    return kernel


def with_values(docs: DataFrame, table: DataFrame, absent: float | None = None) -> tuple[DataFrame, Broadcast]:
    """``docs(rep_id, terms, ...)`` with ``rare``, the values of ``table(term, df, value)`` for a document's terms that were not
    sent (in its order; ``absent`` where the table may lack some), and the terms that were sent with their values.  ``rep_id`` is unique."""
    chosen, all_sent = commonest(table, joins.SENT_KEYS)
    rows = chosen.select("term", F.col("value").cast("double").alias("value")).toArrow()
    terms = rows.column("term").combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast((terms, np.asarray(rows.column("value"), dtype=np.float64)))
    if all_sent and absent is None:
        return docs.withColumn("rare", F.lit(None).cast("array<double>")), sent
    kind = docs.schema["rep_id"].dataType.simpleString()
    away = docs.select("rep_id", "terms").mapInArrow(_unsent(sent), f"rep_id {kind}, place int, term string")
    known = table.select("term", F.col("value").cast("double").alias("value"))
    rare = away.join(known, "term", "inner" if absent is None else "left").groupBy("rep_id").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("value", F.lit(absent).cast("double")).alias("value")))).alias("r"))
    return docs.join(rare.select("rep_id", F.col("r.value").alias("rare")).hint("shuffle_hash"), "rep_id", "left"), sent


def values_of(batch: pa.RecordBatch, terms: pa.Array, sent: tuple[pa.Array, np.ndarray]) -> np.ndarray:
    """The value of every term of a batch of documents that ``with_values`` has prepared."""
    at = np.asarray(pc.fill_null(pc.index_in(terms, value_set=sent[0]), -1)).astype(np.int64)
    out = np.zeros(len(at))
    out[at >= 0] = sent[1][at[at >= 0]]
    out[at < 0] = np.asarray(_flat(batch, "rare")[0], dtype=np.float64)
    return out


def _vectors(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: unit vectors, terms from rare to common.

    A document's terms come sorted by name.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, length = _flat(batch, "terms")
            idf = values_of(batch, terms, sent.value)
            row = np.repeat(np.arange(batch.num_rows), length)
            weight = np.asarray(_flat(batch, "counts")[0], dtype=np.float64) * idf
            # a stable sort: the less common first, equal ones by name
            order = np.lexsort((-idf, row))
            weight = weight[order]
            weight /= np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))[row]
            ends = pa.array(np.append(0, np.cumsum(length)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in KEPT], pa.ListArray.from_arrays(ends, terms.take(pa.array(order))),
                 pa.ListArray.from_arrays(ends, pa.array(weight))], [*KEPT, "terms", "weights"])

    return kernel


def unit_vectors(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(rep_id, copies, sole_label, terms, weights)`` of ``docs(rep_id, copies, sole_label, terms, counts)``: counts times ``idf``, scaled to length 1.

    ``rep_id`` is unique, ``terms`` are not empty and sorted by name, and ``vocab(term, df, idf)`` has all of them.
    """
    met, sent = with_values(docs, vocab.select("term", "df", F.col("idf").alias("value")))
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in KEPT]
    return met.select(*KEPT, "terms", "counts", "rare").mapInArrow(
        _vectors(sent), ", ".join([*kinds, "terms array<string>, weights array<double>"]))
