"""Removal of repeated passages by a join of window hashes; neighbouring hits are then put together as factors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import pieces, small_batches, text_key, window_hashes, word_bounds, word_hashes
from panelspark.session import materialise

WINDOW = 50
PHRASE = 16


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _phrases(hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For every window of words, the least hash among its phrases: equal windows have equal ones."""
    return sliding_least(window_hashes(hashes, phrase), window - phrase + 1)


def _read(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, shas, anchors = [], [], [], []
            for _, _, data, offsets in pieces(batch.column(2)):
                starts, ends, rows = word_bounds(data, offsets)
                hashes = word_hashes(data, starts, ends)
                for i, (first, last) in enumerate(zip(rows[:-1], rows[1:])):
                    own = hashes[first:last]
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    counts.append(len(own))
                    shas.append(hashlib.sha256(b" ".join(data[offsets[i]:offsets[i + 1]].tobytes().split())).hexdigest())
                    anchors.append(np.unique(_phrases(own, window, phrase)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas),
                 pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "text_key", "words_key", "n_words", "whole_sha256", "phrases"])
    return run


def _look_up(window: int, phrase: int):
    """The windows whose phrase another document has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared")
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
                hashes = word_hashes(data, starts, ends)
                at = np.flatnonzero(np.isin(_phrases(hashes, window, phrase).view(np.int64), shared[i].values.to_numpy()))
                found = window_hashes(hashes, window)[at].view(np.int64)
                row = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("lead").take(row), pa.array(at.astype(np.int32)), pa.array(found)],
                    ["doc_id", "lead", "at", "window"])
    return run


def factors(at: np.ndarray, reference: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy parse of the found windows: ``(start, length, reference document)`` in words.

    A factor goes on as long as the next window begins in the same reference
    document; where it ends, the windows across its end have been looked up as
    well, so the next factor begins at the first of them that has a reference.
    """
    out, order = [], np.argsort(at, kind="stable")
    at, reference = at[order], reference[order]
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(reference) != 0)) + 1
    for low, high in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])):
        if low < high:
            out.append((int(at[low]), int(at[high - 1] - at[low]) + window, int(reference[low])))
    return out


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, found = [], [], []
            for text, at, reference in zip(batch.column("text"), batch.column("at"), batch.column("reference")):
                words = text.as_py().encode().split()
                spans = factors(at.values.to_numpy(), reference.values.to_numpy(), window)
                gone = np.zeros(len(words) + 1, np.int64)
                for start, length, _ in spans:
                    gone[start] += 1
                    gone[start + length] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
                found.append([{"start": s, "length": n, "reference": r} for s, n, r in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("reference", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("words_key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(found, kind)], ["doc_id", "words_key", "n_removed", "kept_sha256", "spans"])
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``(doc_id, text_key, n_words, n_removed, kept_sha256, spans)`` per row; ``doc_id`` is a whole number.

    A word goes if one of the runs of ``window`` words over it also stands in a document
    with a smaller id.  Documents are factored against an index of all others:

    1. Rows with the same words as a smaller id are one factor as a whole; only the first of
       such rows is indexed.
    2. Each run of words has one phrase that stands for it (the least of its
       phrase hashes).  Only runs whose phrase occurs in two documents can have
       a reference; all other text is done.
    3. Those runs form the index: run -> lowest document, dealt by its hash into
       blocks.  Every document's candidate runs, those across factor ends
       included, are looked up in every block they may be in.
    4. The hits are parsed greedily into factors, the duplicate spans.

    A run that a third of all documents share costs one row per document.
    Null and empty texts have no words; texts shorter than a run keep all.
    Rows that repeat in full are judged alike, as are rows with an equal id. A null id is smaller than none.
    """
    small_batches(docs.sparkSession)
    read = materialise(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        _read(window, phrase), docs.select("doc_id").schema.add("text_key", "long").add("words_key", "binary")
        .add("n_words", "long").add("whole_sha256", "string")
        .add("phrases", docs.sparkSession.createDataFrame([], "a array<bigint>").schema["a"].dataType)), "words")
    first = read.where(F.col("n_words") >= window).groupBy("words_key").agg(
        F.min("doc_id").alias("first_id"), F.min_by("text_key", "doc_id").alias("first_key"))
    rows = read.drop("phrases").join(first, "words_key", "left")
    leads = (first.where(F.col("first_id").isNotNull()).join(
        read.select("words_key", F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), "phrases"),
        ["words_key", "first_id", "first_key"]).dropDuplicates(["words_key"]))
    phrases = materialise(leads.select(
        F.col("first_id").alias("doc_id"), "words_key", F.col("first_key").alias("text_key"), F.explode("phrases").alias("phrase")), "phrases")
    shared = phrases.groupBy("phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("phrase")
    wanted = phrases.join(shared, "phrase", "left_semi").groupBy("doc_id", "words_key", "text_key").agg(
        F.collect_list("phrase").alias("shared"))
    own = docs.select(F.col("doc_id").alias("own_id"), text_key().alias("own_key"), "text")
    texts = materialise(own.join(wanted, (F.col("own_id") == F.col("doc_id")) & (F.col("own_key") == F.col("text_key")))
                        .dropDuplicates(["doc_id", "words_key"])
                        .select("doc_id", "words_key", "text", "shared", F.monotonically_increasing_id().alias("lead")), "texts")
    windows = materialise(texts.select("doc_id", "lead", "text", "shared").mapInArrow(
        _look_up(window, phrase), texts.select("doc_id", "lead").schema.add("at", "integer").add("window", "long")), "windows")
    index = windows.groupBy("window").agg(F.min("doc_id").alias("reference"), F.max("doc_id").alias("last")).where(
        "reference < last").select("window", "reference")
    hits = (windows.join(index, "window").where(F.col("reference") < F.col("doc_id"))
            .groupBy("lead").agg(F.collect_list(F.struct("at", "reference")).alias("hits"))
            .select("lead", F.col("hits.at").alias("at"), F.col("hits.reference").cast("array<bigint>").alias("reference")))
    span = docs.sparkSession.createDataFrame([], "a array<struct<start:bigint,length:bigint,reference:bigint>>").schema["a"].dataType
    cut = texts.select("doc_id", "words_key", "text", "lead").join(hits, "lead").mapInArrow(
        _cut_out(window), texts.select("doc_id", "words_key").schema.add("n_removed", "long").add("kept_sha256", "string")
        .add("spans", span))
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("length"),
                             F.col("first_id").cast("bigint").alias("reference")))
    none = hashlib.sha256(b"").hexdigest()
    return rows.join(cut, ["doc_id", "words_key"], "left").select(
        "doc_id", "text_key", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"))
