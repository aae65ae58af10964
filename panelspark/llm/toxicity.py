"""Toxicity by compression distance: two zstandard dictionaries and calibrated window lengths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mix, small_batches, text_or_empty, words
from panelspark.session import materialise

SAMPLE_ROWS = 20_000       # labelled rows that the classifier is fitted on, about, where there are more
SAMPLE_WINDOWS = 40_000    # windows that an ordinary dictionary is trained on, about, where there are more
PAIRS = 2                  # pairs of dictionaries, on different windows: what one gains by chance the other does not
DICTIONARY_BYTES = 65_536
TOXIC_WORDS = 4_096        # words in the toxic dictionary, at most
MIN_DOCUMENTS, MIN_CONTRAST = 5, 5.0
LEVEL = 7
WINDOW, STEP = 12, 11      # words


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def windows(text: str, width: int = WINDOW, step: int = STEP) -> list[bytes]:
    """The whole text, lower-cased, in overlapping runs of words."""
    found = text.lower().encode().split()
    return [b" " + b" ".join(found[i:i + width]) + b" " for i in range(0, max(1, len(found) - width + step), step)] if found else []


class Distance:
    """Compressed lengths of windows under pairs of an ordinary and a toxic dictionary."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = pairs
        self._ready: list | None = None

    def __getstate__(self):
        return {"pairs": self.pairs, "_ready": None}

    def _compressors(self) -> list:
        if self._ready is None:
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self._ready = [[zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(d) >= 8 else None,
                compression_params=settings) for d in pair] for pair in self.pairs]
        return self._ready

    @property
    def width(self) -> int:
        return 14 * len(self.pairs) + 1

    def features(self, text: str) -> list[float]:
        """How many bytes the toxic dictionary saves per window: extremes, means, shares and numbers over thresholds."""
        parts = windows(text)
        if not parts:
            return [0.0] * self.width
        out = [math.log(len(parts))]
        for ordinary, toxic in self._compressors():
            saved = np.sort([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts]).astype(float)
            over = {k: int((saved >= k).sum()) for k in (2, 3, 4, 5, 6)}
            out += [saved[-1], saved.mean(), saved[-3:].mean(), saved[-3:].min(), saved[len(saved) // 2], (saved <= -2).mean(),
                    math.sqrt(np.maximum(saved - 1, 0).sum()), *[over[k] / len(saved) for k in (2, 3, 5)],
                    *[math.log1p(over[k]) for k in (2, 3, 4, 6)]]
        return out


class Calibration:
    """Logistic regression of the label on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 3e-3):
        if not len(x):
            x, y = np.zeros((1, x.shape[1])), np.zeros(1)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (p - y) + penalty * len(y) * self.weights
            bend = (z * (p * (1 - p))[:, None]).T @ z + penalty * len(y) * np.eye(len(self.weights))
            self.weights -= np.linalg.solve(bend, slope)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def _emit_windows(share: float):
    """About ``share`` of all windows of eight words, picked by a hash of document and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                parts = windows(text.as_py() or "", 8, 8)
                order = mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(batch.column("seed")[row].as_py() & (2**63 - 1)))
                at = np.flatnonzero((order >> np.uint64(11)).astype(float) / 2.0**53 < share)
                yield pa.RecordBatch.from_arrays([pa.array(order[at].view(np.int64)), pa.array([parts[i] for i in at], pa.binary())],
                                                 ["order", "window"])
    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Distance, Calibration]:
    """The dictionaries and the calibration, from about ``sample_rows`` labelled rows that are not held out.

    The sample is drawn by a hash of the id in the natural ratio of labels.  The
    ordinary dictionary is trained by zstandard on windows of ordinary
    documents.  As whole documents are labelled and most of a toxic one is
    ordinary prose, a toxic dictionary is that same content with the toxic
    part in front: the words whose share of toxic documents is over the share
    of ordinary ones by ``MIN_CONTRAST`` standard errors.  All that reaches the
    driver is bounded: windows, words and features of the sample.
    """
    usable = (labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    slots = 1 << 30
    wanted = min(slots, int(slots * sample_rows / max(usable.count(), 1)))
    ids = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(slots)) < wanted)
    ids = materialise(ids, "toxicity_ids")
    sample = materialise(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
                         .dropDuplicates(["doc_id"]), "toxicity_sample")
    toxic = sample.where("toxic = 1")
    n_toxic, n_rows = toxic.count(), sample.count()
    n_other = n_rows - n_toxic
    seen = (sample.select("toxic", F.explode(F.array_distinct(words(F.lower("text")))).alias("word"))
            .groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b"))
            .where(F.col("a") >= MIN_DOCUMENTS))
    share = (F.col("a") + F.col("b")) / F.lit(float(max(n_rows, 1)))
    error = F.sqrt(share * (1 - share) * F.lit(1 / max(n_toxic, 1) + 1 / max(n_other, 1)) + 1e-12)
    contrast = (F.col("a") / F.lit(float(max(n_toxic, 1))) - F.col("b") / F.lit(float(max(n_other, 1)))) / error
    telling = [r["word"] for r in seen.withColumn("contrast", contrast).where(F.col("contrast") > MIN_CONTRAST)
               .orderBy(F.col("contrast").desc(), "word").limit(TOXIC_WORDS).collect()]
    ordinary_rows = sample.where("toxic <> 1")
    n_windows = ordinary_rows.agg(F.sum(F.ceil(F.size(words(F.col("text"))) / 8))).first()[0] or 1
    found = (ordinary_rows.select("text", F.xxhash64("doc_id").alias("seed"))
             .mapInArrow(_emit_windows(PAIRS * SAMPLE_WINDOWS / n_windows), "order bigint, window binary").collect())
    parts = [bytes(r["window"]) for r in sorted(found, key=lambda r: (r["order"], bytes(r["window"])))]
    front, pairs = " ".join(reversed(telling)).encode() + b" ", []
    for i in range(PAIRS):
        mine = parts[i::PAIRS]
        try:
            ordinary = zstandard.train_dictionary(DICTIONARY_BYTES, mine).as_bytes()
        except zstandard.ZstdError:  # too little text for the trainer: the text itself serves
            ordinary = b"".join(mine)[-DICTIONARY_BYTES:]
        pairs.append((ordinary, front + ordinary))
    distance = Distance(pairs)
    rows = _features(sample, distance, ["toxic"]).collect()  # about sample_rows rows of a few numbers
    return distance, Calibration(np.array([r["features"] for r in rows]).reshape(-1, distance.width),
                                 np.array([r["toxic"] for r in rows], float))


def _features(docs: DataFrame, distance: Distance, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distance.features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.float64()))],
                                             [*keep, "features"])
    schema = docs.select(*keep).schema.add("features", docs.sparkSession.createDataFrame([], "a array<double>").schema["a"].dataType)
    return docs.select(*keep, "text").mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; ``labels`` has ``(doc_id, toxic)``.

    Every whole text is cut into overlapping windows of twelve words; each is
    compressed under each dictionary and the bytes that the toxic ones save
    become a probability by a calibration on the sample.  Only the text counts.

    Null and empty texts have no windows and get the score of texts with
    nothing saved.  Without labels every score is near 0.  Rows with the same text get the same score.
    """
    small_batches(docs.sparkSession)
    distance, calibration = fit(docs, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([distance.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, distance.width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(calibration.score(found))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
