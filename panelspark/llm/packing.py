"""Packing of tokenised documents into sequences of bounded length, by fitted length patterns."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import number_within, small_batches
from panelspark.session import materialise

CAPACITY = 1024
END_ID = 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")   # the same vocabulary, for a faster library
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str):
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer
        return Tokenizer.from_file(tokenizer)

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:  # a string that the two libraries read differently: the tokenizer's own word counts
            return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)
    return encode


def cut(length: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces; only the first may be shorter than ``capacity`` once it is cut."""
    first = length % capacity or min(length, capacity)
    starts = np.concatenate([[0], np.arange(first, length, capacity)]).astype(np.int64)
    return starts, np.diff(np.append(starts, length))


def _tokenise(tokenizer: str, ranks: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders(tokenizer, ranks)
        for batch in batches:
            source, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for i, (s, n) in enumerate(zip(*cut(len(ids), capacity))):
                    part = ids[s:s + n]
                    source.append(row)
                    piece.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END_ID, tokenizer: str = TOKENIZER,
                 ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: every document's ids and end id, cut where longer than ``capacity``."""
    schema = (docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long")
              .add("ids_crc32", "long"))
    if with_ids:
        schema = schema.add("ids", docs.sparkSession.createDataFrame([], "a array<int>").schema["a"].dataType)
    return docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, ranks, capacity, end, with_ids), schema)


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` with two or three of the lengths; rows ``(a, b, c)``, ``c`` 0 for two."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = []
    two = lengths[(lengths * 2 <= capacity) & there[capacity - lengths]]
    out.append(np.stack([capacity - two, two, 0 * two], axis=1))
    for a in lengths[lengths * 3 >= capacity]:
        b = lengths[(lengths <= a) & (capacity - a - lengths > 0)]
        c = capacity - a - b
        ok = (c <= b) & there[np.clip(c, 0, capacity)]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares ``min |A x - h|``: column p of ``A`` counts the lengths of pattern p.

    Accelerated projected gradient; ``A`` is never built, both products are a
    gather and a weighted count over three numbers per pattern.
    """
    used = patterns > 0
    h = histogram.astype(float)

    def forward(x):
        out = np.zeros(len(h))
        for k in range(3):
            out += np.bincount(patterns[:, k], weights=x * used[:, k], minlength=len(h))
        return out

    def backward(r):
        return sum(r[patterns[:, k]] * used[:, k] for k in range(3))

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = backward(forward(v))
        size = np.linalg.norm(v)
        v /= size
    step, x = 0.95 / size, np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * backward(forward(y) - h), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: ``(lengths, repeats)``; longest first, into the fullest sequences that still fit."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                each = min(capacity // length, left)
                groups, fit = [((), left // each)], capacity
            else:
                groups = room.pop(fit)
            while groups and left:
                held, repeats = groups.pop()
                each = min(fit // length, left)
                take = min(repeats, left // each)
                if take < repeats:
                    groups.append((held, repeats - take))
                room.setdefault(fit - each * length, []).append((held + (length,) * each, take))
                left -= take * each
            if groups and fit < capacity:
                room.setdefault(fit, []).extend(groups)
    return [group for groups in room.values() for group in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` for all pieces shorter than ``capacity``.

    Fitted repeats are rounded to whole numbers, the largest first, as far as
    pieces are left; what no pattern takes is packed best-fit.
    """
    left = histogram.copy()
    out = []
    lengths = np.flatnonzero(left)
    patterns = patterns_of(lengths[(lengths > 0) & (lengths < capacity)], capacity)
    if len(patterns):
        wanted = np.floor(fit_repeats(patterns, left) + 0.5).astype(np.int64)
        for p in np.argsort(-wanted, kind="stable"):
            if not wanted[p]:
                break
            parts = patterns[p][patterns[p] > 0]
            names, times = np.unique(parts, return_counts=True)
            repeats = int(min(wanted[p], (left[names] // times).min()))
            if repeats:
                left[names] -= repeats * times
                out.append((tuple(int(x) for x in parts), repeats))
    return out + best_fit(left, capacity)


class _Places:
    """Where the n-th piece of a length goes: per length, ranges of numbers that follow one slot of one pattern."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], capacity: int):
        used = np.zeros(capacity + 1, np.int64)
        rows = []
        sequence = 0
        for lengths, repeats in planned:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], sequence, offset))
                used[n] += repeats
                offset += n
            sequence += repeats
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.begin = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        self.first, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for n in np.unique(length):
            here, low, high = length == n, self.begin[n], self.begin[n + 1]
            at[here] = low + np.searchsorted(self.first[low:high], number[here], "right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END_ID, slices: int = 64, **tokenizer) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``: the place of every piece.

    Patterns of two or three lengths that fill a sequence exactly are fitted to
    the histogram of lengths by non-negative least squares; the remainder goes
    best-fit.  The histogram has ``capacity`` numbers whatever the corpus, so it
    and the plan are the driver's; pieces stay distributed and are numbered per
    length in slices, whose at most ``capacity * slices`` sizes are sent to them.
    A piece's sequence follows from its length and number.

    A null or empty text is its end id alone.  Repeated rows are packed each.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    pieces = materialise(token_pieces(docs, capacity, end, **tokenizer).withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in short.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity - 1 rows
        histogram[r["length"]] = r["n"]
    places = _Places(plan(histogram, capacity), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            names = [n for n in batch.schema.names if n not in ("row", "number")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)], names + ["sequence_id", "offset"])

    names = [c for c in pieces.columns if c != "row"]
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    numbered = number_within(short, ["length"], [F.col("row")], "number", slices, few=True)
    placed = numbered.select(*names, "number").mapInArrow(place, schema)
    whole = pieces.where(F.col("length") == capacity).select(
        *names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, documents)`` from pieces packed ``with_ids``; a sequence is at most ``capacity`` ids."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("documents"))
