"""Shared pieces: words, row numbers without a one-task window, and hashes of words in NumPy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow tasks get at most 2,000 rows or 8 MB at a time: whole documents are wide rows."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than blank, tab, line feed, VT, FF and CR."""
    return F.array_remove(F.split(text, GAP), "")


def text_key(name: str = "text") -> Column:
    """A hash that tells rows with one ``doc_id`` but different texts apart."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str,
                  slices: int = 256, few: bool = False) -> DataFrame:
    """Add a gapless number from 0 to the rows of each group; ``groups`` hold no nulls.

    A group is dealt into ``slices`` by a hash of ``order``; rows are numbered
    inside a slice and moved up by the sizes of the slices before it.  So a
    group that holds most of the table still spreads over the cluster.  With
    ``few`` the number of groups has a bound that no table raises: the sizes of
    the slices are sent to the rows, which are not sorted again to meet them.
    """
    groups = list(groups)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*groups, "_slice").agg(F.count("*").alias("_n")).select(
        *groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order)
    return (sliced.withColumn("_row", F.row_number().over(inside))
            .join(F.broadcast(offsets) if few else offsets, [*groups, "_slice"])
            .withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("bigint"))
            .drop("_slice", "_row", "_before"))


# ---- words and their hashes inside Arrow tasks -------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd multiplier and of its inverse, made as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for side, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, side, np.cumprod(table, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_LETTERS = _Powers(0xD6E8FEB86659FD93)
_WORDS = _Powers(0xA0761D6478BD642F)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string column; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: ``(first, last, bytes, offsets)``."""
    data, offsets = strings(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ``(starts, ends)`` of all words and ``rows``: row i has words ``rows[i]:rows[i + 1]``.

    ``gap`` tells for each byte whether it stands between words.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    final = inside.copy()
    final[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False,
                step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` reads A-Z as a-z.

    A word is a polynomial in its bytes, taken as a difference of running sums;
    the bytes are worked through in stretches, so a very long text needs no
    more memory than ``step`` bytes (or one word) do.
    """
    out = np.empty(len(starts), np.uint64)
    table, at = _LOWER_BYTE if lower else _BYTE, 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _LETTERS.upto(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[:-1], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        at = to
    return out


def window_hashes(hashes: np.ndarray, width: int, step: int = 1 << 18) -> np.ndarray:
    """The hash of every run of ``width`` neighbouring words; empty where there are fewer."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for low in range(0, count, step):
        high = min(low + step, count)
        part = hashes[low:high + width - 1]
        up, down = _WORDS.upto(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        out[low:high] = mix((total[width:] - total[:-width]) * down[:high - low])
    return out


class Sums:
    """Counts by key that a task holds back, at most about ``most`` rows of them."""

    def __init__(self, keys: list[str], most: int):
        self.keys, self.most, self.held, self.rows = keys, most, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(table)
        self.rows += len(table)
        if self.rows > self.most:
            self._join()
            if self.rows > self.most // 2:
                yield from self.flush()

    def _join(self) -> None:
        if self.held:
            joined = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([("n", "sum")])
            joined = joined.rename_columns([c.removesuffix("_sum") for c in joined.column_names])
            self.held, self.rows = [joined.select([*self.keys, "n"])], len(joined)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._join()
        for table in self.held:
            yield from table.to_batches(max_chunksize=50_000)
        self.held, self.rows = [], 0
