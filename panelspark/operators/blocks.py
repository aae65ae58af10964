"""All-against-all work in blocks.

Exact nearest neighbours need every query to meet every document.  Joining on a
shared term would emit a row per pair, and a common term would bring nearly all
of them.  Here Spark cuts both sides into blocks of bounded size, writes each
block once and brings each pair of blocks together once; a task reduces its pairs
with NumPy and emits only what can still be part of the result.

Blocks meet in a Cartesian product of two written tables with a row per block.
It reads the blocks again for every meeting but moves and writes nothing, so what
is shuffled and written grows with the input, and only the work with its square.
A task meets all blocks of documents, or a large share of them, with its queries:
what it sends on is the best of that share, not the best of each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelspark.session import materialise

# so many tasks at least share the meetings, where there are blocks enough
TASKS_PER_CORE = 3
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _packer(entries: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: a task's rows as blocks of up to so many entries and rows, each as one Arrow stream in one value."""
    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as stream:
            for piece in held:
                stream.write_batch(piece)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full, count = [], 0, 0
        for batch in batches:
            upto = np.cumsum(np.asarray(batch.column("_entries"), dtype=np.int64))
            batch, at = batch.drop_columns(["_entries"]), 0
            while at < batch.num_rows:
                done = int(upto[at - 1]) if at else 0
                end = min(int(np.searchsorted(upto, done + entries - full, side="right")), at + rows - count)
                if end <= at and held:  # the block is full
                    yield closed(held)
                    held, full, count = [], 0, 0
                    continue
                end = max(end, at + 1)
                held.append(batch.slice(at, end - at))
                full, count, at = full + int(upto[end - 1]) - done, count + end - at, end
        if held:
            yield closed(held)

    return kernel


def _packed(df: DataFrame, size: Column, blocks: int, entries: int, rows: int, name: str) -> DataFrame:
    """One row per block, each in a file of its own so that Spark can deal them over all cores."""
    sized = df.withColumn("_entries", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint")).coalesce(blocks)
    return materialise(sized.mapInArrow(_packer(entries, rows), "block binary"), name, maxRecordsPerFile=1, compression="zstd")


def _meeting(kernel: Callable, merge: Callable | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a block of queries has found in this task
        found: dict[int, pa.Table] = {}
        for batch in batches:
            for docs, queries, number in zip(*batch.columns):
                part = kernel(*[pa.ipc.open_stream(side.as_buffer()).read_all() for side in (docs, queries)]).cast(schema)
                if merge is None:
                    yield from part.to_batches()
                else:
                    at = number.as_py()
                    found[at] = merge(pa.concat_tables([found[at], part])).cast(schema) if at in found else part
        for part in found.values():
            yield from part.to_batches()

    return task


@contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """A row is a pair of blocks: one at a time goes to Python."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def meet(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str,
         doc_size: Column, query_size: Column, kernel: Callable, schema: str,
         doc_entries: int = 1_000_000, query_entries: int = 250_000,
         query_rows: int = 1024, merge: Callable | None = None) -> DataFrame:
    """Run ``kernel(doc_block, query_block)`` on every pair of blocks.

    Blocks are cut from the rows as they lie and sized by the entries of their
    rows.  ``merge`` brings the results of one block of queries in a task down
    to what may still count, so that less is sent on than one result per pair.
    The result is written before it comes back.
    """
    spark = docs.sparkSession
    n_docs, doc_total = docs.agg(F.count("*"), F.coalesce(F.sum(doc_size), F.lit(0))).first()
    n_queries, query_total = queries.agg(
        F.count("*"), F.coalesce(F.sum(query_size), F.lit(0))).first()
    # use the whole cluster also when the documents would fit in a few blocks
    spare = min(spark.sparkContext.defaultParallelism, ceil(n_docs / 64))
    doc_blocks = max(1, ceil(doc_total / doc_entries), spare)
    query_blocks = max(1, ceil(query_total / query_entries), ceil(n_queries / query_rows))
    left = _packed(docs, doc_size, doc_blocks, max(1, ceil(doc_total / doc_blocks)), 1 << 40, "doc_blocks").withColumnRenamed("block", "docs")
    right = _packed(queries, query_size, query_blocks, query_entries, query_rows, "query_blocks").select(
        F.col("block").alias("queries"), F.xxhash64("block").alias("number"))
    # a task sends what it has found for each of its queries, so a query's meetings lie in few tasks: one, unless the queries are too few for all cores
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    left = left.coalesce(max(1, ceil(tasks / max(1, right.rdd.getNumPartitions()))))
    met = left.crossJoin(right).mapInArrow(_meeting(kernel, merge, to_arrow_schema(StructType.fromDDL(schema))), schema)
    with row_by_row(spark):
        return materialise(met, "met")
