"""The best documents of every query among all, by blocks of sparse vectors.

Both sides are cut into blocks as in ``blocks``, but a block is made ready for all
its meetings when it is written: terms are 64-bit hashes, numbered within the
block, and vectors that use the same words lie in one block.  Of the terms
two blocks share, those that many rows of both hold are multiplied as dense
columns; a product of zeros there costs less than finding the others.  The rest
is added entry by entry.  A task keeps the ``k`` best of each query and looks no
closer at what lies below them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import blocks
from panelspark.operators.kernels import DECIMALS
from panelspark.session import materialise

# a block's entries and rows
ENTRIES, ROWS = 1_000_000, 2048
# so many blocks are held at a time, so that like rows can be put together
POOL = 8
# like rows: groups by the commonest terms of what is held, with so many rounds
GROUPS, COMMON, ROUNDS = 16, 256, 6
# what one product by entries costs in products of dense columns, and the most such columns
ENTRY_COST, COLUMNS = 160, 2048
# products by entries that are worked out at once
CHUNK = 1 << 17
_NO_ID = np.iinfo(np.int64).min
_HALF = 0.5 * 10.0 ** -DECIMALS


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    lists = column.combine_chunks()
    return lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _groups(code: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """A group per row by spherical k-means over the commonest terms; it only decides which rows lie together."""
    if n_rows <= GROUPS:
        return np.zeros(n_rows, dtype=np.int64)
    count = np.bincount(code)
    common = np.argsort(-count, kind="stable")[:COMMON]
    column = np.full(len(count), -1)
    column[common] = np.arange(len(common))
    held = np.flatnonzero(column[code] >= 0)
    points = np.zeros((n_rows, len(common)), dtype=np.float32)
    points[row[held], column[code[held]]] = weight[held]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centres = points[np.linspace(0, n_rows - 1, GROUPS).astype(np.int64)]
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        centres = np.stack([points[own == i].sum(axis=0) for i in range(GROUPS)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return own


def _arranged(pool: pa.Table) -> pa.Table:
    """The rows in an order that puts equal labels, and in them like rows, together."""
    terms, length = _flat(pool["terms"])
    row = np.repeat(np.arange(pool.num_rows), length)
    code = np.unique(np.asarray(terms), return_inverse=True)[1]
    keys = [_groups(code, row, np.asarray(_flat(pool["weights"])[0]), pool.num_rows)]
    if "label" in pool.column_names:
        keys.append(np.asarray(pc.fill_null(pool["label"].combine_chunks().dictionary_encode().indices, -1)))
    return pool.take(pa.array(np.lexsort(keys)))


def _closed(rows: pa.Table, by_term: bool) -> bytes:
    """A block in one value: its terms with their hashes in order, and its entries by row, or by term."""
    hashes, length = _flat(rows["terms"])
    weight = np.asarray(_flat(rows["weights"])[0], dtype=np.float64)
    vocab, code = np.unique(np.asarray(hashes), return_inverse=True)
    row = np.repeat(np.arange(rows.num_rows), length)
    # entries of one row with the same term count together
    cell, first = np.unique(row * len(vocab) + code, return_inverse=True)
    weight = np.bincount(first, weight, minlength=len(cell))
    row, code = np.divmod(cell, max(1, len(vocab)))
    if by_term:
        order = np.argsort(code, kind="stable")
        row, code, weight = row[order], code[order], weight[order]
    parts = {"ids": rows["id"], "length": length, "vocab": vocab, "row": row.astype(np.int32), "code": code.astype(np.int32), "weight": weight}
    if "label" in rows.column_names:
        parts["label"] = rows["label"]
    values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v) for v in parts.values()]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
    batch, sink = pa.RecordBatch.from_arrays(lists, list(parts)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packer(entries: int, rows: int, by_term: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: a task's rows as blocks of up to so many entries and rows."""
    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _arranged(pa.Table.from_batches(held))
        upto, at = np.cumsum(_flat(pool["terms"])[1]), 0
        while at < pool.num_rows:
            done = int(upto[at - 1]) if at else 0
            end = max(at + 1, min(int(np.searchsorted(upto, done + entries, side="right")), at + rows))
            yield pa.RecordBatch.from_arrays([pa.array([_closed(pool.slice(at, end - at), by_term)], pa.binary())], ["block"])
            at = end

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full, count = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                full, count = full + len(batch.column("terms").flatten()), count + batch.num_rows
            if full >= POOL * entries or count >= POOL * rows:
                yield from cut(held)
                held, full, count = [], 0, 0
        if held:
            yield from cut(held)

    return kernel


class _Block:
    """A block as arrays; ``count`` is the number of rows that hold a term."""

    def __init__(self, value: pa.BinaryScalar):
        batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
        part = {name: batch.column(name).flatten() for name in batch.schema.names}
        self.ids, self.label = part["ids"], part.get("label")
        self.length, self.vocab, self.row, self.code, self.weight = (
            np.asarray(part[c]) for c in ("length", "vocab", "row", "code", "weight"))
        self.count = np.bincount(self.code, minlength=len(self.vocab))

    def only(self, rows: np.ndarray) -> None:
        """Keep these rows alone."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        kept = np.flatnonzero(place[self.row] >= 0)
        self.row, self.code, self.weight = place[self.row[kept]], self.code[kept], self.weight[kept]
        self.ids, self.label, self.length = self.ids.take(pa.array(rows)), self.label.take(pa.array(rows)), self.length[rows]
        self.count = np.bincount(self.code, minlength=len(self.vocab))


def _dense(block: _Block, terms: np.ndarray) -> np.ndarray:
    """The weights of the named terms, a column each."""
    column = np.full(len(block.vocab), -1)
    column[terms] = np.arange(len(terms))
    at = column[block.code]
    held = np.flatnonzero(at >= 0)
    out = np.zeros((len(block.ids), len(terms)))
    out[block.row[held], at[held]] = block.weight[held]
    return out


def _products(docs: _Block, queries: _Block) -> np.ndarray:
    """Dot products of all documents (by row) and queries (by term) of two blocks."""
    at = np.minimum(np.searchsorted(docs.vocab, queries.vocab), len(docs.vocab) - 1)
    q_at = np.flatnonzero(docs.vocab[at] == queries.vocab)
    d_at, n_queries = at[q_at], len(queries.ids)
    pairs = docs.count[d_at] * queries.count[q_at]
    many = pairs * ENTRY_COST > len(docs.ids) * n_queries
    if many.sum() > COLUMNS:
        many &= pairs >= np.partition(pairs, -COLUMNS)[-COLUMNS]
    table = _dense(docs, d_at[many]) @ _dense(queries, q_at[many]).T
    first, n_of = np.zeros(len(docs.vocab), dtype=np.int64), np.zeros(len(docs.vocab), dtype=np.int64)
    few = ~many
    first[d_at[few]] = (np.cumsum(queries.count) - queries.count)[q_at[few]]
    n_of[d_at[few]] = queries.count[q_at[few]]
    met = n_of[docs.code]
    hit = np.flatnonzero(met)
    met, code = met[hit], docs.code[hit]
    upto = np.cumsum(met)
    offset, base, weight = first[code] - (upto - met), docs.row[hit].astype(np.int64) * n_queries, docs.weight[hit]
    part = upto // CHUNK
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(hit)) if len(hit) else []
    cells = table.reshape(-1)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        n = met[lo:hi]
        entry = np.arange(upto[lo] - n[0], upto[hi - 1])
        entry += np.repeat(offset[lo:hi], n)
        cell = queries.row[entry] + np.repeat(base[lo:hi], n)
        np.add.at(cells, cell, queries.weight[entry] * np.repeat(weight[lo:hi], n))
    return table


class _Found:
    """The ``k`` best documents so far of each query of a block, in order."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k = ids, k
        self.query, self.doc, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        # a query's k-th best score; 0 where fewer are found
        self.floor = np.zeros(len(ids))

    def add(self, table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``table`` has a document in a row and in its columns the queries ``rows``."""
        k, floor = self.k, np.maximum(self.floor[rows] - 2 * _HALF, 0.9 * _HALF)
        over = table >= floor
        each = np.count_nonzero(over, axis=0)
        if each.sum() > 8 * k * len(rows):
            wide = np.flatnonzero(each > 2 * k)
            best = np.partition(table[:, wide], -k, axis=0)[-k]
            floor[wide] = np.maximum(floor[wide], best - 2 * _HALF)
            over = table >= floor
        doc, query = np.divmod(np.flatnonzero(over), len(rows))
        if not len(doc):
            return
        score = np.round(table[doc, query], DECIMALS)
        right = score > 0
        query = np.append(self.query, rows[query[right]])
        doc, score = np.append(self.doc, ids[doc[right]]), np.append(self.score, score[right])
        order = np.lexsort((doc, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        kept = order[place < k]
        self.query, self.doc, self.score = query[place < k], doc[kept], score[kept]
        last = place[place < k] == k - 1
        self.floor[self.query[last]] = self.score[last]

    def table(self) -> pa.Table:
        return pa.table({"query_id": self.ids.take(pa.array(self.query)), "rep_id": pa.array(self.doc, mask=self.doc == _NO_ID),
                         "score": self.score})


def _codes(docs: _Block, queries: _Block) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both blocks as numbers; -1 for one that no query has."""
    names = pc.unique(queries.label)
    return tuple(np.asarray(pc.fill_null(pc.index_in(side.label, value_set=names), -1)) for side in (docs, queries))


def _meet(docs: _Block, queries: _Block, found: _Found, score: str, match: bool, unlike: bool) -> None:
    rows = np.arange(len(queries.ids))
    if match:
        d_label, q_label = _codes(docs, queries)
        rows = np.flatnonzero(np.isin(q_label, d_label))
        if len(rows) < len(q_label):
            queries.only(rows)
        if (d_label < 0).any():
            docs.only(np.flatnonzero(d_label >= 0))
        if not len(rows) or not len(docs.ids):
            return
    table = _products(docs, queries)
    if score == "jaccard":
        table /= np.maximum(docs.length[:, None] + queries.length[None, :] - table, 1)
    if match or unlike:
        d_label, q_label = _codes(docs, queries)
        if unlike or len(np.unique(q_label)) > 1:
            table[(d_label[:, None] == q_label[None, :]) == unlike] = 0.0
    found.add(table, np.asarray(pc.fill_null(docs.ids, _NO_ID)), rows)


def _meeting(k: int, score: str, match: bool, unlike: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a block of queries has found in this task
        found: dict[int, _Found] = {}
        for batch in batches:
            for docs, queries, number in zip(*batch.columns):
                at, block = number.as_py(), _Block(queries)
                held = found.setdefault(at, _Found(block.ids, k))
                _meet(_Block(docs), block, held, score, match, unlike)
        for held in found.values():
            yield from held.table().to_batches()

    return task


def nearest(queries: DataFrame, docs: DataFrame, k: int, score: str = "dot", match: bool = False, unlike: bool = False) -> DataFrame:
    """``(query_id, rep_id, score)``: a few times the ``k`` best ``docs(rep_id, terms, weights)`` of each query, all of these among them.

    ``score`` is ``dot`` or ``jaccard`` (of unweighted term sets).  With ``match`` only documents that carry the query's ``label``
    count, with ``unlike`` only those that do not.  The result is written before it comes back.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    labels = ["label"] if match or unlike else []

    def packed(df: DataFrame, key: str, spare: int, name: str) -> DataFrame:
        rows = df.where(F.size("terms") > 0).select(
            F.col(key).cast("bigint").alias("id"), *labels, F.transform("terms", lambda t: F.xxhash64(t)).alias("terms"),
            F.col("weights").cast("array<double>").alias("weights"))
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        least = max(1, ceil(total / ENTRIES), ceil(n / ROWS), min(spare, ceil(n / 64)))
        kernel = _packer(max(1, ceil(total / least)), max(1, ceil(n / least)), key == "query_id")
        # one row per block, each in a file of its own so that Spark can deal them over all cores
        return materialise(rows.coalesce(least).mapInArrow(kernel, "block binary"), name, maxRecordsPerFile=1, compression="zstd")

    left = packed(docs, "rep_id", cores, "doc_blocks").withColumnRenamed("block", "docs")
    right = packed(queries, "query_id", 1, "query_blocks").select(F.col("block").alias("queries"), F.xxhash64("block").alias("number"))
    # a query's meetings lie in one task, unless the queries are too few for all cores
    left = left.coalesce(max(1, ceil(blocks.TASKS_PER_CORE * cores / max(1, right.rdd.getNumPartitions()))))
    # also a short side is not broadcast: the meetings of each pair of pieces are a task
    met = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(_meeting(k, score, match, unlike), "query_id bigint, rep_id bigint, score double")
    with blocks.row_by_row(spark):
        return materialise(met, "met")
