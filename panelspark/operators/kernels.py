"""Reductions of one pair of blocks, in NumPy and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Equal similarities that differ only by summation order must tie.
DECIMALS = 9
_CELLS = 4_000_000


def _flat(table: pa.Table, name: str):
    lists = table.column(name).combine_chunks()
    return lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)


def _codes(values, among):
    """Place of each value in ``among``; -1 where absent."""
    return np.asarray(pc.fill_null(pc.index_in(values, value_set=among), -1)).astype(np.int64)


class _Best:
    """The ``k`` best documents of every query seen so far."""

    def __init__(self, k: int, ids: np.ndarray, largest: bool):
        self.k, self.ids, self.sign = k, ids, (-1.0 if largest else 1.0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query, doc, score, n_queries):
        self.parts.append((query, doc, score))
        self.held += len(query)
        if self.held > 4 * self.k * n_queries + 100_000:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0])

    def result(self):
        if not self.parts:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(0)
        query, doc, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((self.ids[doc], self.sign * score, query))
        query, doc, score = query[order], doc[order], score[order]
        first = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - first < self.k
        return query[keep], doc[keep], score[keep]


def _products(docs: pa.Table, queries: pa.Table):
    """Dot products of the sparse rows of two blocks, a slice of documents at a time.

    Yields ``(lo, hi, table)``: ``table[i, j]`` belongs to document ``lo + i``
    and query ``j``.
    """
    q_terms, q_len = _flat(queries, "terms")
    q_weight = np.asarray(_flat(queries, "weights")[0])
    d_terms, d_len = _flat(docs, "terms")
    d_weight = np.asarray(_flat(docs, "weights")[0])
    n_docs, n_queries = docs.num_rows, queries.num_rows

    known = pc.unique(q_terms)
    q_term = _codes(q_terms, known)
    by_term = np.argsort(q_term, kind="stable")
    q_row = np.repeat(np.arange(n_queries), q_len)[by_term]
    q_weight = q_weight[by_term]
    start = np.searchsorted(q_term[by_term], np.arange(len(known) + 1))

    d_term = _codes(d_terms, known)
    hit = d_term >= 0
    d_row = np.repeat(np.arange(n_docs), d_len)[hit]
    d_term, d_weight = d_term[hit], d_weight[hit]
    pairs = start[d_term + 1] - start[d_term]
    # cut the documents so that a dense score table and its inputs stay small
    per_doc = np.bincount(d_row, pairs, minlength=n_docs) + n_queries
    slice_of = np.floor(np.cumsum(per_doc) / _CELLS).astype(np.int64)
    for s in range(slice_of[-1] + 1):
        lo, hi = np.searchsorted(slice_of, [s, s + 1])
        if lo == hi:
            continue
        a, b = np.searchsorted(d_row, [lo, hi])
        n, total = pairs[a:b], int(pairs[a:b].sum())
        at = (np.arange(total) - np.repeat(np.cumsum(n) - n, n)
              + np.repeat(start[d_term[a:b]], n))
        cell = np.repeat(d_row[a:b] - lo, n) * n_queries + q_row[at]
        yield lo, hi, np.bincount(cell, np.repeat(d_weight[a:b], n) * q_weight[at],
                                  minlength=(hi - lo) * n_queries).reshape(hi - lo, n_queries)


def sparse_top_k(k: int, score: str = "dot", match: bool = False, unlike: bool = False):
    """Kernel: the ``k`` documents most similar to each query of the block.

    Both sides hold ``terms`` and ``weights`` lists.  ``score`` is ``dot`` or
    ``jaccard`` (of unweighted term sets); with ``match`` only documents that
    carry the query's ``label`` count, with ``unlike`` only those that do not.
    """
    out = pa.schema([("query_id", pa.int64()), ("rep_id", pa.int64()), ("score", pa.float64())])

    def kernel(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or queries.num_rows == 0:
            return out.empty_table()
        n_queries, doc_ids = queries.num_rows, np.asarray(docs.column("rep_id"))
        q_len, d_len = _flat(queries, "terms")[1], _flat(docs, "terms")[1]
        if match or unlike:
            names = pc.unique(queries.column("label").combine_chunks())
            q_label = _codes(queries.column("label").combine_chunks(), names)
            d_label = _codes(docs.column("label").combine_chunks(), names)
        best = _Best(k, doc_ids, largest=True)
        for lo, hi, table in _products(docs, queries):
            if score == "jaccard":
                table = table / np.maximum(d_len[lo:hi, None] + q_len[None, :] - table, 1)
            if match or unlike:
                table[(d_label[lo:hi, None] == q_label[None, :]) == unlike] = 0.0
            table = np.round(table, DECIMALS)
            floor = (np.partition(table, -k, axis=0)[-k] if hi - lo > k
                     else np.zeros(n_queries))
            doc, query = np.nonzero((table >= floor) & (table > 0))
            best.add(query, doc + lo, table[doc, query], n_queries)
        query, doc, value = best.result()
        return pa.table({"query_id": queries.column("query_id").take(pa.array(query)).cast(pa.int64()),
                         "rep_id": doc_ids[doc], "score": value}, schema=out)

    return kernel


def keep_best(k: int, largest: bool = True):
    """Merge: the ``k`` best rows of each query, the lowest ids on ties."""
    def merge(table: pa.Table) -> pa.Table:
        query = np.asarray(table.column("query_id").combine_chunks().dictionary_encode("encode").indices)
        doc, score = (np.asarray(table.column(c).combine_chunks()) for c in ("rep_id", "score"))
        order = np.lexsort((doc, -score if largest else score, query))
        first = np.searchsorted(query[order], query[order], side="left")
        return table.take(pa.array(order[np.arange(len(order)) - first < k]))

    return merge


class _Heads:
    """The first entries of each vector of a block, up to where what follows is shorter than ``least``.

    ``rest`` is at least the length of what follows an entry, ``tail`` of what follows the row's head.
    """

    def __init__(self, table: pa.Table, least: float):
        terms, length = _flat(table, "terms")
        weight = np.asarray(_flat(table, "weights")[0])
        row, end = np.repeat(np.arange(len(length)), length), np.cumsum(length)
        upto = np.cumsum(weight * weight)
        # a little too long rather than too short, as the sums run over the whole block
        after = np.sqrt(np.maximum(upto[end[row] - 1] - upto, 0.0) + 1e-10)
        kept = np.ones(len(row), dtype=bool)
        kept[1:] = (after[:-1] >= least) | (row[1:] != row[:-1])
        self.terms, self.row, self.weight, self.rest = terms.filter(pa.array(kept)), row[kept], weight[kept], after[kept]
        last = np.append(self.row[1:] != self.row[:-1], True)[:len(self.row)]
        self.tail = np.zeros(len(length))
        self.tail[self.row[last]] = self.rest[last]


def _open_pairs(docs: pa.Table, queries: pa.Table, b_ids: np.ndarray, a_ids: np.ndarray, least: float):
    """Places of documents and queries that share a head term and can still reach ``least``."""
    d, q = _Heads(docs, least), _Heads(queries, least)
    known = pc.unique(q.terms)
    q_term, d_term = _codes(q.terms, known), _codes(d.terms, known)
    by_term = np.argsort(q_term, kind="stable")
    start = np.searchsorted(q_term[by_term], np.arange(len(known) + 1))
    hit = np.flatnonzero(d_term >= 0)
    n = start[d_term[hit] + 1] - start[d_term[hit]]
    # whole documents at a time, whose sums are complete
    per_doc = np.bincount(d.row[hit], n, minlength=docs.num_rows)
    slice_of = np.floor(np.cumsum(per_doc) / _CELLS).astype(np.int64)[d.row[hit]]
    for s in np.unique(slice_of):
        lo, hi = np.searchsorted(slice_of, [s, s + 1])
        m, at = n[lo:hi], hit[lo:hi]
        i = np.repeat(at, m)
        j = by_term[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[d_term[at]], m)]
        ordered = a_ids[q.row[j]] < b_ids[d.row[i]]
        i, j = i[ordered], j[ordered]
        if not len(i):
            continue
        cell = d.row[i] * queries.num_rows + q.row[j]
        order = np.argsort(cell, kind="stable")
        i, j, cell = i[order], j[order], cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        head = np.add.reduceat(d.weight[i] * q.weight[j], first)
        more = np.minimum.reduceat(np.maximum(d.tail[d.row[i]] * q.rest[j], d.rest[i] * q.tail[q.row[j]]), first)
        can = first[head + more >= least - 1e-8]
        yield d.row[i[can]], q.row[j[can]]


def _dots(docs: pa.Table, queries: pa.Table, doc: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Dot products of named rows of two blocks."""
    sides = []
    for table, rows in ((docs, doc), (queries, query)):
        picked = table.select(["terms", "weights"]).take(pa.array(rows))
        terms, length = _flat(picked, "terms")
        sides.append((terms, np.repeat(np.arange(len(rows)), length), np.asarray(_flat(picked, "weights")[0])))
    known = pc.unique(sides[0][0])
    d_key = sides[0][1] * len(known) + _codes(sides[0][0], known)
    code = _codes(sides[1][0], known)
    met = np.flatnonzero(code >= 0)
    _, i, j = np.intersect1d(d_key, sides[1][1][met] * len(known) + code[met], assume_unique=True, return_indices=True)
    return np.bincount(sides[0][1][i], sides[0][2][i] * sides[1][2][met][j], minlength=len(doc))


def sparse_pairs(least: float):
    """Kernel: all pairs with a dot product of at least ``least``, lower id first.

    Vectors are at most 1 long, their weights positive and their terms in one
    order throughout.  Of two with such a product the one whose head ends
    first has only its tail left to share, so they share a term of their heads.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dot", pa.float64())])

    def kernel(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or queries.num_rows == 0:
            return out.empty_table()
        b_ids, a_ids = np.asarray(docs.column("rep_id")), np.asarray(queries.column("query_id"))
        parts = [out.empty_table()]
        for doc, query in _open_pairs(docs, queries, b_ids, a_ids, least):
            for at in range(0, len(doc), 4096):
                d, q = doc[at:at + 4096], query[at:at + 4096]
                dot = _dots(docs, queries, d, q)
                near = dot >= least
                parts.append(pa.table({"a": a_ids[q[near]], "b": b_ids[d[near]], "dot": dot[near]}, schema=out))
        return pa.concat_tables(parts)

    return kernel


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    values, _ = _flat(table, name)
    return np.asarray(values, dtype=np.float64).reshape(table.num_rows, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, added up one coordinate at a time."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, None, j] - b[None, :, j]) ** 2
    return np.sqrt(total)


def dense_top_k(k: int):
    """Kernel: the ``k`` nearest points of each query by Euclidean distance."""
    out = pa.schema([("query_id", pa.int64()), ("rep_id", pa.int64()), ("score", pa.float64())])

    def kernel(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or queries.num_rows == 0:
            return out.empty_table()
        points, wanted = _matrix(docs, "features"), _matrix(queries, "features")
        ids = np.asarray(docs.column("rep_id"))
        best = _Best(k, ids, largest=False)
        step = max(1, _CELLS // len(wanted))
        for lo in range(0, len(points), step):
            table = np.round(_distances(points[lo:lo + step], wanted), DECIMALS)
            limit = (np.partition(table, k - 1, axis=0)[k - 1] if len(table) > k
                     else np.full(len(wanted), np.inf))
            doc, query = np.nonzero(table <= limit)
            best.add(query, doc + lo, table[doc, query], len(wanted))
        query, doc, value = best.result()
        return pa.table({"query_id": queries.column("query_id").take(pa.array(query)).cast(pa.int64()),
                         "rep_id": ids[doc], "score": value}, schema=out)

    return kernel


# squared distances below this share of the lengths are worked out again from the differences
_NEAR = 1e-6


def _quick_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by products, to nine digits or so; near points by their differences."""
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    squares = np.column_stack([-2 * a, a2, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), b2]).T
    i, j = np.nonzero(~(squares >= (_NEAR * (a2 + b2.max()))[:, None]))
    near = ~(squares[i, j] >= _NEAR * (a2[i] + b2[j]))
    i, j = i[near], j[near]
    step = max(1, _CELLS // max(1, a.shape[1]))
    for lo in range(0, len(i), step):
        p, q = i[lo:lo + step], j[lo:lo + step]
        squares[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(squares, out=squares)


def distance_sums():
    """Kernel: sum of distances from each query point to each cluster of the block."""
    out = pa.schema([("query_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.float64())])

    def kernel(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or queries.num_rows == 0:
            return out.empty_table()
        points, wanted = _matrix(docs, "features"), _matrix(queries, "features")
        names, cluster = np.unique(np.asarray(docs.column("cluster")), return_inverse=True)
        order = np.argsort(cluster, kind="stable")
        points, cluster = points[order], cluster[order]
        sums = np.zeros((len(names), len(wanted)))
        step = max(1, _CELLS // 8 // len(wanted))
        for lo in range(0, len(points), step):
            own = cluster[lo:lo + step]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[first]] += np.add.reduceat(_quick_distances(points[lo:lo + step], wanted), first, axis=0)
        ids = np.asarray(queries.column("query_id"))
        return pa.table({"query_id": np.tile(ids, len(names)),
                         "cluster": np.repeat(names, len(ids)).astype(np.int32),
                         "distance": sums.ravel()}, schema=out)

    return kernel
