"""Best matches by blocks of sparse vectors, against all products."""

import numpy as np
import pyarrow as pa
import pytest

from panelspark.operators import kernels, nearest, similar


def some_rows(seed, n, labels="ab"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # a few very common terms and many rare ones
        at = sorted({int(t) for t in np.minimum(rng.zipf(1.3, 14), 400)})
        rows.append((i * 11 % n, labels[i % len(labels)], [f"t{t}" for t in at], rng.random(len(at)).round(3).tolist()))
    return rows


def block(rows, by_term):
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "terms": [[int(t[1:]) * 7 for t in r[2]] for r in rows],
                      "weights": [r[3] for r in rows]})
    return nearest._Block(pa.scalar(nearest._closed(table, by_term), pa.binary()))


def product(a, b):
    held = dict(zip(b[2], b[3]))
    return sum(x * held.get(t, 0.0) for t, x in zip(a[2], a[3]))


@pytest.mark.parametrize("cost", [0, 160, 1 << 40])
def test_products_by_columns_and_by_entries(monkeypatch, cost):
    monkeypatch.setattr(nearest, "ENTRY_COST", cost)
    monkeypatch.setattr(nearest, "CHUNK", 50)
    docs, queries = some_rows(1, 70), some_rows(2, 50)
    got = nearest._products(block(docs, False), block(queries, True))
    assert np.allclose(got, [[product(a, b) for b in queries] for a in docs])


def test_common_terms_are_not_multiplied_entry_by_entry(monkeypatch):
    rows = [(i, "a", ["t1", "t2", f"t{i + 3}"], [1.0, 2.0, 3.0]) for i in range(300)]
    added = []
    real = np.add

    class Add:
        at = staticmethod(lambda cells, cell, value: added.extend(cell) or real.at(cells, cell, value))

    monkeypatch.setattr(nearest.np, "add", Add)
    table = nearest._products(block(rows, False), block(rows, True))
    monkeypatch.setattr(nearest.np, "add", real)
    # 300 of 180,300 products
    assert len(added) == 300 and table[0, 1] == 5.0 and table[0, 0] == 14.0


def test_found_keeps_the_best_of_many_tables():
    rng = np.random.default_rng(4)
    tables = [np.round(rng.random((60, 9)) * (rng.random((60, 9)) < 0.9), 2) for _ in range(5)]
    found = nearest._Found(pa.array([*range(8), None], pa.int64()), 4)
    ids = rng.permutation(300).reshape(5, 60)
    for i, t in zip(ids, tables):
        found.add(t, i, np.arange(9))
    got = found.table().to_pylist()
    flat, all_ids = np.concatenate(tables), ids.ravel()
    for q in range(9):
        want = sorted(zip(-flat[:, q], all_ids))[:4]
        assert [(r["rep_id"], r["score"]) for r in got if r["query_id"] == (q if q < 8 else None)] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("score,match,unlike", [("dot", False, False), ("dot", True, False), ("dot", False, True), ("jaccard", True, False)])
def test_block_matches_against_all_products(spark, monkeypatch, score, match, unlike):
    monkeypatch.setattr(nearest, "ENTRIES", 300)
    monkeypatch.setattr(nearest, "ROWS", 30)
    # the kernel for blocks that was there before is not used
    monkeypatch.setattr(kernels, "_products", None)
    one = score == "jaccard"
    docs = [(i, lab, t, [1.0] * len(w) if one else w) for i, lab, t, w in some_rows(5, 150, ["a", "b", "c", None])]
    asked = [(i, lab, t, [1.0] * len(w) if one else w) for i, lab, t, w in some_rows(6, 90, ["b", "a", "d", None])] + [(1000, "a", ["other"], [1.0]), (1001, "a", [], [])]
    schema = "label string, terms array<string>, weights array<double>"
    d = spark.createDataFrame(docs, "rep_id bigint, " + schema).repartition(3)
    q = spark.createDataFrame(asked, "query_id bigint, " + schema).repartition(2)
    got = {}
    for r in similar.block_matches(q, d, 3, score, match, unlike).collect():
        got.setdefault(r.query_id, []).append((r.rep_id, r.score))

    def value(a, b):
        dot = product(a, b)
        return round(dot / (len(a[2]) + len(b[2]) - dot) if one else dot, 9) if a[2] and b[2] else 0.0

    for row in asked:
        best = sorted((-value(row, x), x[0]) for x in docs if (not match or x[1] == row[1]) and not (unlike and x[1] == row[1]))
        want = [(i, -s) for s, i in best if s < 0][:3]
        have = sorted(got.get(row[0], []), key=lambda p: (-p[1], p[0]))
        assert [i for i, _ in have] == [i for i, _ in want] and [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-8)
