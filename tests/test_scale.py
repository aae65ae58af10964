"""Steps that must grow no faster than their input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.operators import blocks, joins, kernels, kmeans, linkage, similar, text
from panelspark.operators.kernels import keep_best, sparse_top_k


def test_kmeans_rows_lie_in_a_piece_for_every_core(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    points = kmeans.written(rows.coalesce(1), ["x", "y"])
    assert points.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism // 2
    assert points.count() == 400


def test_kmeans_step_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(300, 3))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, c double")
    points = kmeans.written(rows, ["a", "b", "c"])
    starts = {2: x[:2].tolist(), 3: x[:3].tolist()}
    moved = kmeans.lloyd_many(points, starts, 1)
    for k, start in starts.items():
        own = ((x[:, None] - np.array(start)) ** 2).sum(-1).argmin(1)
        assert np.allclose(moved[k], [x[own == i].mean(0) for i in range(k)])


def test_kmeans_wants_numbers(spark):
    points = kmeans.written(spark.createDataFrame([(1, 0.0), (2, None)], "id bigint, a double"), ["a"])
    with pytest.raises(Exception, match="k-means needs a number"):
        kmeans.lloyd_many(points, {1: [[0.0]]}, 1)


def test_blocks_meet_without_moving_rows(spark, monkeypatch):
    plans, write = {}, blocks.materialise

    def noted(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **options)

    monkeypatch.setattr(blocks, "materialise", noted)
    rng = np.random.default_rng(5)
    rows = [(i, [str(t) for t in range(i % 4, 6)], rng.random(6 - i % 4).tolist()) for i in range(90)]
    d = spark.createDataFrame(rows, "rep_id bigint, terms array<string>, weights array<double>")
    q = d.withColumnRenamed("rep_id", "query_id")
    size = F.size("terms")
    got = blocks.meet(d, q, "rep_id", "query_id", size, size, sparse_top_k(90), similar.MATCH, doc_entries=20, query_entries=15, merge=keep_best(90))
    assert sorted(plans) == ["doc_blocks", "met", "query_blocks"] and "hashpartitioning" not in "".join(plans.values())
    want = {(a, b): round(sum(x * y for t, x in zip(ta, wa) for u, y in zip(tb, wb) if t == u), 9) for a, ta, wa in rows for b, tb, wb in rows}
    have = {(r.query_id, r.rep_id): r.score for r in got.collect()}
    assert have.keys() == want.keys() and all(have[p] == pytest.approx(want[p], abs=1e-8) for p in want)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_blocks_send_the_best_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASKS_PER_CORE", 1, raising=False)
    rows = [(i, ["t", f"u{i}"], [1.0, 1.0 + i / 100]) for i in range(400)]
    d = spark.createDataFrame(rows, "rep_id bigint, terms array<string>, weights array<double>")
    q = spark.createDataFrame(rows, "query_id bigint, terms array<string>, weights array<double>")
    size = F.size("terms")
    got = blocks.meet(d, q, "rep_id", "query_id", size, size, sparse_top_k(2), similar.MATCH, doc_entries=20, query_entries=20, merge=keep_best(2))
    # two per query, not two per block of documents or task that reads some
    assert got.count() == 800 and {r.query_id for r in got.collect() if r.query_id == r.rep_id} == set(range(1, 400)) | {0}


def index_of(spark, rows):
    return text.fit_tfidf(spark.createDataFrame(rows, "doc_id bigint, label string, text string"))


def test_index_of_copies_bare_and_unnamed_documents(spark, monkeypatch):
    monkeypatch.setattr(joins, "SENT_KEYS", 3)  # both ways of the look-up
    rows = [(i, "a", f"red red blue w{i % 5}x w{i}y") for i in range(20)]
    rows += [(i + 100, "b", f"red red blue w{i % 5}x w{i}y") for i in range(3)] + [(5, "a", rows[5][2]), (200, "a", None), (None, "c", "green blue")]
    ix = index_of(spark, rows)
    have = {(r.rep_id, r.copies): dict(zip(r.terms, r.weights)) for r in ix.vectors.collect()}
    bags = [r for r in rows if r[0] is not None and r[2]]
    df = {t: sum(t in r[2].split() for r in bags) for r in bags for t in r[2].split()}
    assert {r.term: r.df for r in ix.vocab.collect()} == df
    copies = {i: sum(r[2] == rows[i][2] for r in rows) for i in range(20)}
    assert have.keys() == set(copies.items())
    for i in range(20):
        words = rows[i][2].split()
        w = {t: words.count(t) * (np.log((1 + len(rows)) / (1 + df[t])) + 1) for t in words}
        length = np.sqrt(sum(x * x for x in w.values()))
        assert have[i, copies[i]] == pytest.approx({t: x / length for t, x in w.items()})
    assert {(r.doc_id, r.rep_id) for r in ix.docs.collect() if r.doc_id is not None} == {(r[0], r[0] % 100) for r in bags} | {(200, 200)}


@pytest.mark.parametrize("sent", [3, 100_000])
def test_weights_are_worked_out_where_the_terms_lie(spark, monkeypatch, sent):
    plans, write = {}, text.materialise

    def noted(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **options)

    monkeypatch.setattr(text, "materialise", noted)
    monkeypatch.setattr(joins, "SENT_KEYS", sent)
    rows = [(i, "a", " ".join(f"w{j}w" for j in range(i % 7 + 1)) + f" é{i}x " + "z" * (70 + i % 2)) for i in range(30)]
    # a doc_id with two texts has their terms together
    ix = index_of(spark, [*rows, (2, "a", "w0w other"), (3, "b", rows[3][2])])
    words = {i: t.split() + (["w0w", "other"] if i == 2 else []) for i, _, t in rows}
    idf = {r.term: r.idf for r in ix.vocab.collect()}
    have = {r.rep_id: r for r in ix.vectors.collect()}
    assert have.keys() == words.keys() and have[3].copies == 2 and have[4].copies == 1
    for i, held in words.items():
        assert have[i].terms == sorted(set(held), key=lambda t: (-idf[t], t.encode()))
        w = np.array([held.count(t) * idf[t] for t in have[i].terms])
        assert have[i].weights == pytest.approx(list(w / np.sqrt(w @ w)))
    plain = index_of(spark, rows)
    assert "Generate" not in plans["vectors"] and plain.vectors.count() == 30


def test_terms_of_a_vector_lie_from_rare_to_common(spark):
    ix = index_of(spark, [(i, "a", f"common w{i % 3}x w{i}y") for i in range(9)])
    df = {r.term: r.df for r in ix.vocab.collect()}
    for r in ix.vectors.collect():
        assert r.terms == sorted(r.terms, key=lambda t: (df[t], t))


def test_similar_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        base = rng.integers(0, 12, size=rng.integers(1, 9))
        rows += [(3 * i, "a", " ".join(f"w{t}w" for t in base)), (3 * i + 1, "a", " ".join(f"w{t}w" for t in [*base, *base, rng.integers(0, 40)]))]
    ix = index_of(spark, rows)
    vectors = {r.rep_id: dict(zip(r.terms, r.weights)) for r in ix.vectors.collect()}
    want = {}
    for a in vectors:
        for b in vectors:
            d = np.sqrt(max(0, 2 - 2 * sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())))
            if a < b and d <= 0.6:
                want[a, b] = d
    have = {(r.a, r.b): r.distance for r in linkage.similar_pairs(ix, 0.6).collect()}
    assert len(want) > 20 and have == pytest.approx(want, abs=1e-8)


def test_pairs_meet_on_their_first_terms_only(monkeypatch):
    rows = [(i, [f"r{i // 2}", "common"], [0.9, np.sqrt(1 - 0.81)]) for i in range(40)]
    table = pa.table({"rep_id": [r[0] for r in rows], "terms": [r[1] for r in rows], "weights": [r[2] for r in rows]})
    asked, dots = [], kernels._dots
    monkeypatch.setattr(kernels, "_dots", lambda d, q, doc, query: asked.extend(doc) or dots(d, q, doc, query))
    found = kernels.sparse_pairs(0.82)(table, table.rename_columns({"rep_id": "query_id"}))
    assert sorted(zip(*(found.column(c).to_pylist() for c in "ab"))) == [(i, i + 1) for i in range(0, 40, 2)]
    assert sorted(asked) == list(range(1, 40, 2))


def test_sums_of_distances_by_products(monkeypatch):
    monkeypatch.setattr(kernels, "_distances", None)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 7)) + 1000.0
    x[30:] = x[:20]
    x[40:] += 1e-7
    own = rng.integers(0, 3, size=50)
    docs = pa.table({"rep_id": np.arange(50), "cluster": own.astype(np.int32), "features": x.tolist()})
    found = kernels.distance_sums()(docs, pa.table({"query_id": np.arange(50), "features": x.tolist()}))
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert {(r["query_id"], r["cluster"]): r["distance"] for r in found.to_pylist()} == pytest.approx(
        {(i, c): apart[own == c, i].sum() for i in range(50) for c in range(3)}, rel=1e-8)
    same = pa.table({"rep_id": [0, 1], "cluster": pa.array([0, 1], pa.int32()), "features": [[0.1, 0.7]] * 2})
    assert kernels.distance_sums()(same, same.rename_columns({"rep_id": "query_id"})).column("distance").to_pylist() == [0.0] * 4
