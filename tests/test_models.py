"""Logistic regression and divisive clusters against plain NumPy."""

import numpy as np
import pytest

from panelspark.operators import divisive, logistic, text


def _plain_regression(x, y, labels, steps):
    n, m, s = len(x), x.mean(0), x.std(0)
    s = np.where(s == 0, 1, s)
    z = np.c_[(x - m) / s, np.ones(n)]
    penalty = np.r_[1 / (n * s * s), 0]
    pace = 1 / (0.5 * z.shape[1] + penalty.max())
    w = at = np.zeros((labels, z.shape[1]))
    for t in range(1, steps + 1):
        e = np.exp(z @ at.T - (z @ at.T).max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        new = at - pace * (p.T @ z / n + penalty * at)
        w, at = new, new + t / (t + 3) * (new - w)
    raw = w[:, :-1] / s
    return np.c_[raw, w[:, -1] - raw @ m]


@pytest.mark.parametrize("numbers", [1 << 20, 6])
def test_logistic_weights_in_one_and_in_many_slices(spark, numbers):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 5, 120)
    x = np.c_[rng.normal(y * 30.0, 20), rng.normal(2000 + y, 3)]
    rows = [(f"l{c}", float(a), float(b)) for c, (a, b) in zip(y, x)] + [(None, 1.0, 1.0), ("l1", None, 1.0)]
    train = spark.createDataFrame(rows, "label string, a double, b double")
    model = logistic.fit_logistic(train, ["a", "b"], "label", 8, numbers)
    got = {r.label: r.weights for r in model.collect()}
    want = _plain_regression(x, y, 5, 8)
    assert sorted(got) == [f"l{i}" for i in range(5)]
    assert np.allclose([got[k] for k in sorted(got)], want, atol=1e-9)
    scores = np.c_[x, np.ones(len(x))] @ want.T
    out = logistic.predict_logistic(train, model, ["a", "b"], numbers).collect()
    best = {(r.a, r.b): r.predicted for r in out if r.a is not None}
    assert all(best[a, b] == f"l{i}" for (a, b), i in zip(x, scores.argmax(1)))
    assert [r.predicted for r in out if r.a is None] == [None] and len(out) == len(rows)


def test_logistic_reaches_the_minimum(spark):
    """The gradient of the raw objective vanishes, whatever the features' units."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60)
    x = np.c_[rng.normal(y, 1.0)]
    train = spark.createDataFrame([("ab"[c], float(a[0]), 7.0) for c, a in zip(y, x)], "label string, a double, fixed double")
    got = {r.label: r.weights for r in logistic.fit_logistic(train, ["a", "fixed"], "label", 60).collect()}
    w = np.array([got["a"], got["b"]])
    z = np.c_[x, np.full(60, 7.0), np.ones(60)]
    e = np.exp(z @ w.T)
    p = e / e.sum(1, keepdims=True)
    p[np.arange(60), y] -= 1
    gradient = p.T @ z / 60 + w * [1 / 60, 1 / 60, 0]
    assert np.abs(gradient[:, 0]).max() < 1e-3 and np.abs(gradient[:, 2]).max() < 1e-3


def test_logistic_without_rows(spark):
    none = spark.createDataFrame([], "label string, a double")
    model = logistic.fit_logistic(none, ["a"], "label", 2)
    assert model.collect() == []
    some = spark.createDataFrame([("x", 1.0)], "label string, a double")
    assert [r.predicted for r in logistic.predict_logistic(some, model, ["a"]).collect()] == [None]


def _vectors(index):
    terms = sorted({t for r in index.vectors.collect() for t in r.terms})
    rows = {}
    for r in index.vectors.collect():
        v = np.zeros(len(terms))
        for t, w in zip(r.terms, r.weights):
            v[terms.index(t)] = w
        rows[r.rep_id] = (v, r.copies)
    return rows


def _plain_halves(ids, rows, rounds):
    unit = lambda v: v / (np.sqrt(v @ v) or 1.0)
    furthest = lambda c: min(ids, key=lambda i: (round(float(rows[i][0] @ c), 9), i))
    a = furthest(unit(sum(rows[i][0] * rows[i][1] for i in ids)))
    b = furthest(rows[a][0])
    centres = [rows[a][0], rows[b][0]]
    side = {}
    for _ in range(rounds + 1):
        new = {i: int(round(float(rows[i][0] @ centres[1]), 9) > round(float(rows[i][0] @ centres[0]), 9)) for i in ids}
        if new == side:
            break
        side = new
        centres = [unit(sum((rows[i][0] * rows[i][1] for i in ids if side[i] == s), np.zeros(len(centres[0])))) for s in (0, 1)]
    return side


def _plain_tree(rows, k, rounds):
    spread = lambda ids: round(sum(rows[i][1] for i in ids) - float(np.linalg.norm(sum(rows[i][0] * rows[i][1] for i in ids))), 6)
    groups = [sorted(rows)]
    while len(groups) < k:
        at = max(range(len(groups)), key=lambda g: spread(groups[g]))
        side = _plain_halves(groups[at], rows, rounds)
        groups[at:at + 1] = [[i for i in groups[at] if side[i] == s] for s in (0, 1)]
    return groups


@pytest.fixture(scope="module")
def some_texts(spark):
    rng = np.random.default_rng(11)
    docs = [(i, "x", " ".join(rng.choice([f"{'uvw'[i % 3]}{j}" for j in range(8)] + ["common"], size=rng.integers(2, 7)))) for i in range(36)]
    docs += [(40 + i, "x", "u1 u2 u3") for i in range(14)] + [(60, "x", ""), (61, "x", None)]
    return text.fit_tfidf(spark.createDataFrame(docs, "doc_id bigint, label string, text string"))


def test_divisive_clusters_against_plain_bisection(some_texts):
    rows = _vectors(some_texts)
    rep = {r.doc_id: r.rep_id for r in some_texts.docs.collect()}
    for k in (1, 2, 5):
        groups = _plain_tree(rows, k, 4)
        want = {i: g for g, ids in enumerate(groups) for i in ids}
        got = {r.doc_id: r.cluster for r in divisive.divisive_clusters(some_texts, k, 4).collect()}
        assert got == {d: want.get(r, -1) for d, r in rep.items()}
        assert got[60] == got[61] == -1


def test_divisive_silhouettes_against_all_distances(some_texts):
    rows = _vectors(some_texts)
    points = np.array([v for v, c in rows.values() for _ in range(c)])
    ids = [i for i, (_, c) in rows.items() for _ in range(c)]
    square = ((points[:, None] - points[None]) ** 2).sum(2)
    got = {r.k: r.silhouette for r in divisive.divisive_sweep(some_texts, [2, 4], 4).collect()}
    for k in (2, 4):
        own = {i: g for g, m in enumerate(_plain_tree(rows, k, 4)) for i in m}
        labels = np.array([own[i] for i in ids])
        values = []
        for p, mine in enumerate(labels):
            size = (labels == mine).sum()
            if size < 2:
                values.append(0.0)
                continue
            a = square[p, labels == mine].sum() / (size - 1)
            b = min(square[p, labels == o].mean() for o in set(labels) - {mine})
            values.append((b - a) / max(a, b) if max(a, b) else 0.0)
        assert got[k] == pytest.approx(np.mean(values), abs=1e-6)


def test_divisive_with_fewer_texts_than_clusters(spark):
    docs = spark.createDataFrame([(1, "x", "aa bb"), (2, "x", "aa bb"), (3, "x", "cc dd")], "doc_id bigint, label string, text string")
    index = text.fit_tfidf(docs)
    assert [tuple(r) for r in divisive.divisive_clusters(index, 5).orderBy("doc_id").collect()] in (
        [(1, 0), (2, 0), (3, 1)], [(1, 1), (2, 1), (3, 0)])
    curve = {r.k: r for r in divisive.divisive_sweep(index, [2, 3]).collect()}
    assert curve[2].silhouette > 0 and curve[3].silhouette is None and curve[3].reason == "only 2 clusters"
    none = text.fit_tfidf(spark.createDataFrame([(1, "x", "")], "doc_id bigint, label string, text string"))
    assert [tuple(r) for r in divisive.divisive_clusters(none, 3).collect()] == [(1, -1)]


def test_divisive_in_small_blocks_and_slices(some_texts, monkeypatch):
    monkeypatch.setattr(divisive, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(divisive, "SENT_NUMBERS", 50)
    rows = _vectors(some_texts)
    rep = {r.doc_id: r.rep_id for r in some_texts.docs.collect()}
    want = {i: g for g, ids in enumerate(_plain_tree(rows, 3, 2)) for i in ids}
    got = {r.doc_id: r.cluster for r in divisive.divisive_clusters(some_texts, 3, 2).collect()}
    assert got == {d: want.get(r, -1) for d, r in rep.items()}


def test_divisive_rounds_move_no_vectors(some_texts, monkeypatch):
    """Vectors are packed once; what is shuffled in the rounds are sums of those that changed their half."""
    plans, write = [], divisive.materialise

    def noted(df, name, **options):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name, **options)

    monkeypatch.setattr(divisive, "materialise", noted)
    assert divisive.divisive_clusters(some_texts, 2, 3).count() == 52
    names = [n for n, _ in plans]
    assert names.count("vector_blocks") == 1 and "round" in names and "all_entries" not in names
    assert all("hashpartitioning" not in plan for name, plan in plans if name in ("vector_blocks", "round", "state"))


def test_divisive_groups_that_wait_are_still_split(spark):
    """Groups whose halves were found early keep their vectors until it is their turn."""
    rng = np.random.default_rng(4)
    docs = [(i, "x", " ".join(rng.choice([f"{'uvw'[i % 3]}{j}" for j in range(9)], size=5))) for i in range(40)]
    index = text.fit_tfidf(spark.createDataFrame(docs, "doc_id bigint, label string, text string"))
    rows = _vectors(index)
    want = {i: g for g, ids in enumerate(_plain_tree(rows, 9, 2)) for i in ids}
    rep = {r.doc_id: r.rep_id for r in index.docs.collect()}
    assert {r.doc_id: r.cluster for r in divisive.divisive_clusters(index, 9, 2).collect()} == {d: want[r] for d, r in rep.items()}
