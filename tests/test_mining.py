import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.fixed_values import NO_ANSWER
from panelspark.operators import cluster, kmeans, linkage, questions, similar, text
from panelspark.operators.linkage import connected_components
from panelspark.plans.entities import entity_clusters

COLS = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = [(0, 0), (6, 0), (0, 6)]
    rows = [(i, *(rng.normal(size=2) + centres[i % 3]).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, x double, y double")


def lloyd(data, centres):
    while True:
        d = ((data[:, None] - centres) ** 2).sum(-1)
        own = d.argmin(1)
        new = np.array([data[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if (abs(new - centres) < 1e-4).all():
            return own, centres
        centres = new


def test_lloyd_matches_numpy_and_keeps_empty_clusters(points):
    seeds = [[0.0, 0.0], [5.0, 1.0], [100.0, 100.0]]
    out, centres = cluster.kmeans_lloyd(points, COLS, ["id"], 3, seeds=seeds)
    rows = sorted(tuple(r) for r in out.select("id", "x", "y", "cluster").collect())
    own, want = lloyd(np.array([r[1:3] for r in rows]), np.array(seeds))
    assert [r[3] for r in rows] == own.tolist()
    assert np.allclose(centres, want) and centres[2] == [100.0, 100.0]


def test_silhouette_against_all_pairs(points):
    labelled = points.withColumn("cluster", (F.col("id") % 3).cast("int"))
    labelled = labelled.unionByName(labelled.where("id = 0").withColumn("id", F.lit(99).cast("bigint"))
                                    .withColumn("cluster", F.lit(7)))
    rows = labelled.collect()
    data, own = np.array([[r.x, r.y] for r in rows]), np.array([r.cluster for r in rows])
    d = np.sqrt(((data[:, None] - data) ** 2).sum(-1))
    scores = []
    for i in range(len(rows)):
        same = own == own[i]
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        scores.append((b - a) / max(a, b))
    assert cluster.silhouette(labelled, "id", COLS).first()[0] == pytest.approx(np.mean(scores))


def test_sweep_finds_the_three_groups(points):
    curve = cluster.sweep_k(points, "id", COLS, range(1, 6))
    rows = {r.k: r for r in curve.collect()}
    assert rows[1].inertia > rows[2].inertia > rows[3].inertia and rows[1].silhouette == 0
    assert similar.first_maximum(curve, "k", "silhouette").first().k == 3
    assert cluster.choose_k(curve).first().knee_k == 3


def test_all_k_at_once_are_as_each_alone(points):
    many, centres = kmeans.written(points, COLS), {}
    seeds = kmeans.draw_seeds(many, "id", 5)
    centres = kmeans.lloyd_many(many, {k: seeds[:k] for k in (1, 3, 5)}, 50)
    data = np.array([[r.x, r.y] for r in points.orderBy("id").collect()])
    figures = kmeans.curve_figures(many, centres)
    for k in (1, 3, 5):
        own, want = lloyd(data, np.array(seeds[:k]))
        assert np.allclose(centres[k], want)
        assert figures[k][0] == pytest.approx(((data - want[own]) ** 2).sum(-1).sum())
        labelled, alone = cluster.kmeans(points, "id", COLS, k, max_iter=50)
        assert [r.cluster for r in labelled.orderBy("id").collect()] == own.tolist() and np.allclose(alone, centres[k])
    d = ((data[:, None] - data) ** 2).sum(-1)
    own, scores = lloyd(data, np.array(seeds[:3]))[0], []
    for i in range(len(data)):
        a = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        scores.append((b - a) / max(a, b))
    assert figures[3][1] == pytest.approx(np.mean(scores))


def test_seeds_spread_and_stop_at_the_number_of_different_rows(spark, points):
    seeds = kmeans.draw_seeds(kmeans.written(points, COLS), "id", 3)
    assert len({tuple(np.round(np.array(s) / 6).astype(int)) for s in seeds}) == 3    # one in each of the three groups
    same = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(9)], "id bigint, x double, y double")
    assert len(kmeans.draw_seeds(kmeans.written(same, COLS), "id", 5)) == 2
    curve = {r.k: r for r in cluster.sweep_k(same, "id", COLS, [1, 2, 3, 12]).collect()}
    assert curve[2].inertia == 0 and curve[3].reason == "only 2 different rows" and curve[12].reason == "only 9 rows"


def test_flat_curve_has_no_knee(spark):
    curve = spark.createDataFrame([(1, 2.0, 0.1), (2, 2.0, 0.2)], "k int, inertia double, silhouette double")
    r = cluster.choose_k(curve).first()
    assert (r.knee_k, r.silhouette_k, r.k) == (None, 2, 5)


def test_gain_stop(spark):
    curve = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.805), (4, 0.9)], "k int, accuracy double")
    assert similar.gain_stop(curve).first().k == 2


def test_pca_matches_numpy(points):
    rows = cluster.pca2(points, COLS).orderBy("id").collect()
    data = np.array([[r.x, r.y] for r in rows])
    values, axes = np.linalg.eigh(np.cov(data.T))
    for j, name in ((1, "pc1"), (0, "pc2")):
        axis = axes[:, j] * np.sign(axes[abs(axes[:, j]).argmax(), j])
        assert np.allclose([r[name] for r in rows], data @ axis)
    first, second = cluster.explained_variance(points, COLS)
    assert first >= second


def test_profile_names_dominant_measures(spark):
    df = spark.createDataFrame([(0, 1.0, -1.0), (0, 2.0, -1.0), (1, -1.0, 0.0)], "cluster int, a double, b double")
    got = {r.cluster: (r["size"], r.dominant) for r in cluster.cluster_profile(df, ["a", "b"]).collect()}
    assert got == {0: (2, "a"), 1: (1, "No significantly high crime rates")}


def find_groups(n, edges):
    parent = list(range(n))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    kept = []
    for e in edges:
        a, b = root(e[0]), root(e[1])
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(e)
    return [root(i) for i in range(n)], kept


def test_components_of_a_random_graph_and_a_long_chain(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, size=(70, 2))] + [(i, i + 1) for i in range(150, 199)]
    roots, _ = find_groups(200, edges)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {i: roots[i] for i in touched}


def test_single_linkage_against_kruskal(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, "x", " ".join(rng.choice(words, size=rng.integers(1, 6)))) for i in range(40)]
    index = text.fit_tfidf(spark.createDataFrame(docs, "doc_id bigint, label string, text string"))
    rep = {r.doc_id: r.rep_id for r in index.docs.collect()}
    vec = {r.rep_id: dict(zip(r.terms, r.weights)) for r in index.vectors.collect()}
    cut = 0.9
    pairs = []
    for a in range(40):
        for b in range(a + 1, 40):
            dot = sum(w * vec[rep[b]].get(t, 0) for t, w in vec[rep[a]].items())
            pairs.append((a, b, round(max(2 - 2 * dot, 0) ** 0.5, 9)))
    near = sorted((p for p in pairs if p[2] <= cut), key=lambda p: (p[2], p[0], p[1]))
    roots, forest = find_groups(40, near)
    found = {(r.a, r.b): r.distance for r in linkage.similar_pairs(index, cut).collect()}
    want = {(a, b): d for a, b, d in near if rep[a] == a and rep[b] == b}
    assert found == pytest.approx(want)
    assert {r.doc_id: r.cluster for r in linkage.single_link_clusters(index, cut).collect()} == dict(enumerate(roots))
    merges = sorted(r.distance for r in linkage.single_link_merges(index, cut).collect())
    assert merges == pytest.approx(sorted(p[2] for p in forest), abs=1e-7)


@pytest.mark.parametrize("bare,listed", [(False, 1), (True, 2), (True, 10)])
def test_whole_single_linkage_tree_against_kruskal(spark, bare, listed):
    """Two vocabularies without a common word; with and without documents that have no terms."""
    rng = np.random.default_rng(6)
    docs = [(i, "x", " ".join(rng.choice([f"{'vw'[i % 2]}{j}" for j in range(9)], size=rng.integers(1, 5)))) for i in range(30)]
    docs += [(30, "x", ""), (31, "x", "a")] if bare else []
    n = len(docs)
    index = text.fit_tfidf(spark.createDataFrame(docs, "doc_id bigint, label string, text string"))
    rep = {r.doc_id: r.rep_id for r in index.docs.collect()}
    vec = {r.rep_id: dict(zip(r.terms, r.weights)) for r in index.vectors.collect()}
    pairs = []
    for a in range(n):
        for b in range(a + 1, n):
            x, y = vec.get(rep[a], {}), vec.get(rep[b], {})
            dot = sum(w * y.get(t, 0) for t, w in x.items())
            pairs.append((a, b, round(max(bool(x) + bool(y) - 2 * dot, 0) ** 0.5, 9)))
    roots, forest = find_groups(n, sorted(pairs, key=lambda p: (p[2], p[0], p[1])))
    got = linkage.single_link_tree(index, listed).collect()
    assert len(got) == n - 1 and len(set(roots)) == 1
    assert sorted(r.distance for r in got) == pytest.approx(sorted(p[2] for p in forest), abs=1e-7)
    assert len(set(find_groups(n, [(r.a, r.b, r.distance) for r in got])[0])) == 1


def test_question_words(spark):
    q = spark.createDataFrame([
        (1, "Which state had the MOST kidnapping cases in 2020?"), (2, "trend of domestic violence"),
        (3, "compare therapeutic uses vs 2011"), (4, "safest place, total crime"), (5, "")],
        "question_id bigint, text string")
    got = {r.question_id: r for r in questions.extract_question_params(q).collect()}
    assert (got[1].topic, got[1].year, got[1].direction) == ("kidnapping", 2020, "highest")
    assert got[2].trend and got[2].topic == "domestic_violence" and got[2].year is None
    assert got[3].comparison and got[3].topic is None
    assert (got[4].topic, got[4].direction) == ("total_crime", "lowest")
    loose = {r.question_id: r.topic for r in questions.extract_question_params(q, substring=True).collect()}
    assert loose[3] == "rape"


def test_answers(spark):
    panel = spark.createDataFrame([("a", 2001, 1), ("b", 2001, 3), ("a", 2002, 2), ("b", 2002, 6)],
                                  "state string, year int, dv bigint")
    q = spark.createDataFrame([(1, "trend of domestic violence"), (2, "worst domestic violence"), (3, "weather"),
                               (4, "domestic violence in 1999")], "question_id bigint, text string")
    out = questions.answer_questions(questions.extract_question_params(q), panel, "state", "year", ["dv"],
                                     {"domestic_violence": "dv"}).collect()
    by = {i: sorted((r for r in out if r.question_id == i), key=lambda r: r.place or 0) for i in (1, 2, 3, 4)}
    assert by[1][0].value == pytest.approx(100.0)
    assert by[1][0].answer == "Trend Analysis for dv: total change 100.00%, highest in 2002, lowest in 2001"
    assert [(r.entity, r.value) for r in by[2]] == [("b", 6.0), ("a", 2.0)]
    assert by[3][0].answer == NO_ANSWER and by[4][0].answer == NO_ANSWER


def test_entity_clusters(spark):
    rows = [(f"S{i}", y, 10 * (1 + i % 2) * 50 ** (i % 2) + y % 3, 5 + i % 2 * 400 + i) for i in range(12) for y in (2001, 2002)]
    out = entity_clusters(spark.createDataFrame(rows, "e string, y int, a bigint, b bigint"), "e", ["a", "b"], range(2, 5))
    members = out.members.collect()
    assert len(members) == 12 and {r.cluster for r in members} == {0, 1}
    assert sum(r["size"] for r in out.profile.collect()) == 12
