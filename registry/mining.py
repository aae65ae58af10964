"""Clustering, projection, linkage, questions and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.operators import clean, cluster, divisive, linkage, logistic, metrics, panel, questions, similar
from panelspark.operators.ordering import position
from panelspark.plans.entities import entity_clusters as cluster_entities, prepare_entities as prepare
from panelspark.plans.text import analyse_texts as analyse, classify_texts as classify
from registry.book import query
from registry.sql import INDEX, STOP_WORDS
from registry.tables import (EVENT_PANEL, EVENT_TYPES, MEASURES, ORDER_PANEL, ROW_TOTAL, event_panel,
                             order_panel, six, table)
from registry.text import benchmark, documents, index, spelling_vocabulary

WIDTH = 64
DIMENSIONS = [f"e{i}" for i in range(WIDTH)]


def scaled_panel(spark, d):
    return clean.standardise(order_panel(spark, d), MEASURES)


SCALED = ORDER_PANEL + ", z AS (SELECT entity, period, " + ", ".join(
    f"({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () AS {m}" for m in MEASURES) + " FROM panel)"
SEEDED = SCALED + ", s AS (SELECT row_number() OVER (ORDER BY period, entity) - 1 AS i, * FROM z " \
    "QUALIFY i < 3), " \
    "dist AS (SELECT z.*, s.i, " + " + ".join(f"(z.{m} - s.{m}) ** 2" for m in MEASURES) + \
    " AS dd FROM z, s), assigned AS (SELECT entity, period, " + ", ".join(MEASURES) + \
    ", CAST(i AS INTEGER) AS cluster FROM dist QUALIFY row_number() OVER " \
    "(PARTITION BY entity, period ORDER BY dd, i) = 1) "


def _seeds(z):
    return cluster.seed_rows(z, [F.col("period"), F.col("entity")], MEASURES, 3)


@query("WITH" + SEEDED + "SELECT entity, period, cluster FROM assigned")
def nearest_centroid(spark, d):
    z = scaled_panel(spark, d)
    return cluster.nearest_centroid(z, MEASURES, _seeds(z)).select("entity", "period", "cluster")


@query("WITH" + SEEDED + "SELECT cluster, " + ", ".join(
    f"round(avg({m}), 6) + 0.0 AS {m}" for m in MEASURES) + " FROM assigned GROUP BY cluster")
def lloyd_step(spark, d):
    z = scaled_panel(spark, d)
    out = cluster.lloyd_step(z, MEASURES, _seeds(z))
    return clean.replace_columns(out, {m: six(m) for m in MEASURES})


@query()
def kmeans_lloyd(spark, d):
    out, _ = cluster.kmeans_lloyd(scaled_panel(spark, d), MEASURES, ["entity", "period"], 4)
    return out.select("entity", "period", "cluster")


def _lloyd_sql(steps):
    """Lloyd's iterations from the first three rows, written out step by step."""
    sql, centres = "WITH" + SCALED + ", c0 AS (SELECT row_number() OVER (ORDER BY period, entity) - 1 AS i, " + ", ".join(
        MEASURES) + " FROM z QUALIFY i < 3)", "c0"
    near = lambda c: ("SELECT z.*, c.i FROM z, " + c + " c QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY "
                      + " + ".join(f"(z.{m} - c.{m}) ** 2" for m in MEASURES) + ", c.i) = 1")
    for n in range(1, steps + 1):
        sql += f", a{n} AS ({near(centres)}), c{n} AS (SELECT o.i, " + ", ".join(
            f"coalesce(any_value(m.{m}), any_value(o.{m})) AS {m}" for m in MEASURES) + f" FROM {centres} o LEFT JOIN (SELECT i, " + ", ".join(
            f"avg({m}) AS {m}" for m in MEASURES) + f" FROM a{n} GROUP BY i) m ON m.i = o.i GROUP BY o.i)"
        centres = f"c{n}"
    return sql + f" SELECT entity, period, CAST(i AS INTEGER) AS cluster FROM ({near(centres)})"


@query(_lloyd_sql(4))
def kmeans_lloyd_from_seeds(spark, d):
    """Four iterations from given seeds."""
    z = scaled_panel(spark, d)
    out, _ = cluster.kmeans_lloyd(z, MEASURES, ["entity", "period"], 3, max_iter=4, tol=0.0, seeds=_seeds(z))
    return out.select("entity", "period", "cluster")


def _kmeans_sql(start, ks, steps, out):
    """k-means for several k from ``pts(id, x)``: hashed draws one by one, then the iterations written out."""
    most = max(ks)
    near = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) ** 2))".format
    u = "((CAST('0x' || substr(md5('42:' || {0} || ':' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)".format
    sql = start + f""", seeds AS (
    SELECT 1 AS step, [arg_min(x, struct_pack(r := -ln({u("'0'")}), id := id))] AS chosen FROM pts
    UNION ALL SELECT step + 1, list_append(any_value(chosen), arg_min(x, struct_pack(r := -ln({u("step")}) / w, id := id))) FROM (
      SELECT step, chosen, id, x, list_min(list_transform(chosen, lambda c: {near("x", "c")})) AS w FROM seeds, pts WHERE step < {most})
    WHERE w > 0 GROUP BY step),
  c0 AS MATERIALIZED (SELECT k, i, chosen[i] AS c FROM (SELECT arg_max(chosen, step) AS chosen FROM seeds),
    (SELECT unnest({list(ks)}) AS k), generate_series(1, {most}) AS g(i) WHERE i <= k)"""
    own = lambda n: f"SELECT p.id, any_value(p.x) AS x, k, arg_min(i, struct_pack(d := {near('p.x', 'c')}, i := i)) AS i, min({near('p.x', 'c')}) AS square FROM pts p, c{n} GROUP BY p.id, k"
    for n in range(steps):
        sql += f""", a{n} AS MATERIALIZED ({own(n)}), c{n + 1} AS MATERIALIZED (SELECT o.k, o.i, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN (
    SELECT k, i, list(v ORDER BY j) AS c FROM (SELECT k, i, j, avg(x[j]) AS v FROM a{n}, generate_series(1, (SELECT max(len(x)) FROM pts)) AS g(j)
      GROUP BY ALL) GROUP BY k, i) m ON m.k = o.k AND m.i = o.i)"""
    return sql + f""", own AS MATERIALIZED ({own(steps)}),
  size AS (SELECT k, i, count(*) AS n FROM own GROUP BY ALL),
  apart AS (SELECT a.k, a.id, a.i AS mine, b.i, sum({near('a.x', 'b.x')}) AS t FROM own a JOIN own b ON a.k = b.k GROUP BY ALL),
  ab AS (SELECT k, id, max(CASE WHEN mine = i AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN mine <> i THEN t / n END) AS b
    FROM apart JOIN size USING (k, i) GROUP BY ALL),
  sil AS (SELECT k, avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS silhouette FROM ab GROUP BY k),
  curve AS (SELECT k, sum(square) AS inertia, any_value(silhouette) AS silhouette FROM own JOIN sil USING (k) GROUP BY k) {out}"""


@query(_kmeans_sql("WITH RECURSIVE pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)", [4], 5,
                   "SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS cluster FROM own"))
def kmeans(spark, d):
    """Five iterations from drawn seeds."""
    out, _ = cluster.kmeans(vectors(spark, d), "vec_id", DIMENSIONS, 4, max_iter=5, tol=0.0)
    return out.select("vec_id", "cluster")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMENSIONS)])


@query("""WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  n AS (SELECT label, count(*) AS n FROM p GROUP BY label),
  s AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS t FROM p a, p b GROUP BY ALL),
  ab AS (SELECT vec_id, max(CASE WHEN own = s.label THEN t / (n - 1) END) AS a,
    min(CASE WHEN own <> s.label THEN t / n END) AS b FROM s JOIN n USING (label) GROUP BY vec_id)
  SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM ab""")
def silhouette(spark, d):
    points = vectors(spark, d).withColumnRenamed("label", "cluster")
    return cluster.silhouette(points, "vec_id", DIMENSIONS).select(six("silhouette").alias("silhouette"))


MEANS = "WITH RECURSIVE" + ORDER_PANEL + ", e AS (SELECT entity, " + ", ".join(f"avg({m}) AS {m}" for m in MEASURES) + \
    " FROM panel GROUP BY entity), pts AS (SELECT row_number() OVER (ORDER BY entity) AS id, [" + ", ".join(
        f"({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER ()" for m in MEASURES) + "] AS x FROM e)"


@query(_kmeans_sql(MEANS, range(2, 11), 10, "SELECT CAST(k AS INTEGER) AS k, round(inertia, 6) AS inertia, "
                   "round(silhouette, 6) + 0.0 AS silhouette, CAST(NULL AS VARCHAR) AS reason FROM curve"))
def sweep_k(spark, d):
    points = position(clean.standardise(panel.mean_by_entity(order_panel(spark, d), "entity", MEASURES), MEASURES),
                      [F.col("entity")], "row")
    curve = cluster.sweep_k(points, "row", MEASURES, max_iter=10, tol=0.0)
    return clean.replace_columns(curve, {c: six(c) for c in ("inertia", "silhouette")})


CURVE = "WITH RECURSIVE" + SCALED + ", pts AS (SELECT row_number() OVER (ORDER BY entity, period) AS id, [" + ", ".join(MEASURES) + "] AS x FROM z)"
BEND = """SELECT {0} FROM (SELECT *, 1 - (inertia - min(inertia) OVER ()) / nullif(max(inertia) OVER () - min(inertia) OVER (), 0)
    - (k - min(k) OVER ()) / nullif(max(k) OVER () - min(k) OVER (), 0) AS gap FROM curve)"""


def _panel_curve(spark, d):
    points = position(scaled_panel(spark, d), [F.col("entity"), F.col("period")], "row")
    return cluster.sweep_k(points, "row", MEASURES, range(1, 21), max_iter=10, tol=0.0)


@query(_kmeans_sql(CURVE, range(1, 21), 10, BEND.format("CAST(arg_max(k, struct_pack(g := gap, k := -k)) AS INTEGER) AS k")))
def knee(spark, d):
    """The bend of the inertia of 1 to 20 clusters of the scaled panel."""
    return cluster.knee(_panel_curve(spark, d))


@query(_kmeans_sql(CURVE, range(1, 21), 10, BEND.format(
    "CAST(arg_max(k, struct_pack(g := gap, k := -k)) AS INTEGER) AS knee_k, CAST(arg_max(k, struct_pack(s := silhouette, k := -k)) AS INTEGER) "
    "AS silhouette_k, CAST(coalesce(arg_max(k, struct_pack(g := gap, k := -k)), 5) AS INTEGER) AS k")))
def choose_k(spark, d):
    """k by the knee of the inertia and by the silhouette, over the scaled panel."""
    return cluster.choose_k(_panel_curve(spark, d))


# power iteration on the covariances of the standardised coordinates; each axis is taken out before the next is sought
_AXIS = """p{0} AS (SELECT 0 AS step, list_transform(range(1, 65), lambda i: 1.0::DOUBLE / i / sqrt(list_sum(list_transform(range(1, 65), lambda q: 1.0::DOUBLE / q / q)))) AS v,
    1.0::DOUBLE AS moved UNION ALL SELECT step + 1, list_transform(w, lambda x: x / size), list_max(list_transform(list_zip(v, w), lambda z: abs(z[2] / size - z[1]))) FROM (
    SELECT *, sqrt(list_dot_product(w, w)) AS size FROM (SELECT step, v, list_transform(g, lambda r: list_dot_product(r, v)) AS w FROM p{0}, g{0}
      WHERE step < 5000 AND moved > 1e-12))),
  v{0} AS (SELECT arg_max(v, step) AS v FROM p{0}),
  l{0} AS (SELECT v, list_dot_product(v, list_transform(g, lambda r: list_dot_product(r, v))) AS size FROM v{0}, g{0}),
  a{0} AS (SELECT list_transform(v, lambda x: x * CASE WHEN v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))] >= 0
    THEN 1 ELSE -1 END) AS axis FROM v{0})"""
COMPONENTS = """WITH RECURSIVE f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
  s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM f GROUP BY j),
  e AS (SELECT vec_id, label, j, (x - m) / sd AS x FROM f JOIN s USING (j)),
  z AS (SELECT vec_id, label, list(x ORDER BY j) AS x FROM e GROUP BY ALL),
  c AS (SELECT a.j AS i, b.j, covar_pop(a.x, b.x) AS c FROM e a JOIN e b USING (vec_id) GROUP BY ALL),
  g1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)), """ + _AXIS.format(1) + """,
  g2 AS MATERIALIZED (SELECT list_transform(g, lambda r, i: list_transform(r, lambda c, j: c - size * v[i] * v[j])) AS g FROM g1, l1), """ + _AXIS.format(2) + """,
  pc AS (SELECT vec_id, label, list_dot_product(x, a1.axis) AS pc1, list_dot_product(x, a2.axis) AS pc2 FROM z, a1, a2)"""


def _components(spark, d):
    return cluster.pca2(clean.standardise(vectors(spark, d), DIMENSIONS), DIMENSIONS)


@query(COMPONENTS + " SELECT vec_id, label, round(pc1, 6) + 0.0 AS pc1, round(pc2, 6) + 0.0 AS pc2 FROM pc")
def pca2(spark, d):
    return _components(spark, d).select("vec_id", "label", six("pc1").alias("pc1"), six("pc2").alias("pc2"))


@query(COMPONENTS + " SELECT label AS cluster, vec_id, round(pc1, 6) + 0.0 AS pc1, CAST(row_number() OVER (PARTITION BY label "
       "ORDER BY pc1 DESC, vec_id) AS INTEGER) AS place FROM pc QUALIFY place <= 3")
def top_by_component(spark, d):
    """Labels of the vectors as clusters; the three vectors of each with the largest first component."""
    out = _components(spark, d).withColumnRenamed("label", "cluster")
    return cluster.top_by_component(out, ["vec_id"], 3).select("cluster", "vec_id", six("pc1").alias("pc1"), "place")


@query("SELECT label AS cluster, vec_id FROM embeddings QUALIFY row_number() OVER "
       "(PARTITION BY label ORDER BY CAST(embedding[1] AS DOUBLE) DESC, vec_id) <= 3")
def top_by_given_component(spark, d):
    """The same with the first coordinate as the component."""
    out = vectors(spark, d).select("vec_id", F.col("label").alias("cluster"), F.col("e0").alias("pc1"))
    return cluster.top_by_component(out, ["vec_id"], 3).select("cluster", "vec_id")


REGIONS = ", r AS (SELECT n_regionkey AS cluster, panel.* FROM panel JOIN nation ON n_name = entity) "


def _by_region(spark, d, rows):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.col("n_regionkey").alias("cluster"))
    return rows.join(nation, "entity")


@query("WITH" + ORDER_PANEL + REGIONS + f"""SELECT cluster, entity, CAST(sum({ROW_TOTAL}) AS BIGINT) AS total,
   row_number() OVER (PARTITION BY cluster ORDER BY sum({ROW_TOTAL}) DESC, entity) AS place
   FROM r GROUP BY cluster, entity""")
def cluster_members(spark, d):
    totals = panel.total_by_entity(order_panel(spark, d), "entity", MEASURES)
    return cluster.cluster_members(_by_region(spark, d, totals), "entity")


@query("WITH" + ORDER_PANEL + REGIONS + """, e AS (SELECT cluster, entity, """ + ", ".join(
    f"avg({m}) AS {m}" for m in MEASURES) + " FROM r GROUP BY ALL), z AS (SELECT cluster, " + ", ".join(
    f"({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () AS {m}" for m in MEASURES) + """ FROM e)
  SELECT cluster, count(*) AS size, coalesce(nullif(concat_ws(', ', """ + ", ".join(
    f"CASE WHEN round(avg({m}), 9) > 0 THEN '{m}' END" for m in MEASURES) +
    "), ''), 'No significantly high crime rates') AS dominant FROM z GROUP BY cluster")
def cluster_profile(spark, d):
    means = panel.mean_by_entity(order_panel(spark, d), "entity", MEASURES)
    rows = clean.standardise(_by_region(spark, d, means), MEASURES)
    return cluster.cluster_profile(rows, MEASURES)


# ---------------------------------------------- classifiers on numbers

ROW_ID = "CAST(substr(entity, 8) AS BIGINT) * 10000 + period"


def _numbered(spark, d):
    return order_panel(spark, d).select(
        (F.substring("entity", 8, 9).cast("bigint") * 10_000 + F.col("period")).alias("id"),
        F.col("entity").alias("label"), "period", C.row_total(MEASURES).alias("total"))


@query("WITH" + ORDER_PANEL + f""", x AS (SELECT {ROW_ID} AS id, entity AS label, period, {ROW_TOTAL} AS total FROM panel),
  held AS (SELECT *, CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000 AS test FROM x),
  near AS (SELECT q.id AS query_id, t.label FROM held q, held t WHERE q.test AND NOT t.test
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY
      round(sqrt((q.period - t.period) ** 2 + (q.total - t.total) ** 2), 9), t.id) <= 3),
  v AS (SELECT query_id, label, count(*) AS votes FROM near GROUP BY ALL)
  SELECT query_id, label, votes, round(votes / 3, 6) AS share FROM v
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1""")
def knn_numeric(spark, d):
    train, test = metrics.split_train_test(_numbered(spark, d), "id")
    out = similar.knn_numeric(train, test, ["period", "total"], 3)
    return out.withColumn("share", six("share"))


# softmax regression on period and total, written out as one recursive step; a state holds the weights of all labels
REGRESSION = "WITH RECURSIVE" + ORDER_PANEL + f""", x AS (SELECT {ROW_ID} AS id, entity AS label, period, {ROW_TOTAL} AS total FROM panel),
  held AS (SELECT *, CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000 AS test FROM x),
  sc AS MATERIALIZED (SELECT count(*) AS n, avg(period) AS m1, stddev_pop(period) AS s1, avg(total) AS m2, stddev_pop(total) AS s2 FROM held WHERE NOT test),
  codes AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT label FROM held WHERE NOT test)),
  z AS MATERIALIZED (SELECT c.i AS y, [(period - m1) / s1, (total - m2) / s2, 1.0::DOUBLE] AS x FROM held JOIN codes c USING (label), sc WHERE NOT test),
  pace AS MATERIALIZED (SELECT n, [1 / (n * s1 * s1), 1 / (n * s2 * s2), 0.0::DOUBLE] AS pen, 1 / (1.5 + greatest(1 / (n * s1 * s1), 1 / (n * s2 * s2))) AS h FROM sc),
  fit AS (
    SELECT 0 AS step, list([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS w, list([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS ahead FROM codes
    UNION ALL
    SELECT step + 1, list(new ORDER BY i), list(list_transform(list_zip(new, old), lambda q: q[1] + (step + 1) / (step + 4.0::DOUBLE) * (q[1] - q[2])) ORDER BY i)
    FROM (SELECT step, i, any_value(old) AS old, list_transform([1, 2, 3], lambda j: any_value(a)[j] - any_value(h) * (
        [sum(r * x[1]), sum(r * x[2]), sum(r * x[3])][j] / any_value(n) + any_value(pen)[j] * any_value(a)[j])) AS new
      FROM (SELECT step, x, g.i, w[g.i] AS old, ahead[g.i] AS a, h, n, pen,
          exp(l[g.i] - list_max(l)) / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) - CASE WHEN y = g.i THEN 1 ELSE 0 END AS r
        FROM (SELECT step, x, y, w, ahead, list_transform(ahead, lambda c: list_dot_product(c, x)) AS l FROM fit, z WHERE step < 30), pace, codes g)
      GROUP BY step, i) GROUP BY step),
  model AS MATERIALIZED (SELECT label, [v[1] / s1, v[2] / s2, v[3] - v[1] / s1 * m1 - v[2] / s2 * m2] AS w
    FROM (SELECT label, i, (SELECT arg_max(w, step) FROM fit)[i] AS v FROM codes), sc)"""


def _regression(spark, d):
    train, test = metrics.split_train_test(_numbered(spark, d), "id")
    return logistic.fit_logistic(train, ["period", "total"], "label", steps=30), test


@query(REGRESSION + """ SELECT label, round(w[1], 6) + 0.0 AS period, round(w[2], 6) + 0.0 AS total, round(w[3], 6) + 0.0 AS intercept FROM model""")
def logistic_weights(spark, d):
    """The weights after thirty steps."""
    model, _ = _regression(spark, d)
    return model.select("label", *[six(F.col("weights")[i]).alias(c) for i, c in enumerate(["period", "total", "intercept"])])


@query(REGRESSION + """, p AS (SELECT id, held.label AS actual, arg_max(m.label, struct_pack(s := list_dot_product(w, [period, total, 1.0::DOUBLE]),
     a := -c.i)) AS predicted FROM held, model m JOIN codes c USING (label) WHERE test GROUP BY id, held.label),
   labels2 AS (SELECT actual AS c FROM p UNION SELECT predicted FROM p),
   per AS (SELECT c, count(*) FILTER (WHERE actual = c) AS sup, count(*) FILTER (WHERE predicted = c) AS pre,
     count(*) FILTER (WHERE actual = c AND predicted = c) AS tp FROM labels2, p GROUP BY c),
   r AS (SELECT sup, tp, coalesce(tp / nullif(pre, 0), 0) AS pr, coalesce(tp / nullif(sup, 0), 0) AS re FROM per)
   SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(pr * sup) / sum(sup), 6) AS precision,
     round(sum(re * sup) / sum(sup), 6) AS recall,
     round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * sup) / sum(sup), 6) AS f1 FROM r""")
def logistic_classify(spark, d):
    model, test = _regression(spark, d)
    out = metrics.classification_metrics(logistic.predict_logistic(test, model, ["period", "total"]).select("label", "predicted"))
    return out.select([six(c).alias(c) for c in out.columns])


# ---------------------------------------------------------------- linkage

CUT = 0.6

PAIRS = "WITH RECURSIVE " + INDEX + f""", pairs AS (SELECT a, b, distance FROM (
    SELECT x.doc_id AS a, y.doc_id AS b,
      round(sqrt(greatest(2 - 2 * sum(x.weight * y.weight), 0)), 9) AS distance
    FROM post x JOIN post y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL) WHERE distance <= {CUT})"""


@query(PAIRS + """, bags AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(toks)) AS rep FROM tok)
   SELECT a, b, round(distance, 6) AS distance FROM pairs
   WHERE a IN (SELECT rep FROM bags) AND b IN (SELECT rep FROM bags)""")
def similar_pairs(spark, d):
    return linkage.similar_pairs(index(spark, d), CUT).withColumn("distance", six("distance"))


@query(PAIRS + """, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
   reach AS (SELECT doc_id AS node, doc_id AS other FROM documents
     UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
   empty_bag AS (SELECT min(doc_id) AS rep FROM tok WHERE len(toks) = 0)
   SELECT node AS doc_id, CASE WHEN len(toks) = 0 THEN (SELECT rep FROM empty_bag) ELSE min(other) END AS cluster
   FROM reach JOIN tok ON doc_id = node GROUP BY node, toks""")
def single_link_clusters(spark, d):
    return linkage.single_link_clusters(index(spark, d), CUT)


# Prim's algorithm: ``open`` holds for every vector outside the tree its shortest way in, ``best`` the one taken
TREE = "WITH RECURSIVE " + INDEX + """, bags AS (SELECT doc_id, len(toks) = 0 AS bare, min(doc_id) OVER (PARTITION BY list_sort(toks)) AS rep FROM tok),
  reps AS (SELECT rep AS id, row_number() OVER (ORDER BY rep) AS i, any_value(bare) AS bare FROM bags GROUP BY rep),
  dots AS (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.weight * y.weight), 9) AS dot FROM post x JOIN post y ON x.term = y.term
    SEMI JOIN reps r ON r.id = x.doc_id SEMI JOIN reps q ON q.id = y.doc_id GROUP BY ALL),
  far AS (SELECT x.i, list(CASE WHEN x.bare OR y.bare THEN 1.0::DOUBLE ELSE round(sqrt(greatest(2 - 2 * coalesce(dot, 0), 0)), 9) END ORDER BY y.i) AS d
    FROM reps x CROSS JOIN reps y LEFT JOIN dots ON dots.a = x.id AND dots.b = y.id GROUP BY x.i),
  prim AS (
    SELECT 0 AS step, CAST(NULL AS STRUCT(d DOUBLE, a BIGINT, b BIGINT, i BIGINT)) AS best, list_transform(d, lambda x, i: CASE WHEN i = 1 THEN NULL
      ELSE struct_pack(d := x, a := 1::BIGINT, b := i::BIGINT, i := i::BIGINT) END) AS open FROM far WHERE far.i = 1
    UNION ALL
    SELECT step + 1, next, list_transform(list_zip(open, far.d), lambda z, i: CASE WHEN z[1] IS NULL OR i = next.i THEN NULL
      WHEN z[2] < z[1].d OR (z[2] = z[1].d AND (least(i, next.i) < z[1].a OR (least(i, next.i) = z[1].a AND greatest(i, next.i) < z[1].b)))
      THEN struct_pack(d := z[2], a := least(i, next.i)::BIGINT, b := greatest(i, next.i)::BIGINT, i := i::BIGINT) ELSE z[1] END)
    FROM (SELECT step, open, list_min(open) AS next FROM prim) JOIN far ON far.i = next.i)
  SELECT x.id AS a, y.id AS b, round(best.d, 6) AS distance FROM prim JOIN reps x ON x.i = best.a JOIN reps y ON y.i = best.b
  UNION ALL SELECT rep, doc_id, 0.0 FROM bags WHERE rep <> doc_id"""


@query(TREE)
def single_link_merges(spark, d):
    """The whole tree."""
    return linkage.single_link_tree(index(spark, d)).withColumn("distance", six("distance"))


def _halves_sql(rounds):
    """Two halves of all vectors: the seeds, then the rounds written out."""
    def dots(name, table, cols):
        return f"{name} AS MATERIALIZED (SELECT id, any_value(copies) AS copies, " + ", ".join(
            f"round(sum(weight * coalesce({c}, 0)), 9) AS {c}" for c in cols) + f" FROM own LEFT JOIN {table} USING (term) GROUP BY id)"
    sql = "WITH " + INDEX + """, bags AS (SELECT doc_id, min(doc_id) OVER w AS rep, count(*) OVER w AS copies FROM tok WINDOW w AS (PARTITION BY list_sort(toks))),
  own AS MATERIALIZED (SELECT doc_id AS id, copies, term, weight FROM post JOIN bags USING (doc_id) WHERE doc_id = rep),
  w0 AS (SELECT term, s / sqrt(sum(s * s) OVER ()) AS c0 FROM (SELECT term, sum(copies * weight) AS s FROM own GROUP BY term)),
  """ + dots("d0", "w0", ["c0"]) + """, first AS (SELECT term, weight AS c0 FROM own WHERE id = (SELECT arg_min(id, struct_pack(c := c0, i := id)) FROM d0)),
  """ + dots("d1", "first", ["c0"]) + """, second AS (SELECT term, weight AS c1 FROM own WHERE id = (SELECT arg_min(id, struct_pack(c := c0, i := id)) FROM d1)),
  both_seeds AS (SELECT * FROM first FULL JOIN second USING (term)), """ + dots("s0", "both_seeds", ["c0", "c1"])
    for n in range(1, rounds + 1):
        sql += f""",
  t{n} AS (SELECT term, sum(CASE WHEN c1 > c0 THEN 0 ELSE own.copies * weight END) AS a, sum(CASE WHEN c1 > c0 THEN own.copies * weight ELSE 0 END) AS b
    FROM own JOIN s{n - 1} USING (id) GROUP BY term),
  m{n} AS (SELECT term, a / sqrt(sum(a * a) OVER ()) AS c0, b / sqrt(sum(b * b) OVER ()) AS c1 FROM t{n}), """ + dots(f"s{n}", f"m{n}", ["c0", "c1"])
    return sql + f""" SELECT bags.doc_id, CASE WHEN c0 IS NULL THEN -1 WHEN c1 > c0 THEN 1 ELSE 0 END AS cluster FROM bags LEFT JOIN s{rounds} ON id = rep"""


@query(_halves_sql(divisive.ROUNDS_PER_SPLIT))
def divisive_halves(spark, d):
    """The first split of the tree."""
    return divisive.divisive_clusters(index(spark, d), 2)


@query()
def divisive_clusters(spark, d):
    return divisive.divisive_clusters(index(spark, d), 4)


@query()
def divisive_sweep(spark, d):
    return divisive.divisive_sweep(index(spark, d))


# -------------------------------------------------------------- questions

TOPICS = {
    "rush": ["urgent", "rush"],
    "high": ["high priority", "high orders"],
    "medium": ["medium"],
    "low": ["low priority", "low orders"],
    "total": ["total orders", "all orders"],
}
MEASURE_OF = {"rush": "urgent", "high": "high", "medium": "medium", "low": "low", "total": "total"}

ASKED = """asked AS (SELECT c_custkey AS question_id, CASE c_custkey % 7
    WHEN 0 THEN 'Which nation had the highest urgent orders in ' || (1994 + c_custkey % 9) || '?'
    WHEN 1 THEN 'Show me the trend of medium orders over the years'
    WHEN 2 THEN 'Compare low orders across nations in ' || (1994 + c_custkey % 9)
    WHEN 3 THEN 'What is the safest nation for high priority goods?'
    WHEN 4 THEN 'Which nations have the most total orders?'
    WHEN 5 THEN 'How is the weather in ' || lower(c_mktsegment) || '?'
    ELSE 'The least rush orders, in ' || (1994 + c_custkey % 9) || ', against all' END AS text FROM customer)"""


def asked(spark, d):
    """One question per customer, written from its row."""
    year = (1994 + F.col("c_custkey") % 9).cast("string")
    kind = F.col("c_custkey") % 7
    text = (F.when(kind == 0, F.concat(F.lit("Which nation had the highest urgent orders in "), year, F.lit("?")))
            .when(kind == 1, F.lit("Show me the trend of medium orders over the years"))
            .when(kind == 2, F.concat(F.lit("Compare low orders across nations in "), year))
            .when(kind == 3, F.lit("What is the safest nation for high priority goods?"))
            .when(kind == 4, F.lit("Which nations have the most total orders?"))
            .when(kind == 5, F.concat(F.lit("How is the weather in "), F.lower("c_mktsegment"), F.lit("?")))
            .otherwise(F.concat(F.lit("The least rush orders, in "), year, F.lit(", against all"))))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), text.alias("text"))


def _like(words):
    return " OR ".join(f"contains(plain, ' {w} ')" for w in words)


def _has(words):
    return "list_has_any(words, [" + ", ".join(f"'{w}'" for w in words) + "])"


PARSED = ASKED + r""", cut AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(text),
     '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '') AS words FROM asked),
  plain AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS plain FROM cut),
  parsed AS (SELECT question_id, text, CASE """ + " ".join(
    f"WHEN {_like(w)} THEN '{t}'" for t, w in TOPICS.items()) + r""" END AS topic,
  TRY_CAST(regexp_extract(text, '\b(19|20)\d{2}\b') AS INTEGER) AS year,
  """ + _has(questions.TREND_WORDS) + " AS trend, " + _has(questions.COMPARISON_WORDS) + """ AS comparison,
  CASE WHEN """ + _has(questions.HIGHEST_WORDS) + " THEN 'highest' WHEN " + _has(questions.LOWEST_WORDS) + \
    " THEN 'lowest' END AS direction FROM plain)"


@query("WITH " + PARSED + "SELECT * FROM parsed")
def question_params(spark, d):
    return questions.extract_question_params(asked(spark, d), TOPICS)


NAMES = [*MEASURES, "total"]


def _answers_sql():
    long = " UNION ALL ".join(f"SELECT entity, period, '{m}' AS measure, {m} AS value FROM named" for m in NAMES)
    known = " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in MEASURE_OF.items())
    return "WITH " + PARSED + "," + ORDER_PANEL + f""", named AS (SELECT *, {ROW_TOTAL} AS total FROM panel),
  long AS ({long}),
  a AS (SELECT question_id, trend, comparison, direction, CASE topic {known} END AS measure, year FROM parsed),
  r AS (SELECT question_id, measure, CASE WHEN measure IS NULL THEN 'none' WHEN trend THEN 'trend'
    WHEN comparison THEN 'comparison' ELSE 'statistics' END AS route, direction,
    coalesce(year, (SELECT max(period) FROM panel)) AS y FROM a),
  sums AS (SELECT measure, period, sum(value) AS v FROM long GROUP BY ALL),
  tr AS (SELECT measure, (last(v ORDER BY period) - first(v ORDER BY period)) * 100.0::DOUBLE
      / nullif(first(v ORDER BY period), 0) AS change, (list(period ORDER BY v DESC, period))[1] AS hi,
      (list(period ORDER BY v, period))[1] AS lo FROM sums GROUP BY measure),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY measure, period ORDER BY value DESC, entity) AS down,
      row_number() OVER (PARTITION BY measure, period ORDER BY value, entity) AS up,
      sum(value) OVER (PARTITION BY measure, period) AS s, avg(value) OVER (PARTITION BY measure, period) AS m FROM long)
  SELECT question_id, route, r.measure, CAST(NULL AS INTEGER) AS period, CAST(NULL AS BIGINT) AS place,
    CAST(NULL AS VARCHAR) AS entity, round(change, 6) AS value,
    printf('Trend Analysis for %s: total change %.2f%%, highest in %d, lowest in %d', r.measure, change, hi, lo) AS answer
  FROM r JOIN tr USING (measure) WHERE route = 'trend'
  UNION ALL SELECT question_id, route, r.measure, y, down, entity, CAST(value AS DOUBLE), NULL
  FROM r JOIN ranked k ON k.measure = r.measure AND k.period = y WHERE route = 'comparison'
  UNION ALL SELECT question_id, route, r.measure, y, CASE WHEN direction = 'lowest' THEN up ELSE down END, entity,
    CAST(value AS DOUBLE), 'Statistics for ' || r.measure || ': total cases ' || format('{{:,}}', CAST(s AS BIGINT))
      || ', average cases per entity ' || format('{{:,}}', CAST(round_even(m, 0) AS BIGINT))
  FROM r JOIN ranked k ON k.measure = r.measure AND k.period = y WHERE route = 'statistics'
    AND CASE WHEN direction = 'lowest' THEN up ELSE down END <= 5
  UNION ALL SELECT question_id, route, r.measure, CASE WHEN route IN ('comparison', 'statistics') THEN y END,
    NULL, NULL, NULL, 'I couldn''t find relevant information for your query.' FROM r
  WHERE route = 'none' OR (route <> 'trend' AND y NOT IN (SELECT period FROM panel))"""


@query(_answers_sql())
def answer_questions(spark, d):
    parsed = questions.extract_question_params(asked(spark, d), TOPICS)
    out = questions.answer_questions(parsed, order_panel(spark, d), "entity", "period", MEASURES, MEASURE_OF)
    return out.withColumn("value", six("value"))


@query("WITH " + PARSED + "," + ORDER_PANEL + f""", named AS (SELECT *, {ROW_TOTAL} AS total FROM panel),
  long AS (""" + " UNION ALL ".join(f"SELECT period, '{m}' AS measure, {m} AS value FROM named" for m in NAMES) + """),
  w AS (SELECT DISTINCT CASE topic """ + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in MEASURE_OF.items()) + """ END AS measure
    FROM parsed WHERE trend)
  SELECT measure, period, CAST(sum(value) AS BIGINT) AS value FROM long JOIN w USING (measure) GROUP BY ALL""")
def trend_series(spark, d):
    parsed = questions.extract_question_params(asked(spark, d), TOPICS)
    return questions.trend_series(parsed, order_panel(spark, d), "period", MEASURES, MEASURE_OF)


# ------------------------------------------------------------ whole plans

@query()
def classify_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text", "source", "n_chars")
    return classify(benchmark(spark, d), docs, index(spark, d), 5, ["source", "n_chars"], STOP_WORDS)


def _analysis(spark, d):
    catalogue = documents(spark, d).groupBy("label").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("documents"))
    return analyse(benchmark(spark, d), documents(spark, d), catalogue, spelling_vocabulary(spark, d), 5,
                   ["documents"], STOP_WORDS)


@query()
def analyse_texts(spark, d):
    return _analysis(spark, d).results


def _entities(spark, d):
    return cluster_entities(event_panel(spark, d), "entity", EVENT_TYPES)


@query()
def entity_clusters(spark, d):
    return _entities(spark, d).members


@query()
def entity_curve(spark, d):
    return _entities(spark, d).curve


@query()
def entity_profile(spark, d):
    return _entities(spark, d).profile


@query()
def analysis_terms(spark, d):
    """The list items of every predicted label."""
    return _analysis(spark, d).terms


LIMITS = ", ".join(f"quantile_cont({m}, 0.25) AS a_{m}, quantile_cont({m}, 0.75) AS b_{m}" for m in MEASURES)
CLIPPED = ", ".join(f"ln(1 + greatest(a_{m} - 1.5 * (b_{m} - a_{m}), least(b_{m} + 1.5 * (b_{m} - a_{m}), {m}))) AS {m}"
                    for m in MEASURES)


@query("WITH" + ORDER_PANEL + f", lim AS (SELECT {LIMITS} FROM panel), k AS (SELECT lower(trim(entity)) AS entity, {CLIPPED} "
       "FROM panel, lim), e AS (SELECT entity, " + ", ".join(f"avg({m}) AS {m}" for m in MEASURES) + " FROM k GROUP BY entity) "
       "SELECT entity, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in MEASURES) + f", round({ROW_TOTAL}, 6) + 0.0 AS total FROM e")
def prepare_entities(spark, d):
    """Keys in one spelling, clipped, log-scaled, averaged per entity."""
    out = prepare(order_panel(spark, d), "entity", MEASURES)
    return clean.replace_columns(out, {m: six(m) for m in [*MEASURES, "total"]})
