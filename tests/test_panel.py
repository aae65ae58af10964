import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.functions.fixed_values import NO_DOMINANT_MEASURE
from panelspark.operators import clean, panel
from panelspark.operators.joins import lookup, salted_join
from panelspark.operators.ordering import exact_quantiles, position
from panelspark.sources import tables as source

ROWS = [("A & B", 2001, 5, 1), ("A & B", 2002, 7, 0), ("c", 2001, 0, 0), ("c", 2002, 9, None),
        ("Dé", 2001, 100, 2), ("e", 2001, 5, 3)]


@pytest.fixture
def small(spark):
    return spark.createDataFrame(ROWS, "entity string, period int, x bigint, `K&A` bigint")


def test_read_panel_drops_row_id_and_keeps_nulls(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        ",State,Year,Rape,K&A\n0,A & N ISLANDS,2001,3,4\n1,Goa,unknown,5,\n", encoding="utf8")
    out = source.read_panel(spark, str(tmp_path), "State", "Year", ["Rape", "K&A"])
    assert out.columns == ["State", "Year", "Rape", "K&A"]
    assert sorted(tuple(r) for r in out.where("Year is not null").collect()) == [("A & N ISLANDS", 2001, 3, 4)]
    assert out.where("Year is null").select("`K&A`").first()[0] is None


def test_read_labelled_text_with_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('disease,symptoms,doctor\nflu,"a, ""b""\nc",\nflu,d,x\n', encoding="utf8")
    out = source.read_labelled_text(spark, str(tmp_path), "disease", "symptoms", ["doctor"])
    rows = [tuple(r) for r in out.orderBy("doc_id").collect()]
    assert [r[1:] for r in rows] == [("flu", 'a, "b"\nc', None), ("flu", "d", "x")]


def test_require_columns(small):
    with pytest.raises(ValueError, match="missing columns: z"):
        source.require_columns(small, ["x", "z"])


def test_keys(spark):
    df = spark.createDataFrame([("  D & N Haveli-x1y ",)], "s string")
    got = df.select(C.normalise_key("s"), C.normalise_key("s", "and"), C.normalise_key("s", "title"),
                    C.normalise_label(F.lit("  Flu  "))).first()
    assert tuple(got) == ("  d  n havelixy ", "d and n haveli-x1y", "D & N Haveli-X1Y", "flu")


def test_filters(small):
    assert panel.filter_panel(small, "entity", "period").count() == 6
    got = panel.filter_panel(small, "entity", "period", at=2002, of="c", measure="K&A").collect()
    assert [tuple(r) for r in got] == [("c", 2002, None)]
    with pytest.raises(ValueError):
        panel.filter_panel(small, "entity", "period", measure="nope")
    assert panel.at_period(small, "period").count() == 2
    assert panel.top_entities(small, "entity", "period", "nope", 2001).count() == 0


def test_ranking_breaks_ties_by_name(small):
    got = panel.rank_entities(small, "entity", ["x", "K&A"]).orderBy("place").collect()
    assert [(r.entity, r.total, r.place) for r in got] == [
        ("Dé", 102, 1), ("A & B", 13, 2), ("c", 9, 3), ("e", 8, 4)]


def test_trend_from_zero_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 4), ("a", 3, 4)], "e string, p int, m bigint")
    r = panel.trend(df, "p", ["m"]).first()
    assert (r.change_percent, r.highest_period, r.lowest_period) == (None, 2, 1)


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "a bigint, b bigint")
    assert [r.a for r in clean.standardise(df, ["a", "b"]).collect()] == [0.0, 0.0, 0.0]
    assert clean.minmax_by_column(df, ["a"]).first().a is None
    r = {(x.m1, x.m2): x.r for x in panel.correlation_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] is None and r[("b", "a")] is None and abs(r[("b", "b")] - 1) < 1e-12


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n).round(2))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    assert np.allclose(list(got)[1:], np.quantile(values, [0, .25, .5, .75, 1]))


def test_winsorise(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 1000]], "v bigint")
    assert sorted(r.v for r in clean.winsorise_iqr(df, ["v"]).collect()) == [1.0, 2.0, 3.0, 4.0, 7.0]


def test_position_within_a_group_that_holds_most_rows(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "big").otherwise("small").alias("g"),
                                 ((F.col("id") * 37) % 101).alias("v"), "id").repartition(7)
    got = position(df, [F.col("v").desc(), F.col("id")], "place", within=["g"]).collect()
    for g in ("big", "small"):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(1, len(rows) + 1))
        assert [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda t: (-t[0], t[1]))


def test_joins_keep_every_row_of_a_hot_key(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    want = sorted((r.id, r.v) for r in big.join(small, "k").collect())
    got = salted_join(big, small, ["k"], "id", rows_per_task=100)
    assert sorted((r.id, r.v) for r in got.collect()) == want
    attributes = small.join(big.groupBy("k").agg(F.count("*").alias("n")), "k")
    got = lookup(big, attributes, "k", "id", "n")
    assert sorted((r.id, r.v) for r in got.collect()) == want


def test_statistics_stay_in_the_jvm_without_cartesian(spark, small):
    plan = clean.standardise(small, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_fixed_message():
    assert NO_DOMINANT_MEASURE == "No significantly high crime rates"


def test_numbers_with_a_decimal_point_are_kept(spark, tmp_path):
    (tmp_path / "p.csv").write_text("State,Year,A\nx,2001.0,12.0\ny,2002,1.5\nz,n/a,3\n", encoding="utf8")
    out = source.read_panel(spark, str(tmp_path), "State", "Year", ["A"]).orderBy("State").collect()
    assert [tuple(r) for r in out] == [("x", 2001, 12), ("y", 2002, None), ("z", None, 3)]


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,text\n Flu\u00a0,first\n", encoding="utf8")
    (tmp_path / "b.csv").write_text("label,text\n" + "".join(f"Flu,row {i} of the longer file\n" for i in range(200)), encoding="utf8")
    out = source.read_labelled_text(spark, str(tmp_path), "label", "text").orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == list(range(1, 202))
    assert (out[0].label, out[0].text, out[1].text, out[200].text) == (
        "flu", "first", "row 0 of the longer file", "row 199 of the longer file")


def test_catalogue_labels_meet_in_one_spelling(spark, tmp_path):
    from panelspark.operators import similar
    (tmp_path / "c.csv").write_text("disease,doctor\nFlu ,x\nflu,y\n", encoding="utf8")
    catalogue = source.read_catalogue(spark, str(tmp_path), "disease", ["doctor"])
    asked = spark.createDataFrame([(1, "FLU"), (2, "gout")], "query_id int, label string")
    out = similar.attach_attributes(asked, catalogue, ["doctor"]).orderBy("query_id").collect()
    assert [(r.label, r.doctor, r.found) for r in out] == [("FLU", "x", True), ("gout", None, False)]
    assert [r.label for r in similar.missing_labels(asked, catalogue).collect()] == ["gout"]


def test_filter_arguments_are_spelt_like_the_column(spark):
    from panelspark.operators import panel
    rows = spark.createDataFrame([("A & B", 1, 2), ("a and b ", 2, 3), ("C", 1, 4)], "State string, Year int, m int")
    assert panel.filter_panel(rows, "State", "Year", of=" A and B").count() == 2
    assert panel.filter_panel(rows, "State", "Year", of="A & B", normalise=None).count() == 1


def test_numbering_moves_no_rows_and_goes_over_the_pieces_of_a_file(spark, tmp_path):
    for name, low, high in (("b", 300, 900), ("a", 0, 300)):
        (tmp_path / f"{name}.csv").write_text("label,text\n" + "".join(f"flu,row {i} with some words\n" for i in range(low, high)), encoding="utf8")
    pieces = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = source.read_labelled_text(spark, str(tmp_path), "label", "text", multi_line=False)
        got = sorted((r.doc_id, r.text) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", pieces)
    assert got == [(i + 1, f"row {i} with some words") for i in range(900)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_numbering_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("label,text\n", encoding="utf8")
    assert source.read_labelled_text(spark, str(tmp_path), "label", "text").collect() == []
