"""Panel queries: sources, cleaning, filters, totals, rankings, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.functions.fixed_values import MEASURE_NAMES
from panelspark.operators import clean, panel
from panelspark.session import work_root
from panelspark.sources import tables as source
from registry.book import query
from registry.tables import (CUSTOMER_PANEL, EVENT_PANEL, EVENT_TOTAL, EVENT_TYPES, MEASURES,
                             ORDER_PANEL, ROW_TOTAL, customer_panel, event_panel, order_panel,
                             six, table)

import uuid


# ---------------------------------------------------------------- sources

@query("WITH" + ORDER_PANEL + "SELECT * FROM panel")
def read_panel(spark, d):
    """The panel written as headered CSV with a row id and read back by role."""
    path = f"{work_root(spark)}/{uuid.uuid4().hex}/panel_csv"
    (order_panel(spark, d).withColumn("row_id", F.monotonically_increasing_id())
     .select("row_id", "entity", "period", *MEASURES).write.csv(path, header=True))
    return source.read_panel(spark, path, "entity", "period", MEASURES)


@query("SELECT doc_id, lang AS label, text, source FROM documents")
def read_labelled_text(spark, d):
    return source.read_labelled_text(spark, f"{d}/documents.parquet", "lang", "text",
                                     ["source"], "doc_id", fmt="parquet")


@query("""SELECT doc_id, lang AS label, text, source FROM documents""")
def read_labelled_text_csv(spark, d):
    """Texts with line breaks, quotes and commas through CSV and back."""
    path = f"{work_root(spark)}/{uuid.uuid4().hex}/text_csv"
    (table(spark, d, "documents").select("doc_id", "lang", "text", "source")
     .write.option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path, header=True))
    return source.read_labelled_text(spark, path, "lang", "text", ["source"], "doc_id")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS doc_id, lang AS label, source AS text, CAST(doc_id AS VARCHAR) AS written_id FROM documents")
def read_labelled_text_numbered(spark, d):
    """Files without an id column, cut into pieces: the place of a row is its id."""
    path = f"{work_root(spark)}/{uuid.uuid4().hex}/numbered_csv"
    (table(spark, d, "documents").select(F.col("doc_id").alias("written_id"), "lang", "source").repartitionByRange("written_id")
     .sortWithinPartitions("written_id").write.csv(path, header=True))
    return source.read_labelled_text(spark, path, "lang", "source", ["written_id"], multi_line=False)


@query("SELECT n_nationkey, n_name FROM nation")
def require_columns(spark, d):
    nation = source.require_columns(table(spark, d, "nation"), ["n_nationkey", "n_name"])
    return nation.select("n_nationkey", "n_name")


@query("SELECT c_name, c_nationkey, c_mktsegment FROM customer")
def drop_row_id(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("_c0"), "c_name", "c_nationkey", "c_mktsegment")
    return source.drop_row_id(rows)


# --------------------------------------------------------------- cleaning

@query("""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'n/a'
   ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS user_number FROM events""")
def coerce_numeric(spark, d):
    text = F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("user_id").cast("string"))
    return table(spark, d, "events").select(
        "event_id", C.coerce_numeric(text).alias("user_number"))


@query("""SELECT p_partkey, regexp_replace(lower(p_brand || ' & ' || p_type), '[^a-z\\s]', '', 'g') AS k
   FROM part""")
def normalise_key_symbols(spark, d):
    name = F.concat_ws(" & ", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", C.normalise_key(name).alias("k"))


@query("""SELECT p_partkey, replace(trim(lower('  ' || p_brand || ' & ' || p_type || ' ')), '&', 'and') AS k
   FROM part""")
def normalise_key_and(spark, d):
    name = F.concat(F.lit("  "), "p_brand", F.lit(" & "), "p_type", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", C.normalise_key(name, "and").alias("k"))


@query("""SELECT p_partkey, array_to_string(list_transform(
     regexp_extract_all(lower(trim(' ' || p_name || '-' || p_type)), '[a-z]+|[^a-z]+'),
     lambda w: upper(w[1]) || w[2:]), '') AS k FROM part""")
def normalise_key_title(spark, d):
    name = F.concat(F.lit(" "), "p_name", F.lit("-"), "p_type")
    return table(spark, d, "part").select("p_partkey", C.normalise_key(name, "title").alias("k"))


@query("""SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment
   FROM customer""")
def lower_all(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("C_NAME"), F.col("c_mktsegment").alias("C_MktSegment"))
    return clean.lower_all(rows)


@query("WITH" + EVENT_PANEL + """SELECT entity, period, coalesce(click,0) AS click,
   coalesce(error,0) AS error, coalesce(purchase,0) AS purchase, coalesce(signup,0) AS signup,
   coalesce(view,0) AS view FROM panel""")
def fill_missing(spark, d):
    return clean.fill_missing(event_panel(spark, d), EVENT_TYPES)


def _winsorised_sql(cols, panel_sql):
    limits = ", ".join(
        f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in cols)
    clipped = ", ".join(
        f"greatest(a_{c} - 1.5 * (b_{c} - a_{c}), least(b_{c} + 1.5 * (b_{c} - a_{c}), {c}))"
        f" AS {c}" for c in cols)
    return f"WITH {panel_sql}, lim AS (SELECT {limits} FROM panel), " \
           f"clipped AS (SELECT entity, period, {clipped} FROM panel, lim) "


@query(_winsorised_sql(MEASURES, CUSTOMER_PANEL) + "SELECT * FROM clipped")
def winsorise_iqr(spark, d):
    return clean.winsorise_iqr(customer_panel(spark, d), MEASURES)


@query("WITH" + ORDER_PANEL + "SELECT entity, period, " + ", ".join(
    f"round(ln(1 + {m}), 6) AS {m}" for m in MEASURES) + " FROM panel")
def log1p(spark, d):
    out = clean.log1p(order_panel(spark, d), MEASURES)
    return clean.replace_columns(out, {m: six(m) for m in MEASURES})


@query("WITH" + EVENT_PANEL + f"SELECT *, {EVENT_TOTAL} AS total FROM panel")
def row_total(spark, d):
    return clean.with_total(event_panel(spark, d), EVENT_TYPES)


@query("SELECT p_size, p_retailprice FROM part")
def numeric_columns(spark, d):
    part = table(spark, d, "part")
    return part.select(*clean.numeric_columns(part, exclude=["p_partkey"]))


@query("WITH" + ORDER_PANEL + "SELECT entity, period, medium AS value FROM panel")
def project_measure(spark, d):
    return clean.project_measure(order_panel(spark, d), "entity", "period", "medium", "value")


CODES = {"urgent": "K&A", "high": "DD", "medium": "AoW", "unspecified": "DV", "low": "WT"}


def _as_codes(spark, d):
    """The order panel with measure codes as column names, one of them with a symbol."""
    p = order_panel(spark, d)
    return p.select("entity", "period", *[F.col(m).alias(code) for m, code in CODES.items()])


@query("WITH" + ORDER_PANEL + " UNION ALL ".join(
    f"SELECT entity, period, '{MEASURE_NAMES.get(code, code)}' AS measure, {m} AS value FROM panel" for m, code in CODES.items()))
def measure_names(spark, d):
    return panel.named_long(_as_codes(spark, d), ["entity", "period"], list(CODES.values()),
                            MEASURE_NAMES)


@query("WITH" + EVENT_PANEL + " UNION ALL ".join(
    f"SELECT entity, period, '{m}' AS measure, {m} AS value FROM panel" for m in EVENT_TYPES))
def to_long(spark, d):
    return clean.to_long(event_panel(spark, d), ["entity", "period"], EVENT_TYPES)


@query("WITH" + EVENT_PANEL + "SELECT * FROM panel")
def to_wide(spark, d):
    long = (table(spark, d, "events")
            .groupBy(F.col("user_id").cast("string").alias("entity"),
                     F.dayofmonth("ts").alias("period"), F.col("event_type").alias("measure"))
            .agg(F.count("*").alias("value")))
    return clean.to_wide(long, ["entity", "period"], EVENT_TYPES)


@query("WITH" + ORDER_PANEL + "SELECT period, urgent, high, medium, unspecified, low FROM panel")
def drop_columns(spark, d):
    return clean.drop_columns(clean.with_total(order_panel(spark, d), MEASURES),
                              "entity", "total")


@query("WITH" + ORDER_PANEL + ", s AS (SELECT period, " + ", ".join(
    f"sum({m}) AS {m}" for m in MEASURES) + " FROM panel GROUP BY period) SELECT period, " + ", ".join(
    f"round(({m} - min({m}) OVER ())::DOUBLE / nullif(max({m}) OVER () - min({m}) OVER (), 0), 6) AS {m}"
    for m in MEASURES) + " FROM s")
def minmax_by_column(spark, d):
    sums = panel.sum_by_period(order_panel(spark, d), "period", MEASURES)
    out = clean.minmax_by_column(sums, MEASURES)
    return clean.replace_columns(out, {m: six(m) for m in MEASURES})


@query("WITH" + CUSTOMER_PANEL + "SELECT entity, period, " + ", ".join(
    f"round(coalesce(({m} - avg({m}) OVER ()) / nullif(stddev_pop({m}) OVER (), 0), 0), 6) + 0.0 AS {m}"
    for m in MEASURES) + " FROM panel")
def standardise(spark, d):
    out = clean.standardise(customer_panel(spark, d), MEASURES)
    return clean.replace_columns(out, {m: six(m) for m in MEASURES})


# ---------------------------------------------------------------- filters

@query("WITH" + ORDER_PANEL + """SELECT entity, period, low FROM panel
   WHERE period = 1998 AND entity = 'NATION_7'""")
def filter_panel(spark, d):
    return panel.filter_panel(order_panel(spark, d), "entity", "period", at=1998,
                              of="NATION_7", measure="low")


@query("WITH" + ORDER_PANEL + """SELECT entity, period, 'Dowry Deaths' AS measure, high AS value
   FROM panel WHERE entity = 'NATION_3'""")
def filter_panel_long(spark, d):
    long = panel.named_long(_as_codes(spark, d), ["entity", "period"], list(CODES.values()),
                            MEASURE_NAMES)
    return panel.filter_panel_long(long, "entity", "period", of="NATION_3", measure="DD",
                                   names=MEASURE_NAMES)


@query("WITH" + ORDER_PANEL + "SELECT * FROM panel WHERE period = (SELECT max(period) FROM panel)")
def at_latest_period(spark, d):
    return panel.at_period(order_panel(spark, d), "period")


# ----------------------------------------------------------------- totals

RANKED = "WITH" + ORDER_PANEL + f"""SELECT entity, CAST(sum({ROW_TOTAL}) AS BIGINT) AS total,
   row_number() OVER (ORDER BY sum({ROW_TOTAL}) DESC, entity) AS place
   FROM panel WHERE period = 1997 GROUP BY entity"""


@query(RANKED)
def rank_entities(spark, d):
    rows = panel.filter_panel(order_panel(spark, d), "entity", "period", at=1997)
    return panel.rank_entities(rows, "entity", MEASURES)


@query("WITH" + CUSTOMER_PANEL + f"""SELECT entity, CAST(sum({ROW_TOTAL}) AS BIGINT) AS total,
   row_number() OVER (ORDER BY sum({ROW_TOTAL}) DESC, entity) AS place
   FROM panel GROUP BY entity""")
def rank_many_entities(spark, d):
    return panel.rank_entities(customer_panel(spark, d), "entity", MEASURES)


@query("WITH" + ORDER_PANEL + """SELECT entity, CAST(sum(urgent) AS BIGINT) AS total
   FROM panel GROUP BY entity""")
def sum_measure_by_entity(spark, d):
    return panel.total_by_entity(order_panel(spark, d), "entity", ["urgent"])


@query("WITH" + EVENT_PANEL + "SELECT period, " + ", ".join(
    f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in EVENT_TYPES) +
    " FROM panel GROUP BY period")
def sum_by_period(spark, d):
    return panel.sum_by_period(event_panel(spark, d), "period", EVENT_TYPES)


@query("WITH" + ORDER_PANEL + "SELECT entity, " + ", ".join(
    f"round(avg({m}), 6) AS {m}" for m in MEASURES) + ", round(" + " + ".join(
    f"avg({m})" for m in MEASURES) + ", 6) AS total FROM panel GROUP BY entity")
def mean_by_entity(spark, d):
    out = panel.mean_by_entity(order_panel(spark, d), "entity", MEASURES)
    return clean.replace_columns(out, {c: six(c) for c in [*MEASURES, "total"]})


@query("WITH" + EVENT_PANEL + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, CAST(coalesce(sum({m}), 0) AS BIGINT) AS total FROM panel"
    for m in EVENT_TYPES))
def grand_totals(spark, d):
    return panel.grand_totals(event_panel(spark, d), EVENT_TYPES)


@query("WITH" + ORDER_PANEL + """SELECT CAST(sum(medium) AS BIGINT) AS total,
   round(avg(medium), 6) AS mean FROM panel WHERE period = 1999""")
def total_and_mean(spark, d):
    rows = panel.filter_panel(order_panel(spark, d), "entity", "period", at=1999)
    return panel.total_and_mean(rows, "medium").withColumn("mean", six("mean"))


def _summary_sql(m):
    return f"""SELECT '{m}' AS measure, count({m}) AS count, round(avg({m}), 6) AS mean,
      round(stddev_samp({m}), 6) AS std, CAST(min({m}) AS DOUBLE) AS min,
      round(quantile_cont({m}, 0.25), 6) AS p25, round(quantile_cont({m}, 0.5), 6) AS p50,
      round(quantile_cont({m}, 0.75), 6) AS p75, CAST(max({m}) AS DOUBLE) AS max FROM s"""


@query("WITH" + EVENT_PANEL + ", s AS (SELECT period, " + ", ".join(
    f"CAST(sum({m}) AS BIGINT) AS {m}" for m in EVENT_TYPES) + " FROM panel GROUP BY period) " +
    " UNION ALL ".join(_summary_sql(m) for m in EVENT_TYPES))
def summary_table(spark, d):
    sums = panel.sum_by_period(event_panel(spark, d), "period", EVENT_TYPES)
    out = panel.summary_table(sums, EVENT_TYPES)
    return clean.replace_columns(out, {c: six(c) for c in ("mean", "std", "p25", "p50", "p75")})


@query("WITH" + EVENT_PANEL + ", s AS (SELECT period, " + ", ".join(
    f"CAST(sum({m}) AS BIGINT) AS {m}" for m in EVENT_TYPES) + " FROM panel GROUP BY period) " +
    " UNION ALL ".join(
        f"SELECT '{a}' AS m1, '{b}' AS m2, round(covar_pop({a}, {b}) / "
        f"nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM s"
        for a in EVENT_TYPES for b in EVENT_TYPES))
def correlation_matrix(spark, d):
    sums = panel.sum_by_period(event_panel(spark, d), "period", EVENT_TYPES)
    return panel.correlation_matrix(sums, EVENT_TYPES).withColumn("r", six("r"))


@query("""SELECT 'l_extendedprice' AS measure, round(quantile_cont(l_extendedprice, 0.25), 6) AS q0,
    round(quantile_cont(l_extendedprice, 0.5), 6) AS q1,
    round(quantile_cont(l_extendedprice, 0.99), 6) AS q2 FROM lineitem
  UNION ALL SELECT 'l_quantity', round(quantile_cont(l_quantity, 0.25), 6),
    round(quantile_cont(l_quantity, 0.5), 6), round(quantile_cont(l_quantity, 0.99), 6) FROM lineitem""")
def exact_quantiles(spark, d):
    out = panel.quantiles(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"],
                          [0.25, 0.5, 0.99])
    return clean.replace_columns(out, {c: six(c) for c in ("q0", "q1", "q2")})


@query("WITH" + EVENT_PANEL + """, s AS (SELECT entity, period, coalesce(click, 0) AS v FROM panel)
   SELECT entity, (list(period ORDER BY v DESC, period))[1] AS highest_period,
     (list(period ORDER BY v, period))[1] AS lowest_period FROM s GROUP BY entity""")
def extreme_periods(spark, d):
    rows = clean.fill_missing(event_panel(spark, d), ["click"])
    return panel.extreme_periods(rows, "period", "click", by=["entity"])


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, d):
    return panel.distinct_values(table(spark, d, "orders"), "o_orderpriority")


# --------------------------------------------------- rankings and trends

@query("WITH" + ORDER_PANEL + """SELECT entity, urgent FROM panel WHERE period = 2000
   ORDER BY urgent DESC, entity LIMIT 5""")
def top_entities(spark, d):
    return panel.top_entities(order_panel(spark, d), "entity", "period", "urgent", 2000)


@query("WITH" + ORDER_PANEL + """SELECT entity, low FROM panel
   WHERE period = (SELECT max(period) FROM panel) ORDER BY low, entity LIMIT 5""")
def lowest_entities(spark, d):
    return panel.top_entities(order_panel(spark, d), "entity", "period", "low", None, lowest=True)


@query("WITH" + CUSTOMER_PANEL + """SELECT entity, period, urgent, place FROM (
   SELECT entity, period, urgent, CAST(row_number() OVER
     (PARTITION BY period ORDER BY urgent DESC, entity) AS INTEGER) AS place FROM panel)
   WHERE place <= 5""")
def top_entities_by_period(spark, d):
    return panel.top_entities_by_period(customer_panel(spark, d), "entity", "period", "urgent")


@query("WITH" + ORDER_PANEL + """SELECT entity, high,
   row_number() OVER (ORDER BY high DESC, entity) AS place FROM panel WHERE period = 1996""")
def compare_entities(spark, d):
    return panel.compare_entities(order_panel(spark, d), "entity", "period", "high", 1996)


def _trend_sql(m):
    return f"""SELECT '{m}' AS measure, first({m} ORDER BY period) AS first_value,
      last({m} ORDER BY period) AS last_value,
      (list(period ORDER BY {m} DESC, period))[1] AS highest_period,
      (list(period ORDER BY {m}, period))[1] AS lowest_period,
      round((last({m} ORDER BY period) - first({m} ORDER BY period)) * 100.0::DOUBLE
        / nullif(first({m} ORDER BY period), 0), 6) AS change_percent FROM s"""


@query("WITH" + ORDER_PANEL + ", s AS (SELECT period, " + ", ".join(
    f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES) + " FROM panel GROUP BY period) " +
    " UNION ALL ".join(_trend_sql(m) for m in MEASURES))
def trend(spark, d):
    out = panel.trend(order_panel(spark, d), "period", MEASURES)
    return out.withColumn("change_percent", six("change_percent"))
