"""The given tables in the roles the operators need, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ["urgent", "high", "medium", "unspecified", "low"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Nation x year x five order counts.

    Orders are counted per nation key before the names are joined.
    """
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("period"), "o_orderpriority")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    counts = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .groupBy("c_nationkey", "period")
              .agg(*[F.count_if(F.col("o_orderpriority") == p).alias(m)
                     for m, p in zip(MEASURES, PRIORITIES)]))
    return (counts.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("entity"), "period", *MEASURES))


ORDER_PANEL = """
panel AS (
  SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
    count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
    count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium,
    count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS unspecified,
    count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)
"""


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """User x day x five event counts; a type that did not occur is null."""
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("entity"),
        F.dayofmonth("ts").alias("period"), "event_type")
    return events.groupBy("entity", "period").agg(*[
        F.nullif(F.count_if(F.col("event_type") == t), F.lit(0).cast("bigint")).alias(t)
        for t in EVENT_TYPES])


EVENT_PANEL = """
panel AS (
  SELECT CAST(user_id AS VARCHAR) AS entity, CAST(dayofmonth(ts) AS INTEGER) AS period,
    nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click,
    nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS error,
    nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchase,
    nullif(count(*) FILTER (WHERE event_type = 'signup'), 0) AS signup,
    nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS view
  FROM events GROUP BY ALL)
"""


def customer_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Customer x year x five order counts: the panel with many entities."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"),
        "o_orderpriority").groupBy("entity", "period").agg(*[
            F.count_if(F.col("o_orderpriority") == p).alias(m)
            for m, p in zip(MEASURES, PRIORITIES)])


CUSTOMER_PANEL = """
panel AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
    count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
    count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium,
    count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS unspecified,
    count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low
  FROM orders GROUP BY ALL)
"""

ROW_TOTAL = "urgent + high + medium + unspecified + low"
EVENT_TOTAL = ("coalesce(click,0) + coalesce(error,0) + coalesce(purchase,0) "
               "+ coalesce(signup,0) + coalesce(view,0)")


def six(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
