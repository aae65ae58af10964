"""Plain-English questions about a panel, a whole table of them at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column, row_total, tokens
from panelspark.functions.fixed_values import (COMPARISON_WORDS, HIGHEST_WORDS, KEYWORD_GROUPS,
                                               LOWEST_WORDS, NO_ANSWER, TREND_WORDS)
from panelspark.operators.ordering import position
from panelspark.operators.panel import top_within, trend
from panelspark.session import materialise


def _any_of(words: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))


def extract_question_params(questions: DataFrame, keywords: Mapping[str, Sequence[str]] = KEYWORD_GROUPS,
                            substring: bool = False) -> DataFrame:
    """``questions(question_id, text)`` with topic, year, trend, comparison and direction.

    The topic is the first keyword group, in the order given, that has a
    keyword in the question: as whole words, or anywhere with ``substring``.
    Intent words are looked for before any stop word is dropped.
    """
    words = tokens("text", "punct")
    marked = questions.select("question_id", "text", words.alias("words")).withColumn(
        "plain", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    topic = F.lit(None).cast("string")
    for group, terms in reversed(list(keywords.items())):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.col("plain").contains(t if substring else f" {t} ")
        topic = F.when(hit, F.lit(group)).otherwise(topic)
    year = F.regexp_extract("text", r"\b(19|20)\d{2}\b", 0).try_cast("int")
    return marked.select(
        "question_id", "text", topic.alias("topic"), year.alias("year"),
        _any_of(F.col("words"), TREND_WORDS).alias("trend"),
        _any_of(F.col("words"), COMPARISON_WORDS).alias("comparison"),
        F.when(_any_of(F.col("words"), HIGHEST_WORDS), "highest")
        .when(_any_of(F.col("words"), LOWEST_WORDS), "lowest").alias("direction"))


def answer_questions(params: DataFrame, panel: DataFrame, entity: str, period: str,
                     measures: Sequence[str], topics: Mapping[str, str],
                     total: str = "total") -> DataFrame:
    """Answer rows for the output of ``extract_question_params``.

    ``topics`` names the measure of each topic; ``total`` stands for the sum of
    all measures.  Each different request is answered once and then handed to
    its questions.  Columns: ``question_id, route, measure, period, place,
    entity, value, answer``.
    """
    named = materialise(panel.select(
        as_column(entity).alias("entity"), as_column(period).cast("int").alias("period"),
        *[as_column(m).cast("bigint").alias(m) for m in measures],
        row_total(measures).alias(total)), "panel")
    latest = named.agg(F.max("period")).scalar()
    known = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])
    route = (F.when(F.col("measure").isNull(), "none").when(F.col("trend"), "trend")
             .when(F.col("comparison"), "comparison").otherwise("statistics"))
    asked = (params.withColumn("measure", F.try_element_at(known, F.col("topic")))
             .withColumn("route", route)
             .withColumn("lowest", (F.col("route") == "statistics")
                         & F.coalesce(F.col("direction") == "lowest", F.lit(False)))
             .withColumn("period", F.when(F.col("route").isin("comparison", "statistics"),
                                          F.coalesce("year", latest)))
             .select("question_id", "route", "measure", "period", "lowest"))
    asked = materialise(asked, "requests")
    request = ["route", "measure", "period", "lowest"]
    requests = asked.where(F.col("route") != "none").select(*request).distinct()

    names = [*measures, total]
    long = named.unpivot(["entity", "period"], names, "measure", "value")

    changes = trend(named, "period", names)
    trends = requests.where(F.col("route") == "trend").join(changes, "measure").select(
        *request, F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("entity"),
        F.col("change_percent").alias("value"),
        F.format_string("Trend Analysis for %s: total change %.2f%%, highest in %d, lowest in %d",
                        "measure", "change_percent", "highest_period", "lowest_period").alias("answer"))

    compared = requests.where(F.col("route") == "comparison").join(long, ["measure", "period"])
    compared = position(compared, [F.col("value").desc(), F.col("entity")], "place",
                        within=["measure", "period"])
    comparisons = compared.select(*request, "place", "entity", F.col("value").cast("double").alias("value"),
                                  F.lit(None).cast("string").alias("answer"))

    rows = requests.where(F.col("route") == "statistics").join(long, ["measure", "period"])
    figures = rows.groupBy(*request).agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"))
    signed = F.when(F.col("lowest"), F.col("value")).otherwise(-F.col("value"))
    statistics = (top_within(rows, request, [signed, F.col("entity")], 5)
                  .join(figures, request).select(
                      *request, F.col("place").cast("bigint").alias("place"), "entity",
                      F.col("value").cast("double").alias("value"),
                      F.format_string("Statistics for %s: total cases %s, average cases per entity %s", "measure",
                                      F.format_number("sum", 0), F.format_number("mean", 0)).alias("answer")))

    answers = trends.unionByName(comparisons).unionByName(statistics)
    answers = answers.select(*[F.col(c).alias(f"_{c}") for c in request], "place", "entity", "value",
                             "answer", F.lit(True).alias("_answered"))
    same = F.lit(True)
    for c in request:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return asked.join(answers, same, "left").select(
        "question_id", "route", "measure", "period", "place", "entity", "value",
        F.when(F.col("_answered"), F.col("answer")).otherwise(F.lit(NO_ANSWER)).alias("answer"))


def trend_series(params: DataFrame, panel: DataFrame, period: str, measures: Sequence[str],
                 topics: Mapping[str, str], total: str = "total") -> DataFrame:
    """``(measure, period, value)``: the yearly sums behind the trend answers.

    One series per measure that a trend question asks for; a question meets its
    series by the ``measure`` of its answer, so a measure that all questions ask
    for is computed and kept once.
    """
    known = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])
    wanted = params.where("trend").select(F.try_element_at(known, F.col("topic")).alias("measure")).distinct()
    named = panel.select(as_column(period).cast("int").alias("period"), *[as_column(m).cast("bigint").alias(m) for m in measures],
                         row_total(measures).alias(total))
    names = [*measures, total]
    sums = named.groupBy("period").agg(*[F.sum(m).alias(m) for m in names])
    return sums.unpivot(["period"], names, "measure", "value").join(wanted, "measure", "left_semi").select(
        "measure", "period", "value")
