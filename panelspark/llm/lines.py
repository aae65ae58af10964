"""Removal of lines that many sites share, by distinct-site sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import text_key, text_or_empty
from panelspark.session import materialise

MIN_SITES = 8
SKETCH_BITS = 10
BAND = 0.25
NO_SITE = "\u0000"
BLANKS = " \t\n\u000b\f\r"


def _hash(line: Column) -> Column:
    """128 bits of a line without the blanks around it; null for a line without a word."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.md5(bare))


def document_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, site, line)``: one row per line with a word; ``line`` is its hash."""
    return docs.select(
        "doc_id", text_key().alias("text_key"), F.coalesce(F.col("source"), F.lit(NO_SITE)).alias("site"),
        F.explode(F.split(text_or_empty(), "\n")).alias("_line")).select(
        "doc_id", "text_key", "site", _hash(F.col("_line")).alias("line")).where(F.col("line").isNotNull())


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(line, first_doc)``: the lines that at least ``min_sites`` distinct sites hold.

    Sketches of the sites merge by aggregation, so a line with any number of
    occurrences costs a few hundred bytes per task.  Lines that occur fewer than
    ``min_sites`` times need no sketch.  An estimate within ``BAND`` of the
    threshold is replaced by the exact count of distinct sites.
    """
    frequent = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(
        F.col("n") >= min_sites).drop("n")
    known = lines.select("line", "site").join(frequent.select("line"), "line", "left_semi")
    spread = materialise(known.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites")), "line_spread")
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    near = spread.where(F.col("sites").between(low, high)).select("line")
    exact = (known.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("_one"))
             .groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line"))
    found = spread.where(F.col("sites") > high).select("line").unionByName(exact)
    return found.join(frequent, "line")


def judge_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: the input row, its text without boilerplate, and counts.

    Lines shared by at least ``min_sites`` sites go from all documents but the
    first that holds them.  A site is the document's source; a missing source is
    a site of its own.  Lines are compared without the blanks around them; lines
    without a word are never removed nor counted.  The document with the lowest
    id keeps the line (all rows of that id do), so no text is lost altogether.
    A null text stays null, an empty one empty; repeated rows are treated alike.
    """
    lines = materialise(document_lines(docs), "lines")
    hit = lines.join(boilerplate_lines(lines, min_sites), "line").where(
        ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    drops = hit.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("drop"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text", text_key().alias("key"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    parts = F.split(F.col("text"), "\n")
    kept = F.filter(parts, lambda x: ~F.coalesce(F.array_contains(F.col("drop"), _hash(x)), F.lit(False)))
    changed = F.col("drop").isNotNull()
    with_word = F.size(F.filter(F.split(text_or_empty(), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return joined.select(
        "row", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
        with_word.cast("bigint").alias("n_lines"),
        F.when(changed, F.size(parts) - F.size(kept)).otherwise(F.lit(0)).cast("bigint").alias("n_removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without boilerplate lines; a document that loses all its words with them goes."""
    judged = judge_lines(docs, min_sites).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return judged.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
