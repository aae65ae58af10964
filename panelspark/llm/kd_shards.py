"""Sharding by a k-d tree over document metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import number_within
from panelspark.session import materialise

CELL_BITS = 20
TIE_BITS = 32
BINS = 1024
DIMENSIONS = ("order", "length", "lang", "source")


def _cells(value: Column, low: float, high: float) -> Column:
    """Place of a number between the table's extremes, in 2**20 equal cells; null is the first."""
    span = (high - low) or 1.0
    cell = F.floor((value - F.lit(low)) / F.lit(span) * F.lit((1 << CELL_BITS) - 1))
    return F.coalesce(cell, F.lit(0)).cast("bigint")


def _category(value: Column) -> Column:
    """Names have no natural order: they are spread by a hash, null first."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(value), 64 - CELL_BITS) + F.lit(0), F.lit(0)).cast("bigint")


def document_metadata(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, order, length, lang, source, tie)``: all that the tree needs, without texts.

    ``size`` is the UTF-8 length of the text plus 16.  The last bits of ``tie``
    hold the document, the first ones its text, so equal texts stand together.
    """
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    return docs.select(
        "doc_id", (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.col("doc_id").cast("double").alias("order"), F.log2(F.octet_length(raw) + F.lit(16.0)).alias("length"),
        "lang", "source").withColumn(
        "tie", F.shiftleft(F.pmod(F.xxhash64("text_crc32", "size"), F.lit(1 << 16)), 16)
        + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)))


class _Node:
    """A part of the table that will become ``shards`` shards, the first of them ``first``."""

    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.dimension: str | None = None
        self.cut = 0
        self.left: _Node | None = None
        self.right: _Node | None = None

    def leaves(self) -> list[_Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def expression(self) -> Column:
        """The first shard of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) < F.lit(self.cut), self.left.expression()).otherwise(
            self.right.expression())


def _cut_all(table: DataFrame, nodes: list[_Node], root: _Node, tolerance: float) -> None:
    """Find the weighted median of every open node on its widest dimension.

    Each round counts the bytes of 1,024 equal bins per node (that is all that
    reaches the driver) and goes on inside the bin that holds the median,
    until that bin is negligible or holds one place.
    """
    placed = table.withColumn("_node", root.expression())
    spans = {r["_node"]: r for r in placed.groupBy("_node").agg(
        F.sum("size").alias("bytes"),
        *[F.min(d).alias(f"min_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"max_{d}") for d in DIMENSIONS]).collect()}
    search = {}
    for node in nodes:
        row = spans.get(node.first)
        if row is None:  # nothing here: any cut will do
            node.dimension, node.cut = DIMENSIONS[0], 0
            continue
        node.dimension = max(DIMENSIONS, key=lambda d: (row[f"max_{d}"] >> TIE_BITS) - (row[f"min_{d}"] >> TIE_BITS))
        left = node.shards // 2
        search[node.first] = {"node": node, "low": row[f"min_{node.dimension}"], "high": row[f"max_{node.dimension}"] + 1,
                              "before": 0, "want": row["bytes"] * left / node.shards}
    while search:
        for s in search.values():
            s["width"] = max(1, math.ceil((s["high"] - s["low"]) / BINS))
        # one row per open node, of which there are fewer than shards
        state = table.sparkSession.createDataFrame(
            [(first, DIMENSIONS.index(s["node"].dimension) + 1, s["low"], s["width"], s["high"]) for first, s in search.items()],
            "_node int, dimension int, low bigint, width bigint, high bigint")
        counted = (placed.join(F.broadcast(state), "_node")
                   .select("_node", "size", "low", "width", "high", F.element_at(F.array(*DIMENSIONS), F.col("dimension")).alias("place"))
                   .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
                   .groupBy("_node", F.expr("(place - low) div width").alias("bin"))
                   .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
        bins: dict[int, list] = {}
        for r in counted:
            bins.setdefault(r["_node"], []).append(r)
        for first, s in list(search.items()):
            total = s["before"]
            for r in sorted(bins[first], key=lambda r: r["bin"]):
                if total + r["bytes"] >= s["want"]:
                    break
                total += r["bytes"]
            low = s["low"] + r["bin"] * s["width"]
            if r["rows"] == 1 or s["width"] == 1 or r["bytes"] <= tolerance:
                nearer_end = total + r["bytes"] - s["want"] < s["want"] - total
                s["node"].cut = low + s["width"] if nearer_end else low
                del search[first]
            else:
                s["low"], s["high"], s["before"] = low, min(low + s["width"], s["high"]), total


def kd_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.0005, slices: int = 256) -> DataFrame:
    """Deal all rows into ``shards`` shards of nearly equal bytes; rows near each other in metadata share one.

    The table is split at weighted medians, always along the dimension (place
    in the id order, log length, language, source) in which the part is widest
    relative to the whole table, until a part has the target bytes: the total
    over ``shards``.  Odd parts split in the ratio of their shards.  Texts never
    move: the passes read a written metadata table, and a row's shard is an
    expression over it.

    A null text has no bytes; null ids, languages and sources come first in
    their dimension.  Repeated rows (same id and text) share a shard.  An empty
    table gives no rows; tables with fewer rows than shards leave some empty.

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``; the
    slot counts a shard's rows from 0.
    """
    meta = materialise(document_metadata(docs), "kd_metadata")
    low_order, high_order, low_length, high_length, total = meta.agg(
        F.min("order"), F.max("order"), F.min("length"), F.max("length"), F.sum("size")).first()
    places = {"order": _cells(F.col("order"), low_order or 0.0, high_order or 0.0),
              "length": _cells(F.col("length"), low_length or 0.0, high_length or 0.0),
              "lang": _category(F.col("lang")), "source": _category(F.col("source"))}
    table = meta.select("doc_id", "size", "text_crc32", *[
        (F.shiftleft(places[d], TIE_BITS) + F.col("tie")).alias(d) for d in DIMENSIONS])
    root = _Node(0, shards)
    while total and (open_nodes := [n for n in root.leaves() if n.shards > 1]):
        _cut_all(table, open_nodes, root, tolerance * total / shards)
        for node in open_nodes:
            half = node.shards // 2
            node.left, node.right = _Node(node.first, half), _Node(node.first + half, node.shards - half)
    placed = table.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                          root.expression().cast("int").alias("shard"))
    numbered = number_within(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", slices)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot",
                           F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the documents as Parquet, one folder per shard, rows in slot order of their part."""
    places = assigned.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard").distinct()
    crc = F.crc32(F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b"")))
    (docs.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (crc == F.col("_crc")))
     .drop("_id", "_crc").write.partitionBy("shard").parquet(path))
