"""Text preparation and the TF-IDF index.

The index is a set of tables, never a matrix.  Texts with the same bag of terms
share one vector, so a group of copies is indexed and compared once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from panelspark.functions.columns import as_column, index_terms, split_list_field, tokens
from panelspark.operators import joins
from panelspark.operators.joins import lookup
from panelspark.operators.ordering import position
from panelspark.operators.weighting import SENT_LENGTH, unit_vectors
from panelspark.session import materialise, spread

TABLES = ("docs", "vocab", "vectors", "size")


@dataclass(frozen=True)
class TextIndex:
    """``docs(doc_id, label, rep_id)``, ``vocab(term, df, idf)``,
    ``vectors(rep_id, copies, terms, weights)`` with unit length, terms from rare to
    common (equal ones by name), ``size(n_docs)``.

    ``rep_id`` is the lowest doc_id among documents with the same terms.  ``vectors``
    of ``fit_tfidf`` also have ``sole_label``, the label of all documents with the
    vector; null where they differ, lack one or come together under one ``rep_id``.
    """

    docs: DataFrame
    vocab: DataFrame
    vectors: DataFrame
    size: DataFrame

    @property
    def postings(self) -> DataFrame:
        """``(rep_id, term, weight)``."""
        return postings(self.vectors, "rep_id")

    def save(self, path: str) -> None:
        """Write all tables under a new version, then add the version to the list of whole ones."""
        version = uuid.uuid4().hex
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{version}/{name}")
        (self.size.select(F.lit(version).alias("version"), F.current_timestamp().alias("written"))
         .write.mode("append").parquet(f"{path}/versions"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextIndex | None":
        """The index that was saved last, or None where there is none."""
        try:
            versions = spark.read.parquet(f"{path}/versions")
        except AnalysisException:
            return None
        version = versions.agg(F.max_by("version", F.struct("written", "version"))).first()[0]
        return cls(**{name: spark.read.parquet(f"{path}/{version}/{name}") for name in TABLES})


def stop_word_list(*languages: str) -> list[str]:
    """Spark's own stop words of the named languages."""
    from pyspark.ml.feature import StopWordsRemover
    return sorted({w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)})


def postings(vectors: DataFrame, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per vector entry."""
    return vectors.select(key, *extra, F.explode(F.arrays_zip("terms", "weights")).alias("p")).select(
        key, *extra, F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))


def normalise_terms(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """Replace every token by its base form from ``lexicon(term, base)``.

    Only terms that have another base meet their documents.
    """
    changes = lexicon.where(F.col("base") != F.col("term")).select(F.col("term").alias("word"), F.col("base").alias("new"))
    return rewrite_tokens(df, key, col, changes)


def _rewritten(col: str, sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel: token arrays with the words that were sent replaced; a missing array is an empty one."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, new = sent.value
        for batch in batches:
            lists = batch.column(col)
            tokens = lists.flatten()
            at = pc.index_in(tokens, value_set=words)
            length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            ends = pa.array(np.append(0, np.cumsum(length)), pa.int32())
            done = pa.ListArray.from_arrays(ends, pc.coalesce(new.take(at), tokens))
            yield batch.set_column(batch.schema.get_field_index(col), col, done)

    return kernel


def rewrite_tokens(df: DataFrame, key: str, col: str, changes: DataFrame) -> DataFrame:
    """Put ``changes(word, new)`` into token arrays, in place.

    Up to ``SENT_KEYS`` changes are sent to the documents, which stay where they are.
    Of more, each document sends its distinct tokens; those that change come back as
    one small map per document.  Tokens that stay as they are never move.
    """
    changes = materialise(changes.where(F.col("new") != F.col("word")).select("word", "new"), "changes", compression="zstd")
    n, words, longest = changes.agg(F.count("*"), F.count_distinct("word"), F.coalesce(F.max(F.length("word") + F.length("new")), F.lit(0))).first()
    if n == words and n <= joins.SENT_KEYS and longest <= 2 * SENT_LENGTH:
        rows = changes.toArrow()
        sent = df.sparkSession.sparkContext.broadcast(tuple(rows.column(c).combine_chunks() for c in ("word", "new")))
        kept = df.select(key, *[c for c in df.columns if c != key])
        return kept.mapInArrow(_rewritten(col, sent), kept.schema)
    words = df.select(key, F.explode(F.array_distinct(col)).alias("word")).join(changes.select("word"), "word", "left_semi")
    sized = words.groupBy("word").agg(F.count("*").alias("_n")).join(changes, "word")
    # a map holds the changed words of one text
    maps = lookup(words, sized, "word", key, "_n").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("_new"))
    renamed = F.transform(col, lambda t: F.coalesce(F.try_element_at("_new", t), t))
    empty = F.array().cast("array<string>")
    return df.join(maps, key, "left").withColumn(
        col, F.coalesce(F.when(F.col("_new").isNull(), F.col(col)).otherwise(renamed), empty)).drop("_new")


def _unit_vectors(weighted: DataFrame, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """``(key, ..., term, w)`` rows to one unit-length sparse vector per key.

    The group is one document's distinct terms, which came out of one row.
    """
    packed = weighted.groupBy(key, *extra).agg(
        F.collect_list(F.struct("term", "w")).alias("v"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return packed.select(
        key, *extra, F.transform("v", lambda p: p["term"]).alias("terms"),
        F.transform("v", lambda p: p["w"] / F.col("length")).alias("weights"))


def fit_tfidf(docs: DataFrame, stop_words: Sequence[str] = (), mode: str = "words",
              term_array: Column | None = None) -> TextIndex:
    """Index ``docs(doc_id, label, text)``.

    Terms are tokens of two or more characters; weight is
    ``tf * (ln((1 + n) / (1 + df)) + 1)`` scaled to unit length.  ``term_array``
    replaces the tokenisation where the caller has its own.
    """
    terms = term_array if term_array is not None else index_terms(tokens("text", mode, stop_words))
    # a document without text is one without terms
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    tokenised = materialise(
        _counted(spread(docs).select("doc_id", "label", F.sort_array(terms).alias("tokens"))).withColumn("row", F.monotonically_increasing_id()),
        "tokens", compression="zstd")
    # counted map-side first, so a bag shared by many documents is one row per task
    first = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")
    sole = F.when((F.min("label") == F.max("label")) & (F.count("label") == F.count("*")), F.min("label"))
    bags = tokenised.groupBy("bag").agg(F.min(first).alias("first"), F.count("*").alias("copies"), sole.alias("sole")).select(
        "bag", "copies", "sole", F.col("first.doc_id").alias("rep_id"), F.col("first.row").alias("rep_row"))
    doc_map = materialise(lookup(tokenised.select("doc_id", "label", "bag", "row"), bags, "bag", "row", "copies").drop("bag"), "docs")
    size = tokenised.agg(F.count("*").alias("n_docs"))
    n_docs = F.lit(size.first()[0])
    # short lists, which Spark can send to the documents: copies leave, the first of each group learns of its copies
    later = materialise(doc_map.where(F.col("row") != F.col("rep_row")).select("row"), "later_copies")
    many = materialise(doc_map.where((F.col("row") == F.col("rep_row")) & (F.col("copies") > 1)).select("row", "copies", "sole"), "many_copies")
    bare = tokenised.where(F.col("doc_id").isNotNull()).join(later, "row", "left_anti").join(many, "row", "left")
    reps = bare.select(F.col("doc_id").alias("rep_id"), F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"),
                       F.when(F.col("copies").isNull(), F.col("label")).otherwise(F.col("sole")).alias("sole_label"), "terms", "counts")
    vocab = reps.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("df"))
    vocab = materialise(vocab.withColumn("idf", _idf(F.col("df"), n_docs)), "vocab")
    vectors = materialise(unit_vectors(_once(reps).where(F.size("terms") > 0), vocab), "vectors", compression="zstd")
    return TextIndex(doc_map.select("doc_id", "label", "rep_id"), vocab.select("term", "df", "idf"), vectors, size)


def _idf(df: Column, n_docs: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def _once(reps: DataFrame) -> DataFrame:
    """A doc_id that comes with several texts has their terms together."""
    several = materialise(reps.groupBy("rep_id").agg(F.count("*").alias("n")).where("n > 1").select("rep_id"), "several_texts")
    if several.isEmpty():
        return reps
    entries = reps.join(several, "rep_id", "left_semi").select(
        "rep_id", "copies", F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("rep_id", F.col("e.terms").alias("term")).agg(
        F.sum("e.counts").alias("tf"), F.max("copies").alias("copies"))
    merged = entries.groupBy("rep_id").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("e"))
    return reps.join(several, "rep_id", "left_anti").unionByName(
        merged.select("rep_id", "copies", F.lit(None).cast(reps.schema["sole_label"].dataType).alias("sole_label"),
                      F.col("e.term").alias("terms"), F.col("e.tf").alias("counts")))


def _counted(df: DataFrame) -> DataFrame:
    """Sorted ``tokens`` to the different terms, how often each occurs, and a digest of the bag."""
    at = lambda i: F.element_at("tokens", i)
    starts = F.when(F.size("tokens") > 0, F.filter(
        F.sequence(F.lit(1), F.size("tokens")), lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))).otherwise(
        F.array().cast("array<int>"))
    bag = F.sha2(F.array_join("tokens", " "), 256).alias("bag")
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("tokens") + 1))
    return df.select("doc_id", "label", "tokens", bag, starts.alias("starts")).select(
        "doc_id", "label", "bag", F.transform("starts", lambda i: at(i)).alias("terms"),
        F.when(F.size("starts") > 0, F.zip_with("starts", ends, lambda a, b: (b - a).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")).alias("counts"))


def transform_tfidf(queries: DataFrame, index: TextIndex, stop_words: Sequence[str] = (),
                    mode: str = "words", term_array: Column | None = None,
                    extra: Sequence[str] = ()) -> DataFrame:
    """Vectors of ``queries(query_id, text)`` in the terms of the index.

    Unknown terms are dropped; a query without a known term has no vector.
    """
    terms = term_array if term_array is not None else index_terms(tokens("text", mode, stop_words))
    counts = materialise(
        spread(queries).select("query_id", *extra, F.explode(terms).alias("term"))
        .groupBy("query_id", *extra, "term").agg(F.count("*").alias("tf")), "query_counts")
    used = counts.groupBy("term").agg(F.count("*").alias("rows"))
    known = used.join(index.vocab.select("term", "idf"), "term")
    weighted = lookup(counts, known, "term", "query_id", "rows").select(
        "query_id", *extra, "term", (F.col("tf") * F.col("idf")).alias("w"))
    return materialise(_unit_vectors(weighted, "query_id", extra), "query_vectors")


def label_terms(docs: DataFrame, col: str = "text") -> DataFrame:
    """Every list item of a label once, in order of first appearance.

    ``(label, place, item)`` rows rather than one joined text, because a label
    may own most of the documents.
    """
    items = docs.select("label", "doc_id", F.posexplode(split_list_field(col)).alias("pos", "item"))
    first = items.groupBy("label", "item").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"))
    return position(first, [F.col("first")], "place", within=["label"]).select(
        "label", "place", "item")


def label_term_text(docs: DataFrame, col: str = "text", separator: str = " ; ") -> DataFrame:
    """``(label, terms)``: the items of ``label_terms`` as one text per label.

    One text holds every different item of its label; take ``label_terms``
    where that may be too much for a row.
    """
    placed = label_terms(docs, col).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("p"))
    return placed.select("label", F.array_join(F.transform("p", lambda x: x["item"]), separator).alias("terms"))
