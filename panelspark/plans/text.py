"""From labelled texts and a table of queries to labelled, scored answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import index_terms, suggestion, tokens
from panelspark.operators import similar, spell
from panelspark.operators.text import TextIndex, fit_tfidf, label_terms, normalise_terms, transform_tfidf
from panelspark.session import materialise


def classify_texts(queries: DataFrame, docs: DataFrame, index: TextIndex, k: int,
                   attributes: Sequence[str] = (), stop_words: Sequence[str] = (),
                   means: DataFrame | None = None) -> DataFrame:
    """Label every query by its ``k`` nearest documents.

    Clean, correct each word that sounds like its nearest index term, vote,
    attach the attributes of the label's first document and the cosine to the
    label's mean vector (``means``, where the caller has them).  ``suggestion`` holds the corrected text where it differs.
    """
    prepared = queries.select("query_id", tokens("text", "words", stop_words).alias("tokens"))
    corrected = materialise(
        spell.correct_phonetic(prepared, "query_id", "tokens", index.vocab.select("term")), "corrected")
    vectors = transform_tfidf(corrected, index, term_array=index_terms(F.col("tokens")))
    votes = materialise(similar.vote(similar.nearest_docs(vectors, index, k)), "votes")
    centre = similar.centroid_cosine(
        vectors.join(votes.select("query_id", "label"), "query_id"), similar.centroids(index) if means is None else means)
    first = similar.first_row_per_key(docs.select("doc_id", "label", *attributes), "label")
    texts = prepared.select("query_id", F.array_join("tokens", " ").alias("before")).join(
        corrected.select("query_id", F.array_join("tokens", " ").alias("after")), "query_id")
    return (texts.select("query_id", suggestion("before", "after").alias("suggestion"))
            .join(votes.select("query_id", "label", "share"), "query_id", "left")
            .join(centre.select("query_id", F.col("score").alias("similarity")), "query_id", "left")
            .join(first.select("label", *attributes), "label", "left")
            .select("query_id", "suggestion", "label", "share", "similarity", *attributes))


@dataclass(frozen=True)
class Analysis:
    """One row per query, and the list items of every predicted label."""

    results: DataFrame
    terms: DataFrame


def prepare_alpha(df: DataFrame, key: str, vocabulary: DataFrame, stop_words: Sequence[str] = (),
                  lexicon: DataFrame | None = None) -> DataFrame:
    """Letters only, corrected against the vocabulary, without stop words, in base form.

    Correction comes before the stop words go, as a stop word may be misspelt.
    """
    raw = df.withColumn("tokens", tokens("text", "alpha")).drop("text")
    fixed = spell.correct_vocab(raw, key, "tokens", vocabulary)
    if stop_words:
        words = list(stop_words)
        fixed = fixed.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(words)))
    return normalise_terms(fixed, key, "tokens", lexicon) if lexicon is not None else fixed


def analyse_texts(queries: DataFrame, docs: DataFrame, catalogue: DataFrame, vocabulary: DataFrame,
                  k: int, attributes: Sequence[str], stop_words: Sequence[str] = (),
                  lexicon: DataFrame | None = None) -> Analysis:
    """Label every query and score it against the documents of its label.

    Scores: share of the votes, largest TF-IDF cosine, largest phonetic
    similarity, largest overlap in percent.  The catalogue gives the attributes;
    ``found`` tells whether it knows the label.
    """
    vocabulary = materialise(vocabulary, "vocabulary")
    known = materialise(prepare_alpha(docs, "doc_id", vocabulary, stop_words, lexicon)
                        .select("doc_id", "label", "tokens"), "prepared", compression="zstd")
    index = fit_tfidf(known, term_array=index_terms(F.col("tokens")))
    asked = prepare_alpha(queries, "query_id", vocabulary, stop_words, lexicon)
    vectors = transform_tfidf(asked, index, term_array=index_terms(F.col("tokens")))
    votes = materialise(similar.vote(similar.nearest_docs(vectors, index, k)), "votes")
    labelled = votes.select("query_id", "label")
    texts = queries.select("query_id", "text").join(labelled, "query_id")
    results = (queries.select("query_id")
               .join(votes.select("query_id", "label", F.col("share").alias("confidence")), "query_id", "left"))
    for name, scores in (
            ("cosine", similar.best_cosine(vectors.join(labelled, "query_id"), index)),
            ("phonetic", similar.best_phonetic(texts, docs)),
            ("overlap_percent", similar.best_overlap(texts, docs))):
        results = results.join(scores.withColumnRenamed("score", name), "query_id", "left")
    results = similar.attach_attributes(results, catalogue, attributes)
    return Analysis(results, label_terms(similar.rows_of_label(votes, docs)))
