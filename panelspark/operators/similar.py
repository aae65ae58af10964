"""Nearest neighbours, votes and similarity scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_column, normalise_label, soundex_codes
from panelspark.operators.blocks import meet
from panelspark.operators.joins import salted_join
from panelspark.operators.kernels import dense_top_k, keep_best
from panelspark.operators.nearest import nearest
from panelspark.operators.panel import top_within
from panelspark.operators.search import greatest_length, max_score, plan_search, read_lists
from panelspark.operators.text import TextIndex, postings
from panelspark.session import materialise, spread

MATCH = "query_id bigint, rep_id bigint, score double"
# a search may add up so many rows for each posting of the documents; blocks move every posting at least once
SEARCH_ROWS = 2
# a list of queries is short up to one of so many of the documents' postings
SEARCH_SHARE = 50


def best_matches(queries: DataFrame, docs: DataFrame, k: int, score: str = "dot",
                 match: bool = False, unlike: bool = False) -> DataFrame:
    """The ``k`` most similar ``docs(rep_id, terms, weights)`` of each query.

    Documents that share nothing with the query are left out.  With ``match``
    both sides carry a ``label`` that must agree, with ``unlike`` one that must not.

    A short list of queries (at most one entry per ``SEARCH_SHARE`` of the
    documents') is answered by ``max_score`` over the postings of its terms,
    unless these lists, each counted once per query that holds the term, come
    to more than ``SEARCH_ROWS`` times the documents' postings.  For longer
    lists, and for other scores than the dot product, blocks of both sides
    meet.  Both ways give the same rows.
    """
    if score == "dot" and not unlike:
        queries = materialise(queries, "queries")  # read for its terms, its weights and its size
        entries = F.coalesce(F.sum(F.size("terms")), F.lit(0))
        asked, held = queries.agg(entries).first()[0], docs.agg(entries).first()[0]
        if asked * SEARCH_SHARE <= held:
            lists = read_lists(queries, docs)
            plan = plan_search(queries, lists, k, greatest_length(docs))
            if plan.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] <= SEARCH_ROWS * held:
                return max_score(queries, docs, k, match, lists, plan)
    return block_matches(queries, docs, k, score, match, unlike)


def block_matches(queries: DataFrame, docs: DataFrame, k: int, score: str = "dot",
                  match: bool = False, unlike: bool = False) -> DataFrame:
    """``best_matches`` by blocks of both sides, all of which meet."""
    found = nearest(queries, docs, k, score, match, unlike)
    return top_within(found, ["query_id"], [F.col("score").desc(), F.col("rep_id")], k)


def _expand(found: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Vectors to documents: equal vectors rank by doc_id, so ``k`` copies are enough."""
    found = materialise(found, "found")  # read for its vectors, too
    asked = docs.join(found.select("rep_id").distinct(), "rep_id", "left_semi")
    members = top_within(asked, ["rep_id"], [F.col("doc_id")], k, "copy")
    return top_within(
        found.select("query_id", "rep_id", "score").join(members, "rep_id")
        .select("query_id", "doc_id", "label", "score"),
        ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def nearest_docs(queries: DataFrame, index: TextIndex, k: int, pad: bool = False) -> DataFrame:
    """``(query_id, place, doc_id, label, score)`` of the ``k`` nearest documents.

    ``score`` is the cosine.  A query that shares terms with fewer than ``k``
    documents has fewer neighbours, unless ``pad`` fills up with the lowest
    doc_ids at score 0, as a dense search would.
    """
    # k rows per query, which most callers read more than once
    found = materialise(_expand(best_matches(queries, index.vectors, k), index.docs, k), "nearest")
    if pad:
        # at most 2k documents, whatever the table
        low = index.docs.orderBy("doc_id").limit(2 * k).agg(
            F.collect_list(F.struct("doc_id", "label"))).scalar()
        fill = (queries.select("query_id", F.explode(low).alias("d"))
                .select("query_id", "d.doc_id", "d.label", F.lit(0.0).alias("score"))
                .join(found, ["query_id", "doc_id"], "left_anti"))
        found = top_within(found.drop("place").unionByName(fill), ["query_id"],
                           [F.col("score").desc(), F.col("doc_id")], k)
    return found.select("query_id", "place", "doc_id", "label", "score")


def vote(neighbours: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Majority label (the alphabetically first on ties), its votes and its share."""
    votes = neighbours.groupBy(*by, "label").agg(F.count("*").alias("votes"))
    return votes.groupBy(*by).agg(
        F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("best"),
        F.sum("votes").alias("n")).select(
        *by, F.col("best.label").alias("label"), (-F.col("best.v")).alias("votes"),
        (-F.col("best.v") / F.col("n")).alias("share"))


def knn_text(queries: DataFrame, index: TextIndex, k: int, pad: bool = False) -> DataFrame:
    """Majority label of the ``k`` nearest documents, with both confidences.

    ``share`` is the share of the votes; ``closeness`` is one over one plus the
    mean Euclidean distance of the unit vectors.
    """
    near = nearest_docs(queries, index, k, pad)
    distance = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
    closeness = near.groupBy("query_id").agg((1 / (1 + F.avg(distance))).alias("closeness"))
    return vote(near).join(closeness, "query_id")


def similar_cases(queries: DataFrame, index: TextIndex, docs: DataFrame, k: int) -> DataFrame:
    """The texts of the ``k`` nearest documents."""
    return nearest_docs(queries, index, k).join(docs.select("doc_id", "text"), "doc_id")


def knn_error_curve(index: TextIndex, k_max: int = 20) -> DataFrame:
    """Share of the indexed documents that ``k`` neighbours mislabel, per ``k``.

    One neighbour table serves every ``k``.  A document counts as its own
    neighbour.  Documents with equal vectors have equal neighbours, so each
    vector is searched once and its documents are counted.
    """
    queries = index.vectors.withColumnRenamed("rep_id", "query_id")
    # the table against itself
    near = materialise(_expand(block_matches(queries, index.vectors, k_max), index.docs, k_max), "neighbours")
    per_k = near.withColumn("k", F.explode(F.sequence(F.col("place"), F.lit(k_max))))
    predicted = vote(per_k, ["query_id", "k"]).select(
        F.col("query_id").alias("rep_id"), "k", F.col("label").alias("predicted"))
    truth = index.docs.groupBy("rep_id", "label").agg(F.count("*").alias("n"))
    wrong = F.when(F.col("predicted") == F.col("label"), F.lit(0)).otherwise(F.col("n"))
    return (predicted.join(truth, "rep_id").groupBy("k")
            .agg((F.sum(wrong) / F.sum("n")).alias("error")))


def first_minimum(curve: DataFrame, x: str = "k", y: str = "error") -> DataFrame:
    return curve.agg(F.min_by(x, F.struct(y, x)).alias(x))


def first_maximum(curve: DataFrame, x: str = "k", y: str = "score") -> DataFrame:
    return curve.agg(F.max_by(x, F.struct(F.col(y), -F.col(x))).alias(x))


def gain_stop(curve: DataFrame, x: str = "k", y: str = "accuracy", least: float = 0.01) -> DataFrame:
    """The last ``k`` before the gain to the next falls under ``least``; else the largest.

    The curve has one row per ``k``; its next value is met by an equi-join.
    """
    later = curve.select((F.col(x) - 1).alias(x), F.col(y).alias("next"))
    small = curve.join(later, x).where(F.col("next") - F.col(y) < least)
    return curve.agg(F.max(x).alias("largest")).select(
        F.coalesce(small.agg(F.min(x)).scalar(), F.col("largest")).alias(x))


def term_dot(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Dot product of every query and document that share a term.

    ``queries(query_id, term, weight)`` and ``docs(rep_id, term, weight)``.  The
    result names every such pair, so this is for short query lists; ranking
    uses ``best_matches``.
    """
    pairs = salted_join(docs, queries.withColumnRenamed("weight", "query_weight"), ["term"], "rep_id")
    return pairs.groupBy("query_id", "rep_id").agg(
        F.sum(F.col("query_weight") * F.col("weight")).alias("score"))


def centroids(index: TextIndex) -> DataFrame:
    """``(label, term, weight)``: mean vector of every label, absent terms as zero.

    Vectors that know their label stay where they lie; only those of copies with
    different labels move to meet them.
    """
    owners = index.docs.groupBy("rep_id", "label").agg(F.count("*").alias("n"))
    sizes = index.docs.groupBy("label").agg(F.count("*").alias("size"))
    owned = ["label", "n", "terms", "weights"]
    if "sole_label" in index.vectors.columns:
        known = index.vectors.select(F.col("sole_label").alias("label"), F.col("copies").alias("n"), "terms", "weights").where("label IS NOT NULL")
        other = index.vectors.where(F.col("sole_label").isNull())
        owned_vectors = known.unionByName(owners.join(other, "rep_id").select(*owned))
    else:  # an index saved without it
        owned_vectors = owners.join(index.vectors, "rep_id").select(*owned)
    entries = postings(owned_vectors, "label", ["n"])
    sums = entries.groupBy("label", "term").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    return materialise(sums.join(sizes, "label").select(
        "label", "term", (F.col("s") / F.col("size")).alias("weight")), "centroids")


def centroid_cosine(queries: DataFrame, means: DataFrame) -> DataFrame:
    """Cosine of unit ``queries(query_id, label, terms, weights)`` and their label's mean."""
    lengths = means.groupBy("label").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    entries = postings(queries, "query_id", ["label"]).withColumnRenamed("weight", "w")
    dots = entries.join(means, ["label", "term"]).groupBy("query_id", "label").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return (queries.select("query_id", "label").join(dots, ["query_id", "label"], "left")
            .join(lengths, "label", "left")
            .select("query_id", "label",
                    F.coalesce(F.col("dot") / F.col("length"), F.lit(0.0)).alias("score")))


def label_vectors(index: TextIndex) -> DataFrame:
    """Vectors once per label that owns a document with them; those that know their label do not move."""
    owners = index.docs.select("rep_id", "label").distinct()
    owned = ["rep_id", "label", "terms", "weights"]
    if "sole_label" not in index.vectors.columns:  # an index saved without it
        return owners.join(index.vectors, "rep_id").select(*owned)
    known = index.vectors.select("rep_id", F.col("sole_label").alias("label"), "terms", "weights").where("label IS NOT NULL")
    return known.unionByName(owners.join(index.vectors.where(F.col("sole_label").isNull()), "rep_id").select(*owned))


def _best_score(queries: DataFrame, docs: DataFrame) -> DataFrame:
    best = block_matches(queries, docs, 1, match=True)
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def best_cosine(queries: DataFrame, index: TextIndex) -> DataFrame:
    """Largest cosine of a query vector and a document of the query's label."""
    return _best_score(queries, label_vectors(index))


def _as_sets(df: DataFrame, key: str, words: Column, per_word: Column) -> DataFrame:
    return df.select(F.col(key), "label", words.alias("terms")).select(
        key, "label", "terms", F.transform("terms", lambda t: per_word).alias("weights"))


def _word_set(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(as_column(c)), r"\s+"), lambda t: t != ""))


def best_overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Largest share, in percent, of a document's words that the query holds.

    Over the documents of the query's label: ``queries(query_id, label, text)``,
    ``docs(doc_id, label, text)``.  With weight 1 on the query side and 100 over
    the document's word count on the other, the share is a dot product.
    """
    q = _as_sets(spread(queries), "query_id", _word_set("text"), F.lit(1.0))
    d = _as_sets(spread(docs).select(F.col("doc_id").alias("rep_id"), "label", "text"), "rep_id",
                 _word_set("text"), F.lit(100.0) / F.size("terms"))
    return _best_score(materialise(q, "query_words"), materialise(d, "doc_words", compression="zstd"))


def _phonetic_sets(df: DataFrame, key: str) -> DataFrame:
    """Soundex codes of a text as a set: the second ``B600`` becomes ``B600 2``.

    On such sets the plain Jaccard similarity is the multiset one.
    """
    words = F.filter(F.split(F.lower(as_column("text")), r"\s+"), lambda t: t.rlike(r"^\p{L}+$"))
    at = lambda i: F.element_at("codes", i)
    # a group is the words of one text, sorted: each code is a run
    texts = df.select(F.col(key), "label", soundex_codes(words).alias("codes")).groupBy(key, "label").agg(
        F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes")).where(F.size("codes") > 0)
    starts = texts.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("codes")), lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1))))))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("codes") + 1))
    runs = F.zip_with("starts", ends, lambda a, b: F.transform(F.sequence(F.lit(1), b - a), lambda n: F.concat_ws(" ", at(a), n.cast("string"))))
    return starts.select(key, "label", F.flatten(runs).alias("terms")).withColumn("weights", F.transform("terms", lambda t: F.lit(1.0)))


def best_phonetic(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Largest multiset Jaccard similarity of Soundex codes within the query's label."""
    q = materialise(_phonetic_sets(spread(queries), "query_id"), "query_codes")
    d = materialise(_phonetic_sets(spread(docs).withColumnRenamed("doc_id", "rep_id"), "rep_id"),
                    "doc_codes", compression="zstd")
    best = best_matches(q, d, 1, "jaccard", match=True)
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def first_row_per_key(df: DataFrame, key: str, order: str = "doc_id") -> DataFrame:
    """The first row of every key, by a running minimum rather than a sort."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def attach_attributes(predictions: DataFrame, catalogue: DataFrame,
                      attributes: Sequence[str]) -> DataFrame:
    """Catalogue attributes of each predicted label, and whether the label was found.

    Labels meet trimmed and lower-cased.  A label that occurs twice in the
    catalogue counts with its first row.
    """
    spelt = catalogue.withColumn("_label", normalise_label("label"))
    unique = first_row_per_key(spelt, "_label").select("_label", *attributes, F.lit(True).alias("found"))
    return predictions.join(unique, normalise_label(predictions["label"]) == F.col("_label"), "left").drop("_label").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def missing_labels(predictions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Predicted labels without information."""
    known = catalogue.select(normalise_label("label").alias("_label")).distinct()
    wanted = predictions.select("label").distinct()
    return wanted.join(known, normalise_label(wanted["label"]) == F.col("_label"), "left_anti")


def rows_of_label(predictions: DataFrame, docs: DataFrame) -> DataFrame:
    """All documents of every predicted label."""
    wanted = predictions.select("label").where(F.col("label").isNotNull()).distinct()
    return docs.join(wanted, "label", "left_semi")


def knn_numeric(train: DataFrame, test: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """Majority label of the ``k`` nearest ``train(id, label, ...)`` rows per ``test(id, ...)`` row."""
    vector = F.array(*[as_column(f).cast("double") for f in features])
    points = train.select(F.col("id").alias("rep_id"), "label", vector.alias("features"))
    wanted = test.select(F.col("id").alias("query_id"), vector.alias("features"))
    width = F.lit(len(features))
    found = meet(points.select("rep_id", "features"), wanted, "rep_id", "query_id", width, width,
                 dense_top_k(k), MATCH, merge=keep_best(k, largest=False))
    near = top_within(found, ["query_id"], [F.col("score"), F.col("rep_id")], k)
    return vote(near.join(points.select("rep_id", "label"), "rep_id"))


def vote_shares(neighbours: DataFrame) -> DataFrame:
    """``(query_id, label, share)`` of every label among the neighbours."""
    votes = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    sizes = votes.groupBy("query_id").agg(F.sum("votes").alias("n"))
    return votes.join(sizes, "query_id").select(
        "query_id", "label", (F.col("votes") / F.col("n")).alias("share"))
