"""Text queries: cleaning, index, spelling, neighbours, scores, quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.operators import metrics, similar, spell, text
from panelspark.session import materialise, work_root
from panelspark.sources import tables
from registry.book import query
from registry.sql import (ALPHA, INDEX, INDEXED, QUERY_VECTORS, STOP_WORDS, STOP, TERMS, WORDS, in_test,
                          soundex)
from registry.tables import six, table


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text")


def benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_FITTED: dict[tuple[str, str], text.TextIndex] = {}


def index(spark, d):
    """The index of all documents; its tables are written once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = text.fit_tfidf(documents(spark, d), STOP_WORDS)
    return _FITTED[key]


def forget():
    """Drop what is kept between queries."""
    _FITTED.clear()
    _HELD_OUT.clear()


def indexed(spark, d):
    """The index of the documents and the benchmark texts as its vectors."""
    ix = index(spark, d)
    return ix, text.transform_tfidf(benchmark(spark, d), ix, STOP_WORDS)


# --------------------------------------------------------------- cleaning

@query(f"SELECT doc_id, array_to_string({WORDS}, ' ') AS cleaned FROM documents")
def clean_text_words(spark, d):
    return documents(spark, d).select(
        "doc_id", C.clean_text("text", "words", STOP_WORDS).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string({ALPHA}, ' ') AS cleaned FROM documents")
def clean_text_alpha(spark, d):
    return documents(spark, d).select("doc_id", C.clean_text("text", "alpha").alias("cleaned"))


@query(rf"""SELECT doc_id, array_to_string(list_filter(
    regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'),
    lambda t: regexp_full_match(t, '\p{{L}}+') AND t NOT IN ({STOP})), ' ') AS cleaned FROM documents""")
def clean_text_isalpha(spark, d):
    return documents(spark, d).select(
        "doc_id", C.clean_text("text", "isalpha", STOP_WORDS).alias("cleaned"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(
    regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda t: t <> ''), ' ') AS cleaned
  FROM conversations""")
def clean_text_punct(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", C.clean_text("text", "punct").alias("cleaned"))


LEXICON = f"""lexicon AS (SELECT DISTINCT term, regexp_replace(term, '(ing|s)$', '') AS base FROM
  (SELECT unnest({TERMS}) AS term FROM benchmark) WHERE regexp_matches(term, '.(ing|s)$'))"""


@query("WITH " + LEXICON + f""", words AS (SELECT doc_id, unnest({TERMS}) AS term,
    generate_subscripts({TERMS}, 1) AS pos FROM documents),
  based AS (SELECT doc_id, pos, coalesce(base, term) AS base FROM words LEFT JOIN lexicon USING (term))
  SELECT doc_id, coalesce(string_agg(base, ' ' ORDER BY pos), '') AS cleaned
  FROM documents LEFT JOIN based USING (doc_id) GROUP BY doc_id""")
def normalise_terms(spark, d):
    term = F.explode(C.index_terms(C.tokens("text", stop_words=STOP_WORDS))).alias("term")
    lexicon = (table(spark, d, "benchmark").select(term).distinct()
               .where(F.col("term").rlike(".(ing|s)$"))
               .withColumn("base", F.regexp_replace("term", "(ing|s)$", "")))
    docs = documents(spark, d).select(
        "doc_id", C.index_terms(C.tokens("text", stop_words=STOP_WORDS)).alias("tokens"))
    return text.normalise_terms(docs, "doc_id", "tokens", lexicon).select(
        "doc_id", F.array_join("tokens", " ").alias("cleaned"))


CODES = f"list_transform(list_filter({WORDS}, lambda t: regexp_matches(t, '^[a-z]')), lambda t: {soundex('t')})"


@query(f"SELECT conv_id, turn, array_to_string({CODES}, ' ') AS codes FROM conversations")
def phonetic_codes(spark, d):
    words = C.tokens("text", stop_words=STOP_WORDS)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(C.soundex_codes(words), " ").alias("codes"))


WORD_LIST = f"w AS (SELECT doc_id, {WORDS} AS toks FROM documents)"


@query(f"""WITH {WORD_LIST} SELECT doc_id, array_to_string(list_transform(
     generate_series(1, len(toks) - 1), lambda i: toks[i] || '_' || toks[i + 1]), ' ') AS pairs FROM w""")
def bigrams(spark, d):
    words = documents(spark, d).select(
        "doc_id", C.tokens("text", stop_words=STOP_WORDS).alias("toks"))
    return words.select("doc_id", F.array_join(C.bigrams(F.col("toks")), " ").alias("pairs"))


@query(f"""WITH {WORD_LIST} SELECT doc_id, array_to_string(list_concat(list_concat(toks,
     list_transform(list_filter(toks, lambda t: regexp_matches(t, '^[a-z]')), lambda t: {soundex('t')})),
     list_transform(generate_series(1, len(toks) - 1), lambda i: toks[i] || '_' || toks[i + 1])), ' ')
   AS features FROM w""")
def feature_tokens(spark, d):
    words = documents(spark, d).select(
        "doc_id", C.tokens("text", stop_words=STOP_WORDS).alias("toks"))
    return words.select("doc_id", F.array_join(C.feature_tokens(F.col("toks")), " ").alias("features"))


@query(r"""SELECT doc_id, len(items) AS n, array_to_string(items, '|') AS items FROM
  (SELECT doc_id, regexp_split_to_array(text, ',\s*|\s+and\s+') AS items FROM documents)""")
def split_list_field(spark, d):
    items = C.split_list_field("text")
    return documents(spark, d).select("doc_id", F.size(items).cast("bigint").alias("n"),
                                      F.array_join(items, "|").alias("items"))


@query(r"""WITH parts AS (SELECT lang AS label, doc_id, regexp_split_to_array(text, ',\s*|\s+and\s+') AS l
    FROM documents),
  items AS (SELECT label, doc_id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM parts),
  firsts AS (SELECT label, item, min((doc_id, pos)) AS f FROM items GROUP BY ALL)
  SELECT label, item, row_number() OVER (PARTITION BY label ORDER BY f) AS place FROM firsts""")
def label_terms(spark, d):
    return text.label_terms(documents(spark, d))


@query(r"""WITH parts AS (SELECT p_brand AS label, p_partkey AS doc_id, regexp_split_to_array(p_name, ',\s*|\s+and\s+') AS l FROM part),
  items AS (SELECT label, doc_id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM parts),
  firsts AS (SELECT label, item, min((doc_id, pos)) AS f FROM items GROUP BY ALL)
  SELECT label, string_agg(item, ' ; ' ORDER BY f) AS terms FROM firsts GROUP BY label""")
def label_term_text(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("label"), F.col("p_name").alias("text"))
    return text.label_term_text(parts)


# ------------------------------------------------------------------ index

@query("WITH" + INDEX + "SELECT doc_id, term, round(weight, 6) AS weight FROM post")
def fit_tfidf(spark, d):
    ix = text.fit_tfidf(documents(spark, d), STOP_WORDS)
    entries = text.postings(ix.docs.join(ix.vectors, "rep_id"), "doc_id")
    return entries.withColumn("weight", six("weight"))


@query("WITH" + INDEX + "," + QUERY_VECTORS + "SELECT query_id, term, round(weight, 6) AS weight FROM q")
def transform_tfidf(spark, d):
    _, vectors = indexed(spark, d)
    return text.postings(vectors, "query_id").withColumn("weight", six("weight"))


@query("WITH" + INDEX + "SELECT term, df, round(idf, 6) AS idf FROM vocab")
def saved_text_index(spark, d):
    """The vocabulary of an index that was saved and loaded again."""
    path = f"{work_root(spark)}/{uuid.uuid4().hex}/index"
    index(spark, d).save(path)
    return text.TextIndex.load(spark, path).vocab.withColumn("idf", six("idf"))


# --------------------------------------------------------------- spelling

VOCABULARY = f"""vocab AS (SELECT DISTINCT term FROM (SELECT unnest({ALPHA}) AS term FROM documents) WHERE length(term) >= 2),
  words AS (SELECT DISTINCT unnest({ALPHA}) AS word FROM conversations)"""


def spelling_vocabulary(spark, d):
    """All terms of the documents with two letters or more."""
    terms = F.explode(F.array_distinct(C.tokens("text", "alpha"))).alias("term")
    return documents(spark, d).select(terms).where(F.length("term") >= 2).distinct()


def spoken(spark, d):
    """Conversation turns as token arrays."""
    return table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("key"), C.tokens("text", "alpha").alias("tokens"))


NEAR = f"""WITH {VOCABULARY}, pairs AS (SELECT word, term, levenshtein(word, term) AS edits
    FROM words, vocab WHERE abs(length(word) - length(term)) <= 2),
  near AS (SELECT word, min((edits, term)) AS b FROM pairs WHERE edits <= 2 GROUP BY word)"""


@query(NEAR + "SELECT word, b[2] AS nearest, CAST(b[1] AS INTEGER) AS edits FROM near")
def nearest_terms(spark, d):
    words = spoken(spark, d).select(F.explode("tokens").alias("word")).distinct()
    return spell.nearest_terms(words, spelling_vocabulary(spark, d), 2)


def _corrected_sql(near):
    return near + f""", t AS (SELECT conv_id || ':' || turn AS key, {ALPHA} AS toks FROM conversations),
      e AS (SELECT key, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM t),
      c AS (SELECT key, string_agg(coalesce(new, word), ' ' ORDER BY pos) AS corrected
        FROM e LEFT JOIN fixes USING (word) GROUP BY key)
      SELECT key, coalesce(corrected, '') AS corrected,
        CASE WHEN corrected <> array_to_string(toks, ' ') THEN corrected END AS suggestion
      FROM t LEFT JOIN c USING (key)"""


def _with_suggestion(original, corrected):
    before = original.select("key", F.array_join("tokens", " ").alias("before"))
    after = corrected.select("key", F.array_join("tokens", " ").alias("corrected"))
    return before.join(after, "key").select(
        "key", "corrected", C.suggestion("before", "corrected").alias("suggestion"))


@query(_corrected_sql(NEAR + ", fixes AS (SELECT word, b[2] AS new FROM near)"))
def correct_vocab(spark, d):
    turns = spoken(spark, d)
    return _with_suggestion(turns, spell.correct_vocab(
        turns, "key", "tokens", spelling_vocabulary(spark, d)))


PHRASES = f"""t AS (SELECT item_id AS key, {ALPHA} AS toks FROM benchmark),
  e AS (SELECT key, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM t)"""


@query(f"""WITH {VOCABULARY}, {PHRASES},
   near AS (SELECT word, min((levenshtein(word, term), term)) AS b
     FROM (SELECT DISTINCT word FROM e), vocab GROUP BY word),
   fixes AS (SELECT word, b[2] AS new FROM near WHERE {soundex('word')} = {soundex('b[2]')}),
   c AS (SELECT key, string_agg(coalesce(new, word), ' ' ORDER BY pos) AS corrected
     FROM e LEFT JOIN fixes USING (word) GROUP BY key)
   SELECT key, corrected, CASE WHEN corrected <> array_to_string(toks, ' ') THEN corrected END AS suggestion
   FROM t JOIN c USING (key)""")
def correct_phonetic(spark, d):
    phrases = table(spark, d, "benchmark").select(
        F.col("item_id").alias("key"), C.tokens("text", "alpha").alias("tokens"))
    return _with_suggestion(phrases, spell.correct_phonetic(
        phrases, "key", "tokens", spelling_vocabulary(spark, d)))


# ------------------------------------------------------------- neighbours

@query("WITH" + INDEX + "," + QUERY_VECTORS + """SELECT query_id, doc_id,
   round(sum(q.weight * post.weight), 6) AS score FROM q JOIN post USING (term) GROUP BY ALL""")
def term_dot(spark, d):
    ix, vectors = indexed(spark, d)
    pairs = similar.term_dot(text.postings(vectors, "query_id"), ix.postings)
    return pairs.join(ix.docs, "rep_id").select("query_id", "doc_id", six("score").alias("score"))


@query(INDEXED + """SELECT query_id, CAST(place AS INTEGER) AS place, doc_id, text,
   round(score, 6) AS score FROM near JOIN documents USING (doc_id)""")
def similar_cases(spark, d):
    ix, vectors = indexed(spark, d)
    cases = similar.similar_cases(vectors, ix, documents(spark, d), 5)
    return cases.select("query_id", "place", "doc_id", "text", six("score").alias("score"))


@query(INDEXED + """, c AS (SELECT query_id,
     1 / (1 + avg(sqrt(greatest(2 - 2 * score, 0)))) AS closeness FROM near GROUP BY query_id)
   SELECT query_id, label, CAST(votes AS BIGINT) AS votes, round(share, 6) AS share,
     round(closeness, 6) AS closeness FROM pred JOIN c USING (query_id)""")
def knn_text(spark, d):
    ix, vectors = indexed(spark, d)
    out = similar.knn_text(vectors, ix, 5)
    return out.select("query_id", "label", "votes", six("share").alias("share"),
                      six("closeness").alias("closeness"))


@query(INDEXED + """SELECT query_id, label, round(votes / sum(votes) OVER (PARTITION BY query_id), 6)
   AS share FROM votes""")
def vote_shares(spark, d):
    ix, vectors = indexed(spark, d)
    return similar.vote_shares(similar.nearest_docs(vectors, ix, 5)).withColumn("share", six("share"))


SELF_NEAREST = "WITH" + INDEX + """,
  dots AS (SELECT a.doc_id AS query_id, b.doc_id, b.label, round(sum(a.weight * b.weight), 9) AS score
    FROM post a JOIN post b USING (term) GROUP BY ALL),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place
    FROM dots QUALIFY place <= 20),
  votes AS (SELECT k, query_id, label, count(*) AS n FROM near, generate_series(1, 20) AS g(k)
    WHERE place <= k GROUP BY ALL),
  guess AS (SELECT k, query_id, label FROM votes
    QUALIFY row_number() OVER (PARTITION BY k, query_id ORDER BY n DESC, label) = 1),
  curve AS (SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN g.label = t.label THEN 0.0 ELSE 1.0 END) AS error
    FROM guess g JOIN tok t ON t.doc_id = g.query_id GROUP BY k)
"""


@query(SELF_NEAREST + "SELECT k, round(error, 6) AS error FROM curve")
def knn_error_curve(spark, d):
    return similar.knn_error_curve(index(spark, d)).withColumn("error", six("error"))


@query(SELF_NEAREST + "SELECT min(k) AS k FROM curve WHERE error = (SELECT min(error) FROM curve)")
def best_k_by_error(spark, d):
    return similar.first_minimum(similar.knn_error_curve(index(spark, d)))


@query(SELF_NEAREST + """, g AS (SELECT k, (1 - lead(error) OVER (ORDER BY k)) - (1 - error) AS gain
   FROM curve) SELECT coalesce(min(k) FILTER (WHERE gain < 0.01), max(k)) AS k FROM g""")
def best_k_by_gain(spark, d):
    curve = similar.knn_error_curve(index(spark, d))
    return similar.gain_stop(curve.select("k", (1 - F.col("error")).alias("accuracy")))


@query(INDEXED + """, sizes AS (SELECT label, count(*) AS size FROM tok GROUP BY label),
   cen AS (SELECT label, term, sum(weight) / any_value(size) AS c FROM post JOIN sizes USING (label)
     GROUP BY label, term),
   norms AS (SELECT label, sqrt(sum(c * c)) AS norm FROM cen GROUP BY label)
   SELECT query_id, label, round(coalesce(sum(q.weight * c) / any_value(norm), 0), 6) AS score
   FROM pred JOIN q USING (query_id) JOIN norms USING (label) LEFT JOIN cen USING (label, term)
   GROUP BY query_id, label""")
def centroid_cosine(spark, d):
    ix, vectors = indexed(spark, d)
    predicted = similar.vote(similar.nearest_docs(vectors, ix, 5)).select("query_id", "label")
    out = similar.centroid_cosine(vectors.join(predicted, "query_id"), similar.centroids(ix))
    return out.withColumn("score", six("score"))


@query(INDEXED + """SELECT p.query_id, round(coalesce(max(score), 0), 6) AS score FROM pred p
   LEFT JOIN dots d ON d.query_id = p.query_id AND d.label = p.label GROUP BY p.query_id""")
def best_cosine(spark, d):
    ix, vectors = indexed(spark, d)
    predicted = similar.vote(similar.nearest_docs(vectors, ix, 5)).select("query_id", "label")
    return similar.best_cosine(vectors.join(predicted, "query_id"), ix).withColumn("score", six("score"))


# every conversation turn against the documents of the label that its neighbours predict
TURN_ID = "(conv_id * 4294967296 + turn)"
TURNS_INDEXED = INDEXED.replace("SELECT item_id AS query_id,", f"SELECT {TURN_ID} AS query_id,").replace("FROM benchmark", "FROM conversations")
TURNS = f"t AS (SELECT {TURN_ID} AS query_id, pred.label, text FROM conversations LEFT JOIN pred ON query_id = {TURN_ID})"


def turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * (1 << 32) + F.col("turn")).cast("bigint").alias("query_id"), "text")


def labelled_turns(spark, d):
    ix = index(spark, d)
    vectors = text.transform_tfidf(turns(spark, d), ix, STOP_WORDS)
    predicted = similar.vote(similar.nearest_docs(vectors, ix, 5)).select("query_id", "label")
    return materialise(turns(spark, d).join(predicted, "query_id", "left"), "labelled_turns")


BLANK_SET = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''))"


@query(TURNS_INDEXED + f""", {TURNS},
   aw AS (SELECT query_id, label, unnest({BLANK_SET}) AS w FROM t),
   ds AS MATERIALIZED (SELECT doc_id, lang AS label, {BLANK_SET} AS s FROM documents),
   dw AS (SELECT doc_id, label, unnest(s) AS w, len(s) AS n FROM ds),
   hits AS (SELECT query_id, doc_id, 100.0 * count(*) / any_value(n) AS p
     FROM aw JOIN dw USING (label, w) GROUP BY ALL)
   SELECT query_id, round(coalesce(max(p), 0), 6) AS score FROM t LEFT JOIN hits USING (query_id)
   GROUP BY query_id""")
def best_overlap(spark, d):
    return similar.best_overlap(labelled_turns(spark, d), documents(spark, d)).withColumn("score", six("score"))


@query(INDEXED + f""", pair AS (SELECT query_id, near.doc_id, b.text AS asked, o.text AS held FROM near
     JOIN benchmark b ON item_id = query_id JOIN documents o ON o.doc_id = near.doc_id),
   sets AS (SELECT query_id, doc_id, {BLANK_SET.replace('text', 'asked')} AS a, {BLANK_SET.replace('text', 'held')} AS b FROM pair)
   SELECT query_id, doc_id, round(coalesce(100.0 * len(list_intersect(a, b)) / nullif(len(b), 0), 0), 6) AS percent FROM sets""")
def overlap_percent(spark, d):
    """Each benchmark text against its nearest documents."""
    ix, vectors = indexed(spark, d)
    near = similar.nearest_docs(vectors, ix, 5).select("query_id", "doc_id")
    pairs = near.join(benchmark(spark, d).withColumnRenamed("text", "asked"), "query_id").join(
        documents(spark, d).select("doc_id", F.col("text").alias("held")), "doc_id")
    return pairs.select("query_id", "doc_id", six(C.overlap_percent("asked", "held")).alias("percent"))


SPOKEN_CODES = (r"list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), "
                r"lambda t: regexp_full_match(t, '\p{L}+') AND regexp_matches(t, '^[a-z]')), lambda t: "
                + soundex("t") + ")")


@query(TURNS_INDEXED + f""", {TURNS},
   qc AS (SELECT query_id, label, c, count(*) AS n FROM (SELECT query_id, label,
     unnest({SPOKEN_CODES}) AS c FROM t) GROUP BY ALL),
   dc AS (SELECT doc_id, label, c, count(*) AS n FROM (SELECT doc_id, lang AS label,
     unnest({SPOKEN_CODES}) AS c FROM documents) GROUP BY ALL),
   qs AS (SELECT query_id, sum(n) AS total FROM qc GROUP BY query_id),
   ds AS (SELECT doc_id, sum(n) AS total FROM dc GROUP BY doc_id),
   common AS (SELECT query_id, doc_id, sum(least(qc.n, dc.n)) AS i FROM qc JOIN dc USING (label, c) GROUP BY ALL),
   s AS (SELECT query_id, max(i / (qs.total + ds.total - i)) AS j FROM common JOIN qs USING (query_id)
     JOIN ds USING (doc_id) GROUP BY query_id)
   SELECT query_id, round(coalesce(j, 0), 6) AS score FROM t LEFT JOIN s USING (query_id)""")
def best_phonetic(spark, d):
    return similar.best_phonetic(labelled_turns(spark, d), documents(spark, d)).withColumn("score", six("score"))


# ---------------------------------------------------- lookups by label

CATALOGUE = """catalogue AS (SELECT source AS label, lang, n_chars FROM documents
   QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1)"""


def _sources_wanted(spark, d):
    """One wanted label per customer; some of them are in no catalogue."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("src"), "c_nationkey").alias("label"))


WANTED = "wanted AS (SELECT c_custkey AS query_id, 'src' || c_nationkey AS label FROM customer)"


def _catalogue(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("label"), "lang", "n_chars")


@query(f"""WITH {CATALOGUE}, {WANTED} SELECT query_id, w.label, lang, n_chars, c.label IS NOT NULL AS found
   FROM wanted w LEFT JOIN catalogue c USING (label)""")
def attach_attributes(spark, d):
    return similar.attach_attributes(_sources_wanted(spark, d), _catalogue(spark, d), ["lang", "n_chars"])


@query("SELECT doc_id, lower(trim(source)) AS label, lang, n_chars FROM documents")
def read_catalogue(spark, d):
    return tables.read_catalogue(spark, f"{d}/documents.parquet", "source", ["lang", "n_chars"], "doc_id", "parquet")


@query(f"""WITH {CATALOGUE}, {WANTED} SELECT DISTINCT label FROM wanted
   WHERE label NOT IN (SELECT label FROM catalogue)""")
def missing_labels(spark, d):
    return similar.missing_labels(_sources_wanted(spark, d), _catalogue(spark, d))


@query("""SELECT doc_id, text, lang, source AS label, n_chars FROM documents
   QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""")
def first_row_per_key(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "label")
    return similar.first_row_per_key(docs, "label")


@query(INDEXED + """SELECT doc_id, lang AS label, text FROM documents
   WHERE lang IN (SELECT label FROM pred)""")
def rows_of_label(spark, d):
    ix, vectors = indexed(spark, d)
    predicted = similar.vote(similar.nearest_docs(vectors, ix, 5))
    return similar.rows_of_label(predicted, documents(spark, d)).select("doc_id", "label", "text")


# ---------------------------------------------------------------- quality

@query("SELECT doc_id, " + in_test("doc_id") + " AS held_out FROM documents")
def split_train_test(spark, d):
    train, test = metrics.split_train_test(table(spark, d, "documents").select("doc_id"), "doc_id")
    return (train.withColumn("held_out", F.lit(False))
            .unionByName(test.withColumn("held_out", F.lit(True))))


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents")
def encode_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return metrics.encode_labels(docs, "source").select("doc_id", "source", "label_id")


@query("""SELECT doc_id, lang FROM documents""")
def decode_labels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    coded = metrics.encode_labels(docs, "lang").select("doc_id", "label_id")
    return metrics.decode_labels(coded, metrics.label_codes(docs, "lang")).select("doc_id", "lang")


_HELD_OUT: dict[tuple[str, str], DataFrame] = {}


def held_out_neighbours(spark, d):
    """Truth of the held-out documents and their neighbours among the others."""
    key = (spark.sparkContext.applicationId, d)
    train, test = metrics.split_train_test(documents(spark, d), "doc_id")
    if key not in _HELD_OUT:
        ix = text.fit_tfidf(train, STOP_WORDS)
        vectors = text.transform_tfidf(test.select(F.col("doc_id").alias("query_id"), "text"), ix, STOP_WORDS)
        _HELD_OUT[key] = materialise(similar.nearest_docs(vectors, ix, 5), "neighbours")
    return test.select(F.col("doc_id").alias("query_id"), "label"), _HELD_OUT[key]


def held_out_predictions(spark, d):
    truth, near = held_out_neighbours(spark, d)
    guesses = similar.vote(near).select("query_id", F.col("label").alias("predicted"))
    return truth.join(guesses, "query_id", "left")


HELD_OUT = "WITH" + INDEX.replace("FROM documents),\ntf", f"FROM documents WHERE NOT ({in_test('doc_id')})),\ntf").replace(
    "(SELECT count(*) FROM documents)", "(SELECT count(*) FROM tok)") + f""",
  truth AS (SELECT doc_id AS query_id, lang AS actual, text FROM documents WHERE {in_test('doc_id')}),
  qtf AS (SELECT query_id, term, count(*) AS tf FROM
    (SELECT query_id, unnest({TERMS}) AS term FROM truth) GROUP BY ALL),
  qw AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN vocab USING (term)),
  q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qw),
  """ + INDEXED.split(QUERY_VECTORS + ",")[1] + """,
  p AS (SELECT t.query_id, t.actual, pred.label AS predicted FROM truth t LEFT JOIN pred USING (query_id))"""


@query(HELD_OUT + """, labels2 AS (SELECT actual AS c FROM p UNION SELECT predicted FROM p WHERE predicted IS NOT NULL),
   per AS (SELECT c, count(*) FILTER (WHERE actual = c) AS sup, count(*) FILTER (WHERE predicted = c) AS pre,
     count(*) FILTER (WHERE actual = c AND predicted = c) AS tp FROM labels2, p GROUP BY c),
   r AS (SELECT sup, tp, coalesce(tp / nullif(pre, 0), 0) AS pr, coalesce(tp / nullif(sup, 0), 0) AS re FROM per)
   SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(pr * sup) / sum(sup), 6) AS precision,
     round(sum(re * sup) / sum(sup), 6) AS recall,
     round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * sup) / sum(sup), 6) AS f1 FROM r""")
def classification_metrics(spark, d):
    out = metrics.classification_metrics(held_out_predictions(spark, d))
    return out.select([six(c).alias(c) for c in out.columns])


@query(HELD_OUT + """, shares AS (SELECT query_id, label, votes / sum(votes) OVER (PARTITION BY query_id) AS s FROM votes),
   pos AS (SELECT s.label, actual FROM shares s JOIN truth USING (query_id) WHERE s >= 0.5),
   labels2 AS (SELECT actual AS label FROM truth UNION SELECT label FROM pos),
   per AS (SELECT label, (SELECT count(*) FROM truth WHERE actual = l.label) AS sup,
     (SELECT count(*) FROM pos WHERE pos.label = l.label) AS pre,
     (SELECT count(*) FROM pos WHERE pos.label = l.label AND actual = l.label) AS tp FROM labels2 l),
   r AS (SELECT label, sup, pre, tp, coalesce(tp / nullif(pre, 0), 0) AS pr,
     coalesce(tp / nullif(sup, 0), 0) AS re, (SELECT count(*) FROM truth) AS n FROM per)
   SELECT label, round((n - (pre + sup - 2 * tp)) / n, 6) AS accuracy, round(pr, 6) AS precision,
     round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM r""")
def label_metrics(spark, d):
    truth, near = held_out_neighbours(spark, d)
    out = metrics.label_metrics(similar.vote_shares(near), truth)
    return out.select("label", *[six(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(HELD_OUT + """SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy
   FROM p""")
def model_accuracy(spark, d):
    return metrics.model_accuracy(held_out_predictions(spark, d)).select(
        six("accuracy").alias("accuracy"))
