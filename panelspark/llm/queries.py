"""The queries of the numbered operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (burst_trie, divergence, fingerprint, gru_lm, jaccard_join, kd_shards, lines, minhash_forest, mixing, packing,
                            quality, substring, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where there is one."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_kd_shards(spark, sf_dir):
    """Tested by its law and against a plain k-d tree: SQL cannot recurse over weighted medians."""
    return kd_shards.kd_shards(documents(spark, sf_dir), 40)


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS total,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (
  SELECT *, coalesce(sum(3 * total) OVER before, 0) AS used, sum(weight) OVER rest AS open,
    (sum(total) OVER () - coalesce(sum(3 * total) OVER before, 0)) / sum(weight) OVER rest AS share FROM s
  WINDOW before AS (ORDER BY 3 * total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY 3 * total / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT min_by(share, 3 * total / weight) AS share FROM r WHERE 3 * total >= share * weight),
t AS (SELECT source, total, least(3 * total, share * weight) AS target FROM s, f),
p AS (SELECT d.*, CAST(total AS BIGINT) AS source_size, target, row_number() OVER (PARTITION BY d.source
    ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS place,
    CASE WHEN total > 0 THEN least(target / total, 3.0) ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target, copies, copies * size AS taken FROM (
  SELECT *, CAST(floor({mixing.offset_of(20)!r} + place * rate) - floor({mixing.offset_of(20)!r} + (place - 1) * rate)
    AS BIGINT) AS copies FROM p)
"""


@query(MIX_SQL)
def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select(
        "doc_id", "size", "source", "source_size", "target", "copies", "taken")


@query()
def op8_quality_rules(spark, sf_dir):
    """Tested against a plain computation: the concentration steps are a loop."""
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, i, x, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
j AS (SELECT l.*, b.line IS NOT NULL AND l.doc_id <> b.first_doc AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query(LINES_SQL)
def op9_line_spread(spark, sf_dir):
    return lines.judge_lines(documents(spark, sf_dir)).select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest([w[i:i + 4] FOR i IN range(1, greatest(len(w) - 3, 2))]) AS shingle FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM s a JOIN s b ON a.shingle = b.shingle
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * joint >= 4 * (x.n + y.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, min(r.b) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links FROM r GROUP BY r.a
"""


@query(JACCARD_SQL)
def op3_chosen_path_join(spark, sf_dir):
    return jaccard_join.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


SUBSTRING_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS low FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (
  SELECT s.doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN m ON s.h = m.h WHERE low < doc_id) GROUP BY doc_id),
k AS (SELECT w.doc_id, count(x.word) AS n_words, count(x.word) FILTER (WHERE gone IS NOT NULL AND list_contains(gone, x.i)) AS n_removed,
    string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE gone IS NULL OR NOT list_contains(gone, x.i)) AS kept
  FROM w LEFT JOIN (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) x ON w.doc_id = x.doc_id
  LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""


@query(SUBSTRING_SQL)
def op4_repeated_spans(spark, sf_dir):
    return substring.repeated_spans(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op5_pattern_packing(spark, sf_dir):
    """Tested by round trip and against the least possible number of sequences: SQL has no tokenizer."""
    return packing.pack(documents(spark, sf_dir))


@query()
def op10_compression_toxicity(spark, sf_dir):
    """Tested by accuracy on held-out labels: SQL has no compressor."""
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op6_order_min_hash(spark, sf_dir):
    """Tested against plain Python: SQL engines do not share a 64-bit hash."""
    return fingerprint.compare_with_next(documents(spark, sf_dir))


@query()
def op7_gru_language_model(spark, sf_dir):
    """Tested by counting and by held-out likelihood: SQL trains no network."""
    return gru_lm.score_documents(documents(spark, sf_dir))


DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d)
  GROUP BY ALL HAVING count(*) >= {divergence.MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
g AS (SELECT DISTINCT d.lang, source, coalesce(terms, 0) AS terms FROM d LEFT JOIN v ON d.lang = v.lang),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d)
  SEMI JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, g.terms, k.term, coalesce(n.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * terms) AS p FROM c),
l AS (SELECT lang, term, sum(n) AS n, any_value(terms) AS terms FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * terms) AS q FROM l),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a
  JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a
  JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p
  JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM y
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM z)
WHERE rank <= {divergence.TOP_TERMS}
"""


@query(DIVERGENCE_SQL)
def op13_source_divergence(spark, sf_dir):
    return divergence.source_divergence(documents(spark, sf_dir))


TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, o: CASE WHEN o >= 0 THEN xor(x, o) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) % 9 AS h FROM c),
b AS (SELECT h.conv_id, list_concat(coalesce(c.own[1:h], []), h.own[h + 1:]) AS s
  FROM h LEFT JOIN c ON c.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM b),
m AS (SELECT conv_id, depth, depth = len(s) AS over, strlen(s[depth].text) AS size,
    CASE WHEN depth = 0 THEN '' ELSE md5(to_json(s[1:depth])) END AS node,
    CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN '' ELSE md5(to_json(s[1:depth - 1])) END AS up FROM p),
g AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS first, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
k AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
    (n_convs - 1) * coalesce(size, 0) AS saved FROM g LEFT JOIN k ON g.node = k.node),
d AS (SELECT m.node, sum(coalesce(leaf, 0)) OVER below AS leaves, sum(coalesce(saved, 0)) OVER below AS saved
  FROM m LEFT JOIN v ON v.node = m.node AND v.first = m.conv_id
  WINDOW below AS (PARTITION BY m.conv_id ORDER BY m.depth DESC)),
e AS (SELECT node, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens FROM d GROUP BY node)
SELECT v.first AS conv_id, v.depth, u.first AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN e ON v.node = e.node LEFT JOIN v u ON u.node = v.up
"""


@query(TRIE_SQL)
def op11_burst_trie(spark, sf_dir):
    return burst_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, unnest([w[i:i + 4] FOR i IN range(1, greatest(len(w) - 3, 2))]) AS shingle FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM s a JOIN s b ON a.shingle = b.shingle
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * joint >= {minhash_forest.PERCENT} * (x.n + y.n - joint)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


@query(NEAR_SQL)
def op12_minhash_forest(spark, sf_dir):
    return minhash_forest.near_duplicates(documents(spark, sf_dir))
