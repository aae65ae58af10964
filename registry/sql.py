"""SQL text shared by the text queries."""

# The most frequent function words of the test texts.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "that", "is", "for", "it", "with", "as", "on", "at", "by",
    "der", "die", "und", "das", "den", "von", "ist", "des", "mit", "sich",
    "el", "los", "las", "del", "que", "una", "por", "con", "para", "se",
    "le", "les", "des", "et", "dans", "est", "un", "une", "pour", "qui",
]

STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SPLIT = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')"
WORDS = f"list_filter({SPLIT}, lambda t: t <> '' AND t NOT IN ({STOP}))"
TERMS = f"list_filter({SPLIT}, lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"
ALPHA = (r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\s]', '', 'g'),"
         r" '\s+'), lambda t: t <> '')")


def soundex(w: str) -> str:
    """American Soundex of a word expression; a word that starts with no letter is left alone."""
    digits = ("translate(regexp_replace(w2, '[^a-z]', 'a', 'g'), "
              "'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')")
    for n in "123456":
        digits = f"regexp_replace({digits}, '{n}+', '{n}', 'g')"
    rest = f"replace(substr({digits}, 2), '0', '')"
    code = f"upper({w}[1]) || substr(rpad({rest}, 3, '0'), 1, 3)"
    slim = f"(substr({w}, 1, 1) || regexp_replace(substr({w}, 2), '[hw]', '', 'g'))"
    return code.replace("w2", slim)


# the documents as an index: terms, vocabulary and unit weights
INDEX = f"""
tok AS (SELECT doc_id, lang AS label, {TERMS} AS toks FROM documents),
tf AS (SELECT doc_id, label, term, count(*) AS tf FROM
  (SELECT doc_id, label, unnest(toks) AS term FROM tok) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df,
  ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM tf GROUP BY term),
wts AS (SELECT doc_id, label, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
post AS (SELECT doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wts)
"""

# vectors of the benchmark texts in the terms of that index
QUERY_VECTORS = f"""
qtf AS (SELECT query_id, term, count(*) AS tf FROM
  (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
qw AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN vocab USING (term)),
q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qw)
"""

# their five nearest documents, and the label those vote for
NEAREST = """
dots AS (SELECT query_id, doc_id, label, round(sum(q.weight * post.weight), 9) AS score
  FROM q JOIN post USING (term) GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place
  FROM dots QUALIFY place <= 5),
votes AS (SELECT query_id, label, count(*) AS votes FROM near GROUP BY ALL),
pred AS (SELECT query_id, label, votes, votes / sum(votes) OVER (PARTITION BY query_id) AS share
  FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1)
"""

INDEXED = "WITH" + INDEX + "," + QUERY_VECTORS + "," + NEAREST


def in_test(key: str, share: float = 0.2, seed: int = 42) -> str:
    return (f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
            f" % 10000 < {round(share * 10000)}")
