import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.operators import metrics, search, similar, spell, text
from panelspark.operators.blocks import meet
from panelspark.operators.kernels import sparse_top_k
from panelspark.plans.text import analyse_texts, classify_texts
from panelspark.streaming.answers import answer_stream

DOCS = [(1, "flu", "fever, cough and sore throat"), (2, "flu", "cough, fever"), (3, "cold", "runny nose, cough"),
        (4, "heart", "chest pain, sweating and nausea"), (5, "cold", "cough, fever"), (6, "empty", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, label string, text string")


@pytest.fixture(scope="module")
def index(docs):
    return text.fit_tfidf(docs, ["and"])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def dense_vectors():
    bags = {i: Counter(t for t in s.replace(",", " ").split() if len(t) > 1 and t != "and") for i, _, s in DOCS}
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for i, b in bags.items():
        w = {t: c * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1) for t, c in b.items()}
        n = math.sqrt(sum(x * x for x in w.values())) or 1
        out[i] = {t: x / n for t, x in w.items()}
    return out


def test_tokens(spark):
    df = spark.createDataFrame([("Été_1 the  don't A1!",)], "text string")
    got = df.select(C.clean_text("text", "words", ["the"]), C.clean_text("text", "alpha"),
                    C.clean_text("text", "isalpha"), C.clean_text("text", "punct")).first()
    assert tuple(got) == ("été_1 don t a1", "t the dont a", "the don t", "été_1 the don t a1")


def test_short_token_lists(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "t array<string>")
    assert [r[0] for r in df.select(C.bigrams(F.col("t"))).collect()] == [[], [], ["a_b", "b_c"]]
    assert df.select(C.feature_tokens(F.col("t"))).collect()[2][0] == ["a", "b", "c", "A000", "B000", "C000", "a_b", "b_c"]


def test_index_weights_and_shared_vectors(index):
    want = dense_vectors()
    got = {r.rep_id: dict(zip(r.terms, r.weights)) for r in index.vectors.collect()}
    assert set(got) == {1, 2, 3, 4}            # 5 shares the vector of 2, 6 has no term
    for i, v in got.items():
        assert v == pytest.approx(want[i])
    assert {r.doc_id: r.rep_id for r in index.docs.collect()}[5] == 2


def test_save_and_load(spark, index, tmp_path):
    path = str(tmp_path / "index")
    assert text.TextIndex.load(spark, path) is None
    index.save(path)
    again = text.TextIndex.load(spark, path)
    assert again.vocab.count() == index.vocab.count() and again.size.first()[0] == 6


def test_neighbours_and_votes(spark, index):
    q = spark.createDataFrame([(10, "cough fever"), (11, "zzz"), (12, "nausea")], "query_id bigint, text string")
    v = text.transform_tfidf(q, index)
    near = similar.nearest_docs(v, index, 3).collect()
    rows = sorted((r.query_id, r.place, r.doc_id) for r in near)
    assert rows == [(10, 1, 2), (10, 2, 5), (10, 3, 1), (12, 1, 4)]
    padded = similar.nearest_docs(v, index, 3, pad=True).where("query_id = 12").orderBy("place").collect()
    assert [r.doc_id for r in padded] == [4, 1, 2]
    best = {r.query_id: (r.label, r.votes) for r in similar.knn_text(v, index, 2).collect()}
    assert best == {10: ("cold", 1), 12: ("heart", 1)}     # a tie goes to the first label
    curve = {r.k: r.error for r in similar.knn_error_curve(index, 2).collect()}
    # documents 2 and 5 are equal, so one of them is mislabelled at k = 1
    assert curve[1] == pytest.approx(1 / 5)


def sparse_table(spark, rng, n, key, terms, unit=True):
    rows = []
    for i in range(n):
        # low numbers are common terms, high ones rare
        t = sorted({str(int(x)) for x in rng.geometric(6 / terms, size=rng.integers(1, 25)) % terms})
        w = rng.random(len(t)) + 0.01
        rows.append((i, t, (w / np.sqrt((w * w).sum()) if unit else w).tolist(), "xyz"[i % 3]))
    return spark.createDataFrame(rows, f"{key} bigint, terms array<string>, weights array<double>, label string")


@pytest.mark.parametrize("unit,match", [(True, False), (False, True)])
def test_max_score_agrees_with_blocks(spark, monkeypatch, unit, match):
    monkeypatch.setattr(search, "FIRST_POSTINGS", 3)
    rng = np.random.default_rng(7)
    docs, asked = sparse_table(spark, rng, 400, "rep_id", 80, unit), sparse_table(spark, rng, 25, "query_id", 100, unit)
    for k in (1, 500):
        got, want = (sorted((r.query_id, r.place, r.rep_id, round(r.score, 8)) for r in f(asked, docs, k, match=match).collect())
                     for f in (search.max_score, similar.block_matches))
        assert got == want


def test_max_score_leaves_common_lists_unread(spark, monkeypatch):
    """One rare term that decides: the list of the common term adds nothing to documents without the rare one."""
    monkeypatch.setattr(search, "FIRST_POSTINGS", 1)
    docs = spark.createDataFrame([(i, ["common", f"own{i}"], [0.1, 0.995]) for i in range(500)] +
                                 [(500 + i, ["common", "rare"], [0.1, 0.995]) for i in range(3)],
                                 "rep_id bigint, terms array<string>, weights array<double>")
    asked = spark.createDataFrame([(1, ["common", "rare"], [0.1, 0.995])], "query_id bigint, terms array<string>, weights array<double>")
    sizes, real = {}, search.materialise
    monkeypatch.setattr(search, "materialise", lambda df, name: sizes.setdefault(name, real(df, name)))
    best = search.max_score(asked, docs, 2)
    assert [(r.rep_id, round(r.score, 6)) for r in best.orderBy("place").collect()] == [(500, 1.000025), (501, 1.000025)]
    unread = sizes["search_split"].where("not read").select("term").collect()
    assert [r.term for r in unread] == ["common"] and sizes["sums"].count() == 3


def test_sums_and_vectors_do_not_move_to_meet_the_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST_POSTINGS", 3)
    rng = np.random.default_rng(7)
    docs, asked = (search.materialise(sparse_table(spark, rng, n, key, 80), key) for n, key in ((400, "rep_id"), (25, "query_id")))
    plans, write = {}, search.materialise

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(search, "materialise", noted)
    assert search.max_score(asked, docs, 3).count() == 75
    # what is open meets two numbers per query, and the vectors meet numbers alone
    assert "BroadcastHashJoin" in plans["open"] and "Exchange hashpartitioning" not in plans["open"]
    assert "BroadcastHashJoin" in plans["asked_vectors"] and "Exchange hashpartitioning" not in plans["asked_vectors"]


def test_means_of_labels_with_and_without_copies(spark):
    rows = [(1, "a", "red green"), (2, "a", "red green"), (3, "b", "red green"), (4, "b", "blue"), (5, None, "blue"), (6, "a", "gold red"),
            (6, "b", "gold blue"), (7, "b", "white"), (8, "b", "white"), (9, None, "black"), (7, "a", None), (None, "c", "white"), (10, "a", None)]
    ix = text.fit_tfidf(spark.createDataFrame(rows, "doc_id bigint, label string, text string"))
    assert {r.rep_id: r.sole_label for r in ix.vectors.collect()} == {1: None, 4: None, 6: None, 7: None, 9: None}
    plain = text.fit_tfidf(spark.createDataFrame([(i, "ab"[i % 2], f"w{i}w common") for i in range(6)] + [(8, "a", "w0w common")],
                                                 "doc_id bigint, label string, text string"))
    assert {r.rep_id: (r.sole_label, r.copies) for r in plain.vectors.collect()} == {0: ("a", 2)} | {i: ("ab"[i % 2], 1) for i in range(1, 6)}
    for index in (ix, plain):
        joined = text.TextIndex(index.docs, index.vocab, index.vectors.drop("sole_label"), index.size)
        got, want = ({(r.label, r.term): r.weight for r in similar.centroids(x).collect()} for x in (index, joined))
        assert got == pytest.approx(want) and want


def test_a_query_list_is_searched_without_blocks(spark, monkeypatch, index):
    monkeypatch.setattr(similar, "meet", None)
    monkeypatch.setattr(similar, "SEARCH_ROWS", 100)
    monkeypatch.setattr(similar, "SEARCH_SHARE", 0)
    asked = text.transform_tfidf(spark.createDataFrame([(10, "cough fever"), (12, "nausea")], "query_id bigint, text string"), index)
    out = similar.knn_text(asked, index, 2)
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().toString()
    assert {r.query_id: r.label for r in out.collect()} == {10: "cold", 12: "heart"}


def test_blocks_agree_with_dense_products(spark):
    rng = np.random.default_rng(3)
    def side(n, key):
        rows = []
        for i in range(n):
            t = sorted(set(rng.integers(0, 30, size=rng.integers(1, 12)).tolist()))
            rows.append((i, [str(x) for x in t], rng.random(len(t)).tolist()))
        return rows, spark.createDataFrame(rows, f"{key} bigint, terms array<string>, weights array<double>")
    d_rows, d = side(150, "rep_id")
    q_rows, q = side(40, "query_id")
    got = meet(d, q, "rep_id", "query_id", F.size("terms"), F.size("terms"), sparse_top_k(5),
               similar.MATCH, doc_entries=100, query_entries=60)
    got = similar.top_within(got, ["query_id"], [F.col("score").desc(), F.col("rep_id")], 5).collect()
    for qi, qt, qw in q_rows:
        weights = dict(zip(qt, qw))
        scores = [(-round(sum(weights.get(t, 0) * w for t, w in zip(dt, dw)), 9), di) for di, dt, dw in d_rows]
        want = [(di, -s) for s, di in sorted(scores)[:5] if s < 0]
        have = [(r.rep_id, r.score) for r in sorted((r for r in got if r.query_id == qi), key=lambda r: r.place)]
        assert [i for i, _ in have] == [i for i, _ in want]
        assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-8)


def test_nearest_terms_against_brute_force(spark):
    rng = np.random.default_rng(5)
    def word():
        return "".join(rng.choice(list("abc"), size=rng.integers(1, 9)))
    vocab, words = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)} | {"a" * 20, "zzzzzz"})
    v = spark.createDataFrame([(t,) for t in vocab], "term string")
    w = spark.createDataFrame([(t,) for t in words], "word string")
    best = {x: min((edit_distance(x, t), t) for t in vocab) for x in words}
    got = {r.word: (r.edits, r.nearest) for r in spell.nearest_terms(w, v, None).collect()}
    assert got == best
    got = {r.word: (r.edits, r.nearest) for r in spell.nearest_terms(w, v, 2).collect()}
    assert got == {x: b for x, b in best.items() if b[0] <= 2}


def test_phonetic_correction_needs_the_nearest_of_all(spark):
    v = spark.createDataFrame([("cough",), ("fever",), ("rough",)], "term string")
    d = spark.createDataFrame([(1, ["coughh", "feaver", "tough", "cough"])], "key bigint, tokens array<string>")
    got = spell.correct_phonetic(d, "key", "tokens", v).first().tokens
    # "tough" is as near to "cough" as to "rough"; neither sounds alike
    assert got == ["cough", "fever", "tough", "cough"]


def test_corrections_keep_empty_texts(spark):
    v = spark.createDataFrame([("fever",)], "term string")
    d = spark.createDataFrame([(1, []), (2, ["fevr", "xxxxxxxxx"])], "key bigint, tokens array<string>")
    got = {r.key: r.tokens for r in spell.correct_vocab(d, "key", "tokens", v).collect()}
    assert got == {1: [], 2: ["fever", "xxxxxxxxx"]}


def test_label_terms_in_order(docs):
    got = [(r.place, r.item) for r in text.label_terms(docs).where("label = 'flu'").orderBy("place").collect()]
    assert got == [(1, "fever"), (2, "cough"), (3, "sore throat")]


def test_phonetic_similarity_counts_repeats(spark):
    q = spark.createDataFrame([(1, "x", "cat cat dog")], "query_id bigint, label string, text string")
    d = spark.createDataFrame([(7, "x", "cat cap"), (8, "y", "cat cat dog")], "doc_id bigint, label string, text string")
    # codes: C300 C300 D200 against C300 C100
    assert similar.best_phonetic(q, d).first().score == pytest.approx(1 / 4)
    assert similar.best_overlap(q, d).first().score == pytest.approx(50.0)


def test_metrics_from_confusion(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "label string, predicted string")
    r = metrics.classification_metrics(p).first()
    assert r.accuracy == pytest.approx(0.5)
    assert r.precision == pytest.approx((2 * 1 + 1 * 0.5) / 4)
    assert metrics.model_accuracy(p).first().accuracy == pytest.approx(0.5)


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(1000)
    a = {r.id for r in metrics.split_train_test(ids, "id")[1].collect()}
    b = {r.id for r in metrics.split_train_test(ids.repartition(13), "id")[1].collect()}
    assert a == b and 150 < len(a) < 250


def test_classify_and_analyse(spark, docs, index):
    q = spark.createDataFrame([(1, "fevver and cough"), (2, "chest pain"), (3, "zzz")], "query_id bigint, text string")
    got = {r.query_id: r for r in classify_texts(q, docs, index, 1, ["text"], ["and"]).collect()}
    assert got[1].suggestion == "fever cough" and got[1].label == "flu"
    assert got[2].label == "heart" and got[2].suggestion is None and got[2].text.startswith("chest")
    assert got[3].label is None
    catalogue = spark.createDataFrame([(1, "flu", "rest")], "doc_id bigint, label string, medication string")
    vocab = spark.createDataFrame([(t,) for t in "fever cough chest pain nausea".split()], "term string")
    out = analyse_texts(q, docs, catalogue, vocab, 1, ["medication"], ["and"])
    rows = {r.query_id: r for r in out.results.collect()}
    assert rows[1].found and rows[1].medication == "rest" and rows[1].cosine == pytest.approx(1.0)
    assert not rows[2].found and rows[2].label == "heart"
    assert {r.label for r in out.terms.collect()} == {"flu", "heart"}


def test_stream_answers_once_per_query(spark, docs, index, tmp_path):
    source, answers = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "cough fever")], "query_id bigint, text string").write.parquet(source)
    stream = spark.readStream.schema("query_id bigint, text string").parquet(source)
    run = (answer_stream(stream, docs, index, 1, answers)
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    run.awaitTermination(120)
    assert [(r.query_id, r.label) for r in spark.read.parquet(answers).collect()] == [(1, "flu")]


def _random_words(seed, n, letters="abrst", longest=9):
    rng = np.random.default_rng(seed)
    return sorted({"".join(rng.choice(list(letters), size=rng.integers(1, longest + 1))) for _ in range(n)})


def test_phonetic_corrections_against_brute_force(spark):
    words, terms = _random_words(1, 150), _random_words(2, 60)
    code = {r.w: r.c for r in spark.createDataFrame([(w,) for w in words + terms], "w string").selectExpr("w", "soundex(w) c").collect()}
    w, v = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in terms], "term string")
    nearest = {x: min((edit_distance(x, t), t) for t in terms) for x in words}
    want = {x: t for x, (_, t) in nearest.items() if code[x] == code[t]}
    assert {r.word: r.new for r in spell.phonetic_corrections(w, v).collect()} == want
    alike = {x: min((edit_distance(x, t), t) for t in terms if code[t] == code[x]) for x in words if any(code[t] == code[x] for t in terms)}
    assert {r.word: (r.edits, r.new) for r in spell.nearest_alike(w, v).collect()} == alike


@pytest.mark.parametrize("reach", [1, 2, 3, 5, 9])
def test_candidates_hold_all_in_reach_and_stay_below_all_pairs(spark, reach):
    words, terms = _random_words(3, 120, "abcdefghij", 12), _random_words(4, 120, "abcdefghij", 12)
    w, v = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in terms], "term string")
    pairs = {(r.word, r.term) for r in spell._candidates(w, v, reach, False).distinct().collect()}
    assert {(x, t) for x in words for t in terms if edit_distance(x, t) <= reach} <= pairs
    assert spell._candidates(w, v, reach, True).distinct().count() < len(words) * len(terms)


def test_words_as_short_as_the_reach(spark):
    """No term within two edits: the alphabetically first of those within three."""
    w = spark.createDataFrame([("abc",), ("xy",), ("",)], "word string")
    v = spark.createDataFrame([("zzz",), ("def",), ("qrstu",)], "term string")
    got = {r.word: (r.edits, r.nearest) for r in spell.nearest_terms(w, v, None).collect()}
    assert got == {"abc": (3, "def"), "xy": (3, "def"), "": (3, "def")}


@pytest.mark.parametrize("sent", [0, 100])
def test_tokens_are_rewritten_where_they_lie(spark, monkeypatch, sent):
    from panelspark.operators import joins
    monkeypatch.setattr(joins, "SENT_KEYS", sent)
    docs = spark.createDataFrame([("x", 1, ["a", "bb", "a", None]), ("y", 2, []), ("z", 3, None), ("w", 4, ["cc", "dd"])], "more string, id int, tokens array<string>")
    changes = spark.createDataFrame([("a", "aa"), ("dd", "d"), ("bb", "bb")], "word string, new string")
    out = text.rewrite_tokens(docs, "id", "tokens", changes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["id", "more", "tokens"] and (sent == 0 or "Join" not in plan and "Exchange" not in plan)
    assert {r.id: (r.more, r.tokens) for r in out.collect()} == {
        1: ("x", ["aa", "bb", "aa", None]), 2: ("y", []), 3: ("z", []), 4: ("w", ["cc", "d"])}


def test_vectors_that_know_their_label_do_not_move(spark):
    rows = [(1, "a", "red blue"), (2, "b", "red blue"), (3, "a", "green red"), (4, "b", "grey blue"), (5, None, "grey"), (6, "a", "red green")]
    ix = text.fit_tfidf(spark.createDataFrame(rows, "doc_id bigint, label string, text string"))
    got = similar.label_vectors(ix)
    assert sorted((r.rep_id, r.label or "") for r in got.collect()) == [(1, "a"), (1, "b"), (3, "a"), (4, "b"), (5, "")]
    assert "Union" in got._jdf.queryExecution().executedPlan().toString()


def test_phonetic_sets_are_sent_once(spark):
    d = spark.createDataFrame([(1, "a", "bob bob tim Bob"), (1, "a", "tim b4"), (2, None, "tim"), (3, "a", None), (4, "a", "7")], "doc_id bigint, label string, text string")
    sets = similar._phonetic_sets(d, "doc_id")
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (sorted(r.terms), r.weights) for r in sets.collect()} == {
        1: (["B100 1", "B100 2", "B100 3", "T500 1", "T500 2"], [1.0] * 5), 2: (["T500 1"], [1.0])}
    assert plan.count("Exchange hashpartitioning") == 1
