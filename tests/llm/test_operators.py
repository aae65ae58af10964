"""Each numbered operator against its plain version, and all of them on awkward tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from panelspark.llm import (fingerprint, gru_lm, jaccard_join, kd_shards, lines, mixing, packing, quality, substring,
                            toxicity)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# 1 -------------------------------------------------------------------------------------------

def test_shards_hold_nearly_equal_bytes(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int") % 90).alias("text"),
                                    F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = kd_shards.kd_shards(docs, 40, slices=8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 40 and size.max() - size.min() <= 6 * 300
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    again = kd_shards.kd_shards(docs.repartition(7), 40, slices=8).toPandas()
    assert got.set_index("doc_id")[["shard", "slot"]].sort_index().equals(again.set_index("doc_id")[["shard", "slot"]].sort_index())


def test_shard_rows_have_size_and_crc(docs, rows):
    got = {r.doc_id: r for r in kd_shards.kd_shards(docs, 4).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        assert (got[doc_id]["size"], got[doc_id].text_crc32, got[doc_id].law, got[doc_id].grown_shard) == (
            len(raw) + 16, zlib.crc32(raw), "bytes", None)


def test_shards_split_equal_metadata(spark):
    """Rows that agree in every dimension but the id are still dealt evenly."""
    docs = spark.range(400).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("text"),
                                   F.lit("en").alias("lang"), F.lit("s").alias("source"))
    got = kd_shards.kd_shards(docs.withColumn("text", F.lpad("text", 5, "x")), 8).groupBy("shard").count().toPandas()
    assert len(got) == 8 and got["count"].max() <= 55


# 2 -------------------------------------------------------------------------------------------

def test_mix_agrees_with_plain(docs, rows):
    wanted = brute.mix([(r[0], r[1], r[3]) for r in rows], mixing.offset_of(20))
    got = {(r.doc_id): (r["size"], r.copies, r.taken) for r in mixing.mix_sources(docs).collect()}
    for doc_id, text, *_ in rows:
        n = len(brute.words(text))
        assert got[doc_id] == (n, wanted[doc_id, text], n * wanted[doc_id, text])


def test_mix_rows_are_taken_as_often(docs):
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect() if r.copies}
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken


def test_mix_targets_of_a_large_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 5 + F.col("id").cast("int") % 40).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    got = mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).toPandas()
    assert (abs(got["k"] - got["t"]) <= np.maximum(50, 0.01 * got["t"])).all()


# 3 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("settings", [{}, {"limit": 4, "depth": 2}])
def test_classes_agree_with_plain(docs, rows, settings):
    wanted = dict(zip([r[0] for r in rows], brute.near_classes([r[:2] for r in rows])))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_classes(docs, **settings).collect()}
    assert got == wanted


def test_large_group_of_near_copies(spark, monkeypatch):
    """More sets than one bucket and one block hold; every link is counted, also across blocks."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60:])) for i in range(90)]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 20)
    wanted = brute.near_classes(rows)
    got = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=8, depth=2).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == dict(zip(range(90), wanted))


def test_runs_follow_from_recall():
    assert jaccard_join.survival(0.8, 1) == pytest.approx(0.84)
    assert 0.2 < jaccard_join.survival(0.8, 8) < jaccard_join.survival(0.8, 5) < 0.6


def test_one_row_of_each_class_stays(docs, rows):
    classes = brute.near_classes([r[:2] for r in rows])
    got = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(got) == sorted({c for c, _ in classes})


# 4 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("window,phrase", [(50, 16), (6, 3)])
def test_spans_agree_with_plain(docs, rows, window, phrase):
    got = {r.doc_id: r for r in substring.repeated_spans(docs, window, phrase).collect()}
    for doc_id, n, removed, kept in brute.repeated([r[:2] for r in rows], window):
        assert (got[doc_id].n_words, got[doc_id].n_removed, got[doc_id].kept_sha256) == (n, removed, sha(kept))
        for s in got[doc_id].spans or []:
            assert s.length >= window and s.reference < doc_id


def test_least_of_neighbours():
    values = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    for width in (1, 2, 5, 32, 35):
        assert (substring.sliding_least(values, width) == [values[i:i + width].min() for i in range(301 - width)]).all()


# 5 -------------------------------------------------------------------------------------------

def check_packing(got, capacity):
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == list(np.cumsum([0, *part["length"][:-1]])) and part["length"].sum() <= capacity


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing_round_trip(docs, rows, capacity):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    packed = packing.pack(docs, capacity, with_ids=True)
    got = packed.toPandas()
    check_packing(got, capacity)
    least = -(-got["length"].sum() // capacity)
    assert got["sequence_id"].nunique() <= 1.02 * least + 2
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        parts = got[got["doc_id"] == doc_id].sort_values("piece")
        assert list(parts["piece"]) == list(range(-(-len(ids) // capacity)))
        assert [x for p in parts["ids"] for x in p] == ids and (parts["length"][1:] == capacity).all()
        for p in parts.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    whole = packing.sequences(packed)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == got["length"].sum()


def test_packing_numbers_pieces_without_a_second_sort(spark, docs):
    sent = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(sent)
    spark.conf.set(sent, "-1")
    try:
        packed = packing.pack(docs, 64)
        steps = packed._jdf.queryExecution().executedPlan().toString()
        got = packed.toPandas()
    finally:
        spark.conf.set(sent, before)
    assert "BroadcastHashJoin" in steps and "SortMergeJoin" not in steps
    check_packing(got, 64)


def test_patterns_fill_sequences_and_use_no_piece_twice():
    histogram = np.bincount(np.random.default_rng(3).integers(1, 64, 20_000), minlength=65)
    planned = packing.plan(histogram, 64)
    used = np.zeros(65, int)
    for lengths, repeats in planned:
        assert sum(lengths) <= 64
        np.add.at(used, list(lengths), repeats)
    assert (used == histogram).all()
    total = (histogram * np.arange(65)).sum()
    assert sum(r for _, r in planned) <= -(-total // 64) * 1.01 + 2


def test_special_string_is_read_as_the_tokenizer_does(spark):
    from tokenizers import Tokenizer
    text = "a <|endoftext|> b"
    got = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), with_ids=True).first()
    assert list(got.ids) == Tokenizer.from_file(packing.TOKENIZER).encode(text, add_special_tokens=False).ids + [2]


# 6 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bucket", [512, 7])
def test_fingerprints_agree_with_plain(docs, rows, bucket):
    got = {r.doc_id: r for r in fingerprint.compare_with_next(docs, bucket).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        own, changed, following = (brute.signature(t, fingerprint) for t in (text, edited, after))
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert r.fingerprint == "".join(f"{x:016x}" for x in own)
        assert r.edited_fingerprint == "".join(f"{x:016x}" for x in changed)
        for near, other in ((r.near_edited, changed), (r.near_next, following)):
            classes = {x >> fingerprint.CLASS_SHIFT for x in own + other}
            assert near == (len(set(own) & set(other)) / len(classes) if classes else 1.0)


def test_order_of_words_counts(spark):
    w = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(w)), (2, " ".join(w[150:] + w[:150])), (3, " ".join(w))]
    got = {r.doc_id: r.signature for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[3]
    shared = len(set(got[1]) & set(got[2])) / fingerprint.CLASSES
    assert 0.2 < shared < 0.8  # the k-mers are nearly the same, half of the pairs have turned round


def test_uneven_ids_still_meet_their_neighbours(spark):
    ids = [0, 10**12] + list(range(5, 400)) + list(range(10**9, 10**9 + 400))
    docs = spark.createDataFrame([(i, f"text {i} and more words here {i * 7}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.compare_with_next(docs, 4).collect()}
    order = sorted(ids, reverse=True)
    text = lambda i: f"text {i} and more words here {i * 7}"
    for a, b in zip(order, order[1:] + order[:1]):
        cut = len(text(a)) // 3
        assert got[a] == sha(text(a)[:len(text(a)) - cut] + text(b)[:cut])


# 7 -------------------------------------------------------------------------------------------

def test_language_model_counts_and_beats_the_unigram(docs, rows):
    from collections import Counter
    from math import log10
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = {r[0]: (r[1] or "").encode().translate(low).split() + [None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    got = gru_lm.score_documents(docs, share=1).collect()
    for r in got:
        own = tokens[r.doc_id]
        base = sum(log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(base)
    assert sum(r.score for r in got) == pytest.approx(sum(r.base_score for r in got), rel=0.02)


def test_language_model_learns_what_a_unigram_cannot(spark):
    """Texts keep to one of two vocabularies; held-out ones are better foreseen by a model with a state."""
    import random
    dice = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{dice.randrange(40)}" for _ in range(120))) for i in range(300)],
                                 "doc_id bigint, text string")
    out = [r for r in gru_lm.score_documents(docs, share=1).collect() if r.held_out]
    assert len(out) > 30
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)


def test_rare_words_are_joined_and_probabilities_add_up(spark, docs, monkeypatch):
    whole = {r.doc_id: r for r in gru_lm.score_documents(docs, rounds=0).collect()}
    monkeypatch.setattr(gru_lm, "FREQUENT", gru_lm.GROUPS * gru_lm.GROUP_WORDS)
    for r in gru_lm.score_documents(docs, rounds=0).collect():
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.n_known == whole[r.doc_id].n_known
        assert r.score == pytest.approx(whole[r.doc_id].score)
    known = gru_lm.lexicon(gru_lm.count_words(docs))
    w = gru_lm.first_weights(known)
    ids = np.arange(gru_lm.GROUPS * gru_lm.GROUP_WORDS + gru_lm.SHAPES)
    state = np.tile(np.random.default_rng(2).standard_normal(gru_lm.STATE).astype(np.float32), (len(ids), 1))
    assert np.exp(gru_lm.log_outputs(w, state, ids)).sum() == pytest.approx(1, abs=1e-4)


def test_frequent_words_stay_within_their_bound(spark):
    table = spark.createDataFrame([(i, 1 + 1000 // (i + 1)) for i in range(500)], "word bigint, n bigint")
    got = gru_lm.frequent_words(table, 50)
    assert 20 < len(got) <= 50 and list(got["n"]) == sorted(got["n"], reverse=True)
    assert got["n"].min() > max(1 + 1000 // (i + 1) for i in range(500) if i not in set(got["word"]))
    assert len(gru_lm.frequent_words(table, 500)) == 500


def test_state_is_carried_over_windows():
    known = gru_lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), 0, 0, np.zeros(16), np.ones(1024), np.ones(16))
    w = {k: v + np.float32(0.01) for k, v in gru_lm.first_weights(known).items()}
    texts = [np.random.default_rng(i).integers(0, 1040, n) for i, n in enumerate([3, 200, 64, 1, 130])]
    one = gru_lm.score_texts(w, texts, unroll=1000)
    assert np.allclose(gru_lm.score_texts(w, texts, unroll=7), one, rtol=1e-4)
    assert np.allclose([gru_lm.score_texts(w, [t])[0] for t in texts], one, rtol=1e-4)


def test_gradients_of_training_lower_the_loss():
    known = gru_lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), 0, 0, np.zeros(16), np.ones(1024), np.ones(16))
    w = gru_lm.first_weights(known)
    stream = np.tile(np.arange(0, 40), 800)
    starts = np.zeros(len(stream), bool)
    before = gru_lm.score_texts(w, [stream[:400]])[0]
    for _ in range(10):
        w = gru_lm.train_pass(w, stream, starts)
    assert gru_lm.score_texts(w, [stream[:400]])[0] > 0.5 * before


# 8 -------------------------------------------------------------------------------------------

def test_quality_agrees_with_plain(spark):
    from texts import prose
    import random
    dice, rows = random.Random(9), []
    for i in range(400):
        text = prose(dice, dice.randint(30, 200)).capitalize()
        if i % 17 == 0:
            text = " ".join(w + "***" for w in text.split())
        if i % 19 == 0:
            text = text.upper().replace(" ", "!! ")
        if i % 23 == 0:
            text = "\n".join([text[:80]] * 12)
        rows.append((i, None if i == 7 else text, ["en", "de", None][i % 3 if i % 10 else 2], ["a", "b", None][i % 2 if i % 7 else 2]))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    kept = brute.quality(rows, quality)
    for (doc_id, text, _, _), k in zip(rows, kept):
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.statistics(text)
        assert r.kept == k
    assert not all(kept) and sum(kept) > 200


def test_repeated_windows_by_both_ways(spark):
    """Many windows that repeat take the way by sorting."""
    import random
    dice = random.Random(4)
    pool = [f"w{i}" for i in range(9)]
    rows = [(i, " ".join(dice.choice(pool[:2 + i % 8]) for _ in range(dice.randint(0, 900)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    got = {r.doc_id: r.n_repeat_words for r in quality.document_statistics(docs).collect()}
    assert got == {i: brute.statistics(t)[4] for i, t in rows}


# 9 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("min_sites", [2, 3, 4])
def test_lines_agree_with_plain(docs, rows, min_sites):
    got = {r.row.doc_id: r for r in lines.judge_lines(docs, min_sites).collect()}
    for doc_id, n, removed, text in brute.boilerplate([(r[0], r[1], r[3]) for r in rows], min_sites):
        assert (got[doc_id].n_lines, got[doc_id].n_removed, got[doc_id].text) == (n, removed, text)


def test_documents_without_words_left_go(spark):
    rows = [(i, "shared line here\n", f"s{i % 4}") for i in range(8)] + [(9, "own text", "s1"), (10, None, "s1"), (11, "", "s2")]
    kept = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 3)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 10, 11]


# 10 ------------------------------------------------------------------------------------------

def toxic_table(spark, n=900):
    from texts import prose
    import random
    dice, rows, labels = random.Random(2), [], []
    for i in range(n):
        w, bad = prose(dice, dice.randint(40, 120)).split(), i % 6 == 0
        if bad:
            for _ in range(4):
                w.insert(dice.randrange(len(w)), dice.choice(["zworthyx", "quidiotz", "plumpexo"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_documents_are_found_among_held_out_ones(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id", "left").toPandas()
    held = got[got["held_out"] & got["toxic"].notna()]
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and len(got) == 902
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = toxic_table(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_toxicity(docs, x).select("doc_id", "score").toPandas().set_index("doc_id").sort_index() for x in (labels, turned))
    assert np.allclose(a, b)


# all -----------------------------------------------------------------------------------------

def labels_of(docs):
    return docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


OPERATORS = {
    "shards": lambda d: kd_shards.kd_shards(d, 8), "mix": mixing.mix_sources, "classes": jaccard_join.near_classes,
    "spans": substring.repeated_spans, "pieces": packing.pack, "fingerprints": fingerprint.compare_with_next,
    "model": lambda d: gru_lm.score_documents(d, share=1, rounds=1), "quality": quality.judge, "lines": lines.judge_lines,
    "toxicity": lambda d: toxicity.score_toxicity(d, labels_of(d))}
FILTERS = {"take_mix": mixing.take_mix, "keep_one": jaccard_join.keep_one, "keep_good": quality.keep_good,
           "remove_boilerplate": lines.remove_boilerplate}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_all_come_back(awkward, name):
    got = OPERATORS[name](awkward)
    if name == "pieces":
        got = got.where("piece = 0")
    assert len(got.collect()) == awkward.count()


@pytest.mark.parametrize("name", FILTERS)
def test_awkward_rows_keep_their_columns(awkward, name):
    got = FILTERS[name](awkward)
    assert got.columns == awkward.columns and len(got.collect()) > 0


@pytest.mark.parametrize("name", OPERATORS | FILTERS)
def test_empty_tables_stay_empty(empty, name):
    assert (OPERATORS | FILTERS)[name](empty).collect() == []
