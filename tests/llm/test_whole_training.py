"""The language model's weights learn from every training document, to its last token."""

import numpy as np
import pytest

from panelspark.llm import gru_lm
from texts import rows_of


def test_weights_learn_from_every_training_document(spark):
    """Every document has a word of its own; a word's vector moves only if it was read in training.

    The last word of a stretch or window has no gradient as input, so each stands three times.
    """
    docs = spark.createDataFrame([(i, f"own{i} own{i} own{i} and common words") for i in range(60)], "doc_id bigint, text string")
    rows = docs.where(~gru_lm.held_out(docs["doc_id"])).repartition(5)
    known = gru_lm.lexicon(gru_lm.count_words(rows))
    before, after = gru_lm.first_weights(known), gru_lm.train(rows, known, rounds=1)
    ids = known.look_up(np.concatenate(list(gru_lm.tokens(rows.select("text").toArrow().column(0).combine_chunks()))))[0]
    assert len(np.unique(ids)) == rows.count() + 4
    moved = (after["vector"] != before["vector"]).any(axis=1)
    assert moved[np.setdiff1d(ids, known.look_up(np.array([gru_lm.END]))[0])].all()


def _untrained():
    known = gru_lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), 0, 0, np.zeros(16), np.ones(1024), np.ones(16))
    return gru_lm.first_weights(known)


def test_a_pass_learns_from_the_tail_of_its_stream():
    lanes = gru_lm.STREAMS
    stream = np.concatenate([np.zeros(lanes * (gru_lm.UNROLL + 3), int), np.full(lanes - 1, 7)])
    before = _untrained()
    after = gru_lm.train_pass(before, stream, np.zeros(len(stream), bool))
    assert (after["vector"][7] != before["vector"][7]).any()


def test_places_that_fill_a_stretch_count_for_nothing():
    """Place holders have word 0; a stream without that word leaves its vector as it was."""
    stream = np.tile(np.arange(1, 41), 60)[:gru_lm.STREAMS * gru_lm.UNROLL + 5]
    before = _untrained()
    after = gru_lm.train_pass(before, stream, np.zeros(len(stream), bool))
    assert (after["vector"][0] == before["vector"][0]).all() and np.isfinite(gru_lm._flat(after)).all()
    nothing = gru_lm.train_pass(before, stream[:0], np.zeros(0, bool))
    assert all((nothing[k] == before[k]).all() for k in before)


def test_moments_go_on_from_stream_to_stream():
    stream, starts = np.tile(np.arange(1, 41), 60), np.zeros(2400, bool)
    before = _untrained()
    moments = gru_lm.Moments.none(before)
    once = gru_lm.train_pass(before, stream, starts, moments)
    assert moments.step > 0
    with_memory, without = gru_lm.train_pass(once, stream, starts, moments), gru_lm.train_pass(once, stream, starts)
    assert (with_memory["class"] != without["class"]).any()


def _plain_score(w, known, hashes):
    """One token after another: class, word inside it or share of the form's counts, then the next state."""
    s, own, h, total = gru_lm.STATE, gru_lm.GROUPS * gru_lm.GROUP_WORDS, np.zeros(gru_lm.STATE), 0.0
    ids, counts, _ = known.look_up(hashes)
    for token, count in zip(ids, counts):
        logits = h @ w["class"] + w["class_bias"]
        kind = token % gru_lm.GROUPS if token < own else gru_lm.GROUPS + token - own
        total += logits[kind] - np.log(np.exp(logits).sum())
        if token < own:
            inside = h @ w["word"][kind] + w["word_bias"][kind]
            total += inside[token // gru_lm.GROUPS] - np.log(np.exp(inside).sum())
        else:
            total += np.log(count + 0.5) - known.shape_log[token - own]
        x, u = w["vector"][token] @ w["take"] + w["bias"], h @ w["keep"]
        reset, update = (1 / (1 + np.exp(-(x[a:a + s] + u[a:a + s]))) for a in (0, s))
        new = np.tanh(x[2 * s:] + reset * u[2 * s:])
        h = (1 - update) * new + update * h
    return total / np.log(10)


def test_scores_agree_with_a_plain_scorer(spark, monkeypatch):
    rows = [r[:2] for r in rows_of(9, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    trained, real = [], gru_lm.train
    monkeypatch.setattr(gru_lm, "train", lambda *a: trained.append((a[1], real(*a))) or trained[0][1])
    got = {r.doc_id: r.score for r in gru_lm.score_documents(docs).collect()}
    known, w = trained[0]
    w = {k: v.astype(float) for k, v in w.items()}
    import pyarrow as pa
    for (doc_id, _), hashes in zip(rows, gru_lm.tokens(pa.array([t for _, t in rows]))):
        assert got[doc_id] == pytest.approx(_plain_score(w, known, hashes), rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("n", [0, 1, 5, 4000])
def test_words_are_found_by_their_first_bits(n):
    dice = np.random.default_rng(n)
    words = np.unique(dice.integers(0, 2**64, n, dtype=np.uint64))
    known = gru_lm.Lexicon(words, np.ones(len(words), int), np.zeros(len(words), int), 0, 0, np.zeros(16), np.ones(1024), np.ones(16))
    asked = np.concatenate([words, words + np.uint64(1), dice.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    assert (known._place(asked) == np.searchsorted(words, asked)).all()
    assert (known.look_up(asked)[2] == np.isin(asked, words)).all()


def test_inputs_are_those_of_the_lookup(spark):
    known = gru_lm.lexicon(spark.createDataFrame([(i * 7919 + 3, 1 + 3000 // (i + 1)) for i in range(3000)], "word bigint, n bigint"))
    asked = np.concatenate([known.words, known.words + np.uint64(1)])
    assert (known.inputs(asked) == known.look_up(asked)[0]).all()
