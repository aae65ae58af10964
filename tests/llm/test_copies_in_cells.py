"""Quality rules where copies of one document hold a third of a cell."""

import random

import pytest

from panelspark.llm import quality
from texts import prose

SCHEMA = "doc_id bigint, text string, lang string, source string"


def _clean(dice, n):
    """Prose with some capitals, symbols and calls in every text."""
    return [" ".join(w.capitalize() + dice.choice("!?$#") if dice.random() < 0.1 else w
                     for w in prose(dice, dice.randint(60, 200)).split()) for _ in range(n)]


def _bad(dice, strength):
    """A document that passes the base rules and stands out by symbols and capitals."""
    return " ".join(w.upper() + "#" * strength for w in prose(dice, 120).split())


def _nearly(dice, text):
    words = text.split()
    words[dice.randrange(len(words))] = prose(dice, 1)
    return " ".join(words)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("strength", [1, 4])
def test_a_third_of_a_cell_as_bad_copies(spark, exact, strength):
    dice = random.Random(11)
    clean, bad = _clean(dice, 200), _bad(dice, strength)
    copies = [bad if exact else _nearly(dice, bad) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + copies)], SCHEMA)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert not kept & set(range(200, 300))
    assert len(kept) >= 190


@pytest.mark.parametrize("exact", [True, False])
def test_a_third_of_a_cell_as_good_copies(spark, exact):
    """The copies make the estimate no narrower: the same other rows are kept as without them."""
    dice = random.Random(12)
    clean = _clean(dice, 200)
    copies = [clean[0] if exact else _nearly(dice, clean[0]) for _ in range(100)]
    bad = [_bad(dice, 3) for _ in range(5)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + bad + copies)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    alone = {r.doc_id for r in quality.judge(spark.createDataFrame(rows[:205], SCHEMA)).where("kept").collect()}
    assert not kept & set(range(200, 205)) and set(range(205, 305)) <= kept
    assert len(kept & set(range(200))) >= 190
    if exact:
        assert kept - set(range(205, 305)) == alone


def test_a_cell_of_few_texts_with_many_copies_has_no_estimate(spark):
    """60 copies each of five texts are five vectors, too few to call one of them far out."""
    dice = random.Random(13)
    texts = _clean(dice, 4) + [_bad(dice, 4)]
    rows = [(60 * i + j, t, "en", "s") for i, t in enumerate(texts) for j in range(60)]
    assert quality.judge(spark.createDataFrame(rows, SCHEMA)).where("not kept").count() == 0
    # with others of the language they are judged against these
    rows += [(1000 + i, t, "en", "t") for i, t in enumerate(_clean(dice, 39))]
    out = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).where("not kept").collect()}
    assert set(range(240, 300)) <= out and not out & set(range(240))


def test_cells_beyond_the_broadcast_are_judged_alike(spark, monkeypatch):
    dice = random.Random(14)
    rows = [(i, t, "en", "st"[i % 3 == 0]) for i, t in enumerate(_clean(dice, 150) + [_bad(dice, 3)] * 20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = lambda: {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    sent = kept()
    monkeypatch.setattr(quality, "BROADCAST_CELLS", 0)
    assert kept() == sent
