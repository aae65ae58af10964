"""Made-up prose for the tests."""

import random


def prose(dice, n):
    return " ".join("".join(dice.choice(["ba", "do", "ki", "lu", "me", "ta", "ro"]) for _ in range(dice.randint(1, 3)))
                    for _ in range(n))


def rows_of(seed=5, n=120):
    """Prose with exact and near copies, shared lines and passages, repeated rows, nulls, empties and one long text."""
    dice = random.Random(seed)
    rows, texts = [], []
    passage = prose(dice, 70)
    for i in range(n):
        kind = i % 12
        if kind == 1 and texts:
            text = dice.choice(texts)
        elif kind == 2 and texts:
            w = dice.choice(texts).split(" ")
            w[dice.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = prose(dice, 30) + "\n" + passage + "\n" + prose(dice, 20)
        elif kind == 4:
            text = "All rights reserved here.\n" + prose(dice, 60) + "\n  All rights reserved here. \n\n"
        elif kind == 5:
            text = [None, "", "  \n\t", "one", "two words", "a b a b a b a b"][(i // 12) % 6]
        elif kind == 6:
            text = "ÄÖ é " + prose(dice, 60) + " x y ß!"
        else:
            text = prose(dice, dice.randint(40, 160))
        texts.append(text) if text and len(text) > 300 else None
        rows.append((i, text, dice.choice(["en", "de", None]), dice.choice(["s1", "s2", "s3", "s10", None]), len(text or "")))
    rows.append((n, prose(dice, 6000), "en", "s1", 1))
    return rows
