"""Burst trie, forest of min-wise trees and source divergence against plain Python."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from panelspark.llm import burst_trie, divergence, minhash_forest
from texts import prose

# 11 ------------------------------------------------------------------------------------------


def plain_trie(rows):
    """``{node rows}`` for rows ``(conv_id, turn, role, text)``."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        size = len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * size
    return sorted((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node],
                   saved[node], hashlib.sha256(",".join(str(c) for c in convs if built[c] == node).encode()).hexdigest())
                  for node, convs in members.items())


def trie_rows(df, **limits):
    return sorted(tuple(r) for r in burst_trie.prefix_trie(df, **limits).collect())


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def chats(seed, n=150):
    dice, rows = random.Random(seed), []
    openings = [[(dice.choice(["user", "assistant"]), prose(dice, 3)) for _ in range(dice.randint(1, 6))] for _ in range(3)]
    for c in range(-12, n):
        if c % 17 == 4:
            continue
        turns = list(dice.choice(openings)) + [(dice.choice(["user", None]), dice.choice(["ja", "nein", None, "é"]))
                                               for _ in range(dice.randint(0, 5))]
        if c % 7 == 0:
            turns = turns[:dice.randint(0, 2)]
        rows += [(c, i if dice.random() < 0.95 else None, role, text) for i, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("limits", [{"container_rows": 1}, {"container_rows": 4}, {}, {"container_bytes": 300}])
def test_trie_agrees_with_plain(spark, limits):
    rows = chats(3)
    assert trie_rows(spark.createDataFrame(rows, CONVERSATION).repartition(6), **limits) == plain_trie(rows)


def test_ties_repeats_nulls_and_copies(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, None, None), (None, 1, "user", "lost"),
            (3, 2, "x", "y"), (3, 2, "x", "y")]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    rows += [(c, t, "user", f"long {min(t, 200 + c % 3)}") for c in range(200, 205) for t in range(230)]
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({c: F.lit(c) for c in ("path", "depth", "key", "ids", "n", "first", "parent")})
    assert trie_rows(df, container_rows=2) == plain_trie(rows)


def test_members_are_hashed_in_order_over_runs_of_ids(spark):
    rows = [(c, 0, "user", "hello") for c in (5, 9_000, -4_097, 123_456_789, 10, 4_096, 70_000)]
    assert trie_rows(spark.createDataFrame(rows, CONVERSATION)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], CONVERSATION)) == []


def test_long_common_stretch_is_one_burst(spark, monkeypatch):
    calls, real = [], burst_trie.burst
    monkeypatch.setattr(burst_trie, "burst", lambda c: calls.append(1) or real(c))
    rows = [(c, t, "user", f"{t}" if t < 60 else f"{t} {c}") for c in range(30) for t in range(62)]
    assert trie_rows(spark.createDataFrame(rows, CONVERSATION), container_rows=8) == plain_trie(rows)
    assert len(calls) <= 3


# 12 ------------------------------------------------------------------------------------------

def lower(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_near(rows):
    """``[(doc_id, size, component)]`` for rows ``(doc_id, text)``."""
    sets = [brute.shingles(lower(t)) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {c: min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    return sorted((d, len(s), least[label[i]], d == least[label[i]]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(df, **settings):
    return sorted(tuple(r) for r in minhash_forest.near_duplicates(df, **settings).collect())


def edited(dice, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[dice.randrange(len(words))] = prose(dice, 1) + "x"
    return " ".join(words)


def near_table(seed=8):
    """Groups of copies with few and many changes, a chain of edits, letter case, and awkward texts."""
    dice = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "two words here", "Two Words HERE"]
    for size in (2, 3, 40):
        base = prose(dice, 200)
        texts += [edited(dice, base, dice.randint(0, 5)) for _ in range(size)]
    chain = prose(dice, 300)
    for _ in range(12):
        texts.append(chain)
        chain = edited(dice, chain, 3)
    texts += [prose(dice, dice.randint(3, 90)).upper() for _ in range(40)] + [t.lower() for t in texts[-5:] if t]
    order = list(range(len(texts)))
    dice.shuffle(order)
    return [(d, t) for d, t in zip(order, texts)]


@pytest.mark.parametrize("settings", [{}, {"limit": 8}, {"limit": 3, "depth": 2}])
def test_near_duplicates_agree_with_plain(spark, settings):
    rows = near_table()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert near_rows(df, **settings) == plain_near(rows)


@pytest.mark.parametrize("edits", [1, 14])
def test_one_large_group_makes_few_pairs(spark, edits):
    """A group all linked, and one in which many are almost similar enough: no list grows with the square of it."""
    dice = random.Random(1)
    base = prose(dice, 150)
    rows = [(i, edited(dice, base, dice.randint(0, edits))) for i in range(400)] + [(1000 + i, prose(dice, 60)) for i in range(50)]
    sizes, real = [], minhash_forest.materialise

    def counted(df, name):
        out = real(df, name)
        sizes.append(out.count())
        return out

    minhash_forest.materialise = counted
    try:
        got = near_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=64)
    finally:
        minhash_forest.materialise = real
    assert [r[2] for r in got] == [r[2] for r in plain_near(rows)]
    assert max(sizes) < 40 * len(rows)


def test_similarity_of_the_threshold_itself(spark):
    """Sets that share exactly 85 of 100 are linked, those that share 84 of 100 are not."""
    a = " ".join(f"w{i}" for i in range(89))                       # 85 shingles
    b = a + " " + " ".join(f"x{i}" for i in range(15))             # 100, of which 85 shared
    c = " ".join(f"v{i}" for i in range(88))                       # 84
    d = c + " " + " ".join(f"y{i}" for i in range(16))             # 100, of which 84 shared
    rows = [(1, a), (2, b), (3, c), (4, d)]
    assert near_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), recall=1 - 1e-9) == [
        (1, 85, 1, True), (2, 100, 1, False), (3, 84, 3, True), (4, 100, 4, True)]


def test_number_of_trees_reaches_the_recall():
    for depth in (1, 3, 5):
        trees = minhash_forest.trees_for(0.85, depth, 0.99)
        assert (1 - minhash_forest.survival(0.85, depth)) ** trees <= 0.01


# 13 ------------------------------------------------------------------------------------------

def plain_divergence(rows, least, top):
    """``{rows}`` for rows ``(text, lang, source)``."""
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or "")), a or "", s or "") for t, a, s in rows]
    seen, counts, groups = Counter(), defaultdict(Counter), set()
    for found, lang, source in terms:
        seen.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for a, t in seen if a == lang and seen[a, t] >= least), key=str.encode)
        mine = sorted((s for a, s in groups if a == lang), key=str.encode)

        def share(count):
            total = sum(count[t] for t in kept)
            return [1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept]

        whole = share(sum((counts[lang, s] for s in mine), Counter()))
        p = {s: share(counts[lang, s]) for s in mine}
        for s in mine:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in mine if o != s))
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            told = sorted((-(a - b), t.encode(), t) for a, b, t in zip(p[s], whole, kept) if counts[lang, s][t] and a > b)
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(told[:top], 1)}
    return out


def divergence_rows(df, least, top=50):
    got = [tuple(r) for r in divergence.source_divergence(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def text_table(seed=2):
    dice = random.Random(seed)
    words = ["The", "the", "œuf", "Ärger", "ärger", "x1y", "don't", "日本", "zebra", "zeb", "zebras", "a"]
    rows = [(" ".join(dice.choice(words[:3 + (i * 7) % 10]) for _ in range(dice.randint(0, 30))), dice.choice(["en", "de", None]),
             dice.choice(["s1", "s2", "s10", None])) for i in range(150)]
    return rows + [(None, "en", "silent"), ("", "fr", "one"), ("1 2 3", "fr", "two"), ("word " * 3000 + "Q" * 20_000, "en", "s1")]


@pytest.mark.parametrize("least,top", [(1, 3), (10, 50), (10_000, 50)])
def test_divergence_agrees_with_plain(spark, least, top):
    rows = text_table()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert divergence_rows(df, least, top) == plain_divergence(rows, least, top)


def test_many_ranges_of_terms_blocks_and_passes(spark, monkeypatch):
    for name, value in (("SHARD_TERMS", 3), ("SEGMENT_BYTES", 1500), ("BLOCK_TERMS", 4), ("BLOCK_SOURCES", 2), ("HELD_ROWS", 5)):
        monkeypatch.setattr(divergence, name, value)
    rows = text_table(5)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert divergence_rows(df, 2) == plain_divergence(rows, 2, 50)


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 7, 3), (10**13, 10**13 + 11, 1000), (8 * 10**14, 8 * 10**14, 10**6), (123456789012, 9 * 10**14, 77)]
    df = spark.createDataFrame(cases, "c bigint, n bigint, v bigint").select("c", "n", "v", divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé日", min_size=1, max_size=6), max_size=60), st.lists(st.text("abé日z", min_size=1, max_size=7), max_size=20))
def test_transducer_numbers_its_terms_and_no_others(terms, others):
    order = sorted(t.encode() for t in terms)
    machine = divergence.Transducer.unpack(divergence.Transducer.build(order).pack())
    asked = order + [o.encode() for o in others]
    sizes = np.array([len(a) for a in asked], np.int64)
    found = machine.ordinals(np.frombuffer(b"".join(asked), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) if asked else []
    assert list(found) == [order.index(a) if a in order else -1 for a in asked]


def test_transducer_is_minimal():
    """As many states as there are unlike sets of endings."""
    order = sorted({(a + b).encode() for a in ("un", "re", "pre", "") for b in ("do", "dos", "doing", "make", "makes", "making")})
    prefixes = {t[:i] for t in order for i in range(len(t) + 1)}
    endings = {frozenset(t[len(p):] for t in order if t.startswith(p)) for p in prefixes}
    assert len(divergence.Transducer.build(order).final) == len(endings)


# all -----------------------------------------------------------------------------------------

def test_awkward_rows(awkward):
    near = minhash_forest.near_duplicates(awkward)
    assert near.columns == ["doc_id", "n_shingles", "component_id", "kept"] and near.count() == awkward.count()
    rows = [tuple(r) for r in awkward.select("text", "lang", "source").collect()]
    assert divergence_rows(awkward, 3) == plain_divergence(rows, 3, 50)


def test_empty_tables(empty):
    assert minhash_forest.near_duplicates(empty).collect() == []
    assert divergence.source_divergence(empty).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_trie_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(df) == plain_trie(rows)
