"""Plain Python versions of the numbered operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = " \t\n\x0b\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes_by_source):
    """Words wanted per source: weights 1, 2, 3 in code-point order, null last, capped at three times the size."""
    order = sorted(sizes_by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes_by_source.values()), set()
    while True:
        open_weight = sum(weight[s] for s in order if s not in capped)
        share = (total - sum(3 * sizes_by_source[s] for s in capped)) / open_weight if open_weight else 0
        more = {s for s in order if s not in capped and 3 * sizes_by_source[s] < share * weight[s]}
        if not more:
            return {s: min(3 * sizes_by_source[s], share * weight[s]) if s not in capped else 3 * sizes_by_source[s] for s in order}
        capped |= more


def mix(docs, offset):
    """``{(doc_id, text): copies}`` for rows ``(doc_id, text, source)`` with unlike ids."""
    rows = defaultdict(list)
    for doc_id, text, source in docs:
        rows[source].append((len(words(text)), hashlib.md5(str(doc_id).encode()).hexdigest(), doc_id, text))
    sizes = {s: sum(r[0] for r in part) for s, part in rows.items()}
    wanted, out = targets(sizes), {}
    for source, part in rows.items():
        rate = min(wanted[source] / sizes[source], 3.0) if sizes[source] else 0.0
        for place, r in enumerate(sorted(part, key=lambda r: r[:3]), 1):
            out[r[2], r[3]] = math.floor(offset + place * rate) - math.floor(offset + (place - 1) * rate)
    return out


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_classes(docs, threshold=0.8):
    """``[(class_id, n_links)]`` for rows ``(doc_id, text)``."""
    sets = [shingles(t) for _, t in docs]
    near = [[i != j and a and b and 10 * len(a & b) >= round(10 * threshold) * len(a | b) for j, b in enumerate(sets)]
            for i, a in enumerate(sets)]
    label = list(range(len(docs)))
    for _ in docs:
        label = [min([label[i]] + [label[j] for j, n in enumerate(row) if n]) for i, row in enumerate(near)]
    least = {c: min(docs[i][0] for i in range(len(docs)) if label[i] == c) for c in label}
    return [(least[label[i]], sum(map(bool, near[i]))) for i in range(len(docs))]


def repeated(docs, window):
    """``{row: (n_words, n_removed, kept text)}`` for rows ``(doc_id, text)``."""
    low = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            low[key] = min(low.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i:i + window])] < doc_id:
                gone |= set(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def boilerplate(docs, min_sites):
    """``[(doc_id, n_lines, n_removed, text)]`` for rows ``(doc_id, text, source)``."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in docs:
        for line in (text or "").split("\n"):
            if line.strip(BLANK):
                sites[line.strip(BLANK)].add(source)
                first[line.strip(BLANK)] = min(first.get(line.strip(BLANK), doc_id), doc_id)
    out = []
    for doc_id, text, _ in docs:
        lines = (text or "").split("\n")
        bare = [x.strip(BLANK) for x in lines]
        gone = [bool(b) and len(sites[b]) >= min_sites and first[b] != doc_id for b in bare]
        out.append((doc_id, sum(map(bool, bare)), sum(gone),
                    None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality(docs, settings):
    """``[kept]`` for rows ``(doc_id, text, lang, source)``; the estimates are those of the operator, in NumPy."""
    base = [statistics(t) for _, t, _, _ in docs]
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, r in base]
    vectors = {}
    for i, (_, text, _, _) in enumerate(docs):
        if not failed[i]:
            n, chars, symbols, _, _ = base[i]
            vectors[i] = [math.sqrt(symbols / chars), math.sqrt(sum(c in settings.CAPITALS for c in text) / chars),
                          math.log(chars / n), math.sqrt(sum(c in "!?" for c in text) / n)]
    cells = defaultdict(list)
    for i in vectors:
        cells[docs[i][2], docs[i][3]].append(i)
    pooled = defaultdict(list)
    for (lang, source), rows in cells.items():
        pooled[(lang, source) if len(rows) >= settings.MIN_VECTORS else (lang,)] += rows
    groups = defaultdict(list)
    for key, rows in pooled.items():
        groups[key if len(rows) >= settings.MIN_VECTORS else ()] += rows
    kept = [not f for f in failed]
    for rows in groups.values():
        x = np.array([vectors[i] for i in rows])
        bins = np.sort(np.floor(x / settings.MEDIAN_BIN), axis=0)
        x = x - (bins[(len(x) + 1) // 2 - 1] + 0.5) * settings.MEDIAN_BIN
        n = np.array([base[i][0] for i in rows], float)
        x *= np.sqrt(n / (n + settings.SHORT))[:, None]
        distance = np.minimum((x / settings.FLOOR) ** 2, 1e6).sum(axis=1)
        for _ in range(settings.STEPS + 1):
            bin_of = np.floor(np.log2(distance + 1e-6) * settings.DISTANCE_BINS)
            limit = np.sort(bin_of)[math.ceil(settings.SUBSET * len(x)) - 1]
            near = x[bin_of <= limit]
            mean = near.mean(axis=0)
            cov = settings.CONSISTENCY * ((near - mean).T @ (near - mean)) / len(near) + settings.FLOOR**2 * np.eye(4)
            distance = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
        if len(rows) >= settings.MIN_VECTORS:
            for i, d in zip(rows, distance):
                kept[i] = bool(d <= settings.CUTOFF)
    return kept


def _hash(*values):
    """Spark's xxhash64 of texts, ints (4 bytes) and longs (8 bytes)."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def signature(text, s):
    """Order min-hash with the operator's constants."""
    w = words(text)
    if not w:
        return []
    mask = (1 << s.PLACE_BITS) - 1
    grams = [(_hash(*w[i:i + s.KMER]) >> s.PLACE_BITS, i) for i in range(max(1, len(w) - s.KMER + 1))]
    seen, classes = Counter(), defaultdict(list)
    for gram, i in grams:
        top = _signed(gram << s.PLACE_BITS) >> s.PLACE_BITS
        h = _hash((top, 8), (seen[gram], 4))
        seen[gram] += 1
        classes[_signed(h) % s.CLASSES].append((h >> (64 - s.HASH_BITS), i & mask))
    out = []
    for c in sorted(classes):
        pair = sorted(sorted(classes[c])[:2], key=lambda x: x[1])
        out.append(c << s.CLASS_SHIFT | _hash(*[(p[0], 8) for p in pair]) >> (64 - s.CLASS_SHIFT))
    return out
