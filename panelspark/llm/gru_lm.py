"""A gated recurrent language model in NumPy, trained and applied inside Spark tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Sums, mix, pieces, small_batches, word_bounds, word_hashes
from panelspark.session import materialise

STATE, INPUT = 16, 16           # sizes of the recurrent state and of a word's vector
GROUPS, GROUP_WORDS = 32, 32    # classes of words with an output of their own, and words in each
SHAPES = 16                     # classes of all other words, told by their form
FREQUENT = 262_144              # words whose counts every task knows; the others are looked up by a join
HELD_WORDS = 1_000_000          # counts that a task keeps before it sends them on
TRAIN_SHARE = 1                 # the weights see one in so many training documents, so all of them
ROUNDS, STREAMS, UNROLL = 1, 256, 32
LEAST_STREAMS, LEAST_WINDOWS = 8, 64   # a short stream is cut into fewer, so that there are windows to learn from
RATE = 1e-2
CHUNK = 1_024                   # places whose outputs are worked out at once
TRAINER_ROWS = 8_000            # documents per trainer, until there are MOST_TRAINERS
MOST_TRAINERS = 4_096           # beyond, trainers get more documents each; 64 groups of 64 weights are averaged
END = np.uint64(0x5DEECE66D << 4)
LOG10 = math.log(10.0)

_U = np.uint64
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:!?"]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the hashes of its words, A-Z lower-cased, and of the end.

    The last four bits of a hash are the word's form: any byte beyond ASCII,
    length, a punctuation mark at the end.
    """
    for _, _, data, offsets in pieces(column):
        starts, ends, rows = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        if len(starts):
            high = np.concatenate([[0], np.cumsum(data >= 128)])
            form = 8 * (high[ends] > high[starts]) + 2 * np.minimum((ends - starts - 1) // 4, 3) + _POINT[data[ends - 1]]
            hashes = (hashes & ~_U(SHAPES - 1)) | form.astype(np.uint64)
        for first, last in zip(rows[:-1], rows[1:]):
            yield np.append(hashes[first:last], END)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums(["word"], HELD_WORDS)
    for batch in batches:
        found = list(tokens(batch.column(0)))
        if found:
            counts = pa.array(np.concatenate(found).view(np.int64)).value_counts()
            yield from sums.add(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
    yield from sums.flush()


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts; every text ends with one end token."""
    return docs.select("text").mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The frequent words, and totals of all. Its size does not grow with the corpus."""

    words: np.ndarray        # frequent hashes, sorted
    counts: np.ndarray
    output: np.ndarray       # number among the words with an output, or -1
    total: int               # tokens of all kinds
    kinds: int               # distinct tokens
    shape_log: np.ndarray    # log of the mass that the counts of a form are shared out of
    group_counts: np.ndarray  # counts of the words with an output
    shape_counts: np.ndarray  # tokens without one, per form

    def __post_init__(self):
        # where the words begin whose hashes start with the same bits: about one word each
        bits = max(1, len(self.words).bit_length())
        self._shift = _U(64 - bits)
        self._begin = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self._shift)
        self._ended = np.append(self.words, ~_U(0))

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the first word that is not below each hash."""
        at = self._begin[(hashes >> self._shift).astype(np.int64)]
        below = np.flatnonzero(self._ended[at] < hashes)
        while len(below):
            at[below] += 1
            below = below[self._ended[at[below]] < hashes[below]]
        return at

    def inputs(self, hashes: np.ndarray) -> np.ndarray:
        """Class input of each token: its number where it has an output of its own, else its form's."""
        own = np.flatnonzero(self.output >= 0)
        out = GROUPS * GROUP_WORDS + (hashes & _U(SHAPES - 1)).astype(np.int64)
        if len(own):
            at = np.minimum(np.searchsorted(self.words[own], hashes), len(own) - 1)
            known = np.flatnonzero(self.words[own][at] == hashes)
            out[known] = self.output[own][at[known]]
        return out

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class input of each token, its count (0 unless frequent) and whether it is frequent."""
        at = np.minimum(self._place(hashes), max(len(self.words) - 1, 0))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        counts = np.where(known, self.counts[at] if len(self.words) else 0, 0)
        output = np.where(known, self.output[at] if len(self.words) else -1, -1)
        shape = (hashes & _U(SHAPES - 1)).astype(np.int64)
        return np.where(output >= 0, output, GROUPS * GROUP_WORDS + shape), counts, known


def frequent_words(vocabulary: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` rows ``(word, n)``: all words above a count, the commonest first.

    The count is found on a histogram in steps of a 256th of a doubling, so no
    task and not the driver has to sort the vocabulary.
    """
    step = F.floor(F.log2("n") * 256)
    bins = vocabulary.groupBy(step.alias("bin")).agg(F.count("*").alias("kinds")).collect()
    least, room = None, most
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if r["kinds"] > room:
            break
        least, room = r["bin"], room - r["kinds"]
    chosen = vocabulary.where(step >= least) if least is not None else vocabulary.limit(0)
    return chosen.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def lexicon(vocabulary: DataFrame) -> Lexicon:
    """Collect the most frequent words (at most ``FREQUENT``) and totals of the counts by form."""
    top = frequent_words(vocabulary, FREQUENT)
    shapes = (vocabulary.groupBy(F.col("word").bitwiseAND(F.lit(SHAPES - 1)).alias("shape"))
              .agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas())
    words, counts = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    total, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    total[shapes["shape"].to_numpy(np.int64)] = shapes["n"].to_numpy(np.int64)
    kinds[shapes["shape"].to_numpy(np.int64)] = shapes["kinds"].to_numpy(np.int64)
    own = GROUPS * GROUP_WORDS
    output = np.where(np.arange(len(words)) < own, np.arange(len(words)), -1)
    head = (words[:own] & _U(SHAPES - 1)).astype(np.int64)
    rest = total - np.bincount(head, weights=counts[:own], minlength=SHAPES).astype(np.int64)
    rest_kinds = kinds - np.bincount(head, minlength=SHAPES)
    order = np.argsort(words)
    group_counts = np.zeros(own)
    group_counts[:len(words[:own])] = counts[:own]
    return Lexicon(words[order], counts[order], output[order], int(total.sum()), int(kinds.sum()),
                   np.log(rest + 0.5 * (rest_kinds + 1)), group_counts, rest.astype(float))


CLASSES = GROUPS + SHAPES


def first_weights(known: Lexicon) -> dict[str, np.ndarray]:
    """Small random weights; output biases at the logs of the counts, so an untrained model is a unigram model."""
    dice = np.random.default_rng(7)
    rand = lambda *shape: (dice.standard_normal(shape) * 0.1).astype(np.float32)
    words = known.group_counts.reshape(GROUP_WORDS, GROUPS).T + 0.1   # rank r is word r // GROUPS of group r % GROUPS
    masses = np.concatenate([words.sum(axis=1), known.shape_counts + 1.0])
    return {
        "vector": rand(GROUPS * GROUP_WORDS + SHAPES, INPUT), "take": rand(INPUT, 3 * STATE),
        "keep": rand(STATE, 3 * STATE), "bias": np.zeros(3 * STATE, np.float32),
        "class": rand(STATE, CLASSES) * 0.1, "class_bias": np.log(masses / masses.sum()).astype(np.float32),
        "word": np.zeros((GROUPS, STATE, GROUP_WORDS), np.float32),
        "word_bias": np.log(words / words.sum(axis=1, keepdims=True)).astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < GROUPS * GROUP_WORDS, ids % GROUPS, ids - GROUPS * GROUP_WORDS + GROUPS)


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the share that softmax gives to one row of each column; ``x`` is used up."""
    picked = x[chosen, np.arange(x.shape[1])]
    most = x.max(axis=0)
    x -= most
    np.exp(x, out=x)
    return picked - most - np.log(x.sum(axis=0))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Shares of each column, in place; places stand in columns, as sums over the first axis are the fast ones."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _by_group(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each group of words."""
    group = np.where(ids < GROUPS * GROUP_WORDS, ids % GROUPS, GROUPS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        if cuts[g] < cuts[g + 1]:
            yield g, order[cuts[g]:cuts[g + 1]]


def log_outputs(w: dict[str, np.ndarray], state: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probability of each token given the state before it (without the share inside a form)."""
    out = np.empty(len(ids))
    for low in range(0, len(ids), CHUNK):
        at = slice(low, low + CHUNK)
        out[at] = _log_share(w["class"].T @ state[at].T + w["class_bias"][:, None], _class_of(ids[at]))
    for g, at in _by_group(ids):
        out[at] += _log_share(w["word"][g].T @ state[at].T + w["word_bias"][g][:, None], ids[at] // GROUPS)
    return out


def score_texts(w: dict[str, np.ndarray], texts: list[np.ndarray], width: int = 512, unroll: int = 64) -> np.ndarray:
    """Log probability of whole texts; the state is carried from window to window to each text's end.

    Texts of similar length go side by side; each leaves when it ends.
    """
    table = w["vector"] @ w["take"] + w["bias"]
    keep = w["keep"]
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(texts))
    for low in range(0, len(texts), width):
        mine = order[low:low + width]
        long = sizes[mine]
        state = np.zeros((len(mine), STATE), np.float32)
        for begin in range(0, int(long[0]), unroll):
            span = min(unroll, int(long[0]) - begin)
            alive = int(np.searchsorted(-long, -begin, "left"))
            ids = np.zeros((alive, span), np.int64)
            for i in range(alive):
                part = texts[mine[i]][begin:begin + span]
                ids[i, :len(part)] = part
            states = np.empty((span, alive, STATE), np.float32)
            here = np.arange(span)[:, None] + begin < long[None, :alive]
            for t in range(span):
                n = int(here[t].sum())
                h = state[:n]
                states[t, :n] = h
                x = table[ids[:n, t]]
                u = h @ keep
                gates = _sigmoid(x[:, :2 * STATE] + u[:, :2 * STATE])
                new = np.tanh(x[:, 2 * STATE:] + gates[:, :STATE] * u[:, 2 * STATE:])
                new += gates[:, STATE:] * (h - new)
                state[:n] = new
            at_time, row = np.nonzero(here)
            found = log_outputs(w, states[at_time, row], ids[row, at_time])
            out[mine[:alive]] += np.bincount(row, weights=found, minlength=alive)
    return out


@dataclass
class Moments:
    """What Adam remembers from one stream of a trainer to the next."""

    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @classmethod
    def none(cls, w: dict[str, np.ndarray]) -> Moments:
        return cls({k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()})


def train_pass(w: dict[str, np.ndarray], stream: np.ndarray, starts: np.ndarray,
               moments: Moments | None = None) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation through time with Adam, which goes on from ``moments``.

    ``stream`` is cut into up to ``STREAMS`` parallel stretches; states go on from one
    window of ``UNROLL`` tokens to the next and restart where a text does.  The
    last stretches are filled up to the length of the others by places that
    count for nothing, so every token is learnt from.
    """
    if not len(stream):
        return w
    w = {k: v.copy() for k, v in w.items()}
    moments = moments or Moments.none(w)
    first, second = moments.first, moments.second
    lanes = max(1, min(STREAMS, max(LEAST_STREAMS, len(stream) // (UNROLL * LEAST_WINDOWS)), len(stream) // UNROLL))
    length = -(-len(stream) // lanes)
    filled = (0, lanes * length - len(stream))
    ids = np.pad(stream, filled).reshape(lanes, length).T
    fresh = np.pad(starts, filled).reshape(lanes, length).T
    real = np.pad(np.ones(len(stream), bool), filled).reshape(lanes, length).T
    state = np.zeros((lanes, STATE), np.float32)
    s = STATE
    for begin in range(0, length, UNROLL):
        x_ids, new_text = ids[begin:begin + UNROLL], fresh[begin:begin + UNROLL]
        span = len(x_ids)
        taken = (w["vector"] @ w["take"] + w["bias"])[x_ids]
        before, gates, cand, held = [], [], [], []
        for t in range(span):
            h = np.where(new_text[t][:, None], np.float32(0), state)
            u = h @ w["keep"]
            g = _sigmoid(taken[t][:, :2 * s] + u[:, :2 * s])
            c = np.tanh(taken[t][:, 2 * s:] + g[:, :s] * u[:, 2 * s:])
            before.append(h)
            gates.append(g)
            cand.append(c)
            held.append(u[:, 2 * s:])
            state = c + g[:, s:] * (h - c)
        flat, target = np.concatenate(before), x_ids.reshape(-1)
        weight = real[begin:begin + UNROLL].reshape(-1).astype(np.float32)
        weight /= weight.sum()
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        d_flat, classes = np.empty_like(flat), _class_of(target)
        for low in range(0, len(flat), CHUNK):  # a stretch at a time stays in the cache
            at = slice(low, low + CHUNK)
            p = _softmax(w["class"].T @ flat[at].T + w["class_bias"][:, None])
            p[classes[at], np.arange(p.shape[1])] -= 1
            p *= weight[at]
            grad["class"] += (p @ flat[at]).T
            grad["class_bias"] += p.sum(axis=1)
            d_flat[at] = p.T @ w["class"].T
        # the words of a group stand together, so each group is a slice
        group = np.where(target < GROUPS * GROUP_WORDS, target % GROUPS, GROUPS).astype(np.uint8)
        own = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[own], np.arange(GROUPS + 1))
        own = own[:cuts[GROUPS]]
        sorted_flat, sorted_weight, place = flat[own], weight[own], target[own] // GROUPS
        d_sorted = np.empty_like(sorted_flat)
        for k in range(GROUPS):
            at = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                q = _softmax(w["word"][k].T @ sorted_flat[at].T + w["word_bias"][k][:, None])
                q[place[at], np.arange(q.shape[1])] -= 1
                q *= sorted_weight[at]
                grad["word"][k], grad["word_bias"][k] = (q @ sorted_flat[at]).T, q.sum(axis=1)
                d_sorted[at] = q.T @ w["word"][k].T
        d_flat[own] += d_sorted
        d_states = d_flat.reshape(span, lanes, s)
        d_taken = np.empty((span, lanes, 3 * s), np.float32)
        d_u = np.empty((span, lanes, 3 * s), np.float32)
        carry = np.zeros((lanes, s), np.float32)
        for t in range(span - 1, -1, -1):
            h, g, c = before[t], gates[t], cand[t]
            d_c = carry * (1 - g[:, s:]) * (1 - c * c)
            d_z = carry * (h - c) * g[:, s:] * (1 - g[:, s:])
            d_r = d_c * held[t] * g[:, :s] * (1 - g[:, :s])
            d_taken[t, :, :s], d_taken[t, :, s:2 * s], d_taken[t, :, 2 * s:] = d_r, d_z, d_c
            d_u[t, :, :2 * s], d_u[t, :, 2 * s:] = d_taken[t, :, :2 * s], d_c * g[:, :s]
            carry = carry * g[:, s:] + d_u[t] @ w["keep"].T + d_states[t]
            carry[new_text[t]] = 0
        grad["keep"] = flat.T @ d_u.reshape(-1, 3 * s)
        d_taken = d_taken.reshape(-1, 3 * s)
        grad["bias"] = d_taken.sum(axis=0)
        by_word = np.argsort(target.astype(np.uint16), kind="stable")
        found, firsts = np.unique(target[by_word], return_index=True)
        d_words = np.add.reduceat(d_taken[by_word], firsts, axis=0)
        grad["vector"][found], grad["take"] = d_words @ w["take"].T, w["vector"][found].T @ d_words
        moments.step += 1
        size = math.sqrt(sum(float(np.vdot(v, v)) for v in grad.values()))
        scale = min(1.0, 1.0 / (size + 1e-9))
        rate, spread = RATE / (1 - 0.9**moments.step), 1 / math.sqrt(1 - 0.99**moments.step)
        for k, v in grad.items():
            v *= scale
            first[k] *= 0.9
            first[k] += 0.1 * v
            v *= v
            v *= 0.01
            second[k] *= 0.99
            second[k] += v
            np.sqrt(second[k], out=v)
            v *= spread
            v += 1e-6
            np.divide(first[k], v, out=v)
            v *= rate
            w[k] -= v
    return w


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in w.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at:at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def train(docs: DataFrame, known: Lexicon, share: int = TRAIN_SHARE, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of parallel training: every trainer makes a pass over its documents, then weights are averaged.

    Trainers hold about ``TRAINER_ROWS`` documents each, so there are more of
    them for more data, up to ``MOST_TRAINERS``; a trainer's memory of its steps
    goes on over all its documents.  The mean, weighted by tokens, is taken in two steps of
    bounded groups; the driver sees one set of weights per round.
    """
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(share)) == 0).select("text")
    trainers = min(MOST_TRAINERS, max(1, -(-chosen.count() // TRAINER_ROWS)))
    chosen = materialise(chosen.repartition(trainers), "training_texts")
    fan = max(1, math.isqrt(trainers))
    weights = first_weights(known)
    for turn in range(rounds):
        current = weights

        def run(batches: Iterator[pa.RecordBatch], current=current, turn=turn) -> Iterator[pa.RecordBatch]:
            w, seen, who, moments = current, 0, 0, Moments.none(current)
            for batch in batches:
                found = list(tokens(batch.column(0)))
                who = int(mix(np.array([found[0][:8].sum() + _U(turn)], np.uint64))[0] % _U(fan)) if found else 0
                found = [found[i] for i in np.random.default_rng(turn).permutation(len(found))]
                stream = known.inputs(np.concatenate(found)) if found else np.zeros(0, np.int64)
                starts = np.zeros(len(stream), bool)
                starts[np.cumsum([0] + [len(f) for f in found[:-1]])] = bool(found)
                w, seen = train_pass(w, stream, starts, moments), seen + len(stream)
            yield pa.RecordBatch.from_arrays([pa.array([who], pa.int32()), pa.array([float(seen)]),
                                              pa.array([_flat(w).astype(np.float32).tobytes()], pa.binary())], ["who", "seen", "weights"])

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            total, weight = 0.0, 0.0
            for seen, raw in zip(rows["seen"], rows["weights"]):
                total, weight = total + seen * np.frombuffer(raw, np.float32).astype(float), weight + seen
            flat = total / weight if weight else np.frombuffer(rows["weights"].iloc[0], np.float32)
            return pd.DataFrame({"who": [0], "seen": [weight], "weights": [flat.astype(np.float32).tobytes()]})

        schema = "who int, seen double, weights binary"
        spread = chosen.mapInArrow(run, schema)
        rows = spread.groupBy("who").applyInPandas(mean, schema).groupBy("who").applyInPandas(mean, schema).collect()
        if rows and rows[0]["seen"]:
            weights = _shaped(np.frombuffer(rows[0]["weights"], np.float32), weights)
    return weights


def _score(weights: dict[str, np.ndarray], known: Lexicon):
    base_log = math.log(known.total + 0.5 * (known.kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, n_known, base, shared, open_words = [], [], [], [], [], []
            for hashes in tokens(batch.column("text")):
                token, counts, frequent = known.look_up(hashes)
                logs = np.where(frequent, np.log(counts + 0.5), 0.0)
                shape = token - GROUPS * GROUP_WORDS
                inside = shape >= 0
                ids.append(token.astype(np.int32))
                sizes.append(len(hashes))
                n_known.append(int((counts > 0).sum()))
                base.append((logs.sum() - len(hashes) * base_log) / LOG10)
                shared.append((logs[inside].sum() - known.shape_log[shape[inside]].sum()) / LOG10)
                open_words.append(hashes[~frequent].view(np.int64))
            found = score_texts(weights, ids) / LOG10 + np.array(shared)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(found), pa.array(open_words, pa.list_(pa.int64()))],
                ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "open_words"])
    return run


def score_documents(docs: DataFrame, share: int = TRAIN_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row, logs to base ten.

    Counts come from all training documents (those not held out).  The model is
    a gated recurrent unit over words; a token's probability is that of its
    class times that of the token inside its class.  The most frequent words
    have classes and outputs of their own, both given by the state; all others
    fall into classes by their form, inside which counts plus a half decide, and
    unseen words share one half count.  The weights are trained on all training
    documents (one in ``share``, where that is given), by parallel passes and
    averaging; output biases start at the counts, so the untrained model is
    already a unigram one.

    Whole texts are scored with the state carried to their end.  Counts of words
    that are not among the most frequent come by a join, since they are too many
    to send to every task.

    A null or empty text is its end alone.  Rows without an id are training
    rows.  With no training rows every word is unseen.  Repeated rows score alike.
    """
    small_batches(docs.sparkSession)
    vocabulary = materialise(count_words(docs.where(~held_out(F.col("doc_id")))), "vocabulary")
    known = lexicon(vocabulary)
    weights = train(docs.where(~held_out(F.col("doc_id"))), known, share, rounds)
    schema = (docs.select("doc_id").schema.add("row", "long").add("n_tokens", "long").add("n_known", "long")
              .add("base_score", "double").add("score", "double")
              .add("open_words", docs.sparkSession.createDataFrame([], "a array<bigint>").schema["a"].dataType))
    scored = materialise(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        _score(weights, known), schema), "scored")
    rest = (scored.select("row", F.explode("open_words").alias("word")).join(vocabulary, "word", "left")
            .groupBy("row").agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_log")))
    more = F.coalesce("more_log", F.lit(0.0))
    return scored.drop("open_words").join(rest, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"))
