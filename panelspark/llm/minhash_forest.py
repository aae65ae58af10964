"""Near-duplicate documents by independent trees of min-wise tokens, with every link confirmed on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mix, pieces, small_batches, text_key, window_hashes, word_bounds, word_hashes
from panelspark.llm.jaccard_join import components
from panelspark.operators.joins import lookup
from panelspark.session import materialise

WIDTH = 5
PERCENT = 85                 # linked: 100 * intersection >= PERCENT * union
COORDINATES = 128            # min-wise values of a set
SLACK = 0.11                 # more than three standard deviations of a similarity estimated from them
RECALL = 0.999               # of a pair at the threshold, over all trees
DEPTH = 4                    # levels of a tree
NODE_SETS = 512              # a node with more sets branches
FAN = 500                    # sets that are confirmed against one other set in one task
BLOCK_SHINGLES = 4_000_000   # shingles of the sets that a task compares as a whole, in each of its two blocks
MASK_SLOTS = 1 << 17

_U = np.uint64
_SEEDS = mix(np.arange(101, 101 + 2 * COORDINATES, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))
_XOR = (_SEEDS[:COORDINATES] >> _U(32)).astype(np.uint32)[:, None]
_MULTIPLY = ((_SEEDS[COORDINATES:] >> _U(32)) | _U(1)).astype(np.uint32)[:, None]


# ---- sets and their min-wise values, inside Arrow tasks ---------------------------------

def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text the distinct hashes of its runs of ``width`` words, ascending; A-Z counts as a-z.

    A text with fewer words is one run, a text without words has none.
    """
    for _, _, data, offsets in pieces(column):
        starts, ends, rows = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        runs = window_hashes(hashes, width)
        for low, high in zip(rows[:-1], rows[1:]):
            if high - low >= width:
                yield np.unique(runs[low:high - width + 1])
            else:
                yield window_hashes(hashes[low:high], int(high - low)) if high > low else runs[:0]


def _minima(items: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    short = (items >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, ((short[at:at + 2048] ^ _XOR) * _MULTIPLY).min(axis=1), out=least)
    return least


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, minima = [], [], []
            for items in shingle_sets(batch.column(2), width):
                sizes.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).hexdigest() if len(items) else None)
                minima.append(_minima(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(minima, pa.binary())], ["doc_id", "text_key", "set_key", "n_shingles", "minima"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.cast(pa.large_binary())
    if not len(raw):
        return np.zeros((0, COORDINATES), np.uint32)
    bounds = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
    return np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0]:bounds[-1]].view(np.uint32).reshape(-1, COORDINATES)


# ---- trees ------------------------------------------------------------------------------

def survival(threshold: float, depth: int) -> float:
    """The chance that a pair of that similarity shares a node on level ``depth`` of one tree."""
    lost = 0.0
    for _ in range(depth):
        one = 1 - threshold * (1 - lost)
        lost = (2 - 1 / threshold) * one + (1 / threshold - 1) * one * one
    return 1 - lost


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """Independent trees after which a pair at the threshold has met with the chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def _branch(threshold: float, trees: int = 0):
    """Nodes below ``node`` for every set in it; with ``trees``, below the root of each tree.

    A node draws one coordinate, or with the chance ``1 / threshold - 1`` two,
    and a set goes to the child of the value it has there.  A pair at the
    threshold therefore has one common child on average on every level.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima, keys = _matrix(batch.column("minima")), batch.column("set_key")
            every = np.arange(len(minima))
            starts = [np.full(len(minima), t + 1, np.uint64) for t in range(trees)] if trees else [
                batch.column("node").to_numpy().view(np.uint64)]
            for node in starts:
                draw = mix(node + _U(0x632BE59BD9B4E019))
                one, two = (draw % _U(COORDINATES)).astype(int), ((draw >> _U(20)) % _U(COORDINATES)).astype(int)
                again = ((draw >> _U(40)).astype(float) < (1 / threshold - 1) * 2.0**24) & (one != two)
                rows, at = np.concatenate([every, every[again]]), np.concatenate([one, two[again]])
                token = minima[rows, at].astype(np.uint64) | (at.astype(np.uint64) << _U(32))
                child = mix(mix(node[rows] + _U(1)) ^ mix(token + _U(7)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), keys.take(pa.array(rows))], ["node", "set_key"])
    return run


def _nodes(sets: DataFrame, threshold: float, depth: int, recall: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(node, set_key, n)`` of the nodes to compare, and ``minima`` of the sets in them.

    A node of up to ``limit`` sets is a leaf; larger ones branch, down to level
    ``depth``.  Of leaves with the same sets one is enough.
    """
    start = _branch(threshold, trees_for(threshold, depth, recall))
    rows = materialise(sets.select("set_key", "minima").mapInArrow(start, "node bigint, set_key string"), "tree_nodes")
    leaves, minima = [], None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("who")).where("n > 1")
        met = materialise(lookup(rows.withColumn("node", F.col("node").cast("string")),
                                 materialise(sizes.withColumn("node", F.col("node").cast("string")), "node_sizes"),
                                 "node", "set_key", "n"), "tree_met")
        if minima is None:  # a set that is alone everywhere on the first level is done
            minima = materialise(sets.select("set_key", "minima").join(met.select("set_key").distinct(), "set_key"), "minima")
        leaf = (F.col("n") <= limit) | F.lit(level == depth)
        small = met.where(leaf)
        chosen = small.groupBy("n", "who").agg(F.min("node").alias("node")).select("node")
        leaves.append(materialise(small.join(chosen, "node", "left_semi").select("node", "set_key", "n"), "tree_leaves"))
        large = met.where(~leaf).select(F.col("node").cast("bigint").alias("node"), "set_key")
        if level == depth or large.isEmpty():
            break
        rows = materialise(large.join(minima, "set_key").mapInArrow(_branch(threshold), "node bigint, set_key string"), "tree_nodes")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, minima


# ---- comparing inside nodes -------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch], items: bool = False) -> Iterator[tuple]:
    """``(task, keys, minima, labels, sides, sets)`` of each task's rows, which come sorted by task."""
    current, held = None, []

    def whole() -> tuple:
        return (current, *(np.concatenate(c) for c in zip(*held)))

    for batch in batches:
        tasks = batch.column("task").to_numpy()
        sets = np.empty(len(tasks), object)
        if items:
            for k, raw in enumerate(batch.column("items").to_pylist()):
                sets[k] = np.frombuffer(raw, np.uint64)
        columns = (np.array(batch.column("set_key").to_pylist(), object), _matrix(batch.column("minima")),
                   np.array(batch.column("label").to_pylist(), object), batch.column("side").to_numpy(), sets)
        cuts = np.concatenate([[0], np.flatnonzero(tasks[1:] != tasks[:-1]) + 1, [len(tasks)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low < high:
                if tasks[low] != current and held:
                    yield whole()
                    held = []
                current = tasks[low]
                held.append([c[low:high] for c in columns])
    if held:
        yield whole()


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def _forest(least: float):
    """Edges that are probably links and hang each task's sets together: every set with the one that reached it first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, keys, minima, _, _, _ in _groups(batches):
            order = np.argsort(keys)
            keys, minima = keys[order], minima[order]
            waiting = np.arange(len(keys))
            while len(waiting) > 1:
                front, waiting = [waiting[0]], waiting[1:]
                while front and len(waiting):
                    at = front.pop()
                    near = (minima[waiting] == minima[at]).mean(axis=1) >= least
                    a += [keys[at]] * int(near.sum())
                    b += list(keys[waiting[near]])
                    front += list(waiting[near])
                    waiting = waiting[~near]
            if len(a) > 10_000:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)
    return run


def _partners(i: int, minima: np.ndarray, labels: np.ndarray, sides: np.ndarray, least: float) -> np.ndarray:
    """The rows after i that may be linked with it and hang together with others than it does."""
    others = np.flatnonzero((labels[i + 1:] != labels[i]) & ((sides[i + 1:] != sides[i]) | (sides[i] < 0))) + i + 1
    return others[(minima[others] == minima[i]).mean(axis=1) >= least] if len(others) else others


def _undecided(least: float):
    """The rows of each task that have a partner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, keys, minima, labels, sides, _ in _groups(batches):
            found = np.zeros(len(keys), bool)
            for i in range(len(keys) - 1):
                near = _partners(i, minima, labels, sides, least)
                found[near] = True
                found[i] |= len(near) > 0
            if found.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(found.sum()), task)), pa.array(keys[found], pa.string()),
                     pa.array(labels[found], pa.string()), pa.array(sides[found])], ["task", "set_key", "label", "side"])
    return run


def _joint(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two ascending arrays share."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    joint = _joint(a, b)
    return 100 * joint >= percent * (len(a) + len(b) - joint)


def _decide(least: float, percent: int):
    """Links between sets of unlike labels, found by comparing whole sets; what they join counts as one label at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, minima, labels, sides, sets in _groups(batches, items=True):
            a, b = [], []
            for i in range(len(keys) - 1):
                for j in _partners(i, minima, labels, sides, least):
                    if labels[j] != labels[i] and _linked(sets[i], sets[j], percent):
                        a.append(keys[i])
                        b.append(keys[j])
                        labels[labels == labels[j]] = labels[i]
            yield _pairs(a, b)
    return run


def _with_minima(tasks: DataFrame, minima: DataFrame) -> DataFrame:
    return tasks.join(minima, "set_key").select("task", "set_key", "minima", "label", "side")


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task")


def _first_tasks(leaves: DataFrame, limit: int) -> DataFrame:
    """Nodes as tasks; larger ones in blocks, each of which also gets the node's least set.

    So all blocks hang together over that set, and their number grows only as the node does.
    """
    blocks = F.ceil(F.col("n") / limit).cast("int")
    none = [F.lit(None).cast("string").alias("label"), F.lit(-1).alias("side")]
    rows = leaves.where(F.col("n") <= limit).select(F.xxhash64("node").alias("task"), "set_key", *none)
    large = leaves.where(F.col("n") > limit).withColumn("blocks", blocks)
    dealt = large.select("node", F.pmod(F.xxhash64("set_key", F.lit(5)), F.col("blocks")).cast("int").alias("block"), "set_key")
    pivots = large.groupBy("node", "blocks").agg(F.min("set_key").alias("set_key")).select(
        "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "set_key")
    return rows.unionByName(dealt.unionByName(pivots).distinct().select(F.xxhash64("node", "block").alias("task"), "set_key", *none))


def _second_tasks(leaves: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Nodes with more than one of the ``labels(set_key, label, n_shingles)`` as tasks.

    In larger ones only blocks that can hold two labels meet: the sets of the
    commonest label are dealt into blocks that do not meet each other; each
    meets the blocks of all other sets, and these meet among themselves.
    """
    named = leaves.select("node", "set_key").join(labels, "set_key")
    kinds = named.groupBy("node", "label").agg(F.count("*").alias("held"), F.sum("n_shingles").alias("size"))
    most = materialise(kinds.groupBy("node").agg(
        F.max(F.struct("held", "label", "size")).alias("top"), F.sum("held").alias("rows"), F.sum("size").alias("size")).where(
        F.col("top.held") < F.col("rows")).select("node", F.col("top").alias("top"), "rows", "size"), "node_labels")

    def blocks(rows: Column, size: Column) -> Column:
        return F.greatest(F.ceil(rows / limit), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    open_ = materialise(lookup(named, most, "node", "set_key", "rows"), "open_nodes")
    few = blocks(F.col("rows"), F.col("size")) == 1
    small = open_.where(few).select(F.xxhash64("node").alias("task"), "set_key", "label", F.lit(-1).alias("side"))
    large = open_.where(~few).withColumn("mains", blocks(F.col("top.held"), F.col("top.size"))).withColumn(
        "others", blocks(F.col("rows") - F.col("top.held"), F.col("size") - F.col("top.size")))
    is_main, spread = F.col("label") == F.col("top.label"), F.xxhash64("set_key", F.lit(6))
    mine = F.when(is_main, F.pmod(spread, F.col("mains"))).otherwise(F.col("mains") + F.pmod(spread, F.col("others"))).cast("int")
    last = F.col("mains") + F.col("others") - 1
    dealt = large.withColumn("mine", mine).withColumn("with", F.explode(F.when(
        is_main, F.sequence(F.col("mains"), last)).otherwise(F.sequence(F.lit(0), last))))
    return small.unionByName(dealt.select(
        F.xxhash64("node", F.least("mine", "with"), F.greatest("mine", "with")).alias("task"), "set_key", "label",
        # in a task of two blocks only pairs across them count
        F.when(F.col("mine") == F.col("with"), F.lit(-1)).otherwise(F.col("mine")).alias("side")))


# ---- confirming on full sets ------------------------------------------------------------

def _collect(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(items, pa.binary())], ["set_key", "items"])
    return run


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(set_key, items)`` for ``wanted(set_key, id, key)``: the texts of these documents are read, and become sets."""
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(MASK_SLOTS))
    # before texts move, a table of at most MASK_SLOTS numbers drops most of those that are not asked for
    mask = wanted.select(slot("id", "key").alias("slot")).distinct()
    texts = docs.select(F.col("doc_id").alias("own_id"), text_key().alias("own_key"), "text")
    texts = texts.withColumn("slot", slot("own_id", "own_key")).join(F.broadcast(mask), "slot", "left_semi")
    found = texts.join(wanted, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))).select("set_key", "text")
    # a repeated row can bring a set twice
    return found.mapInArrow(_collect(width), "set_key string, items binary").dropDuplicates(["set_key"])


def _confirm(percent: int):
    """Pairs that are links: each group has one set in front and those it is compared with after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, items = None, None, None
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                own = np.frombuffer(r["items"], np.uint64)
                if r["b"] is None:
                    group, mine, items = r["task"], r["a"], own
                    continue
                if group != r["task"]:
                    raise ValueError("a set to compare with is missing")
                if _linked(items, own, percent):
                    a.append(mine)
                    b.append(r["b"])
            yield _pairs(a, b)
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs(a, b)``, counted on whole sets.

    A set travels once for each pair in which it stands second, and once per
    ``FAN`` pairs in which it stands first, so a set with any number of pairs is many tasks.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    dealt = materialise(pairs.join(fans, "a").withColumn("fan", F.pmod(F.xxhash64("b", F.lit(8)), F.col("fans")).cast("int")).select(
        "a", "b", F.concat_ws(":", "a", "fan").alias("task")), "pairs")
    first = dealt.select("task", "a").distinct().join(sets.withColumnRenamed("set_key", "a"), "a").select(
        "task", "a", F.lit(None).cast("string").alias("b"), "items")
    second = dealt.join(sets.withColumnRenamed("set_key", "b"), "b").select("task", "a", "b", "items")
    return materialise(first.unionByName(second).repartition("task").sortWithinPartitions("task", F.asc_nulls_first("b")).mapInArrow(
        _confirm(percent), "a string, b string"), "links")


def _labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("set_key"), F.col("component").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, recall: float = RECALL,
                    depth: int = DEPTH, limit: int = NODE_SETS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row.

    Two documents are linked when 100 times the size of the intersection of
    their sets of ``width``-word shingles (A-Z lower-cased) is ``percent`` times
    the size of the union or more; ``component_id`` is the least ``doc_id`` that
    links lead to, and the document of that id is kept.

    Equal sets are one set.  Each of a number of independent trees branches the
    sets by drawn min-wise values until nodes are small; inside a node all sets
    are compared by their min-wise values.  Full sets then decide in two steps,
    so that a group of near copies costs one comparison per member: first the
    edges of a spanning forest of each node, then, inside the nodes, every
    pair that may be a link and is not connected yet.  Pairs are never sent on, only links.

    The number of trees gives a pair at the threshold the chance ``recall`` to
    meet; with the estimate's slack, it is missed with a chance below 0.5 %.

    A text with fewer words than a shingle is one shingle.  A text without words
    (null, empty, blanks) has size 0, is linked to nothing and kept.  Rows with
    one id are one document for ``component_id`` only if their texts are linked;
    a null id is smaller than none and names a component only when no other does.
    """
    small_batches(docs.sparkSession)
    threshold = percent / 100
    least = threshold - SLACK
    signed = materialise(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        _describe(width), docs.select("doc_id").schema.add("text_key", "long").add("set_key", "string")
        .add("n_shingles", "long").add("minima", "binary")), "described")
    sets = materialise(signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("carrier"),
        F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima")), "sets")
    leaves, minima = _nodes(sets, threshold, depth, recall, limit)
    carriers = minima.select("set_key").join(sets.select("set_key", "carrier"), "set_key").select(
        "set_key", F.col("carrier.doc_id").alias("id"), F.col("carrier.text_key").alias("key"))
    forest = materialise(_by_task(_with_minima(_first_tasks(leaves, limit), minima)).mapInArrow(
        _forest(threshold - SLACK / 4), "a string, b string").distinct(), "forest")
    asked = forest.select(F.col("a").alias("set_key")).union(forest.select("b")).distinct()
    have = materialise(full_sets(docs, materialise(carriers.join(asked, "set_key"), "wanted"), width), "full_sets")
    links = confirmed(forest, have, percent)
    known = minima.select("set_key").join(sets.select("set_key", "n_shingles"), "set_key").join(_labels(links), "set_key", "left")
    labels = known.select("set_key", F.coalesce("label", "set_key").alias("label"), "n_shingles")
    rest = materialise(_by_task(_with_minima(_second_tasks(leaves, labels, limit), minima)).mapInArrow(
        _undecided(least), "task bigint, set_key string, label string, side int"), "undecided")
    asked = rest.select("set_key").distinct().join(have.select("set_key"), "set_key", "left_anti")
    have = have.unionByName(materialise(full_sets(docs, materialise(carriers.join(asked, "set_key"), "wanted"), width), "full_sets"))
    more = _by_task(_with_minima(rest, minima).join(have, "set_key")).mapInArrow(_decide(least, percent), "a string, b string")
    labels = _labels(links.unionByName(materialise(more, "links")))
    named = sets.select("set_key", "first").join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    least_id = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialise(named.join(least_id, "label").select("set_key", "component_id"), "named")
    own = signed.select("doc_id", "n_shingles", "set_key")
    return own.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
