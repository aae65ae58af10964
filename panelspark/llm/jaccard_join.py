"""Near-duplicate classes by a chosen-path similarity join on word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mix, pieces, small_batches, text_key, window_hashes, word_bounds, word_hashes
from panelspark.session import materialise

WIDTH = 5
THRESHOLD = 0.8
HASHES = 128
SLACK = 0.11            # three standard deviations of an estimate from 128 hashes
RECALL = 0.995
DEPTH = 5
LIMIT = 2048            # sets that are compared with each other at once: 1 MB of signatures
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1_000_000
FILTER_SLOTS = 1 << 17

_U = np.uint64
_ARGUMENTS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FLIP = (_ARGUMENTS[:HASHES] >> _U(32)).astype(np.uint32)[:, None]
_TIMES = ((_ARGUMENTS[HASHES:] >> _U(32)) | _U(1)).astype(np.uint32)[:, None]


def shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct word shingles of every text, hashed; a shorter text is one shingle, an empty one none."""
    for _, _, data, offsets in pieces(column):
        starts, ends, rows = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        windows = window_hashes(hashes, width)
        for first, last in zip(rows[:-1], rows[1:]):
            if last - first >= width:
                yield np.unique(windows[first:last - width + 1])
            else:
                yield window_hashes(hashes[first:last], int(last - first)) if last > first else windows[:0]


def _signature(items: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (items >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, ((short[at:at + 4096] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    return low


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs = [], [], []
            for items in shingles(batch.column(2), width):
                sizes.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                signs.append(_signature(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(signs, pa.binary())], ["doc_id", "text_key", "set_key", "n", "sign"])
    return run


def survival(threshold: float, depth: int) -> float:
    """The chance that two sets of that similarity still share a path at ``depth``.

    A node tries one coordinate, or two with the chance ``1 / threshold - 1``,
    so a pair at the threshold keeps one common child on average.
    """
    lost, two = 0.0, 1 / threshold - 1
    for _ in range(depth):
        one = 1 - threshold + threshold * lost
        lost = (1 - two) * one + two * one * one
    return 1 - lost


def _children(paths: np.ndarray, signs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths of the children; the sampled coordinates depend on the path alone."""
    dice = mix(paths * _U(0x9E3779B97F4A7C15) + _U(1))
    first = (dice % _U(HASHES)).astype(np.int64)
    second = ((dice >> _U(8)) % _U(HASHES)).astype(np.int64)
    more = ((dice >> _U(32)).astype(np.float64) / 2.0**32 < 1 / threshold - 1) & (second != first)
    rows = np.arange(len(paths))
    rows, chosen = np.concatenate([rows, rows[more]]), np.concatenate([first, second[more]])
    held = signs[rows, chosen].astype(np.uint64) | (chosen.astype(np.uint64) << _U(32))
    return rows, mix(mix(paths[rows]) ^ mix(held + _U(1)))


def _signs_of(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros((0, HASHES), np.uint32)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint32).reshape(-1, HASHES)


def _descend(threshold: float, runs: int | None = None):
    """Children of ``(path, set_key, sign)`` rows; at the start every set stands at the root of each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, keys = _signs_of(batch.column("sign")), batch.column("set_key")
            roots = [np.full(len(signs), mix(np.array([r + 1], np.uint64))[0]) for r in range(runs)] if runs else [
                batch.column("path").to_numpy().view(np.uint64)]
            for paths in roots:
                rows, children = _children(paths, signs, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(children.view(np.int64)), keys.take(pa.array(rows))], ["path", "set_key"])
    return run


def _components(near: np.ndarray) -> np.ndarray:
    """The lowest index of each row's component in a symmetric matrix of links."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        lower = np.array([label[row].min() for row in near])
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _groups(batches: Iterator[pa.RecordBatch], name: str, read) -> Iterator[tuple]:
    """Gather rows that come sorted by ``name`` into groups: lists of what ``read`` made of the rows."""
    current, held = None, []
    for batch in batches:
        keys = batch.column(name).to_numpy()
        values = read(batch)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for low, high in zip(cuts[:-1], cuts[1:]):
            if low == high:
                continue
            if keys[low] != current:
                if held:
                    yield held
                current, held = keys[low], []
            held.append([v[low:high] for v in values])
    if held:
        yield held


def _brute(least: float):
    """Within each bucket, link every set to the lowest of its component of similar estimates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        read = lambda b: (np.array(b.column("set_key").to_pylist(), object), _signs_of(b.column("sign")))
        for held in _groups(batches, "path", read):
            keys, signs = (np.concatenate(part) for part in zip(*held))
            if len(keys) == 2:
                if (signs[0] == signs[1]).mean() >= least:
                    left.append(keys[1])
                    right.append(keys[0])
            elif len(keys) > 2:
                near = np.array([(signs == s).mean(axis=1) >= least for s in signs])
                label = _components(near)
                for i in np.flatnonzero(label != np.arange(len(label))):
                    left.append(keys[i])
                    right.append(keys[label[i]])
            if len(left) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
    return run


def _compare(rows: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """Links inside the buckets of ``(path, set_key)``."""
    with_sign = rows.select("path", "set_key").join(signs, "set_key").select("path", "set_key", "sign")
    return with_sign.repartition("path").sortWithinPartitions("path").mapInArrow(_brute(least), "a binary, b binary")


def candidate_links(sets: DataFrame, threshold: float, recall: float, depth: int, limit: int) -> DataFrame:
    """``(a, b)``: links that join any two similar sets with probability ``recall`` or more.

    Every run starts with all sets in one node.  A node samples one or two
    coordinates of the min-wise signatures, and a set goes to a child per sampled
    token it holds; sets that are alone leave.  Buckets of up to ``limit`` sets are compared at
    once, larger ones split again.  What is still larger at the last level is
    compared in blocks, every two blocks once.
    """
    least = threshold - SLACK
    runs = math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))
    rows = materialise(sets.select("set_key", "sign").mapInArrow(_descend(threshold, runs), "path bigint, set_key binary"), "paths")
    links, signs = [], None
    for level in range(1, depth + 1):
        buckets = rows.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("who")).where("n > 1")
        live = materialise(rows.join(buckets, "path"), "live")
        if signs is None:  # most sets meet no other and are done
            signs = materialise(sets.select("set_key", "sign").join(live.select("set_key").distinct(), "set_key"), "signs")
        # runs often put the same sets together: one bucket of each kind is enough
        small = live.where(F.col("n") <= limit)
        chosen = small.groupBy("n", "who").agg(F.min("path").alias("path")).select("path")
        links.append(materialise(_compare(small.join(chosen, "path", "left_semi"), signs, least), "links"))
        large = live.where(F.col("n") > limit)
        if large.isEmpty():
            break
        if level == depth:
            blocks = F.ceil(F.col("n") / limit).cast("int")
            mine = F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("blocks")).cast("int")
            dealt = (large.withColumn("blocks", blocks).withColumn("mine", mine)
                     .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                     .select(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), "set_key"))
            links.append(materialise(_compare(dealt, signs, least), "links"))
        else:
            rows = materialise(large.select("path", "set_key").join(signs, "set_key").select("path", "set_key", "sign")
                               .mapInArrow(_descend(threshold), "path bigint, set_key binary"), "paths")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; nodes are hashes.

    Each round, every node goes over to its least neighbour and edges follow
    until none is left.  As the order of hashes has nothing to do with the graph,
    a round takes away a share of all nodes; stars, which is what buckets send, need one.
    """
    edges = materialise(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy(F.col("a").alias("old")).agg(F.least(F.min("b"), F.col("old")).alias("new")), "step")
        if labels is None:
            labels = step.select(F.col("old").alias("node"), F.col("new").alias("component"))
        else:
            labels = labels.join(step, F.col("component") == F.col("old"), "left").select(
                "node", F.coalesce("new", "component").alias("component"))
        labels = materialise(labels, "labels")
        edges = edges.join(step, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        edges = edges.join(step, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        edges = materialise(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    return labels


def _verify(width: int, threshold: float):
    """Exact similarities inside a task: per set the weight of its partners and the lowest set it hangs together with."""
    def overlaps(items: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        _, token, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = count[token] > 1
        owner, token = owner[shared], token[shared]
        names, token = np.unique(token, return_inverse=True)
        total = np.zeros((len(items), len(items)), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        step = max(1, 16_000_000 // max(1, len(items)))
        for low in range(0, len(names), step):
            first, last = np.searchsorted(token, [low, low + step])
            part = np.zeros((len(items), min(step, len(names) - low)), np.float32)
            part[owner[first:last], token[first:last] - low] = 1
            total += part @ part.T
        return total

    def read(batch: pa.RecordBatch):
        items = np.empty(batch.num_rows, object)
        for i, x in enumerate(shingles(batch.column("text"), width)):
            items[i] = x
        return (np.array(batch.column("set_key").to_pylist(), object), batch.column("docs").to_numpy(),
                batch.column("side").to_numpy(), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for held in _groups(batches, "task", read):
            keys, docs, side, items = (np.concatenate(part) for part in zip(*held))
            # a repeated row can bring a set twice
            _, once = np.unique(keys.astype("S16"), return_index=True)
            keys, docs, side, items = keys[once], docs[once], side[once], items[once]
            size = np.array([len(x) for x in items])
            inter = overlaps(list(items))
            near = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-6
            np.fill_diagonal(near, False)
            if (side >= 0).any():
                near &= side[:, None] != side[None, :]
            label = _components(near)
            out += zip(keys, keys[label], near @ docs)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        a, b, n = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                          ["set_key", "root", "links"])
    return run


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL,
                 depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, text_key, class_id, n_links, class_key)`` per row.

    Two rows are linked when the Jaccard similarity of their sets of word
    shingles is ``threshold`` or more; a class is a connected component, named
    by its lowest ``doc_id``.  Rows with one set are handled as one set with a
    count.  The chosen-path join gives candidate groups by signature; inside
    each, every pair is then checked on the whole sets, in tasks of bounded
    size that send on counts and one link per set, never all pairs.

    A text with fewer words than a shingle is one shingle; a text without words
    (null, empty, blanks) is linked to nothing and is a class of its own.
    """
    small_batches(docs.sparkSession)
    signed = materialise(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        _sign(width), docs.select("doc_id").schema.add("text_key", "long").add("set_key", "binary")
        .add("n", "long").add("sign", "binary")), "signatures")
    sets = materialise(signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.count("*").alias("docs"), F.min(F.struct("doc_id", "text_key")).alias("carrier"), F.first("n").alias("n"),
        F.first("sign").alias("sign")), "sets")
    groups = materialise(components(candidate_links(sets, threshold, recall, depth, limit)).select(
        F.col("node").alias("set_key"), F.col("component").alias("group")), "groups")
    members = groups.join(sets.drop("sign"), "set_key")
    blocks = members.groupBy("group").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = materialise(members.join(blocks, "group").select(
        "set_key", "docs", "group", "blocks", F.col("carrier.doc_id").alias("id"), F.col("carrier.text_key").alias("key")), "members")
    mine = F.pmod(F.xxhash64("set_key", F.lit(2)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # in a task of two blocks only pairs across them count
    side = F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise(F.col("mine"))
    texts = docs.select(F.col("doc_id").alias("own_id"), text_key().alias("own_key"), "text")
    # before texts move, a table of at most FILTER_SLOTS numbers drops most of those that are not asked for
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(FILTER_SLOTS))
    asked = members.select(slot("id", "key").alias("slot")).distinct()
    texts = texts.withColumn("slot", slot("own_id", "own_key")).join(F.broadcast(asked), "slot", "left_semi")
    tasks = (texts.join(members, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
             .withColumn("mine", mine).withColumn("other", other)
             .select("set_key", "docs", side.alias("side"), "text",
                     F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("task")))
    checked = materialise(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(
        _verify(width, threshold), "set_key binary, root binary, links bigint"), "checked")
    links = checked.groupBy("set_key").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    named = (sets.select("set_key", "docs", "carrier").join(links, "set_key", "left")
             .join(classes.withColumnRenamed("node", "set_key"), "set_key", "left")
             .withColumn("component", F.coalesce("component", "set_key")))
    first = named.groupBy("component").agg(F.min("carrier").alias("first"))
    named = named.join(first, "component").select(
        "set_key", "first", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "text_key", "set_key").join(named, "set_key", "left").select(
        "doc_id", "text_key", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("set_key").isNull(), F.col("text_key")).otherwise(F.col("first.text_key")).alias("class_key"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of each class: a row of its lowest id.  Rows without words all stay."""
    chosen = near_classes(docs, **settings).select(F.col("class_id").alias("id"), F.col("class_key").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_key().alias("own_key"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
