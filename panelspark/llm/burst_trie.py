"""The prefix trie of rebuilt conversations, as a burst trie whose containers are spread over the cluster."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import small_batches
from panelspark.operators.joins import lookup
from panelspark.session import materialise

TURN = 24                    # bytes of a turn's id: 128 bits of its role and text, 64 of the text's size
GROUP, MOST_SHARED = 5, 9    # a conversation takes fewer than 9 turns from the first of its five
CONTAINER_ROWS, CONTAINER_BYTES = 256, 8 << 20   # a container above either bursts
CHUNK_BITS = 12              # ids of members are strung together in runs of 4,096
NO_MEMBER = hashlib.sha256(b"").hexdigest()
ROOT = "root"

ROWS = "path string, depth bigint, parent string, key string, ids binary, n bigint, first bigint, ends string"
NODES = ("top boolean, path string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes that tell turns apart and carry the size of the text in UTF-8."""
    known = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(known, F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")))


def encode(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ids)``: the ids of each conversation's turns one after another, without any text.

    Turns go by ``turn``, null first; texts move only for conversations in
    which unlike turns have one number, and there role and text decide.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("numbered"),
        F.coalesce("turn", F.lit(0)).cast("bigint").alias("number"), empty("role").alias("role"), empty("text").alias("text"))
    key = turns.select("conv_id", F.struct("numbered", "number", F.lit(0).alias("tie"), turn_id(F.col("role"), F.col("text")).alias("id")).alias("t"))

    def lists(rows: DataFrame) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def joined(rows: DataFrame) -> DataFrame:
        return rows.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("ids"))

    n = F.size("turns")
    tied = F.exists(F.zip_with(F.slice("turns", F.lit(1), n - 1), F.slice("turns", F.lit(2), n), lambda a, b: (
        (a["numbered"] == b["numbered"]) & (a["number"] == b["number"]) & (a["id"] != b["id"]))), lambda x: F.coalesce(x, F.lit(False)))
    first = materialise(lists(key).select("conv_id", "turns", tied.alias("tied")), "turn_lists")
    again = first.where("tied").select("conv_id")
    if again.isEmpty():
        return joined(first)
    # the order inside a conversation with ties: one sort of its own turns
    full = turns.join(again, "conv_id", "left_semi").select("conv_id", F.struct(
        "numbered", "number", "role", "text", turn_id(F.col("role"), F.col("text")).alias("id")).alias("t"))
    return joined(first.where(~F.col("tied"))).unionByName(joined(lists(full)))


def rebuild(encoded: DataFrame) -> DataFrame:
    """``(conv_id, ids)``: the first h turns of the first conversation of each five, then the own ones after h.

    h is the CRC-32 of the decimal id modulo ``MOST_SHARED``.
    """
    shared = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(MOST_SHARED)).cast("int")
    own = encoded.select("conv_id", "ids", (shared * TURN).alias("cut"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = encoded.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.substring("ids", F.lit(1), F.lit(TURN * (MOST_SHARED - 1))).alias("head"))
    taken = F.coalesce(F.substring(F.col("head"), F.lit(1), F.col("cut")), F.lit(bytearray()))
    return own.join(heads, "base", "left").select(
        "conv_id", F.concat(taken, F.substring(F.col("ids"), F.col("cut") + 1, F.octet_length("ids"))).alias("ids"))


# ---- conversations that are the same ----------------------------------------------------

def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of ids of each class, which come in order; nothing is kept but the running hash."""
    key, running, out = None, None, []
    for batch in batches:
        for own, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != key:
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = own, hashlib.sha256(chunk.encode())
            else:
                running.update(b"," + chunk.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.string()),
                                          "ends": pa.array([e for _, e in out], pa.string())})
        out = []
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [running.hexdigest()]})


def classes(rebuilt: DataFrame) -> DataFrame:
    """``(key, ids, n, first, ends)``: each distinct sequence, its conversations' number, least id and hash of ids.

    Ids are strung together in runs of 4,096 numbers, so a class with any share
    of all conversations is many short groups; only the hash, which has to see
    its runs in turn, streams them through one task.
    """
    chunks = materialise(
        rebuilt.groupBy(F.md5("ids").alias("key"), F.shiftright("conv_id", CHUNK_BITS).alias("run"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("members"))
        .select("key", "run", F.size("members").cast("bigint").alias("n"), F.col("members")[0].alias("first"),
                F.array_join(F.transform("members", lambda c: c.cast("string")), ",").alias("chunk")), "member_runs")
    found = materialise(chunks.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("runs"), F.min("chunk").alias("chunk")), "classes")
    streamed = chunks.join(found.where("runs > 1").select("key"), "key", "left_semi").select("key", "chunk", "run").repartition(
        "key").sortWithinPartitions("key", "run").select("key", "chunk").mapInArrow(_hash_members, "key string, ends string")
    named = found.join(streamed, "key", "left").select(
        "key", "n", "first", F.coalesce("ends", F.sha2("chunk", 256)).alias("ends"))
    return named.join(rebuilt.select(F.col("conv_id").alias("first"), "ids"), "first").select("key", "ids", "n", "first", "ends")


# ---- bursting ---------------------------------------------------------------------------

def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n:n + TURN] == b[n:n + TURN]:
        n += TURN
    return n // TURN


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far all sequences of a container agree: as far as its least and its greatest do."""
    for batch in batches:
        rows = batch.to_pylist()
        reach = [_common(r["low"], r["high"]) for r in rows]
        yield pa.RecordBatch.from_pydict({
            "path": batch.column("path"), "depth": batch.column("depth"), "parent": batch.column("parent"),
            "rows": batch.column("rows"), "reach": pa.array(reach, pa.int64()),
            "prefix": pa.array([r["low"][:n * TURN] for r, n in zip(rows, reach)], pa.binary())})


def burst(container: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads, ends and new containers of oversized containers.

    A head stands for the nodes from its container's depth to where the
    sequences part; sequences that end there are ends, all others go to a
    container per next turn.  So a long stretch in common is one step.
    """
    ranges = container.groupBy("path", "depth", "parent").agg(
        F.min("ids").alias("low"), F.max("ids").alias("high"), F.count("*").alias("rows"))
    heads = materialise(ranges.mapInArrow(
        _reach, "path string, depth bigint, parent string, rows bigint, reach bigint, prefix binary"), "heads")
    dealt = materialise(lookup(container, heads.select("path", "rows", "reach"), "path", "key", "rows"), "dealt")
    ends = dealt.where(F.octet_length("ids") == F.col("reach") * TURN).select(F.col("path").alias("parent"), "n", "first", "ends")
    reach = F.col("reach").cast("int")
    deeper = dealt.where(F.octet_length("ids") > F.col("reach") * TURN).select(
        F.md5(F.substring(F.col("ids"), F.lit(1), (reach + 1) * TURN)).alias("path"), (F.col("reach") + 1).alias("depth"),
        F.col("path").alias("parent"), "key", "ids", "n", "first", "ends")
    return heads, ends, deeper


# ---- from containers to nodes -----------------------------------------------------------

class _Node:
    __slots__ = ("depth", "first", "n", "children", "leaves", "saved", "ends", "size", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.first, self.ends = depth, size, None, NO_MEMBER
        self.n = self.children = self.leaves = self.saved = 0
        self.waiting: list[tuple] = []

    def take(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


class _Sweep:
    """Goes over the sorted sequences of a container and closes every node once its last member has passed."""

    def __init__(self, path: str, depth: int):
        self.path, self.depth, self.open, self.last, self.out = path, depth, [], b"", []

    def add(self, ids: bytes, n: int, first: int, ends: str) -> None:
        if self.open:
            self._close(_common(self.last, ids))
        start = self.open[-1].depth + 1 if self.open else self.depth
        for depth in range(start, len(ids) // TURN + 1):
            size = int.from_bytes(ids[depth * TURN - 8:depth * TURN], "big") if depth else 0
            self.open.append(_Node(depth, size))
        self.open[-1].take(n, first)
        self.open[-1].ends, self.last = ends, ids

    def _close(self, depth: int) -> None:
        while self.open and self.open[-1].depth > depth:
            node = self.open.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
            self.out += [(False, self.path, row[0], row[1], node.first, *row[2:]) for row in node.waiting]
            row = (node.first, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)
            if self.open:
                up = self.open[-1]
                up.take(node.n, node.first)
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
                up.waiting.append(row)
            else:
                self.out.append((True, self.path, row[0], row[1], None, *row[2:]))

    def end(self) -> None:
        self._close(self.depth - 1)


_ARROW = pa.schema([("top", pa.bool_()), ("path", pa.string()), *[(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in OUT]])


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows come sorted by path and sequence."""
    sweep = None
    for batch in batches:
        for r in batch.to_pylist():
            if sweep is None or sweep.path != r["path"]:
                if sweep:
                    sweep.end()
                    yield _nodes(sweep.out)
                sweep = _Sweep(r["path"], r["depth"])
            sweep.add(r["ids"], r["n"], r["first"], r["ends"])
            if len(sweep.out) >= 10_000:
                yield _nodes(sweep.out)
                sweep.out = []
    if sweep:
        sweep.end()
        yield _nodes(sweep.out)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that heads stand for, from the deepest up; only the deepest branches."""
    for batch in batches:
        for r in batch.to_pylist():
            saved, out = r["saved"], []
            for depth in range(r["reach"], r["depth"] - 1, -1):
                size = int.from_bytes(r["prefix"][depth * TURN - 8:depth * TURN], "big") if depth else 0
                saved += (r["n"] - 1) * size
                deepest, top = depth == r["reach"], depth == r["depth"]
                out.append((top, r["path"], r["first"], depth, None if top else r["first"], r["n"],
                            r["children"] if deepest else 1, r["leaves"], saved, r["ends"] if deepest else NO_MEMBER))
                if len(out) >= 10_000:
                    yield _nodes(out)
                    out = []
            yield _nodes(out)


def prefix_trie(conversations: DataFrame, container_rows: int = CONTAINER_ROWS,
                container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """One row per node of the prefix trie of all rebuilt conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``: a node is a distinct sequence of the first
    ``depth`` turns, named by the least of the conversations that start with it.

    Conversations become sequences of turn ids; equal ones are one row.  All
    start in one container.  A container above ``container_rows`` sequences or
    ``container_bytes`` bursts: a trie head takes the turns that all of them
    share, and each next turn gets a container.  What remains is
    sorted and swept into nodes, container by container; heads are summed up
    from the deepest to the root.  Texts are read once and move only to settle ties.

    Turns of one conversation go by ``turn`` (null first), then by role and
    text; repeated rows are turns of their own.  Null role or text is empty.
    Rows without ``conv_id`` belong to no conversation.  A conversation whose
    turns all fall away stays a member of the root.  An empty table gives no rows.
    The ids of one conversation (24 bytes a turn) are one row.
    """
    small_batches(conversations.sparkSession)
    rebuilt = materialise(rebuild(encode(conversations)), "rebuilt")
    rows = materialise(classes(rebuilt).select(
        F.lit(ROOT).alias("path"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("parent"),
        "key", "ids", "n", "first", "ends"), "sequences")
    steps, settled, first = [], [], True
    while True:
        if first:  # the root is always a head
            over = rows
        else:
            sizes = materialise(rows.groupBy("path").agg(
                F.count("*").alias("rows"), F.sum(F.octet_length("ids")).alias("bytes")), "container_sizes")
            sized = materialise(lookup(rows, sizes, "path", "key", "rows"), "sized")
            large = (F.col("rows") > 1) & ((F.col("rows") > container_rows) | (F.col("bytes") > container_bytes))
            settled.append(sized.where(~large).drop("rows", "bytes"))
            over = sized.where(large).drop("rows", "bytes")
        if over.isEmpty():
            break
        heads, ends, deeper = burst(over)
        rows, first = materialise(deeper, "containers"), False
        steps.append((heads, ends))
    if not steps:
        return _nodes_of(rows.sparkSession.createDataFrame([], NODES))
    remaining = settled[0]
    for more in settled[1:]:
        remaining = remaining.unionByName(more)
    swept = materialise(remaining.select("path", "depth", "ids", "n", "first", "ends").repartition("path")
                        .sortWithinPartitions("path", "ids").mapInArrow(_sweep, NODES), "swept")
    parents = remaining.select("path", "parent").distinct()
    tops = materialise(swept.where("top").drop("top", "parent_conv_id").join(parents, "path"), "tops")

    below, chains = tops, []
    for heads, ends in reversed(steps):
        kind = lambda children, n, first, leaves, saved, ends: [
            children.alias("children"), n.alias("n"), first.alias("first"), leaves.alias("leaves"), saved.alias("saved"), ends.alias("ends")]
        zero, col = F.lit(0).cast("bigint"), F.col
        parts = below.select("parent", *kind(F.lit(1), col("n_convs"), col("conv_id"), col("n_leaves"), col("saved_tokens"), F.lit(None).cast("string"))).unionByName(
            ends.select("parent", *kind(zero, col("n"), col("first"), zero, zero, col("ends"))))
        sums = parts.groupBy("parent").agg(
            F.sum("children").alias("children"), F.sum("n").alias("n"), F.min("first").alias("first"),
            F.greatest(F.sum("leaves"), F.lit(1)).alias("leaves"), F.sum("saved").alias("saved"),
            F.coalesce(F.max("ends"), F.lit(NO_MEMBER)).alias("ends"))
        summed = heads.join(sums.withColumnRenamed("parent", "path"), "path")
        made = materialise(summed.mapInArrow(_chains, NODES), "chains")
        chains.append(made)
        risen = made.where("top").drop("top", "parent_conv_id").join(heads.select("path", "parent"), "path")
        tops = tops.unionByName(risen)
        # containers that hang from heads of earlier steps wait for them
        mine = heads.select("path")
        below = materialise(below.join(mine, below["parent"] == mine["path"], "left_anti").unionByName(risen), "below")
    nodes = swept.where(~F.col("top"))
    for made in chains:
        nodes = nodes.unionByName(made.where(~F.col("top")))
    # the node above a top is the deepest of the head that its container hangs from
    above = chains[0]
    for made in chains[1:]:
        above = above.unionByName(made)
    above = materialise(above.groupBy("path").agg(F.min("conv_id").alias("parent_conv_id")).join(
        tops.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("rows")), "path"), "above")
    placed = lookup(tops.where(F.col("parent").isNotNull()).withColumnRenamed("path", "own").withColumnRenamed("parent", "path"),
                    above, "path", "own", "rows")
    root = tops.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return _nodes_of(nodes).unionByName(_nodes_of(placed)).unionByName(_nodes_of(root))


def _nodes_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(*OUT)
