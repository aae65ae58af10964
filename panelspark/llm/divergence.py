"""Which terms set a source apart from its language, counted through acyclic transducers."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Sums, pieces, small_batches, word_bounds
from panelspark.session import materialise

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTH = 5
SHARD_TERMS, SHARD_BYTES = 32_768, 4 << 20   # a transducer takes so many terms, or so many bytes of them
SEGMENT_BYTES = 64 << 20                     # transducers that one pass over the texts carries
HELD_ROWS = 400_000                          # counts that a task keeps before it sends them on
BLOCK_TERMS, BLOCK_SOURCES = 256, 256

_GAP = np.ones(256, bool)
_GAP[0x41:0x5B] = _GAP[0x61:0x7B] = _GAP[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# ---- the transducer ---------------------------------------------------------------------

class Transducer:
    """A minimal acyclic automaton over the bytes of sorted terms.

    The numbers on a term's path add up to its ordinal.  ``keys`` holds
    ``state * 256 + byte`` of every transition in ascending order; state 0 is the start.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray):
        self.keys, self.targets, self.outputs, self.final = keys, targets, outputs, final

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending order; equal ends are shared as soon as they are complete."""
        kept: dict[tuple, int] = {}      # complete states by what follows them
        reach: list[int] = []            # terms that can end at a complete state or behind it
        shape: list[tuple] = []
        path: list[list] = [[False, []]]  # the states of the last term: [final, [(byte, complete state)]]
        last = b""

        def complete(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                number = kept.get(key)
                if number is None:
                    number = kept[key] = len(shape)
                    shape.append(key)
                    reach.append(final + sum(reach[t] for _, t in edges))
                path[-1][1].append((last[len(path) - 1], number))

        for term in terms:
            same = next((i for i, (a, b) in enumerate(zip(last, term)) if a != b), min(len(last), len(term)))
            complete(same)
            path += [[False, []] for _ in term[same:]]
            path[-1][0] = True
            last = term
        complete(0)
        keys, targets, outputs = [], [], []
        # the start comes first, complete states in their order of completion after it
        for number, (final, edges) in enumerate([(path[0][0], path[0][1]), *shape]):
            before = int(final)
            for byte, target in edges:
                keys.append(number << 8 | byte)
                targets.append(target + 1)
                outputs.append(before)
                before += reach[target]
        return cls(np.array(keys, np.uint64), np.array(targets, np.int64), np.array(outputs, np.int64),
                   np.array([path[0][0], *(f for f, _ in shape)], bool))

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.final)], np.int64)
        return b"".join(a.tobytes() for a in (head, self.keys, self.targets.astype(np.int32),
                                              self.outputs.astype(np.int32), self.final))

    @classmethod
    def unpack(cls, raw: bytes) -> Transducer:
        n, states = np.frombuffer(raw, np.int64, 2)
        at, parts = 16, []
        for kind, size in ((np.uint64, n), (np.int32, n), (np.int32, n), (bool, states)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += parts[-1].nbytes
        return cls(parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3])

    def ordinals(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ordinal of each term ``data[start:start + size]``, -1 for terms that are not in; all walk in step."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        lost = np.full(len(starts), not len(self.keys))
        alive, depth = np.flatnonzero((sizes > 0) & ~lost), 0
        while len(alive):
            key = (state[alive].astype(np.uint64) << np.uint64(8)) | data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            lost[alive[~found]] = True
            alive, at = alive[found], at[found]
            state[alive] = self.targets[at]
            total[alive] += self.outputs[at]
            depth += 1
            alive = alive[sizes[alive] > depth]
        return np.where(~lost & self.final[state], total, -1)


class Vocabulary:
    """The transducers of some languages; each covers a range of a language's terms."""

    def __init__(self, shards: list[tuple[str, str, int, bytes]]):
        self.parts: dict[str, tuple[list[bytes], list[int], list[Transducer]]] = {}
        for lang, first, base, raw in sorted(shards, key=lambda s: (s[0], s[2])):
            firsts, bases, machines = self.parts.setdefault(lang, ([], [], []))
            firsts.append(first.encode())
            bases.append(base)
            machines.append(Transducer.unpack(raw))

    def ordinals(self, lang: str, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), -1, np.int64)
        firsts, bases, machines = self.parts.get(lang, ([], [], []))
        if len(firsts) == 1:
            shard = np.zeros(len(starts), np.int64)
        else:
            raw = data.tobytes()
            shard = np.array([bisect.bisect_right(firsts, raw[s:s + n]) - 1 for s, n in zip(starts, sizes)], np.int64)
        for k, (base, machine) in enumerate(zip(bases, machines)):
            mine = np.flatnonzero(shard == k)
            found = machine.ordinals(data, starts[mine], sizes[mine])
            out[mine] = np.where(found >= 0, found + base, -1)
        return out


# ---- terms of texts, inside Arrow tasks -------------------------------------------------

def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """``(first, last, row of each term, its number, the distinct terms)`` for runs of rows."""
    for first, last, data, offsets in pieces(column, 4 << 20):
        starts, ends, rows = word_bounds(data, offsets, _GAP)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        letters = _LOWER[data[~_GAP[data]]]
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        yield first, last, np.repeat(np.arange(last - first), np.diff(rows)), terms.indices.to_numpy(), terms.dictionary


def _plain(column: pa.Array) -> pa.DictionaryArray:
    return column.cast(pa.string()).dictionary_encode()


def _documents_by_term(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "term"], most)
        for batch in batches:
            langs = _plain(batch.column(0))
            lang_of = langs.indices.to_numpy().astype(np.int64)
            for first, last, row, code, distinct in _terms(batch.column(1)):
                kinds = max(1, len(distinct))
                once = np.unique(row * kinds + code)
                key, n = np.unique(lang_of[first:last][once // kinds] * kinds + once % kinds, return_counts=True)
                yield from sums.add(pa.table({
                    "lang": langs.dictionary.take(pa.array(key // kinds)),
                    "term": distinct.take(pa.array(key % kinds)).cast(pa.large_string()).cast(pa.string()), "n": n}))
        yield from sums.flush()
    return run


def _recount(vocabulary, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Vocabulary(vocabulary.value), Sums(["lang", "source", "ordinal"], most)
        for batch in batches:
            langs, sources = _plain(batch.column(0)), _plain(batch.column(1))
            n_sources = max(1, len(sources.dictionary))
            group_of = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
            for first, last, row, code, distinct in _terms(batch.column(2)):
                kinds = max(1, len(distinct))
                key, n = np.unique(group_of[first:last][row] * kinds + code, return_counts=True)
                group, code = key // kinds, key % kinds
                bounds = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, 8 * distinct.offset)
                letters = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8)
                ordinal = np.full(len(key), -1, np.int64)
                for lang in np.unique(group // n_sources):
                    mine = np.flatnonzero(group // n_sources == lang)
                    asked, back = np.unique(code[mine], return_inverse=True)
                    ordinal[mine] = known.ordinals(langs.dictionary[int(lang)].as_py(), letters, bounds[asked],
                                                   bounds[asked + 1] - bounds[asked])[back]
                kept = np.flatnonzero(ordinal >= 0)
                yield from sums.add(pa.table({
                    "lang": langs.dictionary.take(pa.array(group[kept] // n_sources)),
                    "source": sources.dictionary.take(pa.array(group[kept] % n_sources)),
                    "ordinal": ordinal[kept], "n": n[kept]}))
        yield from sums.flush()
    return run


# ---- the vocabulary as a table ----------------------------------------------------------

def _build(most_terms: int, most_bytes: int):
    """Transducers of sorted ``(lang, term)`` rows; a new one begins with a language or when the last is full.

    The terms themselves follow with their places, a row each.
    """
    def done(lang: str, terms: list[str]) -> pa.RecordBatch:
        raw, n = Transducer.build(t.encode() for t in terms).pack(), len(terms)
        return pa.RecordBatch.from_pydict({
            "lang": [lang] * (n + 1), "first": [terms[0]] * (n + 1), "term": pa.array([None, *terms], pa.string()),
            "place": pa.array([None, *range(n)], pa.int64()), "n_terms": pa.array([n] + [None] * n, pa.int64()),
            "size": pa.array([len(raw)] + [None] * n, pa.int64()), "machine": pa.array([raw] + [None] * n, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, size = None, [], 0
        for batch in batches:
            for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if terms and (own != lang or len(terms) >= most_terms or size >= most_bytes):
                    yield done(lang, terms)
                    terms, size = [], 0
                lang = own
                terms.append(term)
                size += len(term)
        if terms:
            yield done(lang, terms)
    return run


def vocabulary(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transducers over ranges of each language's sorted terms, and the terms with their ordinals.

    ``(lang, first, base, n_terms, size, machine)`` and ``(lang, ordinal, term)``; ``base`` is the ordinal of a
    range's first term, to which the transducer's sums are added.
    """
    built = materialise(
        kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
            _build(SHARD_TERMS, SHARD_BYTES), "lang string, first string, term string, place bigint, n_terms bigint, size bigint, machine binary"),
        "transducers")
    machines = built.where(F.col("term").isNull())
    # one row per transducer, and of that the numbers only
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(machines.select("lang", "first", F.coalesce(F.sum("n_terms").over(before), F.lit(0)).alias("base")), "bases")
    terms = built.where(F.col("term").isNotNull()).join(bases, ["lang", "first"]).select(
        "lang", (F.col("base") + F.col("place")).alias("ordinal"), "term")
    return machines.select("lang", "first", "n_terms", "size", "machine").join(bases, ["lang", "first"]), terms


def _segments(machines: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """Runs of transducers of at most ``SEGMENT_BYTES`` together."""
    held, size = [], 0
    for row in machines.select("lang", "base", "size").orderBy("lang", "base").collect():
        if held and size + row["size"] > SEGMENT_BYTES:
            yield held
            held, size = [], 0
        held.append((row["lang"], row["base"]))
        size += row["size"]
    if held:
        yield held


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 * (count + 5) / (total + 5 * terms))`` by long division, so 64 bits do up to 9e15 terms."""
    part, whole, out = count + SMOOTH, total + SMOOTH * terms, F.lit(0).cast("bigint")
    for _ in range(3):
        part = part * 1000
        out = out * 1000 + _div(part, whole)
        part = F.pmod(part, whole)
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _distances(cells: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of the shares of every two sources over one block of terms."""
    heads = cells[cells["place"] < 0].sort_values("source")
    width = int(heads["width"].iloc[0])
    shares = np.repeat(heads["p"].to_numpy(np.int64)[:, None], width, axis=1)
    held = cells[cells["place"] >= 0]
    names = pd.Index(heads["source"])
    shares[names.get_indexer(held["source"]), held["place"].to_numpy(np.int64)] = held["p"].to_numpy(np.int64)
    side = heads["side"].to_numpy()
    out = []
    for i in range(len(heads)):
        # in a task of two blocks of sources only pairs across them count
        others = np.arange(i + 1, len(heads))
        if (side >= 0).any():
            others = others[side[others] != side[i]]
        value = np.abs(shares[others] - shares[i]).sum(axis=1)
        out.append(pd.DataFrame({"lang": cells["lang"].iloc[0], "a": names[i], "b": names[others], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far a language's sources lie apart, and their telling terms.

    A term is a run of letters (A-Z, lower-cased, a-z and everything beyond
    ASCII).  A language keeps the terms in at least ``min_documents`` of its
    documents.  They are sorted and built into minimal acyclic transducers,
    whose path sums are the terms' lexicographic ordinals; the texts stream
    through these a second time and are counted by ordinal.  A vocabulary of
    any size is exact: transducers cover ranges of at most ``SHARD_TERMS``
    terms, and where all together exceed ``SEGMENT_BYTES``, the texts of the
    languages concerned are read once per so many bytes.

    Every group (language and source) gives each kept term the share
    ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, and so does the language
    as a whole.  Part ``pair`` has one row per other source of the language with
    the summed differences of the shares; part ``term`` the ``top`` terms
    whose share lies furthest above the language's.  Ranks go by value, then by
    name of the source or ordinal of the term.

    Nulls in text, lang and source count as empty strings; a repeated row is
    another document.  Groups without terms are compared like any other; a
    language that keeps no term has pairs of value 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialise(
        texts.select("lang", "text").mapInArrow(_documents_by_term(HELD_ROWS), "lang string, term string, n bigint")
        .groupBy("lang", "term").agg(F.sum("n").alias("documents")).where(F.col("documents") >= min_documents), "kept_terms")
    machines, terms = vocabulary(kept)
    counts = spark.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    for segment in _segments(machines):
        wanted = spark.createDataFrame(segment, "lang string, base bigint")
        # at most SEGMENT_BYTES, or one transducer
        loaded = [tuple(r) for r in machines.join(F.broadcast(wanted), ["lang", "base"]).select("lang", "first", "base", "machine").collect()]
        carried = spark.sparkContext.broadcast([(lang, first, base, bytes(raw)) for lang, first, base, raw in loaded])
        some = texts.where(F.col("lang").isin(sorted({lang for lang, _ in segment})))
        counts = counts.unionByName(some.mapInArrow(_recount(carried, HELD_ROWS), counts.schema))
    counts = materialise(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "term_counts")

    kinds = machines.groupBy("lang").agg(F.sum("n_terms").alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    groups = materialise(
        texts.select("lang", "source").distinct()
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(kinds, "lang", "left").select("lang", "source", zero("total"), zero("terms")), "groups")
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all")).join(
        groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("terms").alias("lang_terms")), "lang")
    whole = whole.select("lang", "ordinal", _share(F.col("all"), F.col("lang_total"), F.col("lang_terms")).alias("q"))
    cells = materialise(counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "ordinal", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    telling = (cells.join(whole, ["lang", "ordinal"]).where(F.col("p") > F.col("q"))
               .select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
               .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    telling = telling.join(terms, ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(
        F.col("source") != F.col("item"))
    apart = _apart(cells, groups)
    both = apart.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        apart.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", zero("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(telling)


def _apart(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` for every two sources of a language: differences of shares summed over all kept terms.

    Terms are dealt into blocks of ``BLOCK_TERMS`` and sources into blocks of about ``BLOCK_SOURCES``; each task fills
    a matrix of two blocks of sources by one of terms, where a term that a source lacks has the share of no occurrence.
    """
    sides = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("sides"))
    dealt = groups.where("terms > 0").join(sides, "lang").withColumn(
        "mine", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other")).withColumn(
        "side", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")))
    heads = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("terms") - 1) / BLOCK_TERMS).cast("int")))).select(
        "lang", "source", "block", "one", "two", "side", F.lit(-1).alias("place"),
        _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")).alias("p"),
        F.least(F.lit(BLOCK_TERMS), F.col("terms") - BLOCK_TERMS * F.col("block")).cast("int").alias("width"))
    held = cells.join(dealt.select("lang", "source", "one", "two", "side"), ["lang", "source"]).select(
        "lang", "source", F.floor(F.col("ordinal") / BLOCK_TERMS).cast("int").alias("block"), "one", "two", "side",
        F.pmod("ordinal", F.lit(BLOCK_TERMS)).cast("int").alias("place"), "p", F.lit(None).cast("int").alias("width"))
    parts = heads.unionByName(held).groupBy("lang", "block", "one", "two").applyInPandas(
        _distances, "lang string, a string, b string, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
