"""Quality rules: base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import text_key, text_or_empty, words
from panelspark.operators.joins import lookup
from panelspark.session import materialise

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATISTICS = ("symbols", "capitals", "length", "calls")
MIN_WORDS = 50
MIN_VECTORS = 40       # fewer different vectors share an estimate with others of their language
BROADCAST_CELLS = 100_000   # limits of so many cells go to every task; more are looked up
SUBSET = 0.5           # the share of vectors that an estimate rests on
CONSISTENCY = 2.109    # covariance of that share of a normal in four dimensions -> of the whole
STEPS = 4
FLOOR = 0.05           # least standard deviation of a statistic, in its transformed unit
CUTOFF = 13.28          # squared distance; one normal row in 100 lies further out, in four dimensions
SHORT = 100            # deviations of texts with about so many words shrink by the root of a half
MEDIAN_BIN = 0.002
DISTANCE_BINS = 64     # per doubling


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _windows(words_of: Column) -> Column:
    """The hash of every run of three words."""
    return F.when(F.size(words_of) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(words_of) - 2),
        lambda i: F.xxhash64(F.element_at(words_of, i), F.element_at(words_of, i + 1), F.element_at(words_of, i + 2))
    )).otherwise(F.array().cast("array<bigint>"))


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows that begin at the (sorted) places."""
    return F.when(F.size(places) == 0, F.lit(0)).otherwise(3 + F.aggregate(
        F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
                   F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3))),
        F.lit(0), lambda total, x: total + x))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...)``.

    To find 3-word windows that repeat, their hashes are sorted inside the row;
    places are looked at only where some do, by membership where they are few
    and by a sort with places where they are many.  Nothing is shuffled.
    """
    few = 64
    base = docs.select("doc_id", text_key().alias("text_key"), "lang", "source", text_or_empty().alias("t"))
    base = base.withColumn("w", words(F.col("t")))
    base = base.withColumn("h", _windows(F.col("w")))
    ordered = base.withColumn("s", F.sort_array("h"))
    repeats = ordered.withColumn("r", F.array_distinct(F.filter(
        F.col("s"), lambda x, i: (i > 0) & (x == F.get(F.col("s"), i - 1)))))
    by_member = F.filter(F.transform(F.col("h"), lambda x, i: F.when(F.array_contains(F.col("r"), x), i)),
                         lambda i: i.isNotNull())
    pairs = repeats.withColumn("p", F.when(F.size("r") > few, F.sort_array(
        F.transform(F.col("h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda j, i: F.get(F.col("p"), j)["h"] == F.get(F.col("p"), i)["h"]
    by_sort = F.sort_array(F.transform(F.filter(
        F.col("p"), lambda x, i: F.coalesce(((i > 0) & same(i - 1, i)), F.lit(False))
        | F.coalesce(same(i + 1, i), F.lit(False))), lambda x: x["i"]))
    placed = pairs.withColumn("places", F.when(F.size("r") == 0, F.array().cast("array<int>"))
                              .when(F.size("r") <= few, by_member).otherwise(by_sort))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\u000b\f\r")) != "")
    return placed.select(
        "doc_id", "text_key", "lang", "source", F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.translate(F.col("t"), " \t\n\u000b\f\r", "")).cast("bigint").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("places")).cast("bigint").alias("n_repeat_words"),
        _count(F.col("t"), CAPITALS).cast("bigint").alias("n_capitals"),
        _count(F.col("t"), "!?").cast("bigint").alias("n_calls"))


def _medians(rows: DataFrame) -> DataFrame:
    """Median of every statistic per group, on a fine grid: counts per bin, so any group stays spread."""
    binned = (rows.select("cell", *[F.floor(F.col(c) / MEDIAN_BIN).alias(c) for c in STATISTICS])
              .unpivot(["cell"], list(STATISTICS), "name", "bin").groupBy("cell", "name", "bin")
              .agg(F.count("*").alias("n")))
    upto = Window.partitionBy("cell", "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("cell", "name")
    middle = (binned.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
              .where(2 * F.col("upto") >= F.col("all")).groupBy("cell", "name").agg(F.min("bin").alias("bin")))
    return middle.groupBy("cell").agg(*[
        F.max(F.when(F.col("name") == c, (F.col("bin") + 0.5) * MEDIAN_BIN)).alias(f"mid_{c}") for c in STATISTICS])


def _estimates(rows: DataFrame, scale: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance per cell, from sums; one row per cell."""
    p = len(STATISTICS)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)]
    sums += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy("cell").agg(F.count("*").alias("n"), *sums)
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    out = out.withColumns({f"c{i}_{j}": F.lit(scale) * (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
                           + F.lit(FLOOR * FLOOR if i == j else 0.0) for i in range(p) for j in range(i + 1)})
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.select("cell", *[f"m{i}" for i in range(p)], *[f"l{i}_{j}" for i in range(p) for j in range(i + 1)])


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Add ``distance``, the squared Mahalanobis distance to the cell's estimate."""
    out = rows.join(estimates, "cell")
    for i, c in enumerate(STATISTICS):
        rest = F.col(c) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    return out.withColumn("distance", sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(STATISTICS))))


def _nearest(rows: DataFrame) -> DataFrame:
    """The vectors up to the distance within which ``SUBSET`` of their cell lies (counted in fine bins)."""
    binned = rows.withColumn("bin", F.floor(F.log2(F.col("distance") + 1e-6) * DISTANCE_BINS))
    upto = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    limit = (binned.groupBy("cell", "bin").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
             .withColumn("all", F.sum("n").over(Window.partitionBy("cell")))
             .where(F.col("upto") >= SUBSET * F.col("all")).groupBy("cell").agg(F.min("bin").alias("limit"), F.max("all").alias("all")))
    limit = materialise(limit, "limits")
    if limit.count() <= BROADCAST_CELLS:
        met = binned.join(F.broadcast(limit), "cell")
    else:  # large cells are spread
        met = lookup(binned.withColumn("deal", F.xxhash64(*STATISTICS)), limit, "cell", "deal", "all").drop("deal")
    return met.where(F.col("bin") <= F.col("limit"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Base counts and verdict per row: ``(doc_id, text_key, n_words, ..., base_failed, distance, kept)``.

    A row fails the base rules with fewer than 50 words or with more than half
    of its words in repeated 3-word windows.  The others are vectors of four
    statistics, transformed: root of the share of symbols, root of the share of
    capitals, log of the mean word length, root of the exclamation and question
    marks per word; less the median of the row's cell and, as short texts
    scatter more, times sqrt(n / (n + 100)).  A cell is a language and source;
    cells with under 40 different vectors are joined per language, and such
    remains again into one.  Per cell the minimum-covariance-determinant estimate is found by
    concentration steps from a start at the median: take the half of the vectors
    that are nearest, estimate anew.  Equal vectors of a cell count once in
    median and estimate, so copies neither draw the estimate to themselves nor
    make it narrow; near copies may hold less than half of a cell.  Every row is
    judged: one whose squared Mahalanobis distance exceeds ``cutoff`` is rejected.

    All steps are sums and counts per cell, so a cell with most of the table is
    no single task.  Null languages and sources are values of their own, a null
    text has no words and fails; if too few vectors remain for an estimate, base
    rules alone decide.  Repeated rows are judged alike.
    """
    stats = materialise(document_statistics(docs).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "statistics")
    words_of, chars = F.col("n_words").cast("double"), F.greatest(F.col("word_chars"), F.lit(1))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c)
    raw = stats.where(~F.col("base_failed")).select(
        "doc_id", "text_key", named("lang"), named("source"),
        F.sqrt(F.col("n_symbols") / chars).alias("symbols"), F.sqrt(F.col("n_capitals") / chars).alias("capitals"),
        F.log(chars / words_of).alias("length"), F.sqrt(F.col("n_calls") / words_of).alias("calls"),
        F.sqrt(words_of / (words_of + SHORT)).alias("shrink"))
    raw = materialise(raw, "raw")
    cells = raw.select("lang", "source", *STATISTICS, "shrink").distinct().groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = Window.partitionBy("lang", F.col("n") >= MIN_VECTORS)
    cells = cells.withColumn("pooled", F.sum("n").over(small)).select(
        "lang", "source", F.when(F.col("n") >= MIN_VECTORS, F.concat_ws("\u0001", F.lit("cell"), "lang", "source"))
        .when(F.col("pooled") >= MIN_VECTORS, F.concat_ws("\u0001", F.lit("lang"), "lang"))
        .otherwise(F.lit("rest")).alias("cell"))
    raw = materialise(raw.join(cells, ["lang", "source"]).drop("lang", "source"), "raw_cells")
    once = materialise(raw.select("cell", *STATISTICS, "shrink").distinct(), "distinct")
    shift = materialise(_medians(once), "medians")
    moved = [((F.col(c) - F.col(f"mid_{c}")) * F.col("shrink")).alias(c) for c in STATISTICS]
    rows = materialise(raw.join(shift, "cell").select("doc_id", "text_key", "cell", *moved), "vectors")
    once = materialise(once.join(shift, "cell").select("cell", *moved), "distinct_vectors")
    # the start: distance to the median, every statistic in units of its floor
    start = once.withColumn("distance", sum(F.least(F.col(c) * F.col(c) / (FLOOR * FLOOR), F.lit(1e6)) for c in STATISTICS))
    estimate = materialise(_estimates(_nearest(start), CONSISTENCY), "estimate")
    for _ in range(STEPS):
        estimate = materialise(_estimates(_nearest(_with_distance(once, estimate)), CONSISTENCY), "estimate")
    enough = once.groupBy("cell").agg(F.count("*").alias("vectors"))
    verdict = (_with_distance(rows, estimate).join(enough, "cell")
               .withColumn("out", (F.col("distance") > cutoff) & (F.col("vectors") >= MIN_VECTORS))
               .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
               .agg(F.max("distance").alias("distance"), F.max("out").alias("out")))
    return (stats.join(verdict, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("out", F.lit(False))).drop("_id", "_key", "out"))


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that pass; rows with equal id and text pass or fail together."""
    good = judge(docs, cutoff).where("kept").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_key().alias("own_key"))
    return rows.join(good, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

