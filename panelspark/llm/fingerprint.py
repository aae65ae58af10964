"""Document fingerprints by order min-hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import text_key, text_or_empty, words
from panelspark.operators.ordering import position
from panelspark.session import materialise

KMER = 3               # words
CLASSES = 32           # k-mers are dealt into so many classes by their hash
PLACE_BITS = 26        # places of words are kept up to 2**26; k-mers further on count as one place
HASH_BITS = 32
CLASS_SHIFT = PLACE_BITS + HASH_BITS
BUCKET_ROWS = 512

_PLACE = (1 << PLACE_BITS) - 1


def _class(x: Column) -> Column:
    return F.shiftrightunsigned(x, CLASS_SHIFT)


def _rank(x: Column) -> Column:
    """The hash that decides which k-mer is least."""
    return F.shiftrightunsigned(x, PLACE_BITS).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _same(a: Column, b: Column) -> Column:
    """Whether two neighbours in the sorted list are one k-mer; false past the ends."""
    return F.coalesce(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.lit(False))


def _numbered(x: Column, occurrence: Column | int) -> Column:
    """A k-mer with its occurrence number as class, hash and place in one number."""
    h = F.xxhash64(F.shiftright(x, PLACE_BITS), F.lit(occurrence).cast("int") if isinstance(occurrence, int) else occurrence)
    return F.shiftleft(F.pmod(h, F.lit(CLASSES)), CLASS_SHIFT).bitwiseOR(
        F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS)).bitwiseOR(_place(x))


def add_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the order min-hash signature of a non-null text column: an array of up to ``CLASSES`` numbers.

    Every run of three words is a k-mer (a shorter text is one k-mer, an empty
    one has none), numbered among its equals in the text.  In each class the
    two least by hash are kept, put back into text order and hashed as a pair;
    the class stands in the top bits.  So an entry agrees between two texts if
    they share the least k-mers and have them in the same order, which is what
    makes likeness follow edit distance rather than mere overlap.
    """
    w, p, e, q, s = (f"_{name}_{x}" for x in "wpeqs")
    df = df.withColumn(w, words(F.col(text)))
    at = lambda i: F.get(F.col(w), i)
    pack = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(
        F.least(i, F.lit(_PLACE)).cast("bigint"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - KMER, F.lit(0)))
    df = df.withColumn(p, F.when(F.size(w) > 0, F.sort_array(F.transform(starts, pack)))
                       .otherwise(F.array().cast("array<bigint>")))
    near = lambda i: F.get(F.col(p), i)
    # first and last places of the runs of equal k-mers; unequal ones need no number
    first = F.filter(F.transform(F.col(p), lambda x, i: F.when(_same(x, near(i + 1)) & ~((i > 0) & _same(x, near(i - 1))), i)),
                     lambda i: i.isNotNull())
    last = F.filter(F.transform(F.col(p), lambda x, i: F.when((i > 0) & _same(x, near(i - 1)) & ~_same(x, near(i + 1)), i)),
                    lambda i: i.isNotNull())
    repeats = F.exists(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: _same(near(i), near(i - 1)))
    df = df.withColumn(e, F.when((F.size(p) > 1) & repeats, F.flatten(F.zip_with(
        first, last, lambda a, b: F.transform(F.slice(F.col(p), a + 1, b - a + 1), _numbered)))))
    single = F.transform(F.when(F.col(e).isNull(), F.col(p)).otherwise(F.filter(
        F.col(p), lambda x, i: ~_same(x, near(i + 1)) & ~((i > 0) & _same(x, near(i - 1))))), lambda x: _numbered(x, 0))
    df = df.withColumn(q, F.sort_array(F.when(F.col(e).isNull(), single).otherwise(F.concat(single, F.col(e)))))
    beside = lambda i: F.get(F.col(q), i)
    df = df.withColumn(s, F.filter(F.col(q), lambda x, i: (i < 2) | (_class(F.when(i >= 2, beside(i - 2))) != _class(x))))
    kept = lambda i: F.get(F.col(s), i)

    def entry(x: Column, i: Column) -> Column:
        mate = F.when(_class(kept(i + 1)) == _class(x), kept(i + 1))
        pair = F.when(mate.isNull(), F.xxhash64(_rank(x))).when(
            _place(x) <= _place(mate), F.xxhash64(_rank(x), _rank(mate))).otherwise(F.xxhash64(_rank(mate), _rank(x)))
        leads = (i == 0) | (_class(F.when(i > 0, kept(i - 1))) != _class(x))
        return F.when(leads, F.shiftleft(_class(x), CLASS_SHIFT).bitwiseOR(F.shiftrightunsigned(pair, 64 - CLASS_SHIFT)))

    return df.withColumn(name, F.filter(F.transform(F.col(s), entry), lambda x: x.isNotNull())).drop(w, p, e, q, s)


def as_string(signature: Column) -> Column:
    """Sixteen hexadecimal digits per entry."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the classes that either text has: 1 for equal texts, 0 with nothing in common."""
    classes = F.size(F.array_union(F.transform(a, _class), F.transform(b, _class)))
    return F.when(classes == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / classes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, signature)`` of every row; a null text counts as empty."""
    signed = add_signature(docs.select("doc_id", text_or_empty().alias("text")), "text", "signature")
    return signed.select("doc_id", as_string(F.col("signature")).alias("fingerprint"), "signature")


def _bucketed(docs: DataFrame, rows: int) -> DataFrame:
    """Add ``bucket``: stretches of the order of ids that hold about ``rows`` rows each.

    Equal widths do where ids are spread evenly, which is counted first; else the
    stretches follow the places of the ids in their order.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = 1 if low is None else max(1, (high - low + 1) * rows // max(n, 1))
    even = docs.withColumn("bucket", F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("bigint"))
    if (even.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= 8 * rows:
        return even
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    placed = position(ids, [F.col("doc_id").asc_nulls_first()], "place").select(
        F.col("doc_id").alias("_id"), (F.col("place") / F.lit(rows)).cast("bigint").alias("bucket"))
    return docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")


def compare_with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every row, of its edited text, and how like they and the next row's are.

    The edited text has its last third (rounded down, in code points) replaced by
    as many code points from the start of the next row's text, or all it has.
    Rows follow each other by falling id; after the last comes the first.

    Rows meet their neighbours in buckets of consecutive ids, so no task sees the
    whole order; only one row per bucket travels to the bucket above it.
    Null texts are empty; equal ids follow each other by a hash of their text; a single row is its own next.
    An empty text has an empty fingerprint; two empty ones have likeness 1.

    Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """
    rows = _bucketed(docs.select("doc_id", text_or_empty().alias("text"), text_key().alias("tie")), bucket_rows)
    head = F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")
    heads = materialise(rows.groupBy("bucket").agg(F.max_by("text", head).alias("first_text")), "heads")
    heads = position(heads, [F.col("bucket").desc()], "place")
    # a bucket's last row is followed by the first row of the next bucket down, the very last by the very first
    before = F.when(F.col("place") == 1, F.lit(heads.count())).otherwise(F.col("place") - 1)
    after = heads.select(before.alias("place"), F.col("first_text").alias("after_text"))
    bridge = heads.select("bucket", "place").join(after, "place").select("bucket", "after_text")
    bridge = add_signature(bridge, "after_text", "after_sign")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    signed = add_signature(rows, "text", "sign")
    near = signed.select("doc_id", "bucket", "text", "sign", F.lead("text").over(order).alias("lead_text"),
                         F.lead("sign").over(order).alias("lead_sign"))
    near = near.join(bridge, "bucket").select(
        "doc_id", "text", "sign", F.coalesce("lead_text", "after_text").alias("next_text"),
        F.coalesce("lead_sign", "after_sign").alias("next_sign"), F.char_length("text").alias("n"))
    third = F.floor(F.col("n") / 3).cast("int")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - third),
                                              F.substring("next_text", F.lit(1), third)))
    both = add_signature(near.select("doc_id", "n", "sign", "next_sign", "edited"), "edited", "edited_sign")
    return both.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sign")).alias("fingerprint"), as_string(F.col("edited_sign")).alias("edited_fingerprint"),
        likeness(F.col("sign"), F.col("edited_sign")).alias("near_edited"),
        likeness(F.col("sign"), F.col("next_sign")).alias("near_next"))
