"""Column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character is a letter, a digit or an underscore in any script.
NOT_WORD = r"[^\p{L}\p{N}_]"


def as_column(c: str | Column) -> Column:
    """A name may hold any character, so it is quoted."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def coerce_numeric(c: str | Column, to: str = "int") -> Column:
    """Number, or null where the text is none; ``12.0`` is a whole number too."""
    plain = as_column(c).try_cast(to)
    if to in ("int", "bigint"):
        decimal = as_column(c).try_cast("double")
        return F.coalesce(plain, F.when(decimal == F.floor(decimal), decimal.try_cast(to)))
    return plain


def normalise_key(c: str | Column, mode: str = "strip_symbols") -> Column:
    """One spelling per entity.

    ``strip_symbols`` lower-cases and deletes all but ``a-z`` and blanks;
    ``and`` lower-cases, trims and spells out ``&``; ``title`` trims and
    capitalises every run of letters.
    """
    col = as_column(c)
    if mode == "strip_symbols":
        return F.regexp_replace(F.lower(col), r"[^a-z\s]", "")
    if mode == "and":
        return F.replace(F.trim(F.lower(col)), F.lit("&"), F.lit("and"))
    if mode == "title":
        runs = F.regexp_extract_all(F.lower(F.trim(col)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
        return F.array_join(F.transform(runs, F.initcap), "")
    raise ValueError(f"unknown key mode: {mode}")


def normalise_label(c: str | Column) -> Column:
    """Trimmed (non-breaking blanks too) and lower-cased label."""
    return F.lower(F.regexp_replace(as_column(c), r"^[\s\u00A0]+|[\s\u00A0]+$", ""))


def row_total(cols: Sequence[str], to: str = "bigint") -> Column:
    """Sum across columns; a null counts as nothing."""
    total = F.lit(0).cast(to)
    for c in cols:
        total = total + F.coalesce(as_column(c).cast(to), F.lit(0).cast(to))
    return total


def _not_in(words: Sequence[str]):
    words = list(words)
    if not words:
        return lambda token: F.lit(True)
    # more than ten literals become one hash-set lookup
    return lambda token: ~token.isin(words)


def tokens(c: str | Column, mode: str = "words", stop_words: Sequence[str] = ()) -> Column:
    """Cleaned text as an array of tokens.

    ``words`` and ``punct`` turn every non-word character (``punct`` keeps
    blanks) into a blank; ``alpha`` deletes everything but ``a-z`` and blanks;
    ``isalpha`` keeps only tokens made of letters.
    """
    low = F.lower(as_column(c))
    keep = _not_in(stop_words)
    if mode in ("words", "punct"):
        parts = F.split(low, NOT_WORD + "+")
    elif mode == "alpha":
        parts = F.split(F.regexp_replace(low, r"[^a-z\s]", ""), r"\s+")
    elif mode == "isalpha":
        # a token is a run of word characters or one mark of punctuation
        parts = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))
        return F.filter(parts, lambda t: t.rlike(r"^\p{L}+$") & keep(t))
    else:
        raise ValueError(f"unknown text mode: {mode}")
    return F.filter(parts, lambda t: (t != "") & keep(t))


def clean_text(c: str | Column, mode: str = "words", stop_words: Sequence[str] = ()) -> Column:
    """The tokens joined by single blanks."""
    return F.array_join(tokens(c, mode, stop_words), " ")


def index_terms(token_array: Column) -> Column:
    """Tokens that enter the text index: two characters or more."""
    return F.filter(token_array, lambda t: F.length(t) >= 2)


def soundex_codes(token_array: Column) -> Column:
    """Soundex of every token that starts with a Latin letter."""
    return F.transform(F.filter(token_array, lambda t: t.rlike("^[A-Za-z]")), F.soundex)


def bigrams(token_array: Column) -> Column:
    """Neighbouring tokens joined by an underscore."""
    n = F.size(token_array)
    pairs = F.zip_with(
        F.slice(token_array, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(token_array, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws("_", a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def feature_tokens(token_array: Column) -> Column:
    """Tokens, their Soundex codes and their bigrams in one bag."""
    return F.concat(token_array, soundex_codes(token_array), bigrams(token_array))


def split_list_field(c: str | Column) -> Column:
    """Items of a list written with commas or the word *and*."""
    return F.split(as_column(c), r",\s*|\s+and\s+")


def overlap_percent(query: str | Column, doc: str | Column) -> Column:
    """Share of the document's blank-separated words that the query holds, in percent."""
    def word_set(c):
        return F.array_distinct(F.filter(F.split(F.lower(as_column(c)), r"\s+"),
                                         lambda t: t != ""))
    q, d = word_set(query), word_set(doc)
    return F.coalesce(F.try_divide(100.0 * F.size(F.array_intersect(q, d)), F.size(d)), F.lit(0.0))


def suggestion(original: str | Column, corrected: str | Column) -> Column:
    """The corrected text where it differs from the original, else null."""
    return F.when(as_column(original) != as_column(corrected), as_column(corrected))
