"""Text and key expressions.

All builders return Column expressions evaluated inside whole-stage codegen;
none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the SQL oracles: the word splitter (letters only,
# Unicode aware) used by every word/k-gram feature.
WORD_SPLIT = r"[^\p{L}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_key(text) -> Column:
    """Exact-duplicate key: md5 of the trimmed lower-case text."""
    return F.md5(F.trim(F.lower(_c(text))))


def truncate_key(key, width: int | None = None, drop_last: bool = False) -> Column:
    """first ``width`` characters, or everything but the last character."""
    k = _c(key)
    if drop_last:
        return k.substr(F.lit(1), F.greatest(F.length(k) - 1, F.lit(0)))
    if width is None:
        raise ValueError("width or drop_last required")
    return k.substr(1, width)


def words(text) -> Column:
    """Lower-case word tokens, empty strings removed (array<string>)."""
    arr = F.split(F.lower(_c(text)), WORD_SPLIT)
    return F.filter(arr, lambda w: w != F.lit(""))


def word_count(text) -> Column:
    """Number of word tokens."""
    return F.size(words(text))


def kgrams(tokens, k: int = 3, sep: str = " ") -> Column:
    """Contiguous k-grams of a token array (array<string>), empty when too short.

    Built from k shifted slices combined with ``zip_with`` so the token array
    is referenced a constant number of times (a per-gram ``slice`` inside a
    lambda would re-evaluate the tokeniser once per gram).
    """
    t = _c(tokens)
    n = F.greatest(F.size(t) - F.lit(k - 1), F.lit(0))
    shifted = [F.slice(t, j + 1, n) for j in range(k)] if k > 1 else [t]
    grams = shifted[0]
    for nxt in shifted[1:]:
        grams = F.zip_with(grams, nxt, lambda a, b: F.concat(a, F.lit(sep), b))
    return F.when(n > 0, grams).otherwise(F.array().cast("array<string>"))


def distinct_kgrams(text, k: int = 3) -> Column:
    """X1 set form: distinct lower-case word k-grams of a text."""
    return F.array_distinct(kgrams(words(text), k))


def hashed_bits(tokens, n_bits: int = 1024) -> Column:
    """X1 bit form: distinct bucket indices ``pmod(xxhash64(token), n_bits)``."""
    return F.array_sort(F.array_distinct(
        F.transform(_c(tokens), lambda t: F.pmod(F.xxhash64(t), F.lit(n_bits)).cast("int"))))


def strip_prefix(col, prefix_regex: str) -> Column:
    """Remove a leading prefix pattern such as ``cpd:`` or ``EC-``."""
    return F.regexp_replace(_c(col), "^(?:" + prefix_regex + ")", "")


def strip_tags(col) -> Column:
    """Remove inline markup tags such as ``<i>``/``</i>``."""
    return F.regexp_replace(_c(col), "<[^>]*>", "")


def squash_ws(col) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def first_value(map_col, key: str) -> Column:
    """first value of a multi-valued attribute map, or NULL."""
    return F.try_element_at(F.try_element_at(_c(map_col), F.lit(key)), F.lit(1))
