"""Pluggable Arrow-batched encoders.

Kept in a module without postponed annotations: pandas UDFs are typed by
their real ``pd.Series`` hints.  These are the fallback path; built-in
expressions are preferred wherever they exist.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType


@pandas_udf(LongType())
def n_words(text: pd.Series) -> pd.Series:
    """Number of letter-run words of a lower-cased text (Unicode letters)."""
    import regex
    pat = regex.compile(r"[^\p{L}]+")
    return text.map(lambda s: None if s is None else sum(1 for w in pat.split(s.lower()) if w)).astype("Int64")


VOWELS = "aeiou"


@pandas_udf(ArrayType(IntegerType()))
def vowel_vector(text: pd.Series) -> pd.Series:
    """Counts of a, e, i, o and u in a lower-cased text: a vector-valued encoder; a null text gives null."""
    return text.map(lambda s: None if s is None else [s.lower().count(v) for v in VOWELS])


ENCODERS = {"n_words": n_words, "vowel_vector": vowel_vector}


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; two nulls are equal, as in a grouping, and so are two NaNs."""
    if pa.types.is_nested(a.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    found = pc.not_equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(a.type):
        found = found & ~(pc.is_nan(a).fill_null(False).to_numpy(zero_copy_only=False)
                          & pc.is_nan(b).fill_null(False).to_numpy(zero_copy_only=False))
    return found | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _run_places(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Per row of a sorted partition 4 * place in its run of equal values (from 1), + 2 in the partition's
    first run, + 1 on its last row.  One batch is held at a time."""
    held, last, n, head = None, None, 0, True
    for columns in batches:
        columns = columns if isinstance(columns, (tuple, list)) else (columns,)
        m = len(columns[0])
        if not m:
            continue
        turn = np.zeros(m, bool)
        for k, c in enumerate(columns):
            turn[1:] |= _differs(c.slice(1), c.slice(0, m - 1))
            if last is not None:
                turn[:1] |= _differs(c.slice(0, 1), last[k])
        row = np.arange(m)
        start = np.maximum.accumulate(np.where(turn, row, -1))
        place = np.where(start >= 0, row - start + 1, row + 1 + n)
        if held is not None:
            yield pa.array(held, pa.int64())
        held = place * 4 + 2 * (head & (start < 0))
        head, n, last = head and start[-1] < 0, int(place[-1]), [c.slice(m - 1, 1) for c in columns]
    if held is not None:
        held[-1] += 1
        yield pa.array(held, pa.int64())


run_places = arrow_udf(_run_places, LongType()).asNondeterministic()
