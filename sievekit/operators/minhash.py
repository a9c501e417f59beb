"""MinHash fingerprints (X3): mergeable registers per set, built from permutation minima.

A token's 32-bit hash h is moved by ``K`` fixed affine permutations ``(a * h + b) mod P``; register k
of a set is the least value that the k-th permutation takes on its tokens.  The minima are plain
``min`` aggregates, so a set spread over many rows, or a third of all rows in one group, is reduced
before the shuffle, and two fingerprints merge to that of the union by the smaller of each register.

The share of equal registers estimates the Jaccard similarity J with standard error
``sqrt(J (1 - J) / K)``: at most 0.0625 for the 64 registers here.  An empty set has no registers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 64
P = (1 << 32) + 15          # the least prime above every 32-bit hash


def permutations(k: int = K) -> list[tuple[int, int]]:
    """(a, b) of every permutation: successive values of a multiplicative generator modulo 2**31 - 1."""
    out, x = [], 20_231
    for _ in range(k):
        a = x = x * 48_271 % 2_147_483_647
        b = x = x * 48_271 % 2_147_483_647
        out.append((a, b))
    return out


def token_hash(token: Column) -> Column:
    """The first 32 bits of the token's MD5 (the same number in SQL engines)."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def fingerprints(sets: DataFrame, id_col: str, tokens: str, k: int = K) -> DataFrame:
    """(id, n_tokens, registers): ``tokens`` arrays of any number of rows per id; repeated tokens do no harm."""
    h = sets.select(id_col, F.explode(F.array_distinct(tokens)).alias("__t")).select(id_col, token_hash(F.col("__t")).alias("__h"))
    mins = [F.min((F.col("__h") * a + b) % P).alias(f"__r{n}") for n, (a, b) in enumerate(permutations(k))]
    found = h.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_tokens"), *mins)
    return found.select(id_col, "n_tokens", F.array(*[f"__r{n}" for n in range(k)]).alias("registers"))


def merge(prints: DataFrame, group: str, registers: str = "registers", k: int = K) -> DataFrame:
    """(group, registers) of the union of each group's sets."""
    mins = [F.min(F.col(registers)[n]).alias(f"__r{n}") for n in range(k)]
    return prints.groupBy(group).agg(*mins).select(group, F.array(*[f"__r{n}" for n in range(k)]).alias(registers))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)
