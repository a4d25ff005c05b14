"""Edit distance, similarity and token scores (lengths and distances in code points; null is the empty string)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import text
from .sanitize import sanitize

PERFECT, SOFT, MISMATCH, GAP = 2, 1, -2, -1


def levenshtein_distance(a: Column | str, b: Column | str) -> Column:
    """Least number of insertions, deletions and substitutions."""
    return F.levenshtein(text(a), text(b))


def bounded_levenshtein(a: Column | str, b: Column | str, most: Column | int) -> Column:
    """The distance if it is at most ``most``, else ``most`` + 1."""
    limit = most if isinstance(most, Column) else F.lit(most)
    found = F.call_function("levenshtein", text(a), text(b), limit.cast("int"))
    return F.when(found < 0, limit + 1).otherwise(found).cast("int")


#: Places of hashed pairs of characters; more of them make the bound below sharper.
PAIRS = 1024


def least_distances(a: list[str], b: list[str]) -> np.ndarray:
    """A lower bound of the edit distance of each pair of texts, from the pairs of neighbouring characters that they hold.

    An edit takes away two such pairs and brings two at most, so that the distance is
    at least a quarter of the difference of their counts.
    """
    counts = np.zeros(len(a) * PAIRS, np.int32)
    for texts, sign in ((a, 1), (b, -1)):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        inside = row[1:] == row[:-1]
        mixed = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]) * np.uint32(0x85EBCA77) >> np.uint32(22)
        counts += sign * np.bincount(row[1:][inside] * PAIRS + mixed[inside], minlength=len(counts)).astype(np.int32)
    apart = np.abs(counts.reshape(-1, PAIRS)).sum(axis=1)
    return np.maximum(-(-apart // 4), np.abs(np.asarray([len(x) - len(y) for x, y in zip(a, b, strict=True)], np.int64)))


@F.arrow_udf(T.BooleanType())
def within_reach(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """Whether two texts may be within ``most`` edits; false only if they are not."""
    out = []
    for k in range(0, len(a), 1024):
        x, y = ([t or "" for t in c.slice(k, 1024).to_pylist()] for c in (a, b))
        out.append(least_distances(x, y) <= most.slice(k, 1024).to_numpy(zero_copy_only=False))
    return pa.array(np.concatenate([*out, np.zeros(0, bool)]).astype(bool))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the distance over the greater length; 1 for two empty texts."""
    x, y = text(a), text(b)
    size = F.greatest(F.length(x), F.length(y), F.lit(1))
    return (size - F.levenshtein(x, y)) / size


def similar_after_normalization(a: Column | str, b: Column | str, threshold: float = 0.6) -> Column:
    """Whether two texts reach ``threshold`` once normalised for search."""
    return normalized_similarity(a, b) >= threshold


def normalized_similarity(a: Column | str, b: Column | str) -> Column:
    """The similarity of two texts normalised for search, each normalised once even inside a lambda."""
    both = F.struct(sanitize(text(a)).alias("a"), sanitize(text(b)).alias("b"))
    return F.transform(F.array(both), lambda v: similarity(v["a"], v["b"]))[0]


def edit_distance(a: str, b: str) -> int:
    """The edit distance by bit vectors: a column of the table is two integers of as many bits as ``a`` has characters."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up | same | down) & every
        more, less = down | every & ~(diagonal | up), diagonal & up
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | every & ~(diagonal | more), more & diagonal
    return score


def likeness(a: str, b: str) -> float:
    """``similarity`` of two texts."""
    size = max(len(a), len(b), 1)
    return 1.0 if a == b else (size - edit_distance(a, b)) / size


def may_reach(a: str, b: str, threshold: float) -> bool:
    """Whether the lengths alone allow ``threshold``."""
    size = max(len(a), len(b), 1)
    return (size - abs(len(a) - len(b))) / size >= threshold


def symbol_in(a: Column, b: Column, symbols: Sequence[str]) -> Column:
    """Whether one of two tokens is a symbol."""
    return a.isin(*symbols) | b.isin(*symbols) if symbols else F.lit(False)


def alignment_score(a: Column | str, b: Column | str, symbols: Sequence[str], threshold: float) -> Column:
    """2 for tokens equal once normalised, 1 for a symbol or similar tokens, else -2."""
    x, y = text(a), text(b)
    return score_of(x, y, sanitize(x), sanitize(y), symbols, threshold)


def score_of(a: Column, b: Column, na: Column, nb: Column, symbols: Sequence[str], threshold: float) -> Column:
    """The same for tokens whose normalised forms are at hand."""
    # the distance is at least the difference of the lengths, which is quicker to tell
    m, n = F.length(na), F.length(nb)
    hopeless = F.abs(m - n) > (1 - threshold) * F.greatest(m, n) + 1e-9
    soft = symbol_in(a, b, symbols) | (~hopeless & (similarity(na, nb) >= threshold))
    return F.when(na == nb, PERFECT).when(soft, SOFT).otherwise(MISMATCH)
