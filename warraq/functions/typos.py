"""Repair of typing errors from a second reading of the same text, as one Column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alignment import align_tokens
from .distance import similar_after_normalization, similarity
from .sanitize import sanitize
from .tokens import footnote_fusion, footnote_selection, standalone_footnotes, tokenize


def select_best_tokens(a: Column, b: Column, symbols: Sequence[str], threshold: float) -> Column:
    """The tokens that an aligned pair leaves: what is there of a gap, the first of equals, references, symbols, else by similarity."""
    symbol = F.coalesce(*(F.when((a == s) | (b == s), s) for s in symbols), F.lit(None).cast("string"))

    def chosen(v: Column) -> Column:
        na, nb = v["na"], v["nb"]
        rest = F.coalesce(
            footnote_selection(a, b),
            standalone_footnotes(a, b),
            F.when(symbol.isNotNull(), F.array(symbol)),
            F.when(similarity(na, nb) > threshold, F.array(a)).otherwise(F.array(b)),
        )
        return F.when(a.isNull(), F.array(b)).when(b.isNull() | (na == nb), F.array(a)).otherwise(rest)

    return F.transform(F.array(F.struct(sanitize(a).alias("na"), sanitize(b).alias("nb"))), chosen)[0]


def remove_duplicate_tokens(tokens: Column, threshold: float) -> Column:
    """Tokens without echoes of the token kept last (the shorter stays) and without references that a word holds already."""

    def add(kept: Column, token: Column) -> Column:
        last = F.element_at(kept, -1)
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(token))
        fused = footnote_fusion(kept, last, token)
        return (
            F.when(F.size(kept) == 0, F.array(token))
            .when(similar_after_normalization(last, token, threshold), F.when(F.length(token) < F.length(last), swapped).otherwise(kept))
            .otherwise(F.transform(F.array(fused), lambda f: F.when(f["handled"], f["kept"]).otherwise(F.concat(kept, F.array(token))))[0])
        )

    return F.aggregate(tokens, F.array().cast("array<string>"), add)


def process_text_alignment(original: Column | str, other: Column | str, symbols: Sequence[str], similarity_threshold: float, high_similarity_threshold: float) -> Column:
    """The text that the best tokens of two readings make."""
    a, b = tokenize(original, symbols), tokenize(other, symbols)
    pairs = align_tokens(a, b, symbols, similarity_threshold)
    tokens = F.flatten(F.transform(pairs, lambda p: select_best_tokens(p["a"], p["b"], symbols, similarity_threshold)))
    return F.array_join(remove_duplicate_tokens(tokens, high_similarity_threshold), " ")


def fix_typo(original: Column | str, correction: Column | str, symbols: Sequence[str] = (), similarity_threshold: float = 0.6, high_similarity_threshold: float = 0.8) -> Column:
    """``process_text_alignment`` with the usual thresholds."""
    return process_text_alignment(original, correction, symbols, similarity_threshold, high_similarity_threshold)
