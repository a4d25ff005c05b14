"""Classification of lines as noise of text recognition (null is the empty string; lengths in code points)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

PUNCTUATION = r"""[.,;:()\[\]{}"'`]"""
REPEATED = ("!", ".", "-", "=", "_")
#: Classes of which a text that holds nothing else (and white space) is noise.
BARE = (r"\-=_━≺≻", r".", r"!", r"A-Z", r"\-0-9", r"—", r"्र\-")


def _count(col: Column, pattern: str) -> Column:
    """Code points of a class: what the text loses without its runs of them (``regexp_count`` makes a string of each)."""
    return F.length(col) - F.length(F.regexp_replace(col, pattern + "+", ""))


@F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
def _frequencies(texts: pa.Array) -> pa.Array:
    """How often each code point stands in a text: one sort of its code points."""
    ends, chars, counts = [0], [], []
    for x in texts.to_pylist():
        codes = np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, first, n = np.unique(codes, return_index=True, return_counts=True)
        order = np.argsort(first)
        chars += kinds[order].tobytes().decode("utf-32-le")
        counts.append(n[order])
        ends.append(len(chars))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chars, pa.string()), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int32)))


def character_stats(col: Column | str) -> Column:
    """(arabic, latin, digit, space, punctuation, symbol, frequency): counts of code points by kind, and of each code point.

    A character counts under the first kind that fits, in the order Arabic, digit, Latin, space, punctuation, symbol.
    """
    x = P.text(col)
    arabic, digit, latin = _count(x, f"[{P.ARABIC}]"), _count(x, "[0-9]"), _count(x, "[A-Za-z]")
    space, punctuation = _count(x, f"[{P.WS}&&[^{P.ARABIC}]]"), _count(x, PUNCTUATION)
    rest = F.length(x) - arabic - digit - latin - space - punctuation
    named = {"arabic": arabic, "latin": latin, "digit": digit, "space": space, "punctuation": punctuation, "symbol": rest, "frequency": _frequencies(x)}
    return F.struct(*(v.alias(k) for k, v in named.items()))


class _Counts:
    """The counts that the rules need, without the map of frequencies."""

    def __init__(self, x: Column):
        self.arabic, self.digit, self.latin = _count(x, f"[{P.ARABIC}]"), _count(x, "[0-9]"), _count(x, "[A-Za-z]")
        self.space, self.punctuation = _count(x, f"[{P.WS}&&[^{P.ARABIC}]]"), _count(x, PUNCTUATION)
        self.length = F.length(x)
        self.symbol = self.length - self.arabic - self.digit - self.latin - self.space - self.punctuation
        self.content = self.arabic + self.latin + self.digit


def has_excessive_repetition(col: Column | str, length: Column | None = None) -> Column:
    """Whether marks that stand five times or more make up over 40 % of the text."""
    x = P.text(col)
    counts = [F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) for c in REPEATED]
    total = sum((F.when(n >= 5, n).otherwise(0) for n in counts), F.lit(0))
    return F.coalesce(total / F.nullif(F.length(x) if length is None else length, F.lit(0)) > 0.4, F.lit(False))


def is_basic_noise_pattern(col: Column | str) -> Column:
    """Whether a text holds only marks of one kind, capitals or digits, besides white space; true for an empty text."""
    return P.text(col).rlike("|".join(rf"^[{c}{P.WS}]*\z" for c in BARE))


def _spacing(space: Column, content: Column, arabic: Column, length: Column) -> Column:
    scattered = (space > 0) & (content == space + 1) & (content <= 5)
    short = (length <= 10) & (space >= 2) & (arabic == 0)
    return scattered | short | F.coalesce(space / F.nullif(length, F.lit(0)) > 0.6, F.lit(False))


def is_spacing_noise(col: Column | str) -> Column:
    """Whether white space outweighs what stands between it."""
    c = _Counts(P.text(col))
    return _spacing(c.space, c.content, c.arabic, c.length)


def is_valid_arabic_content(col: Column | str) -> Column:
    """Whether a text that holds Arabic holds enough of it for its length."""
    c = _Counts(P.text(col))
    return (
        (c.arabic >= 3)
        | ((c.arabic >= 1) & (c.digit > 0) & (c.length <= 20))
        | ((c.arabic >= 2) & (c.punctuation <= 2) & (c.length <= 10))
        | ((c.arabic >= 1) & (c.length <= 5) & (c.punctuation <= 1))
    )


def is_non_arabic_noise(col: Column | str) -> Column:
    """Whether a text without Arabic letters is noise; long numbers and longer contents are not."""
    x = P.text(col)
    c = _Counts(x)
    outside = c.symbol + F.greatest(F.lit(0), c.punctuation - 5)
    number = x.rlike(r"^[0-9]+\z") & (c.digit >= 3)
    return (
        F.when(c.content == 0, True)
        .when(_spacing(c.space, c.content, c.arabic, c.length), True)
        .when(x.rlike(f"[{P.ARABIC_DIGITS}]") & (c.digit >= 3), False)
        .when(outside / F.greatest(c.content, F.lit(1)) > 2, True)
        .when((c.length <= 5) & (c.arabic == 0) & ~number, True)
        .when(x.rlike(r"^[0-9]{3,4}\z"), False)
        .otherwise(c.length <= 10)
    )


def is_noise(col: Column | str) -> Column:
    """Whether a line is noise rather than Arabic text."""
    x = P.trimmed(P.text(col))
    arabic = x.rlike(f"[{P.ARABIC}]")
    return (
        F.when(F.length(x) < 2, True)
        .when(is_basic_noise_pattern(x), True)
        .when(has_excessive_repetition(x), True)
        .when(~arabic & x.rlike("[A-Za-z]"), True)
        .when(arabic, ~is_valid_arabic_content(x))
        .otherwise(is_non_arabic_noise(x))
    )
