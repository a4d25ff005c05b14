"""The search and aggressive normalisation of many texts at once, for Arrow batches.

The texts that ``sanitize`` makes, for steps that have whole columns at hand. Almost all of
its rules look at one character, so that a table over all code points does their work and
runs of blanks are told by neighbours. References and Hijri marks are found by the same
expressions first, and the few texts with a mark that composes take its rules by
themselves.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

#: What stands for a removed reference until marks are judged; no code point.
_GAP, _GONE = "\ue000", 0xFFFFFFFF
#: Characters of texts that are normalised at once.
SLICE = 1 << 21

_REFERENCE = re.compile(rf"\( ?(?:¬[{P.ARABIC_DIGITS}]+ ?|[{P.ARABIC_DIGITS}](?: [؀-ۿ])?)\)")
_HIJRI = re.compile(rf"([{P.DIGITS}][{P.BLANKS}{P.ZERO_WIDTH}]*)\u0647ـ?(?=\Z|[{P.BLANKS}{P.NOISE_SYMBOLS}/\-])")
_BETWEEN, _COMPOSING, _BLANKS = re.compile(r"([\u0648\u064a])[\u0653\u0655]+\u0654"), re.compile(f"[{P.COMPOSING}]+"), re.compile(f"[{P.BLANKS}]+")
_COMPOSED = (("\u0627\u0653", "\u0622"), ("\u0627\u0654", "\u0623"), ("\u0627\u0655", "\u0625"), ("\u0648\u0654", "\u0624"), ("\u064a\u0654", "\u0626"))


@cache
def _table(preset: str) -> np.ndarray:
    """What becomes of each code point."""
    out = np.arange(0x110000, dtype=np.uint32)

    def codes(inside: str) -> list[int]:
        member = re.compile(f"[{inside}]")
        return [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and member.match(chr(c))]

    if preset == "aggressive":
        out[:] = 0x20
        stay = codes(P.LETTERS + P.COMPOSING)
        out[stay] = stay
    elif preset == "search":
        out[ord(_GAP)] = 0x20
    else:
        raise ValueError(f"no table for the preset {preset}")
    out[:0x21] = 0x20
    out[codes(P.ZERO_WIDTH + P.MARKS) + [0x640]] = _GONE
    out[[0x622, 0x623, 0x625, 0x671]] = 0x627
    out[0x649] = 0x64A
    if preset == "aggressive":
        out[0x629] = 0x647
    return out


def _some(texts: Sequence[str | None], preset: str) -> list[str]:
    given = []
    for t in texts:
        t = t or ""
        if preset == "search" and "(" in t:
            t = _REFERENCE.sub(_GAP, t)
        given.append(_HIJRI.sub(r"\1", t) if "\u0647" in t else t)
    codes = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(given), dtype=np.int32), [len(t) for t in given])
    out = _table(preset)[codes]
    stay = out != _GONE
    out, row = out[stay], row[stay]
    composing = (out >= 0x653) & (out <= 0x655)
    apart = {}
    for k in np.unique(row[composing]).tolist() if composing.any() else ():
        a, b = np.searchsorted(row, [k, k + 1])
        t = _BETWEEN.sub("\\1\u0654", out[a:b].tobytes().decode("utf-32-le", "surrogatepass"))
        for pair, composed in _COMPOSED:
            t = t.replace(pair, composed)
        apart[k] = _BLANKS.sub(" ", _COMPOSING.sub("", t)).strip(" ")
    # of a run of blanks the first stays, unless it begins or ends its text
    blank, same = out == 0x20, np.zeros(len(out), bool)
    same[1:] = row[1:] == row[:-1]
    stay = ~blank
    stay[1:] |= same[1:] & ~blank[:-1]
    out, row, blank = out[stay], row[stay], blank[stay]
    last = np.ones(len(out), bool)
    last[:-1] = row[1:] != row[:-1]
    stay = ~(blank & last)
    whole = out[stay].tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum(np.bincount(row[stay], minlength=len(given))).tolist()
    cut = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for k, t in apart.items():
        cut[k] = t
    return cut


def normalised(texts: Sequence[str | None], preset: str = "search") -> list[str]:
    """The texts as ``sanitize`` makes them; null is empty."""
    sizes = np.cumsum([len(t or "") for t in texts])
    # a longer text is a slice of its own
    cut = np.flatnonzero(np.diff(sizes // SLICE, prepend=0)).tolist() if len(texts) else []
    return [t for a, b in zip([0, *cut], [*cut, len(texts)], strict=True) if b > a for t in _some(texts[a:b], preset)]


@F.arrow_udf(T.StringType())
def clean_text(text: pa.Array) -> pa.Array:
    """``sanitize(text, "aggressive")``."""
    return pa.array(normalised(text.to_pylist(), "aggressive"), pa.string())


@F.arrow_udf(T.StringType())
def search_text(text: pa.Array) -> pa.Array:
    """``sanitize(text, "search")``; null stays."""
    return pc.if_else(text.is_null(), pa.scalar(None, pa.string()), pa.array(normalised(text.to_pylist(), "search"), pa.string()))


@F.arrow_udf(T.IntegerType())
def clean_length(text: pa.Array) -> pa.Array:
    """The length of ``sanitize(text, "aggressive")``."""
    return pa.array([len(t) for t in normalised(text.to_pylist(), "aggressive")], pa.int32())
