"""Tokens, footnote tokens and Hijri and end marks (null is the empty string)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def extract_digits(col: Column | str) -> Column:
    """The first run of Western or Arabic-Indic digits, else an empty string."""
    return F.regexp_extract(P.text(col), f"[{P.DIGITS}]+", 0)


def tokenize(col: Column | str, symbols: Sequence[str] = ()) -> Column:
    """Tokens between white space; each symbol (a literal) is a token of its own."""
    x = P.text(col)
    for s in symbols:
        x = F.replace(x, F.lit(s), F.lit(f" {s} "))
    return F.filter(F.split(x, f"[{P.WS}]+"), lambda t: t != "")


def is_embedded(token: Column) -> Column:
    """Whether a token holds a reference in parentheses."""
    return token.rlike(P.EMBEDDED_FOOTNOTE)


def is_standalone(token: Column) -> Column:
    """Whether a token is nothing but a reference, its parentheses optional."""
    return token.rlike(P.STANDALONE_FOOTNOTE)


def _shorter(a: Column, b: Column) -> Column:
    return F.when(F.length(a) <= F.length(b), a).otherwise(b)


def footnote_selection(a: Column | str, b: Column | str) -> Column:
    """The token with an embedded reference, the shorter of two such, else null; as an array."""
    x, y = P.text(a), P.text(b)
    p, q = is_embedded(x), is_embedded(y)
    return F.when(p & ~q, F.array(x)).when(q & ~p, F.array(y)).when(p & q, F.array(_shorter(x, y)))


def standalone_footnotes(a: Column | str, b: Column | str) -> Column:
    """A lone reference before the other token, the shorter of two references, else null; as an array."""
    x, y = P.text(a), P.text(b)
    p, q = is_standalone(x), is_standalone(y)
    return F.when(p & ~q, F.array(x, y)).when(q & ~p, F.array(y, x)).when(p & q, F.array(_shorter(x, y)))


def footnote_fusion(kept: Column, previous: Column, current: Column) -> Column:
    """(handled, kept): the kept tokens after a reference met the same one fused with a word.

    A lone reference before the fused word gives way to it; one after it is dropped.
    """
    same = extract_digits(previous) == extract_digits(current)
    gives_way = is_standalone(previous) & is_embedded(current) & same
    dropped = is_embedded(previous) & is_standalone(current) & same
    swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(current))
    return F.struct((gives_way | dropped).alias("handled"), F.when(gives_way, swapped).otherwise(kept).alias("kept"))


def _tidied(col: Column) -> Column:
    return P.trimmed(F.regexp_replace(col, " +", " "))


def remove_footnote_references_simple(col: Column | str) -> Column:
    """Without references such as (¬١٢)."""
    return _tidied(F.regexp_replace(P.text(col), rf" ?\(¬[{P.ARABIC_DIGITS}]+\) ?", " "))


def remove_single_digit_footnote_references(col: Column | str) -> Column:
    """Without references of one digit, with or without a letter after it: (٣), (٣ م)."""
    return _tidied(F.regexp_replace(P.text(col), rf" ?\([{P.ARABIC_DIGITS}](?:[{P.WS}]+[؀-ۿ])?\) ?", " "))


def standardize_hijri_symbol(col: Column | str) -> Column:
    """The heh after a digit becomes a blank and the Hijri mark, unless a letter or Arabic-Indic digit follows it."""
    follows = rf"(?=\z|[^ء-غف-ي{P.ARABIC_DIGITS}])"
    return F.regexp_replace(P.text(col), rf"([{P.DIGITS}])[{P.WS}]*ه{follows}", "$1 هـ")


def standardize_intaha_symbol(col: Column | str) -> Column:
    """The whole word that ends a quotation gets its tatweel."""
    return F.regexp_replace(P.text(col), r"(^|[^؀-ۿ])اه(?=\z|[^؀-ۿ])", "$1" + P.INTAHA)
