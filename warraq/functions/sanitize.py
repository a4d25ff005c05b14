"""Configurable normalisation of Arabic text as one Column expression.

``sanitize(col, "search")`` or ``sanitize(col, SanitizeOptions(base="none", strip_zero_width=True))``.
The options are resolved while the plan is built, so that a switch that is off
leaves no expression behind. A null text gives the empty string.

The rules that look at neighbouring characters work on the text as it has become,
so the order of the steps below is part of the meaning: references and Hijri marks
are recognised in the raw text, letters are folded before tatweel is judged, and
combining hamza and madda compose last of all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Private characters that stand for a removed reference, for a tatweel that stays and for further strokes.
_GAP, _KEPT, _STROKES = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class Resolved:
    """Every switch decided. ``strip_tatweel`` is False, "safe" or "all"."""

    nfc: bool = False
    strip_zero_width: bool = False
    zero_width_to_space: bool = False
    strip_diacritics: bool = False
    strip_footnotes: bool = False
    strip_tatweel: bool | str = False
    normalize_alif: bool = False
    replace_alif_maqsurah: bool = False
    replace_ta_marbutah_with_ha: bool = False
    strip_latin_and_symbols: bool = False
    keep_only_arabic_letters: bool = False
    letters_and_spaces_only: bool = False
    collapse_whitespace: bool = False
    trim: bool = False
    remove_hijri_marker: bool = False


_LIGHT = Resolved(nfc=True, strip_zero_width=True, collapse_whitespace=True, trim=True)
_SEARCH = replace(_LIGHT, strip_diacritics=True, strip_footnotes=True, strip_tatweel="all", normalize_alif=True, replace_alif_maqsurah=True, remove_hijri_marker=True)
_AGGRESSIVE = replace(_SEARCH, replace_ta_marbutah_with_ha=True, strip_latin_and_symbols=True, letters_and_spaces_only=True)
PRESETS: dict[str, Resolved] = {"none": Resolved(), "light": _LIGHT, "search": _SEARCH, "aggressive": _AGGRESSIVE}


@dataclass(frozen=True)
class SanitizeOptions:
    """Overrides over a base preset; None leaves the base's value. ``strip_tatweel=True`` means "safe"."""

    base: str = "light"
    nfc: bool | None = None
    strip_zero_width: bool | None = None
    zero_width_to_space: bool | None = None
    strip_diacritics: bool | None = None
    strip_footnotes: bool | None = None
    strip_tatweel: bool | str | None = None
    normalize_alif: bool | None = None
    replace_alif_maqsurah: bool | None = None
    replace_ta_marbutah_with_ha: bool | None = None
    strip_latin_and_symbols: bool | None = None
    keep_only_arabic_letters: bool | None = None
    letters_and_spaces_only: bool | None = None
    collapse_whitespace: bool | None = None
    trim: bool | None = None
    remove_hijri_marker: bool | None = None


def resolve_options(options: str | SanitizeOptions = "search") -> Resolved:
    """A preset's name or options, with every switch decided."""
    if isinstance(options, str):
        if options not in PRESETS or options == "none":
            raise ValueError(f"unknown preset: {options}")
        return PRESETS[options]
    given = {f.name: v for f in fields(Resolved) if (v := getattr(options, f.name)) is not None}
    if given.get("strip_tatweel") is True:
        given["strip_tatweel"] = "safe"
    return replace(PRESETS[options.base], **given)


def _replaced(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, pattern, by)


def _apply(col: Column, o: Resolved) -> Column:
    letters = o.keep_only_arabic_letters or o.letters_and_spaces_only
    gap = "" if o.keep_only_arabic_letters else " "
    x = P.text(col)
    # a pass over the text for each rule is what it costs: rules that nothing between them can tell apart share one,
    # and single characters are replaced as literals
    if o.trim and not o.collapse_whitespace:
        x = _replaced(x, rf"^[{P.BLANKS}]+", "")
    if o.strip_footnotes and not letters:
        x = _replaced(x, rf"\( ?(?:¬[{P.ARABIC_DIGITS}]+ ?|[{P.ARABIC_DIGITS}](?: [؀-ۿ])?)\)", _GAP)
    if o.strip_latin_and_symbols and not letters:
        # the first stroke still bounds a Hijri mark
        x = _replaced(x, "//+", "/" + _STROKES)
    if o.remove_hijri_marker:
        x = _replaced(x, rf"([{P.DIGITS}][{P.BLANKS}{P.ZERO_WIDTH}]*)\u0647ـ?(?=\z|[{P.BLANKS}{P.NOISE_SYMBOLS}/\-])", "$1")
    if o.strip_zero_width and o.zero_width_to_space and gap:
        x = _replaced(x, f"[{P.ZERO_WIDTH}]", gap)
    gone = (P.ZERO_WIDTH if o.strip_zero_width and not (o.zero_width_to_space and gap) else "") + (P.MARKS if o.strip_diacritics else "") + (r"\u0640" if o.strip_tatweel == "all" else "")
    if gone:
        x = _replaced(x, f"[{gone}]+", "")
    if o.strip_footnotes and not letters:
        x = F.replace(x, F.lit(_GAP), F.lit(" "))
    if o.strip_latin_and_symbols and not letters:
        x = _replaced(x, f"[A-Za-z0-9{P.NOISE_SYMBOLS}]|/{_STROKES}", " ")
    # marks that may compose and tatweel are judged after the letters around them
    later = (P.COMPOSING if o.nfc or o.strip_diacritics else "") + (r"\u0640" if o.strip_tatweel == "safe" else "")
    if o.keep_only_arabic_letters:
        x = _replaced(x, f"[^{P.LETTERS}{later}]", "")
    elif o.letters_and_spaces_only:
        x = _replaced(x, f"[^{P.LETTERS}{P.BLANKS}{later}]", " ")
    if o.normalize_alif:
        x = _replaced(x, "[\u0622\u0623\u0625\u0671]", "\u0627")
    if o.replace_alif_maqsurah:
        x = F.replace(x, F.lit("\u0649"), F.lit("\u064a"))
    if o.replace_ta_marbutah_with_ha:
        x = F.replace(x, F.lit("\u0629"), F.lit("\u0647"))
    if o.strip_tatweel == "safe":
        # the first tatweel after a digit or heh stays; blanks and marks that will be gone don't count
        unseen = (P.BLANKS if o.collapse_whitespace else r"\x20") + (P.COMPOSING if o.strip_diacritics else "")
        x = _replaced(_replaced(x, rf"([{P.DIGITS}\u0647][{unseen}]*)\u0640", "$1" + _KEPT), r"\u0640", "")
        x = _replaced(x, _KEPT, gap if letters else "\u0640")
    if o.nfc:
        if o.strip_diacritics:
            x = _replaced(x, r"([\u0648\u064a])[\u0653\u0655]+\u0654", "$1\u0654")
        for pair, composed in (("\u0627\u0653", "\u0622"), ("\u0627\u0654", "\u0623"), ("\u0627\u0655", "\u0625"), ("\u0648\u0654", "\u0624"), ("\u064a\u0654", "\u0626")):
            x = F.replace(x, F.lit(pair), F.lit(composed))
    if o.strip_diacritics:
        x = _replaced(x, f"[{P.COMPOSING}]+", "")
    elif letters and o.nfc:
        x = _replaced(x, f"[{P.COMPOSING}]", gap)
    if o.collapse_whitespace and not o.keep_only_arabic_letters:
        # a blank between two others is left as it is
        x = _replaced(x, r"[\x00-\x1f][\x00-\x20]*|\x20[\x00-\x20]+", " ")
        x = F.trim(x) if o.trim else F.ltrim(x)
    return x


def sanitize(col: Column | str, options: str | SanitizeOptions = "search") -> Column:
    """The normalised text of a string column."""
    return _apply(F.col(col) if isinstance(col, str) else col, resolve_options(options))


def sanitize_array(col: Column | str, options: str | SanitizeOptions = "search") -> Column:
    """The normalised texts of an array of strings."""
    resolved = resolve_options(options)
    return F.transform(F.col(col) if isinstance(col, str) else col, lambda x: _apply(x, resolved))


def create_sanitizer(options: str | SanitizeOptions = "search") -> Callable[[Column | str], Column]:
    """A function of a column with the options resolved once."""
    resolved = resolve_options(options)
    return lambda col: _apply(F.col(col) if isinstance(col, str) else col, resolved)
