"""Character classes and patterns of Arabic text, as Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware scripts see it; the inside of a class.
WS = r"\t-\r    -     　﻿"
ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
DIGITS = r"0-9٠-٩"
ARABIC_DIGITS = r"٠-٩"
#: Letters that the letter filters keep.
LETTERS = r"ء-غف-يٱپچڤ-گیےۓ"
ZERO_WIDTH = r"​-‏‪-‮⁠-⁤﻿"
#: Vowel and other marks but the three that compose with a letter.
MARKS = r"ً-ْٖ-ٟؐ-ؚٰۖ-ۭ"
COMPOSING = r"ٓ-ٕ"
NOISE_SYMBOLS = r"¬§`=&ﷺ"
#: Control characters and the blank: what the sanitiser takes for white space.
BLANKS = r"\x00-\x20"

EMBEDDED_FOOTNOTE = rf"\([{DIGITS}]+\)"
STANDALONE_FOOTNOTE = rf"^\(?[{DIGITS}]+\)?[،.]?\z"
REFERENCE = rf"\([{ARABIC_DIGITS}]+\)"
OCR_REFERENCE = r"\([.1OV9]+\)"
#: Confused references that hold a letter; the others may be numbers as they should be.
LETTERED_REFERENCE = r"\([.19]*[OV][.1OV9]*\)"
INVALID_REFERENCE = r"\(\)|\([.1OV9]+\)"
INTAHA = "اهـ"

#: All published patterns by name.
PATTERNS: dict[str, str] = {
    "arabic_characters": f"[{ARABIC}]",
    "arabic_digits": f"[{DIGITS}]+",
    "arabic_footnote_reference": f"^{REFERENCE}",
    "arabic_letters_and_digits": rf"[{DIGITS}\u0621-\u063a\u0641-\u064a]+",
    "arabic_punctuation_and_whitespace": rf"[{WS}\u060c\u061b\u061f\u06d4]+",
    "arabic_reference": REFERENCE,
    "footnote_embedded": EMBEDDED_FOOTNOTE,
    "footnote_standalone": STANDALONE_FOOTNOTE,
    "invalid_reference": INVALID_REFERENCE,
    "ocr_confused_footnote_reference": f"^{OCR_REFERENCE}",
    "ocr_confused_reference": OCR_REFERENCE,
    "whitespace": f"[{WS}]+",
}


def text(col: Column | str) -> Column:
    """A string column whose null is the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def trimmed(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, rf"^[{WS}]+|[{WS}]+\z", "")
