"""The normaliser against a plain state machine that decides character by character, and known cases."""

import itertools
import random
from dataclasses import fields

import pytest

from warraq.functions.sanitize import PRESETS, Resolved, SanitizeOptions, create_sanitizer, resolve_options, sanitize, sanitize_array

ZW = {*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF}
DIA = {*range(0x64B, 0x660), *range(0x610, 0x61B), 0x670, *range(0x6D6, 0x6EE)}
LETTERS = {*range(0x621, 0x63B), *range(0x641, 0x64B), 0x671, 0x67E, 0x686, *range(0x6A4, 0x6B0), 0x6CC, 0x6D2, 0x6D3}
DIGITS, ARABIC_DIGITS, SYMBOLS = set("0123456789٠١٢٣٤٥٦٧٨٩"), set("٠١٢٣٤٥٦٧٨٩"), set("¬§`=&ﷺ")
JOIN = {("ا", "ٓ"): "آ", ("ا", "ٔ"): "أ", ("ا", "ٕ"): "إ", ("و", "ٔ"): "ؤ", ("ي", "ٔ"): "ئ"}


def footnote_at(t, i):
    """Length of the reference that begins at a parenthesis, or 0."""
    j = i + 1 + (t[i + 1 : i + 2] == " ")
    if t[j : j + 1] == "¬":
        k = j + 1
        while k < len(t) and t[k] in ARABIC_DIGITS:
            k += 1
        if k > j + 1:
            k += t[k : k + 1] == " "
            return k + 1 - i if t[k : k + 1] == ")" else 0
        return 0
    if t[j : j + 1] in ARABIC_DIGITS and t[j : j + 1]:
        if t[j + 1 : j + 2] == ")":
            return j + 2 - i
        if t[j + 1 : j + 2] == " " and 0x600 <= ord(t[j + 2 : j + 3] or "a") <= 0x6FF and t[j + 3 : j + 4] == ")":
            return j + 4 - i
    return 0


def model(t: str, o: Resolved) -> str:
    out, space, letters = [], False, o.keep_only_arabic_letters or o.letters_and_spaces_only
    i = 0

    def gap():
        nonlocal space
        if o.keep_only_arabic_letters:
            return
        if o.collapse_whitespace:
            if not space and out:
                out.append(" ")
                space = True
        else:
            out.append(" ")
            space = False

    if o.trim:
        while i < len(t) and ord(t[i]) <= 32:
            i += 1
    while i < len(t):
        c = t[i]
        if ord(c) <= 32:
            if not o.keep_only_arabic_letters:
                if o.collapse_whitespace:
                    gap()
                else:
                    out.append(c)
                    space = False
            i += 1
            continue
        if o.nfc and out and (out[-1], c) in JOIN:
            out[-1] = JOIN[out[-1], c]
            i += 1
            continue
        if o.strip_zero_width and ord(c) in ZW:
            if o.zero_width_to_space:
                gap()
            i += 1
            continue
        if o.remove_hijri_marker and c == "ه":
            n = i + 1 + (t[i + 1 : i + 2] == "ـ")
            if n >= len(t) or ord(t[n]) <= 32 or t[n] in SYMBOLS or t[n] in "/-":
                b = i - 1
                while b >= 0 and (ord(t[b]) <= 32 or ord(t[b]) in ZW):
                    b -= 1
                if b >= 0 and t[b] in DIGITS:
                    i = n
                    continue
        if o.strip_diacritics and ord(c) in DIA:
            i += 1
            continue
        if o.strip_tatweel and c == "ـ":
            if o.strip_tatweel == "safe":
                b = len(out) - 1
                while b >= 0 and out[b] == " ":
                    b -= 1
                if b >= 0 and (out[b] in DIGITS or out[b] == "ه"):
                    if letters:
                        gap()
                    else:
                        out.append(c)
                        space = False
            i += 1
            continue
        if o.strip_latin_and_symbols and not letters:
            if (c.isascii() and c.isalnum()) or c in SYMBOLS:
                gap()
                i += 1
                continue
            if c == "/" and t[i + 1 : i + 2] == "/":
                while t[i : i + 1] == "/":
                    i += 1
                gap()
                continue
        if o.strip_footnotes and not letters and c == "(" and (n := footnote_at(t, i)):
            gap()
            i += n
            continue
        if letters and ord(c) not in LETTERS:
            gap()
            i += 1
            continue
        if o.normalize_alif and c in "آأإٱ":
            c = "ا"
        if o.replace_alif_maqsurah and c == "ى":
            c = "ي"
        if o.replace_ta_marbutah_with_ha and c == "ة":
            c = "ه"
        out.append(c)
        space = False
        i += 1
    if o.trim and space and out and out[-1] == " ":
        out.pop()
    return "".join(out)


def random_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    alphabet = "ابوي هةىأإآٱـسم" + "َٕٓٔ‌﻿" + "123٣٥٩" + "()()¬/-=& ﷺaZ.\n\t "
    pieces = ["(٣)", "( ¬١٢ )", "(٣ م)", "٥ هـ", "1435/3/29 هـ ", "ـه", "هـ", "  "]
    return ["".join(r.choice(pieces) if r.random() < 0.15 else r.choice(alphabet) for _ in range(r.randint(0, 24))) for _ in range(n)]


OPTIONS = {
    **{p: p for p in ("light", "search", "aggressive")},
    **{f.name: SanitizeOptions("none", **{f.name: True}) for f in fields(Resolved)},
    "all_tatweel": SanitizeOptions("none", strip_tatweel="all", collapse_whitespace=True, trim=True),
    "safe_search": SanitizeOptions("search", strip_tatweel="safe"),
    "zero_width_space": SanitizeOptions("light", zero_width_to_space=True),
    "compact": SanitizeOptions("search", keep_only_arabic_letters=True),
    "search_latin": SanitizeOptions("search", strip_latin_and_symbols=True),
    "light_words": SanitizeOptions("light", letters_and_spaces_only=True, strip_diacritics=True),
}


@pytest.mark.parametrize("name", OPTIONS)
def test_agrees_with_the_state_machine(spark, name):
    texts = random_texts(3000, 7) + ["", " ", "ه", "٥ه", "٥ه/"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sanitize("t", OPTIONS[name]).alias("s")).collect()
    resolved = resolve_options(OPTIONS[name])
    got = {r.i: r.s for r in rows}
    wrong = [(ascii(t), ascii(got[i]), ascii(model(t, resolved))) for i, t in enumerate(texts) if got[i] != model(t, resolved)]
    assert not wrong[:3], len(wrong)


def one(spark, text, options="search"):
    return spark.createDataFrame([(text,)], "t string").select(sanitize("t", options).alias("s")).first().s


def test_known_cases(spark):
    assert one(spark, None) == ""
    assert one(spark, "1435/3/29 هـ") == "1435/3/29"
    assert one(spark, "4ـ ومدح لكتاب", SanitizeOptions("none", strip_tatweel=True)) == "4ـ ومدح لكتاب"
    assert one(spark, "أبتـكَةُ‌ على", "aggressive") == "ابتكه علي"
    assert one(spark, "a\n b", SanitizeOptions("none", trim=True)) == "a\n b"


def test_arrays_and_factories(spark):
    df = spark.createDataFrame([(["أ ", None],)], "a array<string>")
    assert df.select(sanitize_array("a").alias("s")).first().s == ["ا", ""]
    clean = create_sanitizer("light")
    assert spark.createDataFrame([("  x  y ",)], "t string").select(clean("t").alias("s")).first().s == "x y"


def test_options():
    assert resolve_options(SanitizeOptions()) == PRESETS["light"]
    assert resolve_options(SanitizeOptions("none", strip_tatweel=True)).strip_tatweel == "safe"
    assert resolve_options(SanitizeOptions("search", nfc=False)).nfc is False
    with pytest.raises(ValueError):
        resolve_options("other")
    assert len({*itertools.chain(PRESETS)}) == 4


def test_passes_over_the_text(spark):
    """Each rule of its own costs a pass over the text by a regular expression; most share one or are literal."""
    from warraq.functions.noise import is_valid_arabic_content

    plan = lambda c: spark.range(1).selectExpr("cast(id as string) as x").select(c.alias("y"))._jdf.queryExecution().analyzed().toString()
    assert all(plan(sanitize("x", p)).count("regexp_replace(") <= most for p, most in (("light", 2), ("search", 8), ("aggressive", 8)))
    assert "translate(" not in plan(sanitize("x", "search"))
    assert "regexp_count" not in plan(is_valid_arabic_content("x"))
