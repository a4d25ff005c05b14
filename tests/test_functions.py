"""Functions of columns against known cases and plain models."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.functions import alignment, balance, distance, noise, segments, tokens, typos


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances(spark):
    r = random.Random(1)
    rows = [("kitten", "sitting"), ("", ""), ("", "abc"), ("مدرسة", "مدرسه"), (None, "ab")] + [("".join(r.choices("ابت", k=r.randint(0, 9))), "".join(r.choices("ابت", k=r.randint(0, 9)))) for _ in range(200)]
    got = values(spark, rows, "a string, b string", distance.levenshtein_distance("a", "b"), distance.bounded_levenshtein("a", "b", 2), distance.similarity("a", "b"))
    for (a, b), (d, e, s) in zip(rows, got, strict=True):
        want = edits(a or "", b or "")
        size = max(len(a or ""), len(b or "")) or 1
        assert (d, e) == (want, min(want, 3)) and s == pytest.approx((size - want) / size)


def test_alignment_score(spark):
    rows = [("ﷺ", "كتاب"), ("أحمد", "احمد"), ("الكتاب", "الكتب"), ("بيت", "قلم")]
    assert values(spark, rows, "a string, b string", distance.alignment_score("a", "b", ["ﷺ"], 0.8).alias("s")) == [(1,), (2,), (1,), (-2,)]
    assert values(spark, [("", ""), ("أ", "ا")], "a string, b string", distance.similar_after_normalization("a", "b")) == [(True,), (True,)]


TOKEN_CASES = [
    (lambda c: tokens.extract_digits(c), "أ (٣٤) 12", "٣٤"),
    (lambda c: tokens.extract_digits(c), "لا", ""),
    (lambda c: F.array_join(tokens.tokenize(c, ["ﷺ"]), "|"), "محمدﷺ رسول الله ", "محمد|ﷺ|رسول|الله"),
    (lambda c: F.array_join(tokens.tokenize(c), "|"), "", ""),
    (tokens.remove_footnote_references_simple, "نص (¬١٢) آخر", "نص آخر"),
    (tokens.remove_single_digit_footnote_references, "نص (٣) و(٣ م) (١٢)", "نص و (١٢)"),
    (tokens.standardize_hijri_symbol, "123ه!", "123 هـ!"),
    (tokens.standardize_hijri_symbol, "٥ ه", "٥ هـ"),
    (tokens.standardize_hijri_symbol, "٥هو", "٥هو"),
    (tokens.standardize_intaha_symbol, "قال اه", "قال اهـ"),
    (tokens.standardize_intaha_symbol, "باه", "باه"),
]


def test_tokens(spark):
    for f, text, want in TOKEN_CASES:
        assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x == want, text


def test_footnote_tokens(spark):
    rows = [("(٥)أخرجه", "أخرجه"), ("(٥)", "نص"), ("(٥)أخرجه", "(٥)أخرجها"), ("نص", "كلمة"), ("٥", "(٦)")]
    got = values(spark, rows, "a string, b string", tokens.footnote_selection("a", "b"), tokens.standalone_footnotes("a", "b"))
    assert got == [(["(٥)أخرجه"], None), (["(٥)"], ["(٥)", "نص"]), (["(٥)أخرجه"], None), (None, None), (["(٦)"], ["٥"])]
    rows = [(["(٥)"], "(٥)", "(٥)أخرجه"), (["(٥)أخرجه"], "(٥)أخرجه", "(٥)"), (["(٥)"], "(٥)", "(٦)أخرجه")]
    got = values(spark, rows, "k array<string>, p string, c string", tokens.footnote_fusion(F.col("k"), F.col("p"), F.col("c")).alias("f"))
    assert [tuple(f) for (f,) in got] == [(True, ["(٥)أخرجه"]), (True, ["(٥)أخرجه"]), (False, ["(٥)"])]


def test_noise(spark):
    cases = {"": True, "  ": True, "---": True, "Ap Ap Ap": True, "صص": False, "هذا نص عربي": False, "2023": True, "!!!!!!!": True, "له.": False, "ABC DEF": True, "؟": True, "(٦٠١٠).": False, "A": True, "ـ": True, "12/": True, "هذا ... نص": False}
    got = values(spark, [(t,) for t in cases], "t string", noise.is_noise("t"))
    assert {t: g for t, (g,) in zip(cases, got, strict=True)} == cases
    stats = values(spark, [("نص a1 .@",)], "t string", noise.character_stats("t").alias("c"))[0][0]
    assert (stats.arabic, stats.latin, stats.digit, stats.space, stats.punctuation, stats.symbol) == (2, 1, 1, 2, 1, 1)
    assert stats.frequency[" "] == 2 and stats.frequency["ن"] == 1
    assert values(spark, [(None,)], "t string", noise.is_noise("t"), noise.has_excessive_repetition("t"), noise.is_spacing_noise("t"), noise.is_valid_arabic_content("t"), noise.is_non_arabic_noise("t"), noise.is_basic_noise_pattern("t"))[0][0] is True


def errors(text):
    pair, stack, out = balance.BRACKETS, [], []
    for i, c in enumerate(text):
        if c in pair:
            stack.append((i, c))
        elif c in balance.CLOSE_BRACKETS:
            if not stack:
                out.append((i, c, "unmatched", "bracket"))
            elif pair[stack[-1][1]] != c:
                out += [(*stack.pop(), "mismatched", "bracket"), (i, c, "mismatched", "bracket")]
            else:
                stack.pop()
    out += [(i, c, "unclosed", "bracket") for i, c in stack]
    if text.count('"') % 2:
        out.append((text.rindex('"'), '"', "unmatched", "quote"))
    return sorted(out)


def test_balance(spark):
    r = random.Random(3)
    texts = ["Hello (world [test}", 'a "b', "", "«»(){}[]"] + ["".join(r.choices('ab()[]{}«»"\n', k=r.randint(0, 30))) for _ in range(300)]
    got = values(spark, [(t,) for t in texts], "t string", balance.check_balance("t").alias("b"), balance.unbalanced_errors("t").alias("u"), balance.are_quotes_balanced("t"), balance.are_brackets_balanced("t"), balance.is_balanced("t"))
    for t, (b, u, q, k, both) in zip(texts, got, strict=True):
        want = errors(t)
        assert [tuple(e) for e in b.errors] == want and b.is_balanced == (not want) == both
        assert q == (t.count('"') % 2 == 0) and k == all(e[3] == "quote" for e in want)
        lines, at, far = t.split("\n"), 0, []
        for line in lines:
            far += [(at + e[0], *e[1:]) for e in errors(line) if len(line) > 10]
            at += len(line) + 1
        assert [tuple(e) for e in u] == far
    assert [e["index"] for e in got[0][0].errors] == [6, 13, 18]


def needleman(a, b, score):
    m, n = len(a), len(b)
    s = [[-(i + j) if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    d = [["l" if not i else "u" for _ in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            x = [(s[i - 1][j - 1] + score(a[i - 1], b[j - 1]), "d"), (s[i - 1][j] - 1, "u"), (s[i][j - 1] - 1, "l")]
            s[i][j], d[i][j] = max(x, key=lambda v: (v[0], -"dul".index(v[1])))
    out, i, j = [], m, n
    while i or j:
        k = d[i][j] if i else "l"
        out.append((a[i - 1] if k in "du" else None, b[j - 1] if k in "dl" else None))
        i, j = i - (k in "du"), j - (k in "dl")
    return out[::-1]


def test_alignment(spark):
    r = random.Random(5)
    words = ["كتاب", "كتب", "قلم", "ﷺ", "بيت", "a"]
    rows = [(["a"], ["a", "b"]), ([], ["x"]), (["x"], []), ([], [])] + [(r.choices(words, k=r.randint(0, 7)), r.choices(words, k=r.randint(0, 7))) for _ in range(60)]

    def score(x, y):
        if x == y:
            return 2
        size = max(len(x), len(y))
        return 1 if "ﷺ" in (x, y) or (size - edits(x, y)) / size >= 0.6 else -2

    got = values(spark, rows, "a array<string>, b array<string>", alignment.align_tokens("a", "b", ["ﷺ"], 0.6))
    for (a, b), (pairs,) in zip(rows, got, strict=True):
        assert [tuple(p) for p in pairs] == needleman(a, b, score), (a, b)


def test_typos(spark):
    cases = [
        ("محمد صلى الله عليه وسلم رسول الله", "محمد ﷺ رسول الله", 0.6, 0.8, "محمد صلى الله عليه ﷺ رسول الله"),
        ("نفس النص", "نفس النص", 0.7, 0.9, "نفس النص"),
        ("الكتاب (٥)أخرجه", "الكتاب (٥) أخرجه", 0.7, 0.9, "الكتاب (٥)أخرجه"),
        ("", "كلمة", 0.6, 0.8, "كلمة"),
    ]
    for a, b, low, high, want in cases:
        got = values(spark, [(a, b)], "a string, b string", typos.fix_typo("a", "b", ["ﷺ"], low, high))
        assert got == [(want,)], (a, b)


def test_segments(spark):
    cases = [
        (["hello world goodbye"], ["goodbye", "hello world"], ["hello world goodbye"]),
        (["", "b"], ["a", "b"], ["a", "b"]),
        (["a b"], [], []),
        ([], ["x", "y"], ["x", "y"]),
        (["same line"], ["same line", "rest"], ["same line", "rest"]),
        (["one two"], ["one"], ["one"]),
        (["word"], ["", "word"], ["", "word"]),
        (None, None, []),
    ]
    got = values(spark, [(t, s) for t, s, _ in cases], "t array<string>, s array<string>", segments.align_segments("t", "s"))
    assert [g for (g,) in got] == [w for _, _, w in cases]


def plain_alignment(a, b, na, nb, symbols, threshold):
    """Needleman-Wunsch cell by cell; ties prefer both tokens, then the first alone."""
    score = lambda i, j: 2 if na[i] == nb[j] else 1 if a[i] in symbols or b[j] in symbols or (max(len(na[i]), len(nb[j]), 1) - edits(na[i], nb[j])) / max(len(na[i]), len(nb[j]), 1) >= threshold else -2
    table = [[-j for j in range(len(b) + 1)]]
    steps = []
    for i in range(len(a)):
        row, own = [-i - 1], []
        for j in range(len(b)):
            options = (table[i][j] + score(i, j), table[i][j + 1] - 1, row[j] - 1)
            row.append(max(options))
            own.append(options.index(max(options)))
        table.append(row)
        steps.append(own)
    i, j, out = len(a), len(b), []
    while i or j:
        step = 2 if not i else 1 if not j else steps[i - 1][j - 1]
        out.append(step)
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


@pytest.mark.parametrize("keep", [None, 1, 2, 5])
def test_alignment_steps_agree_with_a_plain_table(keep):
    r = random.Random(2)
    for k in range(60):
        words = ["", "*", "ab", "abc", "abcd", "xbcd", "zz", "longerword", "longerwort", "é中"]
        a, b = r.choices(words, k=r.randint(0, 12)), r.choices(words, k=r.randint(0, 12))
        if k % 3 == 0:
            b = [w for w in a if r.random() < 0.8]
        threshold = r.choice([0.0, 0.5, 0.6, 0.75, 1.0, 1.5])
        got = alignment.alignment_steps(a, b, a, b, ["*"], threshold, keep)
        assert got.tolist() == plain_alignment(a, b, a, b, ["*"], threshold)


def test_alignment_of_long_lists_in_bounded_memory():
    """5,000 tokens with 5,000: the table has 25 million cells, of which a small part is held."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(500)]
    a = r.choices(words, k=5000)
    b = [w for w in a if r.random() < 0.9]
    tracemalloc.start()
    steps = alignment.alignment_steps(a, b, a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    left, right = alignment.backtrack(steps, a, b)
    assert most < 25_000_000, most
    assert [x for x in left if x is not None] == a and [x for x in right if x is not None] == b
    # what was left out is all that differs, at a cost of one gap each
    assert sum(2 if x == y else 1 for x, y in zip(left, right, strict=True) if x is not None and y is not None) - (left.count(None) + right.count(None)) >= 2 * len(b) - (len(a) - len(b))


def test_brackets_agree_with_a_stack():
    """Random brackets in lines: the errors of each line in the order in which a stack finds them."""
    r = random.Random(8)
    partner = {"«": "»", "(": ")", "[": "]", "{": "}"}
    for _ in range(300):
        text = "".join(r.choices("«»()[]{}ab\n", k=r.randint(0, 60)))
        want, at = [], 0
        for line in text.split("\n"):
            stack = []
            for i, c in enumerate(line):
                if c in partner:
                    stack.append(i)
                elif c in partner.values():
                    if not stack:
                        want.append((at + i, 0))
                    elif partner[line[stack[-1]]] != c:
                        want += [(at + stack.pop(), 1), (at + i, 1)]
                    else:
                        stack.pop()
            want += [(at + i, 2) for i in stack]
            at += len(line) + 1
        codes = balance._codes(text)
        breaks = codes == 10
        got = balance.bracket_faults(codes, np.cumsum(breaks) - breaks)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_a_million_brackets(spark):
    """Linear in a text's length: a million open brackets, and as many in pairs of different kinds, one inside the other."""
    n = 1_000_000
    df = spark.range(1).select(F.repeat(F.lit("("), n).alias("a"), F.concat(F.repeat(F.lit("("), n), F.repeat(F.lit("]"), n)).alias("b"))
    begin = time.time()
    found = df.select(F.size(balance.bracket_errors("a")), F.size(balance.unbalanced_errors("b"))).first()
    assert tuple(found) == (n, 2 * n) and time.time() - begin < 60


def test_character_stats_of_many_kinds(spark):
    """80,000 characters of which 20,000 differ."""
    text = "".join(chr(0x4E00 + k % 20_000) for k in range(80_000))
    begin = time.time()
    frequency = spark.createDataFrame([(text,)], "t string").select(noise.character_stats("t")["frequency"]).first()[0]
    assert len(frequency) == 20_000 and set(frequency.values()) == {4} and time.time() - begin < 30


def test_least_distances_are_bounds():
    r = random.Random(12)
    a = ["".join(r.choices("abc é中", k=r.randint(0, 30))) for _ in range(400)]
    b = [x if r.random() < 0.2 else "".join(c if r.random() < 0.8 else r.choice("abcx") for c in x) if r.random() < 0.7 else "".join(r.choices("abc", k=r.randint(0, 30))) for x in a]
    bound, true = distance.least_distances(a, b).tolist(), [edits(x, y) for x, y in zip(a, b, strict=True)]
    assert all(m <= n for m, n in zip(bound, true, strict=True)) and sum(m > 0 for m in bound) > 200
