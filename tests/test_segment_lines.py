"""Alignment of lines over tables, against the expression over arrays."""

import random

from pyspark.sql import functions as F

from warraq.functions.segments import align_segments
from warraq.operators import segment_lines

KIND = "doc_id string, line_no int, text string, pos int"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choices("abcﷺ", k=r.randint(0, 90))) for _ in range(2))
        assert segment_lines.edit_distance(a, b) == plain_distance(a, b)


def book(r, n):
    """Targets, and segments that are split, swapped, misread, missing, added, empty or null."""
    words = ["".join(r.choices("ابتثجحخد", k=r.randint(2, 6))) for _ in range(60)]
    targets, parts = [], []
    for _ in range(n):
        line = r.choices(words, k=r.randint(1, 8))
        text, cut = " ".join(line), r.randint(0, len(line))
        halves = [" ".join(line[:cut]), " ".join(line[cut:])]
        noisy = "".join("ظ" if r.random() < 0.2 else c for c in text)
        parts += r.choice([[text], halves, halves[::-1], [noisy], [], [""], [None], [text + "ـ", "زائد"]])
        targets.append(r.choice([text] * 6 + ["", None]))
    return targets, parts


def test_lines_equal_the_expression(spark):
    r = random.Random(2)
    books = {f"d{k}": book(r, n) for k, n in enumerate([0, 1, 2, 5, 40, 40, 300, 900])} | {None: book(r, 30), "t": (["a", "b"], []), "s": ([], ["x", "x", None, ""])}
    rows = [[(d, i, t, 0) for d, sides in books.items() for i, t in enumerate(sides[k])] for k in (0, 1)]
    targets, parts = (spark.createDataFrame(x, KIND).repartition(5) for x in rows)
    got = {}
    for row in sorted(segment_lines.align_lines(targets, parts).collect(), key=lambda x: x.pos):
        lines = got.setdefault(row.doc_id, [])
        assert row.pos == len(lines)
        lines.append(row.line)
    lists = spark.createDataFrame([(d, *sides) for d, sides in books.items()], "d string, t array<string>, s array<string>")
    want = {x.d: x.lines for x in lists.select("d", align_segments("t", "s").alias("lines")).collect()}
    assert got == {d: lines for d, lines in want.items() if lines}
    assert segment_lines.align_lines(targets.limit(0), parts.limit(0)).collect() == []


def test_equal_lines_and_ids_of_another_kind(spark):
    """Repeated rows stay as often as they are; the result has the id's kind."""
    parts = spark.createDataFrame([(1, 0, "x y"), (1, 0, "x y"), (1, None, "z")], "doc_id bigint, line_no int, text string")
    out = segment_lines.align_lines(parts.where(F.lit(False)), parts)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "z"), (1, 1, "x y"), (1, 2, "x y")]


def test_little_waits():
    """Of a document of 100,000 lines whose sides have the same letters no more than a few lines wait."""
    fold, most, made = segment_lines._Fold(100_000, 200_000, 0.6), 0, 0
    for n in range(100_000):
        first, second = f"head {n}", f"tail of the line {n}"
        rows = [
            {"side": 0, "text": f"{first} {second}", "normal": f"{first} {second}"},
            {"side": 1, "text": second, "normal": second, "following": first, "ahead": f"{second} {first}", "back": f"{first} {second}"},
            {"side": 1, "text": first, "normal": first, "following": "next", "ahead": "", "back": ""},
        ]
        rows[1]["normal"] = "other"
        made += sum(len([*fold.take(row)]) for row in rows)
        most = max(most, len(fold.goals) + len(fold.waiting))
    assert made == 100_000 and most <= 3
