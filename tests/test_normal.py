"""The vectorised normalisation against the Column expression, on texts that its rules tell apart."""

import random

import pytest
from pyspark.sql import functions as F

from warraq.functions import alignment, normal, segments
from warraq.functions.sanitize import sanitize

LETTERS = "ابهـوي ىةآأإٱپ\u0653\u0654\u0655\u064b\u0670\u200c\u200b\ufeff(¬)٣٤1 9\t\n\x00/-،xZ\ue000\ue001\U0001f600§`=&ﷺ"
FIXED = [None, "", " ", "\n \t", "١٤ ه", "١٤\u200cهـ", "12ه/3", "5هx", "5ه(", "(٣)", "( ¬١٢ )", "(٣ م)", "و\u0653\u0655\u0654", " \u0653 ", "ا\u0653 ا\u0654", "a  b", "ه", "7ه" * 3]


@pytest.mark.parametrize("preset", ["search", "aggressive"])
def test_normalised_is_sanitize(spark, preset, monkeypatch):
    rng = random.Random(preset)
    texts = FIXED + ["".join(rng.choices(LETTERS, k=rng.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = [r.c for r in df.select("k", sanitize("t", preset).alias("c")).orderBy("k").collect()]
    assert normal.normalised(texts, preset) == want
    monkeypatch.setattr(normal, "SLICE", 64)
    assert normal.normalised(texts, preset) == want


def test_columns(spark):
    df = spark.createDataFrame([(t,) for t in FIXED], "t string")
    c = sanitize("t", "aggressive")
    assert df.select(normal.clean_text("t"), normal.clean_length("t")).collect() == df.select(c, F.length(c)).collect()


def test_alignments_together_are_those_alone(monkeypatch):
    """Small tables in lock step, of words that repeat letters, of symbols and of no tokens; groups of one and of many."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("ابجد", k=rng.randrange(7)))
    items = []
    for _ in range(60):
        a, b = ([rng.choice([word(), "ﷺ"]) for _ in range(rng.randrange(12))] for _ in range(2))
        items.append((a, b, a, b))
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(alignment, "GROUP", size)
        for threshold in (0.6, 0.0, 1.0):
            for x, steps in zip(items, alignment.many_steps(items, ["ﷺ"], threshold), strict=True):
                assert steps.tolist() == alignment.alignment_steps(*x, ["ﷺ"], threshold).tolist()
    calls = []
    monkeypatch.setattr(alignment, "distances", lambda *x, f=alignment.distances: (calls.append(1), f(*x))[1])
    alignment.many_steps(items, (), 0.6)
    assert len(calls) < len(items) / 4


def test_segments_of_odd_rows(spark):
    """Null lists and lines, empty lines before and after, lines out of order, more of one side than of the other."""
    rows = [(["ab cd", None, "xy"], ["cd", "ab", "q", "xy", None]), (["ab"], None), (None, ["a", None]), (["abc", "def"], ["", "abc", "def"]), (["abc"], ["zzz"]), (["abc", "d"], [None, "abc"]), ([], [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t array<string>, s array<string>")
    got = [r.x for r in df.select("k", segments.align_segments("t", "s").alias("x")).orderBy("k").collect()]
    assert got == [["ab cd", "q", "xy", None], [], ["a", None], ["", "abc", "def"], ["zzz"], [None, "abc"], []]
