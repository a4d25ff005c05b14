"""Grams counted and told without a row for each, against their postings; what a search moves."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from warraq.operators import grams, page_index, search

PAGES = "book_id string, page int, text string"


def pages_of(spark, seed, letters="ابجد ه", n=40):
    r = random.Random(seed)
    return spark.createDataFrame([(b, i, "".join(r.choices(letters, k=r.choice([0, 1, 3, 9, 60])))) for b in "xy" for i in range(n)], PAGES).repartition(3)


@pytest.mark.parametrize("q, letters", [(4, "ابجد ه"), (9, "".join(map(chr, range(0x621, 0x63B)))), (30, "".join(map(chr, range(0x621, 0x63B))))])
def test_counts_are_those_of_postings(spark, q, letters, monkeypatch):
    monkeypatch.setattr(grams, "SLICE", 100)
    book = search.normalised_pages(pages_of(spark, q, letters))
    seams = search.create_seams(book, 20)
    every = search.qgram_postings(book, seams, q)
    wanted = every.where(F.xxhash64("gram") % 3 == 0).select("book_id", "gram").unionByName(spark.createDataFrame([("x", "ش" * q), ("z", "ا" * q)], "book_id string, gram string"))
    want = Counter((r.book_id, r.gram) for r in every.join(wanted.distinct(), ["book_id", "gram"], "left_semi").collect())
    got = {(r.book_id, r.gram): r.freq for r in search.gram_counts(book, seams, wanted, q).collect()}
    assert got == want and (want or q == 30)


def test_passing_pages_are_an_index(spark):
    """Counts and places of pages that are searched once are those of a kept index, breaks over short and empty pages too."""
    df, policy = pages_of(spark, 5), search.MatchPolicy(seam_len=9)
    once, index = page_index.passing_pages(df, policy), page_index.create_index(spark, None, 4, 9, 3).add(df)
    asked = once.book.select("book_id", F.explode(search.grams_of(F.col("text"), 4)).alias("gram")).distinct().unionByName(spark.createDataFrame([("x", " اب "), ("y", "ب ه ")], "book_id string, gram string")).distinct()
    for kinds in ((page_index.PAGE, page_index.SEAM), (page_index.PAGE, page_index.CROSS)):
        rows = lambda x: Counter((r.book_id, r.gram, r.kind, r.idx, r.pos) for r in x.postings(asked, kinds).collect())  # noqa: B023, E731
        assert rows(once) == rows(index) != Counter()
        freq = lambda x: {(r.book_id, r.gram): r.n for r in x.counts(asked, {"n": kinds}).collect() if r.n}  # noqa: B023, E731
        assert freq(once) == freq(index)


def test_starts_without_texts(spark):
    df = pages_of(spark, 9)
    book = search.build_book(search.normalised_pages(df))
    starts = search.page_starts(df)
    assert "text" not in starts.columns and sorted(starts.collect()) == sorted(book.select(*starts.columns).collect())


def test_a_search_moves_no_whole_pages_to_its_places(spark, monkeypatch):
    """What is compared with an excerpt is of its length, however long the page is."""
    r, sizes = random.Random(2), {}
    text = "".join(r.choices("ابتثجحخدذرزسشصضطعغفقكلمن ", k=60_000))
    pages = spark.createDataFrame([("b", i, text[20_000 * i : 20_000 * (i + 1)]) for i in range(3)], PAGES)
    excerpts = spark.createDataFrame([("b", i, text[at : at + 50] + "ظ" + text[at + 51 : at + 100]) for i, at in enumerate((500, 19_960, 45_000))], "book_id string, excerpt_id int, text string")
    whole = search.saved

    def noted(df, label):
        out = whole(df, label)
        if label == "places":
            sizes[label] = out.agg(F.max(F.length("text"))).first()[0]
        return out

    monkeypatch.setattr(search, "saved", noted)
    found = {x.excerpt_id: x.page for x in search.find_matches(pages, excerpts).collect()}
    assert found == {0: 0, 1: 0, 2: 2} and sizes["places"] <= 120
