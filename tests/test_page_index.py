"""The index of pages on disk: bytes of postings, additions, merging, search and streams."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warraq.operators import page_index, search
from warraq.sources import shared
from warraq.streaming.lines import index_stream, search_stream

PAGES = "book_id string, page int, text string, idx int, gram string"


def pages_of(seed, books=("x", "y"), n=12):
    r = random.Random(seed)
    words = ["كتاب", "علم", "النحو", "باب", "قول", "في", "من", "ا", "ab", "c"]
    return [(b, i, " ".join(r.choices(words, k=r.choice([0, 0, 1, 1, 2, 9, 25]))) if i % 5 else None, 0, "g") for b in books for i in range(n)]


def test_numbers_as_bytes():
    r = random.Random(1)
    rows = [[r.choice([0, 1, 127, 128, 300, 1 << 20, (1 << 40) + 3]) for _ in range(r.randint(0, 9))] for _ in range(200)]
    flat = np.asarray([x for row in rows for x in row], np.int64)
    column = page_index.packed(flat, np.repeat(np.arange(len(rows)), [len(x) for x in rows]), len(rows))
    numbers, counts = page_index.unpacked(column)
    assert numbers.tolist() == flat.tolist() and counts.tolist() == [len(x) for x in rows]
    numbers, counts = page_index.unpacked(pa.array([], pa.binary()))
    assert len(numbers) == len(counts) == 0


@pytest.mark.parametrize("q", [1, 4])
def test_postings_after_additions(spark, q):
    """Places of all grams, after one addition, after three, and merged: of pages, seams and the running text."""
    rows = pages_of(7)
    df = spark.createDataFrame(rows, PAGES)
    normal = {}
    for x in search.normalised_pages(df).orderBy("idx").collect():
        normal.setdefault(x.book_id, []).append(x.text)
    want = Counter()
    for b, pages in normal.items():
        starts = np.cumsum([0, *(len(p) + 1 for p in pages)])[:-1]
        whole = " ".join(pages)
        for kind, texts in ((page_index.PAGE, pages), (page_index.SEAM, [a[-9:] + " " + c[:9] for a, c in zip(pages, pages[1:], strict=False)])):
            want.update((b, kind, t[k : k + q], i, k) for i, t in enumerate(texts) for k in range(len(t) - q + 1))
        for k in range(len(whole) - q + 1):
            i = int(np.searchsorted(starts, k, "right")) - 1
            if k - starts[i] + q > len(pages[i]):
                want[b, page_index.CROSS, whole[k : k + q], i, int(k - starts[i])] += 1
    if q == 1:  # a gram of one character goes over no break
        want = Counter({k: n for k, n in want.items() if k[1] != page_index.CROSS})
    grams = spark.createDataFrame(list({(b, g) for b, _, g, _, _ in want}), "book_id string, gram string")
    every = (page_index.PAGE, page_index.SEAM, page_index.CROSS)
    read = lambda index: Counter((r.book_id, r.kind, r.gram, r.idx, r.pos) for r in index.postings(grams, every).collect())
    make = lambda: page_index.create_index(spark, None, q, 9, 5)
    assert read(make().add(df)) == want
    index = make()
    for low, high in ((0, 1), (1, 7), (7, 99)):
        index = index.add(df.where(F.col("page").between(low, high - 1)))
    assert len(index.generations) == 3 and read(index) == want
    merged = index.merge()
    assert len(merged.generations) == 1 and read(merged) == want == read(page_index.open_index(spark, merged.path))
    freq = {(r.book_id, r.gram): r.freq for r in merged.frequencies(grams, every).collect()}
    count = Counter()
    for (b, _, g, _, _), n in want.items():
        count[b, g] += n
    assert freq == count


def test_bytes_of_postings(spark, monkeypatch):
    """Postings take bytes for pages, not for places; a search finds the places, whether the pages are broadcast or not."""
    df = spark.createDataFrame([("x", p, "علم " * 2000) for p in range(6)], "book_id string, page int, text string")
    index = page_index.create_index(spark, buckets=2).add(df.where("page < 3")).add(df.where("page >= 3")).merge()
    grams = spark.createDataFrame([("x", "علم ")], "book_id string, gram string")
    every = (page_index.PAGE, page_index.SEAM, page_index.CROSS)
    stored = spark.read.parquet(f"{index.path}/postings/{index.generations[0]}")
    binary = [f.name for f in stored.schema.fields if f.dataType.simpleString() == "binary"]
    assert stored.agg(F.sum(sum(F.octet_length(c) for c in binary))).first()[0] < 200
    found = Counter(map(tuple, index.postings(grams, every).collect()))
    # 2,000 words a page, the last without a blank after it; 256 a seam
    assert len(found) == sum(found.values()) == 6 * 1999 + 5 * 256 + 5 == index.frequencies(grams, every).first().freq
    monkeypatch.setattr(page_index, "FEW", -1)
    assert Counter(map(tuple, index.postings(grams, every).collect())) == found


def test_exact_hits_over_breaks(spark):
    """Every stretch of a book of short and empty pages, and some that are none."""
    rows = pages_of(3, ("x",), 10)
    df = spark.createDataFrame(rows, PAGES)
    book = search.normalised_pages(df)
    pages = [r.text for r in book.orderBy("idx").collect()]
    whole, starts = " ".join(pages), np.cumsum([0, *(len(p) + 1 for p in pages)])[:-1]
    r = random.Random(5)
    some = {whole[k : k + n].strip(" ") for k, n in ((r.randrange(len(whole)), r.choice([1, 2, 3, 4, 5, 9, 30])) for _ in range(90))} | {"zzzz", "", "c c c c c c"}
    patterns = spark.createDataFrame([("x", p) for p in some], "book_id string, pattern string")
    want = {(p, int(np.searchsorted(starts, k, "right")) - 1) for p in some if p for k in range(len(whole)) if whole.startswith(p, k)}
    index = page_index.create_index(spark, buckets=4).add(df.where("page < 4")).add(df.where("page >= 4"))
    assert {(h.pattern, h.idx) for h in page_index.exact_hits(index, patterns).collect()} == want
    assert {(h.pattern, h.idx) for h in search.exact_hits(book, patterns).collect()} == want


def test_search_in_an_index(spark):
    """Rows of find_matches, whatever the additions; a wrong order of pages and a policy of other grams are errors."""
    df = spark.createDataFrame(pages_of(11), PAGES)
    excerpts = spark.createDataFrame([("x", 1, "كتاب علم باب"), ("y", 2, "النحو باب فول في من كتاب علم"), ("y", 3, "ab"), ("x", 4, None), ("z", 5, "كتاب علم")], "book_id string, excerpt_id int, text string")
    index = page_index.create_index(spark, buckets=4)
    assert [r.page for r in page_index.search_index(index, excerpts).collect()] == [None] * 5
    for low, high in ((0, 5), (6, 8), (9, 20)):
        index = index.add(df.where(F.col("page").between(low, high)))
    want = Counter(map(tuple, search.find_matches(df, excerpts).collect()))
    assert Counter(map(tuple, page_index.search_index(index, excerpts).collect())) == want
    every = {(r.book_id, r.excerpt_id): r.pages for r in search.find_matches_all(df, excerpts).collect()}
    assert {(r.book_id, r.excerpt_id): r.pages for r in page_index.search_index_all(index.merge(), excerpts).collect()} == every
    with pytest.raises(ValueError, match="cannot be added"):
        index.add(df.where("page = 3"))
    with pytest.raises(ValueError, match="policy"):
        page_index.search_index(index, excerpts, search.MatchPolicy(q=3))


def test_streams_of_an_index(spark, tmp_path):
    """Pages come in three batches, and each is indexed once; batches of excerpts read the index and leave no tables."""
    rows = pages_of(13)
    index = page_index.create_index(spark, "file://" + str(tmp_path / "index"), buckets=4)
    for k, (low, high) in enumerate(((0, 4), (4, 8), (8, 99))):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        stream = spark.readStream.schema(PAGES).parquet(str(tmp_path / "pages"))
        query = index_stream(stream, index.path, merge_every=3).option("checkpointLocation", str(tmp_path / "at")).start()
        query.processAllAvailable()
        query.stop()
        index = page_index.open_index(spark, index.path)
        assert index.batch == k and index.pages().count() == sum(r[1] < high for r in rows)
    assert len(index.generations) == 1 and index.add(spark.createDataFrame(rows, PAGES), batch=2) is index
    excerpts = spark.createDataFrame([("x", 1, "كتاب علم"), ("y", 2, "النحو باب")], "book_id string, excerpt_id int, text string")
    excerpts.write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "ex"))
    found, left = [], []
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(excerpts.schema).parquet(str(tmp_path / "ex"))
    query = search_stream(stream, index, lambda df, _: (found.extend(df.collect()), left.append(df.inputFiles()))).start()
    query.processAllAvailable()
    query.stop()
    assert Counter(map(tuple, found)) == Counter(map(tuple, search.find_matches(spark.createDataFrame(rows, PAGES), excerpts).collect()))
    assert len(left) >= 1 and all(left)
    files = spark.sparkContext._jvm.java.io.File
    assert not any(files(f.removeprefix("file://").replace("file:", "")).exists() for some in left for f in some if "/index/" not in f)


def test_saved_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.rpartition("/")[2] for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    table = shared.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "groups")
    for _ in range(50):  # executors are told, not waited for
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and table.count() == 7
