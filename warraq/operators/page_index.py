"""A q-gram index of books that is kept on disk, added to and searched often.

Below its path an index has generations, one for each addition. A generation holds

- ``pages``: normalised pages with their number and start in their book, ``seams``, the
  ends of pages with the beginnings of the next, written where they are made, and
  ``breaks``, the few characters about the breaks between pages;
- ``postings``: for each gram, book and range of pages one row with the number of its
  places and the gaps between the pages that hold it, in bytes of variable length;
- ``books``, their sizes.

Postings are filed by buckets, a hash of the gram: a search reads the buckets of its grams,
and of those the rows of its grams. A gram stands on a page, on a seam, or in the book's
running text over the break between two pages or more: the first two serve the approximate
search, the first and the last hold every place of the book once and serve the exact one.
Of a posting its page is kept; the places on it are told by the pages' texts, which an
index has anyway: a search looks through those that hold one of its grams.

Pages are added behind those that their book has. Rows of a range are made where its pages
are, so that no posting is shuffled by itself. ``merge`` folds all generations into one
and joins rows of neighbouring ranges. The list of generations is written last: an addition
that breaks off leaves the index as it was. One writer at a time; readers keep the
generations that they opened.
"""

from __future__ import annotations

import dataclasses
import functools
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.policy import DEFAULT_POLICY, MatchPolicy
from ..sources.shared import saved, scratch, shared_path, tidied
from . import search as S
from .grams import counted, places

#: Kinds of postings: on a page, on a seam, over page breaks.
PAGE, SEAM, CROSS = 0, 1, 2
#: Pages whose postings one row of a merged index may hold, characters of texts that are indexed at once.
MERGED, SLICE = 4096, 1 << 21
#: Pages, seams and breaks that hold grams of a search and are picked by a broadcast (some 40 bytes each); beyond that all are looked through.
FEW = 500_000
#: Number of the form of an index on disk.
FORMAT = 2


def packed(numbers: np.ndarray, owner: np.ndarray, owners: int) -> pa.Array:
    """Numbers of each owner (ascending) as bytes: seven bits each, the lowest first, the eighth where more follow."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        size += numbers >= 1 << 7 * k
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[begin[:-1][some] + k] = (numbers[some] >> 7 * k & 127) | (size[some] > k + 1) * 128
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, size, owners))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), owners, [None, pa.py_buffer(ends), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column, and how many each row has."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    last = data < 128
    place = np.flatnonzero(last)
    begin = np.concatenate([[0], place[:-1] + 1])[: len(place)]
    shift = 7 * (np.arange(len(data)) - np.repeat(begin, place - begin + 1))
    numbers = np.add.reduceat((data & 127).astype(np.int64) << shift, begin) if len(begin) else np.zeros(0, np.int64)
    ends = np.cumsum([len(b) for b in column.to_pylist()])
    before = np.concatenate([[0], np.searchsorted(place, ends)])
    return numbers, np.diff(before)


def _lists(group: np.ndarray, idx: np.ndarray, groups: int) -> tuple[pa.Array, pa.Array]:
    """(first, pages) of pages that are sorted by group; a page may come several times."""
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    page = fresh.copy()
    page[1:] |= idx[1:] != idx[:-1]
    at = np.flatnonzero(page)
    gap = np.diff(idx[at], prepend=0)
    gap[fresh[at]] = 0
    return pa.array(idx[fresh].astype(np.int32)), packed(gap, group[at], groups)


def _pages(first: pa.Array, pages: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, idx) of every page of rows."""
    gap, counts = unpacked(pages)
    row, total = np.repeat(np.arange(len(counts)), counts), np.cumsum(gap)
    begin = np.cumsum(counts) - counts
    return row, total - (total[begin] - first.to_numpy())[row]


def _grams(codes: np.ndarray, starts: np.ndarray, q: int) -> np.ndarray:
    """A number for the gram at each of ``starts``, equal for equal grams."""
    kinds, number = np.unique(codes, return_inverse=True)
    key, values = number[starts], len(kinds)
    for k in range(1, q):
        if values > (1 << 62) // max(len(kinds), 1):
            known, key = np.unique(key, return_inverse=True)
            values = len(known)
        key, values = key * len(kinds) + number[starts + k], values * len(kinds)
    return key


def _block_rows(q: int):
    """Rows of postings for texts (book_id, kind, idx, base, low, high, text): grams that begin from ``low`` to before ``high``."""
    names = ["book_id", "kind", "gram", "first", "n", "pages"]

    def some(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [t.encode("utf-32-le") for t in batch.column(6).to_pylist()]
        size = np.asarray([len(t) // 4 for t in texts])
        codes = np.frombuffer(b"".join(texts), np.uint32)
        low, high = (batch.column(k).to_numpy() for k in (4, 5))
        count = np.maximum(np.minimum(high, size - q + 1) - low, 0)
        row = np.repeat(np.arange(len(size)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
        starts = (np.cumsum(size) - size)[row] + within
        if not len(starts):
            return None
        books, kind = batch.column(0).dictionary_encode(), batch.column(1).to_numpy().astype(np.int64)
        home = (books.indices.to_numpy().astype(np.int64) * 3 + kind)[row]
        known, key = np.unique(_grams(codes, starts, q), return_inverse=True)
        idx = batch.column(2).to_numpy().astype(np.int64)[row]
        key = home * len(known) + key
        order = np.lexsort((idx, key))
        key, idx, first = key[order], idx[order], starts[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(fresh) - 1
        text = codes[first[fresh][:, None] + np.arange(q)].tobytes().decode("utf-32-le")
        grams = pa.array([text[k : k + q] for k in range(0, len(text), q)])
        home = key[fresh] // len(known)
        own = books.dictionary.take(pa.array(home // 3))
        low, pages = _lists(group, idx, len(grams))
        return pa.RecordBatch.from_arrays([own, pa.array((home % 3).astype(np.int8)), grams, low, pa.array(np.bincount(group).astype(np.int64)), pages], names)

    def run(batches):
        for batch in batches:
            sizes = np.cumsum([len(t) for t in batch.column(6).to_pylist()])
            # a longer text is a slice of its own
            cut = np.flatnonzero(np.diff(sizes // SLICE, prepend=0)) if len(sizes) else []
            for a, b in zip([0, *cut], [*cut, len(sizes)], strict=True):
                if b > a and (out := some(batch.slice(a, b - a))) is not None:
                    yield out

    return run


def _held(batches):
    """(book_id, kind, idx) of the pages of rows (book_id, kind, first, pages), each once a batch."""
    for batch in batches:
        row, idx = _pages(batch.column(2), batch.column(3))
        books, kind = batch.column(0).dictionary_encode(), batch.column(1).to_numpy().astype(np.int64)
        found = np.unique(np.stack([books.indices.to_numpy().astype(np.int64)[row], kind[row], idx], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([books.dictionary.take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int8)), pa.array(found[:, 2].astype(np.int32))], ["book_id", "kind", "idx"])


def _folded(batches):
    """Rows (bucket, book_id, kind, gram, n, parts) with their parts, rows of neighbouring ranges, put together."""
    for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
        parts = batch.column(5).flatten()
        sizes = np.diff(batch.column(5).offsets.to_numpy())
        row, idx = _pages(parts.field(0), parts.field(1))
        group = np.repeat(np.arange(len(sizes)), sizes)[row]
        order = np.lexsort((idx, group))
        first, pages = _lists(group[order], idx[order], len(sizes))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], first, batch.column(4), pages], ["bucket", "book_id", "kind", "gram", "first", "n", "pages"])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket")


def _summed(counts: DataFrame, kinds: dict[str, tuple[int, ...]]) -> DataFrame:
    """(book_id, gram, ...): sums of counts (book_id, kind, gram, freq) for each entry of ``kinds``."""
    sums = (F.coalesce(F.sum(F.when(F.col("kind").isin(*k), F.col("freq"))), F.lit(0)).alias(name) for name, k in kinds.items())
    return counts.groupBy("book_id", "gram").agg(*sums)


@dataclass(frozen=True)
class PageIndex:
    """The generations of an index at the time when it was opened."""

    spark: SparkSession
    path: str
    version: int
    generations: tuple[str, ...]
    q: int
    seam_len: int
    buckets: int
    kind: str
    page_kind: str
    batch: int | None = None

    def _read(self, table: str, schema: str, by: str | None = None, values: Iterable[int] | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema + (f", {by} int" if by else ""))
        paths = [f"{self.path}/{table}/{g}" for g in self.generations]
        found = None
        for p in paths:
            one = reader.parquet(p)
            found = one if found is None else found.unionByName(one)
        if found is None:
            found = self.spark.createDataFrame([], schema + (f", {by} int" if by else ""))
        return found if values is None else found.where(F.col(by).isin([*values]))

    def pages(self) -> DataFrame:
        """(book_id, idx, page, text, start, len) of all pages, normalised."""
        return self._read("pages", f"book_id {self.kind}, idx int, page {self.page_kind}, text string, start bigint, len int")

    def seams(self) -> DataFrame:
        """(book_id, idx, page, text) of all seams."""
        return self._read("seams", f"book_id {self.kind}, idx int, page {self.page_kind}, text string")

    def breaks(self) -> DataFrame:
        """(book_id, kind, idx, base, low, high, text): texts over the breaks between pages."""
        return self._read("breaks", f"book_id {self.kind}, {BREAKS}")

    def texts(self, kinds: tuple[int, ...]) -> DataFrame:
        """(book_id, kind, idx, base, low, high, text): all texts of ``kinds``, for ``grams``."""
        every = {PAGE: lambda: S.whole_texts(self.pages(), PAGE), SEAM: lambda: S.whole_texts(self.seams(), SEAM), CROSS: self.breaks}
        return functools.reduce(DataFrame.unionByName, (every[k]() for k in kinds if self.q > 1 or k != CROSS))

    def books(self) -> DataFrame:
        """(book_id, n, size, last): the pages of each book, its characters with a blank after each page, its last page."""
        rows = self._read("books", f"book_id {self.kind}, n int, size bigint, last {self.page_kind}")
        return rows.groupBy("book_id").agg(F.sum("n").cast("int").alias("n"), F.sum("size").alias("size"), F.max("last").alias("last"))

    def _buckets_of(self, grams: DataFrame) -> list[int]:
        """The buckets of grams; at most as many numbers as there are buckets."""
        return [r.bucket for r in grams.select(_bucket(self.buckets)).distinct().collect()]

    def rows(self, grams: DataFrame) -> DataFrame:
        """Rows of postings of ``grams`` (book_id, gram, ...), with their columns; only their buckets are read."""
        stored = self._read("postings", f"book_id {self.kind}, {ROWS}", "bucket", self._buckets_of(grams))
        return stored.join(grams.withColumn("bucket", _bucket(self.buckets)), ["bucket", "book_id", "gram"]).drop("bucket")

    def postings(self, grams: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
        """``grams`` (book_id, gram, ...) with (kind, idx, pos) of each place, told by the texts that the rows of postings name."""
        rows = self.rows(grams.select("book_id", "gram").distinct()).where(F.col("kind").isin(*kinds))
        held = rows.select("book_id", "kind", "first", "pages").mapInArrow(_held, f"book_id {self.kind}, kind tinyint, idx int")
        held = saved(held.distinct(), "held-pages")
        texts = self.texts(kinds)
        if held.count() <= FEW:
            texts = texts.join(F.broadcast(held), ["book_id", "kind", "idx"], "left_semi").select(texts.columns)
        return places(texts, grams, self.q)

    def frequencies(self, grams: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
        """(book_id, gram, freq) of ``grams`` (gram, ...) in all books that have them."""
        return self.counts(grams, {"freq": kinds}).where("freq > 0")

    def counts(self, grams: DataFrame, kinds: dict[str, tuple[int, ...]]) -> DataFrame:
        """(book_id, gram, ...) of ``grams`` in all books that have them, with a number of places for each entry of ``kinds``."""
        stored = self._read("postings", f"book_id {self.kind}, kind tinyint, gram string, n bigint", "bucket", self._buckets_of(grams)).withColumnRenamed("n", "freq")
        wanted = grams.select(_bucket(self.buckets), "gram").distinct()
        return _summed(stored.join(wanted, ["bucket", "gram"], "left_semi"), kinds)

    def _commit(self, generations: tuple[str, ...], batch: int | None = None) -> PageIndex:
        row = [(g, self.q, self.seam_len, self.buckets, self.kind, self.page_kind, self.batch if batch is None else batch, FORMAT) for g in generations or (None,)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version + 1}")
        return open_index(self.spark, self.path)

    def _write(self, df: DataFrame, table: str, generation: str, *by: str) -> None:
        with tidied(self.spark):
            df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{table}/{generation}")

    def _spread(self) -> tuple[int, Column, Column]:
        """A number of tasks, and for rows of postings their range of MERGED pages and a number by which buckets are dealt to as many tasks as give all something to do."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        of = F.floor(F.col("first") / MERGED)
        return parts, of.alias("of"), F.pmod(F.xxhash64("book_id", of), F.lit(-(-parts // self.buckets))).alias("spread")

    def add(self, pages: DataFrame, batch: int | None = None) -> PageIndex:
        """The index with ``pages`` (book_id, page, text), each after the pages that its book has; other columns are ignored.

        ``batch`` numbers additions that may be tried again, such as those of a stream:
        one whose number the index has already changes nothing.
        """
        if batch is not None and self.batch is not None and batch <= self.batch:
            return self
        generation, q = self._generation(), self.q
        with scratch():
            given = S.normalised_pages(pages)
            old = saved(self.books(), "books")
            early = given.groupBy("book_id").agg(F.min("page").alias("page")).join(old, "book_id").where("page <= last")
            if wrong := early.limit(1).collect():
                raise ValueError(f"book {wrong[0].book_id!r} has page {wrong[0].last!r}; page {wrong[0].page!r} cannot be added behind it")
            numbered = given.join(old, "book_id", "left").select("book_id", (F.col("idx") + F.coalesce("n", F.lit(0))).cast("int").alias("idx"), "page", "text", (F.col("start") + F.coalesce("size", F.lit(0))).cast("bigint").alias("start"), "len")
            self._write(numbered, "pages", generation)
            new = self.spark.read.schema(self.pages().schema).parquet(f"{self.path}/pages/{generation}")
            new.groupBy("book_id").agg(F.count("*").cast("int").alias("n"), F.sum(F.col("len") + 1).cast("bigint").alias("size"), F.max("page").alias("last")).write.parquet(f"{self.path}/books/{generation}")

            # the last pages of books that go on: they make seams and grams with what is added
            going = old.join(new.select("book_id").distinct(), "book_id", "left_semi")
            ends = self.pages().join(going, "book_id").where(F.col("idx") >= F.col("n") - q)
            ends = saved(ends.select(*new.columns, (F.col("idx") == F.col("n") - 1).alias("is_last"), (F.col("size") - 1).alias("stop")), "ends")
            seams = S.create_seams(ends.where("is_last").select(*new.columns).unionByName(new), self.seam_len)
            self._write(seams, "seams", generation)

            made = dataclasses.replace(self, generations=(generation,))
            if q > 1:
                self._write(_crossings(ends, new, q), "breaks", generation)
            blocks = made.texts((PAGE, SEAM, CROSS)).mapInArrow(_block_rows(q), f"book_id {self.kind}, {ROWS}")
            parts, _, spread = self._spread()
            dealt = blocks.repartition(parts, _bucket(self.buckets), spread)
            self._write(dealt.withColumn("bucket", _bucket(self.buckets)), "postings", generation, "bucket")
        return self._commit((*self.generations, generation), batch)

    def _generation(self) -> str:
        """A new name; what an addition that broke off has written stays under its own."""
        return f"g{self.version + 1:06d}-{uuid.uuid4().hex[:8]}"

    def merge(self) -> PageIndex:
        """The index with all generations folded into one; the files of the old ones stay until they are removed by hand, for readers that have them open."""
        if len(self.generations) < 2:
            return self
        generation = self._generation()
        for table in ("pages", "seams", *["breaks"] * (self.q > 1)):
            self._write(getattr(self, table)(), table, generation)
        self.books().write.parquet(f"{self.path}/books/{generation}")
        rows = self._read("postings", f"book_id {self.kind}, {ROWS}", "bucket")
        ranges = F.sort_array(F.collect_list(F.struct("first", "pages"))).alias("parts")
        # a row holds the postings of one gram on MERGED pages at most; rows are dealt once, as they are filed
        parts, of, spread = self._spread()
        dealt = rows.select("*", of, spread).repartition(parts, "bucket", "spread")
        folded = dealt.groupBy("bucket", "spread", "book_id", "kind", "gram", "of").agg(F.sum("n").alias("n"), ranges).select("bucket", "book_id", "kind", "gram", "n", "parts")
        self._write(folded.mapInArrow(_folded, f"bucket int, book_id {self.kind}, {ROWS}"), "postings", generation, "bucket")
        return self._commit((generation,))


MANIFEST = "generation string, q int, seam_len int, buckets int, kind string, page_kind string, batch bigint, format int"
#: Columns of postings and of breaks after the book.
ROWS, BREAKS = "kind tinyint, gram string, first int, n bigint, pages binary", "kind tinyint, idx int, base int, low int, high int, text string"


def _crossings(ends: DataFrame, new: DataFrame, q: int) -> DataFrame:
    """Texts whose grams go over page breaks: the last q - 1 characters of a page and the first of what follows it in the book."""
    own = F.least(F.col("len"), F.lit(q - 1))
    # of a page, no more than its grams over the break need
    cut = lambda df, had: df.select("book_id", "idx", F.left("text", F.lit(q)).alias("head"), F.right("text", F.lit(q - 1)).alias("tail"), "len", had.alias("had"))
    rows = cut(ends, (F.col("stop") - F.col("start") - F.col("len") + own).cast("int")).unionByName(cut(new, F.lit(0)))
    # of q pages, were they all empty, the blanks between them are enough
    heads = rows.select("book_id", F.col("idx").alias("of"), "head", F.explode(F.sequence(F.lit(1), F.lit(q))).alias("k"))
    after = heads.groupBy("book_id", (F.col("of") - F.col("k")).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("k", "head"))).alias("heads"))
    after = after.where(F.get("heads", F.lit(0))["k"] == 1).select("book_id", "idx", F.left(F.array_join(F.transform("heads", lambda h: h["head"]), " "), F.lit(q - 1)).alias("after"))
    text = F.concat("tail", F.lit(" "), F.col("after"))
    # of a page that was there before, what did not yet have all its characters
    low = F.greatest(F.lit(0), F.when(F.col("had") > 0, F.col("had") - q + 1).otherwise(0))
    return rows.join(after, ["book_id", "idx"]).select("book_id", F.lit(CROSS).cast("tinyint").alias("kind"), "idx", (F.col("len") - own).alias("base"), low.alias("low"), (own + 1).alias("high"), text.alias("text"))


def create_index(spark: SparkSession, path: str | None = None, q: int = 4, seam_len: int = 512, buckets: int = 64, kind: str = "string", page_kind: str = "int") -> PageIndex:
    """A new index without pages; ``kind`` and ``page_kind`` are the types of book ids and pages."""
    path = path or shared_path(spark, "page-index")
    return PageIndex(spark, path, 0, (), q, seam_len, buckets, kind, page_kind)._commit(())


def open_index(spark: SparkSession, path: str) -> PageIndex:
    """The index at ``path`` as its last complete addition or merge left it."""
    rows = spark.read.schema(MANIFEST + ", version int").parquet(f"{path}/manifest")
    last = rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").orderBy("generation").collect()  # a row for each generation
    r = last[0]
    if r.generation and r.format != FORMAT:
        raise ValueError(f"the index at {path} was written in another form; its pages must be added to a new one")
    return PageIndex(spark, path, r.version, tuple(x.generation for x in last if x.generation), r.q, r.seam_len, r.buckets, r.kind, r.page_kind, r.batch)


@dataclass(frozen=True)
class PassingPages:
    """Pages that are searched once: what a search asks of an index, told by passes over their texts.

    Of the grams, nothing is kept but sums and the places of those that are asked for.
    """

    book: DataFrame
    ends: DataFrame
    texts: DataFrame
    q: int
    seam_len: int
    page_kind: str

    def pages(self) -> DataFrame:
        """(book_id, idx, page, text, start, len) of all pages, normalised."""
        return self.book

    def seams(self) -> DataFrame:
        """(book_id, idx, page, text) of all seams."""
        return self.ends

    def counts(self, grams: DataFrame, kinds: dict[str, tuple[int, ...]]) -> DataFrame:
        """The rows of ``PageIndex.counts``."""
        return _summed(counted(self.texts, grams, self.q), kinds)

    def postings(self, grams: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
        """The rows of ``PageIndex.postings``."""
        return places(self.texts.where(F.col("kind").isin(*kinds)), grams, self.q)


def passing_pages(pages: DataFrame, policy: MatchPolicy) -> PassingPages:
    """What a single search needs of ``pages`` (book_id, page, text): they, their seams and breaks are written once."""
    book = S.normalised_pages(pages).select("book_id", "idx", "page", "text", F.col("start").cast("bigint").alias("start"), "len")
    seams = saved(S.create_seams(book, policy.seam_len), "seams")
    texts = S.whole_texts(book, PAGE).unionByName(S.whole_texts(seams, SEAM))
    if policy.q > 1:
        none = book.limit(0).withColumn("stop", F.lit(0))
        texts = texts.unionByName(saved(_crossings(none, book, policy.q), "crossings"))
    return PassingPages(book, seams, texts, policy.q, policy.seam_len, pages.schema["page"].dataType.simpleString())


@dataclass(frozen=True)
class Asked:
    """Patterns of a search: their texts once each (key, pattern, size), and (book_id, key, gram, offset, exact, near), how often each book has their grams."""

    texts: DataFrame
    grams: DataFrame


def ask(index: PageIndex | PassingPages, patterns: DataFrame) -> Asked:
    """What an index knows of patterns (book_id, pattern); a pattern of many books is cut into grams once."""
    keyed = patterns.select("book_id", F.xxhash64("pattern").alias("key"), "pattern")
    texts = saved(keyed.groupBy("key").agg(F.first("pattern").alias("pattern")).withColumn("size", F.length("pattern")), "pattern-texts")
    each = texts.where(F.col("size") >= index.q).select("key", F.posexplode(S.grams_of(F.col("pattern"), index.q)).alias("offset", "gram"))
    each = saved(each.groupBy("key", "gram").agg(F.min("offset").alias("offset")), "pattern-grams")
    counts = index.counts(each, {"exact": (PAGE, CROSS), "near": (PAGE, SEAM)})
    rows = keyed.select("book_id", "key").distinct().join(each, "key").join(counts, ["book_id", "gram"], "left")
    return Asked(texts, saved(rows.select("book_id", "key", "gram", "offset", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("exact", "near"))), "gram-counts"))


def exact_hits(index: PageIndex | PassingPages, patterns: DataFrame, asked: Asked | None = None) -> DataFrame:
    """(book_id, pattern, idx, page): each page on which a pattern (book_id, pattern) begins; empty patterns are nowhere.

    A pattern is compared with the text at the places of its rarest gram, of which a
    book that lacks one of the grams has none; a pattern that is shorter than a gram is
    looked for on all pages.
    """
    asked = asked or ask(index, patterns)
    rare = asked.grams.groupBy("book_id", "key").agg(F.min(F.struct("exact", "offset", "gram")).alias("o")).where("o.exact > 0")
    rare = saved(rare.select("book_id", F.col("o.gram").alias("gram"), "key", F.col("o.offset").alias("offset")), "anchors")
    at = index.postings(rare, (PAGE, CROSS)).select("book_id", "idx", "key", (F.col("pos") - F.col("offset")).alias("at"))
    book = index.pages().withColumnRenamed("page", "name")
    found = S.confirmed(book, saved(at, "anchor-places"), asked.texts)
    short = patterns.where((F.length("pattern") > 0) & (F.length("pattern") < index.q))
    if short.limit(1).count():
        found = found.unionByName(S.exact_hits(index.pages(), short))
    return found


def near_hits(index: PageIndex | PassingPages, open_: DataFrame, asked: Asked, policy: MatchPolicy) -> DataFrame:
    """Verified candidates of the patterns in ``open_`` (book_id, pattern)."""
    rank = F.row_number().over(W.partitionBy("book_id", "key").orderBy("near", "offset"))
    wanted = open_.select("book_id", F.xxhash64("pattern").alias("key"))
    seeds = asked.grams.where("near > 0").join(wanted, ["book_id", "key"], "left_semi").withColumn("seed", rank).where(F.col("seed") <= max(1, policy.grams_per_excerpt))
    seeds = saved(seeds.join(asked.texts.select("key", "size"), "key").select("book_id", "gram", F.col("key").alias("pattern"), "offset", "size", "seed"), "seeds")
    postings = index.postings(seeds, (PAGE, SEAM)).withColumn("seam", F.col("kind") == SEAM).drop("kind")
    near = saved(S.ranked_places(postings, policy), "candidates")
    book = index.pages()
    near = near.withColumnRenamed("pattern", "key").join(asked.texts.select("key", "pattern"), "key").drop("key").join(book.select("book_id", "idx", "page"), ["book_id", "idx"])
    return S.verified(near, book, index.seams(), policy)


def _checked(index: PageIndex | PassingPages, policy: MatchPolicy) -> None:
    if policy.enable_fuzzy and (policy.q, policy.seam_len) != (index.q, index.seam_len):
        raise ValueError(f"the index has grams of {index.q} and seams of {index.seam_len} characters, the policy asks for {policy.q} and {policy.seam_len}")


def search_index(index: PageIndex | PassingPages, excerpts: DataFrame, policy: MatchPolicy = DEFAULT_POLICY) -> DataFrame:
    """(book_id, excerpt_id, page): the rows of ``find_matches`` for the pages of an index."""
    _checked(index, policy)
    patterns = saved(S.deduplicate_excerpts(excerpts), "excerpts")
    asked = ask(index, patterns)
    return S.best_pages(patterns, exact_hits(index, patterns, asked), lambda open_: near_hits(index, open_, asked, policy), policy)


def search_index_all(index: PageIndex | PassingPages, excerpts: DataFrame, policy: MatchPolicy = DEFAULT_POLICY) -> DataFrame:
    """(book_id, excerpt_id, pages): the rows of ``find_matches_all`` for the pages of an index."""
    _checked(index, policy)
    patterns = saved(S.deduplicate_excerpts(excerpts), "excerpts")
    asked = ask(index, patterns)
    return S.all_pages(patterns, exact_hits(index, patterns, asked), lambda open_: near_hits(index, open_, asked, policy), policy, index.page_kind)
