"""Search of excerpts in the pages of books, exact first, then approximate.

Books are tables of pages, excerpts are rows; both carry the book they belong to.
Texts are normalised aggressively on both sides.

Exact hits: an excerpt stands on the page where it begins, and may go on over the
following pages. The places of its rarest gram are compared with the excerpt, page by
page. Approximate hits: rare grams of an excerpt give their places on pages and page
breaks; each place gives a window of about the excerpt's length, and the edit distance
between the two decides. The grams' places come from a ``page_index``; ``exact_hits`` does
without one and starts from each pattern's rarest word.

No step needs a book in one task: pages are numbered by ranges, and neighbours are
found by the stretches of the book's characters that they lie on. Lists that come
from the excerpts are saved first, so that Spark knows their size: it broadcasts
those below its threshold and shuffles larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import bounded_levenshtein, within_reach
from ..functions.normal import clean_length, normalised
from ..functions.sanitize import sanitize
from ..plans.policy import DEFAULT_POLICY, SEAM_BONUS, SEAM_GAP, MatchPolicy
from ..sources.shared import kept, passing, saved
from .automaton import occurrences
from .grams import counted
from .ranges import ranged

#: Leading characters by which patterns that begin with a blank are found.
LEAD = 12
#: Characters of a stretch by which neighbouring pages meet.
STRETCH = 4096


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _counted(names: list[str], clean: bool):
    """Rows in the order of their book with the number and the characters of those before them in the batch's range; ``clean`` normalises the texts."""

    def run(batches):
        book, idx, start = (), 0, 0
        for batch in batches:
            columns = {name: batch.column(name) for name in names}
            if clean:
                columns["text"] = pa.array(normalised(columns["text"].to_pylist(), "aggressive"), pa.string())
            size = columns["len"] if "len" in columns else pc.utf8_length(columns["text"])
            at, begin = [], []
            for own, n in zip(columns["book_id"].to_pylist(), size.to_pylist(), strict=True):
                if (own,) != book:
                    book, idx, start = (own,), 0, 0
                at.append(idx)
                begin.append(start)
                idx += 1
                start += 0 if n is None else n + 1
            added = {"len": size.cast(pa.int32()), "idx_in": pa.array(at, pa.int64()), "start_in": pa.array(begin, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | added)

    return run


def _running(rows: DataFrame, clean: bool = False) -> DataFrame:
    """``rows`` (book_id, page, and text or len, ...) with ``len``, their number ``idx`` in their book and its characters before them, ``start``, with a blank after each page; ``clean`` normalises the texts first.

    The rows are dealt by ranges, once, and numbered where they are; only one row for
    each range and book is summed in the order of the ranges.
    """
    # a number that is given is kept, so that few long texts still make many tasks
    dealt = rows.repartitionByRange(_partitions(rows), "book_id", "page").sortWithinPartitions("book_id", "page").withColumn("part", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields} | {"len": "int", "idx_in": "bigint", "start_in": "bigint"}
    parts = saved(dealt.mapInArrow(_counted(dealt.columns, clean), ", ".join(f"`{k}` {v}" for k, v in kinds.items())), "page-ranges")
    order = W.partitionBy("book_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = parts.groupBy("book_id", "part").agg(F.count("*").alias("idx"), F.coalesce(F.sum(F.col("len") + 1), F.lit(0)).alias("start"))
    sums = saved(sums.select("book_id", "part", *(F.coalesce(F.sum(k).over(order), F.lit(0)).alias(f"{k}_before") for k in ("idx", "start"))), "page-sums")
    own = [c for c in rows.columns if c not in ("idx", "start", "len")]
    return parts.join(sums, ["book_id", "part"]).select(*own, "len", *((F.col(f"{k}_before") + F.col(f"{k}_in")).alias(k) for k in ("idx", "start")))


def normalised_pages(pages: DataFrame) -> DataFrame:
    """(book_id, page, text, idx, start, len): normalised pages numbered from 0 in the order of ``page`` within each book, with their start and length in it."""
    return _running(pages.select("book_id", "page", "text"), clean=True).select("book_id", "page", "text", F.col("idx").cast("int").alias("idx"), "start", "len")


def page_starts(pages: DataFrame) -> DataFrame:
    """(book_id, page, len, start) of the normalised pages; of a text only its length is moved."""
    sizes = saved(pages.select("book_id", "page", clean_length("text").alias("len")), "page-sizes")
    return _running(sizes).select("book_id", "page", "len", "start")


def deduplicate_excerpts(excerpts: DataFrame) -> DataFrame:
    """(book_id, pattern, excerpt_ids): excerpts of a book that are equal once normalised, their ids in order."""
    rows = excerpts.select("book_id", "excerpt_id", sanitize("text", "aggressive").alias("pattern"))
    return rows.groupBy("book_id", "pattern").agg(F.array_sort(F.collect_list("excerpt_id")).alias("excerpt_ids"))


def build_book(pages: DataFrame) -> DataFrame:
    """Pages (book_id, page, text) with the length and the start of each in the book that joins them by one blank."""
    return _running(pages.drop("idx", "start", "len")).drop("idx")


def pos_to_page(positions: DataFrame, book: DataFrame) -> DataFrame:
    """``positions`` (book_id, pos) with the page of the greatest start that is not after ``pos``; before the first start its page, null where there is no book.

    Starts and positions are put in one order and dealt by its ranges; the last start
    of a range is carried on, so that a book is on as many tasks as it has ranges.
    """
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in positions.schema.fields) + ">"
    starts = book.where("book_id is not null").select("book_id", F.col("start").cast("bigint").alias("pos"), F.col("page").alias("found"), F.lit(None).cast(kind).alias("row"), F.lit(0).alias("asked"))
    asked = positions.where("book_id is not null and pos is not null").select("book_id", F.col("pos").cast("bigint").alias("pos"), F.lit(None).cast(book.schema["page"].dataType).alias("found"), F.struct("*").alias("row"), F.lit(1).alias("asked"))
    first = book.groupBy("book_id").agg(F.min_by("page", "start").alias("first"))
    # the page itself may be null, so that what is carried is a struct
    hit = ranged(starts.unionByName(asked), ["book_id"], ["pos", "asked"], "positions").along(lasts={"hit": F.when(F.col("asked") == 0, F.struct("found"))}, facts=first)
    told = hit.where("asked = 1").select("row.*", F.when(F.col("hit").isNull(), F.col("first")).otherwise(F.col("hit.found")).alias("page"))
    nowhere = positions.where("book_id is null or pos is null").withColumn("page", F.lit(None).cast(book.schema["page"].dataType))
    return told.unionByName(nowhere)


def create_seams(book: DataFrame, seam_len: int = 512) -> DataFrame:
    """(book_id, idx, page, text): the end of each page and the beginning of the next, joined by a blank."""
    following = book.select("book_id", (F.col("idx") - 1).alias("idx"), F.left("text", F.lit(seam_len)).alias("b"))
    ends = book.select("book_id", "idx", "page", F.right("text", F.lit(seam_len)).alias("a"))
    return ends.join(following, ["book_id", "idx"]).select("book_id", "idx", "page", F.concat_ws(" ", "a", "b").alias("text"))


def grams_of(text: Column, size: int) -> Column:
    """array<string>: the gram of ``size`` characters at each place; empty for a shorter text."""
    # a gram is put together of characters, each of which is found at once
    joined = F.transform(F.array(F.split(text, "")), lambda c: F.transform(F.sequence(F.lit(0), F.length(text) - size), lambda i: F.concat(*(F.get(c, i + k) for k in range(size)))))[0]
    return F.when(F.length(text) >= size, joined).otherwise(F.array().cast("array<string>"))


def qgram_postings(book: DataFrame, seams: DataFrame, q: int = 4) -> DataFrame:
    """(book_id, gram, page, idx, pos, seam): every place of every gram on pages and seams."""
    texts = book.select("book_id", "idx", "page", "text", F.lit(False).alias("seam")).unionByName(seams.select("book_id", "idx", "page", "text", F.lit(True).alias("seam")))
    return texts.select("book_id", "idx", "page", "seam", F.posexplode(grams_of(F.col("text"), q)).alias("pos", "gram"))


def excerpt_grams(patterns: DataFrame, q: int = 4) -> DataFrame:
    """(book_id, pattern, gram, offset): the grams of each pattern at their first places."""
    each = patterns.where(F.length("pattern") >= q).select("book_id", "pattern", F.posexplode(grams_of(F.col("pattern"), q)).alias("offset", "gram"))
    return each.groupBy("book_id", "pattern", "gram").agg(F.min("offset").alias("offset"))


def whole_texts(df: DataFrame, kind: int) -> DataFrame:
    """(book_id, kind, idx, base, low, high, text): rows for ``grams`` of texts with all their places."""
    none = F.lit(0)
    return df.select("book_id", F.lit(kind).cast("tinyint").alias("kind"), "idx", none.alias("base"), none.alias("low"), F.length("text").alias("high"), "text")


def gram_counts(book: DataFrame, seams: DataFrame, wanted: DataFrame, q: int = 4) -> DataFrame:
    """(book_id, gram, freq): how often pages and seams have each of ``wanted`` (book_id, gram), of those that they have."""
    wanted = saved(wanted.select("book_id", "gram").distinct(), "wanted-grams")
    rows = counted(whole_texts(book, 0).unionByName(whole_texts(seams, 1)), wanted, q)
    return rows.groupBy("book_id", "gram").agg(F.sum("freq").alias("freq")).join(wanted, ["book_id", "gram"], "left_semi")


def pick_rare(grams: DataFrame, postings: DataFrame, k: int = 5) -> DataFrame:
    """(book_id, pattern, gram, offset, seed): the ``k`` rarest grams of each pattern that the book has, the rarest first; ``postings`` may be counts (book_id, gram, freq)."""
    freq = postings if "freq" in postings.columns else postings.groupBy("book_id", "gram").agg(F.count("*").alias("freq"))
    rank = F.row_number().over(W.partitionBy("book_id", "pattern").orderBy("freq", "offset"))
    return grams.join(freq, ["book_id", "gram"]).withColumn("seed", rank).where(F.col("seed") <= max(1, k)).drop("freq")


def _stretches(first: Column, last: Column) -> Column:
    """Numbers of the stretches that the characters from ``first`` to ``last`` lie on."""
    return F.sequence(F.floor(first / STRETCH), F.floor(F.greatest(first, last) / STRETCH))


def _rarest_words(patterns: DataFrame, words: DataFrame, key: list[str], own: list[str]) -> DataFrame:
    """(own, pattern, word, offset): of each pattern the inner word that the texts hold least often, or null for one without.

    ``words`` are (key, word) of all places; inner words stand between blanks.
    """
    parts = F.split("pattern", " ")
    # the place of a word is the length of what stands before it
    inner = F.filter(F.transform(parts, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda s: (s["i"] > 0) & (s["i"] < F.size(parts) - 1) & (s["word"] != ""))
    each = patterns.select(*own, "pattern", F.explode(inner).alias("s")).select(*own, "pattern", F.col("s.word").alias("word"), (F.length(F.array_join(F.slice(F.split("pattern", " "), F.lit(1), F.col("s.i")), " ")) + 1).alias("offset"))
    wanted = saved(each.select(*key, "word").distinct(), "inner-words")
    freq = words.join(wanted, [*key, "word"], "left_semi").groupBy(*key, "word").agg(F.count("*").alias("freq"))
    # a word that no text has rules its pattern out: it is the rarest
    return each.join(freq, [*key, "word"], "left").groupBy(*own, "pattern").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "word")).alias("o")).select(*own, "pattern", "o.word", "o.offset")


def _word_places(kept: list[str]):
    """Each word of texts (kept, text) with its place."""

    def run(batches):
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            rows, words, places = [], [], []
            for k, text in enumerate(batch.column(len(kept)).to_pylist()):
                at = 0
                for word in (text or "").split(" "):
                    if word:
                        rows.append(k)
                        words.append(word)
                        places.append(at)
                    at += len(word) + 1
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(kept))), pa.array(words, pa.string()), pa.array(places, pa.int32())], [*kept, "word", "pos"])

    return run


def _places(texts: DataFrame, patterns: DataFrame, key: list[str], own: list[str], row: list[str]) -> DataFrame:
    """(row, own, pattern, at): places in ``texts`` (row, text) where a pattern may begin, counted from 0; below 0 if it begins before the text.

    A pattern with an inner word is looked for where that word stands between blanks
    or the text's ends; of the others an automaton finds the first words.
    """
    placed = F.split("text", " ")
    words = texts.select(*row, F.posexplode(placed).alias("i", "word"))
    rare = saved(_rarest_words(patterns, words.select(*key, "word").where("word <> ''"), key, own), "rarest-words")
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in row)
    # words are told with their places, so that no text is moved to the patterns
    some = texts.select(*row, "text").mapInArrow(_word_places(row), f"{kinds}, word string, pos int")
    found = some.join(rare, [*key, "word"]).select(*row, *(c for c in own if c not in row), "pattern", (F.col("pos") - F.col("offset")).alias("at"))
    bare = patterns.join(rare.select(*own, "pattern"), [*own, "pattern"], "left_anti").select(*own, "pattern").distinct()
    # what goes on over the text's end is not in it, but its first word is
    first = F.substring_index("pattern", " ", 1)
    bare = bare.withColumn("head", F.when(first == "", F.left("pattern", F.lit(LEAD))).otherwise(first))
    heads = occurrences(texts, bare.select(F.col("head").alias("pattern")), row).withColumnRenamed("pattern", "head").join(bare, [*key, "head"])
    return found.unionByName(heads.select(*row, *(c for c in own if c not in row), "pattern", (F.col("end") - F.length("head")).cast("int").alias("at")))


def exact_hits(book: DataFrame, patterns: DataFrame) -> DataFrame:
    """(book_id, pattern, idx, page): each page on which a pattern begins; ``book`` is (book_id, idx, page, text), with ``start`` and ``len`` where they are known; empty patterns are nowhere.

    A pattern's part on the page of its anchor is compared first; what goes on over
    other pages is compared with each page that the pattern lies on.
    """
    if "start" not in book.columns:
        book = saved(build_book(book.withColumnRenamed("page", "name").withColumnRenamed("idx", "page")).withColumnRenamed("page", "idx"), "book")
    else:
        book = book.withColumnRenamed("page", "name")
    patterns = patterns.where(F.length("pattern") > 0).select("book_id", "pattern")
    at = _places(book, patterns, ["book_id"], ["book_id"], ["book_id", "idx"]).withColumn("key", F.xxhash64("pattern"))
    texts = saved(patterns.select(F.xxhash64("pattern").alias("key"), "pattern").distinct(), "pattern-texts")
    return confirmed(book, saved(at.select("book_id", "idx", "key", "at"), "anchor-places"), texts)


def confirmed(book: DataFrame, at: DataFrame, texts: DataFrame) -> DataFrame:
    """(book_id, pattern, idx, page): the pages on which patterns of ``texts`` (key, pattern) begin that stand at places ``at`` (book_id, idx, key, at), relative to a page that the pattern lies on; ``book`` is (book_id, idx, name, start, len, text)."""
    pages = book.select("book_id", "idx", "name", "start", F.concat("text", F.lit(" ")).alias("text"))
    size = F.length("pattern")
    # of a page from ``start`` and a pattern from ``begin``: what both hold, compared
    low, high = F.greatest(F.col("begin"), F.col("start")), F.least(F.col("begin") + size, F.col("start") + F.length("text"))
    same = F.substring(F.col("text"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int")) == F.substring(F.col("pattern"), (low - F.col("begin") + 1).cast("int"), (high - low).cast("int"))
    near = at.join(pages, ["book_id", "idx"]).join(texts, "key").withColumn("begin", F.col("start") + F.col("at")).where(same)
    whole = (F.col("at") >= 0) & (F.col("at") + size <= F.length("text"))
    near = saved(near.select("book_id", "pattern", "idx", "name", "begin", whole.alias("whole")), "near-places")
    inside = near.where("whole").select("book_id", "pattern", "idx", F.col("name").alias("page"))
    over = near.where("not whole").select("book_id", "pattern", "begin").distinct()
    over = saved(over.select("*", F.explode(_stretches(F.greatest(F.col("begin"), F.lit(0)), F.col("begin") + size - 1)).alias("stretch")), "over-breaks")
    # which pages a pattern lies on is told by numbers; only these pages' texts are brought to it
    laid = book.select("book_id", "idx", "start", (F.col("start") + F.col("len") + 1).alias("end"))
    laid = laid.select("*", F.explode(_stretches(F.col("start"), F.col("end") - 1)).alias("stretch"))
    first = F.greatest(F.col("begin"), F.col("start"))
    # pages and patterns that meet on several stretches are compared on the first
    met = over.join(laid, ["book_id", "stretch"]).where((F.least(F.col("begin") + size, F.col("end")) > first) & (F.col("stretch") == F.floor(first / STRETCH)))
    meet = met.select("book_id", "pattern", "begin", "idx").join(pages, ["book_id", "idx"])
    parts = meet.groupBy("book_id", "pattern", "begin").agg(F.min(same).alias("same"), F.sum(high - low).alias("n"), F.min(F.struct("idx", "name")).alias("o"))
    across = parts.where(F.col("same") & (F.col("n") == size)).select("book_id", "pattern", "o.idx", F.col("o.name").alias("page"))
    return inside.unionByName(across).distinct()


def pattern_occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id, end_pos): every occurrence of every pattern, overlapping ones too; ``end_pos`` is the place after it.

    ``texts`` are (text_id, text), ``patterns`` (pattern_id, pattern); empty patterns
    are nowhere. Work grows with the texts, the patterns and the occurrences.
    """
    found = occurrences(texts, patterns, ["text_id"])
    return found.join(patterns.select("pattern_id", "pattern"), "pattern").select("text_id", "pattern_id", F.col("end").alias("end_pos"))


def candidates(seeds: DataFrame, postings: DataFrame, policy: MatchPolicy) -> DataFrame:
    """(book_id, pattern, idx, page, start, seam, rank): places to verify, in the order in which seeds and postings give them."""
    rows = ranked_places(postings.drop("page").join(seeds.withColumn("size", F.length("pattern")), ["book_id", "gram"]), policy)
    return rows.join(postings.select("book_id", "idx", "page").distinct(), ["book_id", "idx"]).select("book_id", "pattern", "idx", "page", "start", "seam", "rank")


def ranked_places(rows: DataFrame, policy: MatchPolicy) -> DataFrame:
    """(book_id, pattern, idx, start, seam, rank) of seeds at their postings (book_id, pattern, size, seed, offset, idx, pos, seam); ``pattern`` may be a name, ``size`` is its length."""
    at = F.col("pos") - F.col("offset")
    rows = rows.where(at >= -F.floor(F.col("size") * 0.25)).withColumn("start", F.greatest(F.lit(0), at))
    place = ["book_id", "pattern", "idx", "start", "seam"]
    first = rows.groupBy(*place).agg(F.min(F.struct("seed", "seam", "idx", "pos")).alias("o"))
    rank = F.row_number().over(W.partitionBy("book_id", "pattern").orderBy("o"))
    return first.withColumn("rank", rank).where(F.col("rank") <= policy.max_candidates_per_excerpt).drop("o")


def _taken(texts: Column, need: Column) -> Column:
    """Lengths that are taken of texts from the nearest on until ``need`` characters are had or a text is empty."""

    def add(acc: Column, t: Column) -> Column:
        over = acc["over"] | (t == "") | (acc["left"] <= 0)
        n = F.least(acc["left"], F.length(t))
        return F.struct(F.when(over, acc["left"]).otherwise(acc["left"] - n).alias("left"), over.alias("over"), F.when(over, acc["sizes"]).otherwise(F.concat(acc["sizes"], F.array(n))).alias("sizes"))

    start = F.struct(need.cast("int").alias("left"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("sizes"))
    return F.aggregate(texts, start, add, lambda acc: acc["sizes"])


def _neighbours(book: DataFrame, asked: DataFrame) -> DataFrame:
    """(book_id, idx, ahead, back): for pages ``asked`` (book_id, idx, before, after) the texts of their neighbours, from the nearest on, that ``before`` and ``after`` characters reach.

    Characters are counted without the blanks between pages. Of a neighbour comes no
    more than is asked for.
    """
    begin, size = F.col("start") - F.col("idx"), F.col("len")
    pages = book.select("book_id", "idx", begin.alias("begin"), size.alias("size"))
    want = asked.join(pages, ["book_id", "idx"])
    low, high = F.greatest(F.col("begin") - F.col("before"), F.lit(0)), F.col("begin") + F.col("size") + F.col("after")
    want = want.select("book_id", F.col("idx").alias("at"), "before", "after", low.alias("low"), high.alias("high")).withColumn("stretch", F.explode(_stretches(F.col("low"), F.col("high"))))
    laid = pages.withColumn("stretch", F.explode(_stretches(F.col("begin"), F.col("begin") + F.col("size"))))
    meet = saved(want, "wanted-stretches").join(laid, ["book_id", "stretch"]).where((F.col("idx") != F.col("at")) & (F.col("begin") <= F.col("high")) & (F.col("begin") + F.col("size") >= F.col("low")) & (F.col("stretch") == F.floor(F.greatest("low", "begin") / STRETCH)))
    # which pages meet is told by numbers; then the texts come
    meet = saved(meet.select("book_id", "idx", "at", "before", "after"), "neighbours").join(book.select("book_id", "idx", "text"), ["book_id", "idx"])
    ahead = F.when(F.col("idx") > F.col("at"), F.struct("idx", F.expr("left(text, after)").alias("t")))
    back = F.when(F.col("idx") < F.col("at"), F.struct((-F.col("idx")).alias("idx"), F.expr("right(text, before)").alias("t")))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["t"])
    return meet.groupBy("book_id", F.col("at").alias("idx")).agg(texts(ahead).alias("ahead"), texts(back).alias("back"))


def verified(places: DataFrame, book: DataFrame, seams: DataFrame, policy: MatchPolicy) -> DataFrame:
    """``places`` whose windows are near enough, with ``dist`` and ``acceptance``; ``book`` has the pages' starts."""
    n, none = F.length("pattern"), F.lit(0)
    most = F.greatest(F.lit(policy.max_edit_abs), F.ceil(n * F.lit(policy.max_edit_rel)))
    spare = F.least(most, F.greatest(F.lit(6), F.ceil(n * 0.12)))
    texts = book.select("book_id", "idx", "text", F.lit(False).alias("seam")).unionByName(seams.select("book_id", "idx", "text", F.lit(True).alias("seam")))
    rows = places.join(texts, ["book_id", "idx", "seam"]).where(F.length("text") > 0)
    rows = rows.select("*", F.length("text").alias("size"), (n + spare).cast("int").alias("want"), (F.col("start") - F.floor(spare / 2)).cast("int").alias("begin"), most.alias("most"))
    rows = rows.select("*", (~F.col("seam") & (F.col("begin") + F.col("want") > F.col("size"))).alias("to_end"), (~F.col("seam") & (F.col("begin") < 0)).alias("from_start"))
    slack = F.least(F.lit(2), F.greatest(F.lit(1), F.ceil(n * 0.005)))
    bonus = F.least(F.lit(SEAM_BONUS), F.ceil(n * 0.08))
    rows = rows.withColumn("acceptance", (F.col("most") + F.when(F.col("to_end") | F.col("from_start") | F.col("seam"), bonus).otherwise(slack)).cast("int"))
    # of a text goes on what its window may hold
    rows = rows.withColumn("text", F.substring(F.col("text"), F.greatest(none, F.col("begin")) + 1, F.col("want")))
    # few bytes make much work here, so that the places are dealt out
    rows = saved(rows.repartition(_partitions(rows)), "places")
    # only the pages that lend something are brought together; a window asks for no more than its length
    asked = rows.where("to_end or from_start").groupBy("book_id", "idx").agg(F.max(F.when(F.col("from_start"), -F.col("begin")).otherwise(none)).alias("before"), F.max("want").alias("after"))
    asked = saved(asked, "lending-pages")
    lent = rows.where("to_end or from_start").join(_neighbours(book, asked), ["book_id", "idx"], "left")
    # a window within its text meets no neighbour, and stays where it is
    rows = rows.where("not (to_end or from_start)").unionByName(lent, allowMissingColumns=True)
    for name in ("ahead", "back"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    # the window as it is, one that leaves out the page's end and one that leaves out what lies before the page
    cut = F.least(F.lit(SEAM_GAP), F.greatest(none, F.col("size") - F.greatest(none, F.col("begin"))))
    trims = F.array(
        F.struct(none.alias("tail"), none.alias("head")),
        F.when(F.col("to_end") & (cut > 0), F.struct(cut.alias("tail"), none.alias("head"))),
        F.when(F.col("from_start"), F.struct(none.alias("tail"), F.least(F.lit(SEAM_GAP), -F.col("begin")).alias("head"))),
    )
    rows = rows.withColumn("trim", F.explode(F.filter(trims, lambda t: t.isNotNull()))).select("*", "trim.*")
    rows = rows.withColumn("need", F.when(F.col("from_start"), -F.col("begin") - F.col("head")).otherwise(none))
    rows = rows.withColumn("sizes", _taken(F.col("back"), F.col("need")))
    before = F.reverse(F.zip_with(F.slice("back", F.lit(1), F.size("sizes")), F.col("sizes"), lambda t, k: F.right(t, k)))
    rows = rows.withColumn("pre", F.when((F.col("need") > 0) & (F.size("sizes") > 0), F.concat(F.array_join(before, " "), F.lit(" "))).otherwise(""))
    rows = rows.withColumn("from", F.greatest(none, F.col("begin")))
    stop = F.least(F.col("size") - F.col("tail"), F.col("from") + F.col("want") - F.length("pre"))
    rows = rows.withColumn("window", F.concat("pre", F.substring(F.col("text"), F.lit(1), F.greatest(none, stop - F.col("from")))))
    rows = rows.withColumn("need", F.when(F.col("to_end") | F.col("from_start"), F.col("want") - F.length("window")).otherwise(none))
    rows = rows.withColumn("sizes", _taken(F.col("ahead"), F.col("need")))
    after = F.zip_with(F.slice("ahead", F.lit(1), F.size("sizes")), F.col("sizes"), lambda t, k: F.concat(F.lit(" "), F.left(t, k)))
    rows = rows.withColumn("window", F.when(F.col("need") > 0, F.concat("window", F.array_join(after, ""))).otherwise(F.col("window")))
    # most windows are too far off by the pairs of characters alone
    rows = rows.where(F.length("window") > 0).where(within_reach("pattern", "window", "acceptance"))
    near = rows.withColumn("dist", bounded_levenshtein(F.col("pattern"), F.col("window"), F.col("acceptance"))).where("dist <= acceptance")
    return near.groupBy("book_id", "pattern", "idx", "page", "start", "seam", "rank", "acceptance").agg(F.min("dist").alias("dist"))


def passing_index(pages: DataFrame, policy: MatchPolicy):
    """An index of ``pages`` (book_id, page, text) in the shared folder."""
    from .page_index import create_index

    path = passing(pages.sparkSession, "page-index")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("book_id", "page")}
    return create_index(pages.sparkSession, path, policy.q, policy.seam_len, _partitions(pages), kinds["book_id"], kinds["page"]).add(pages)


def find_matches(pages: DataFrame, excerpts: DataFrame, policy: MatchPolicy = DEFAULT_POLICY) -> DataFrame:
    """(book_id, excerpt_id, page): the best page of each excerpt, null if there is none.

    ``pages`` are (book_id, page, text), ``excerpts`` (book_id, excerpt_id, text).
    The first page with an exact occurrence, else that of the least distance, else
    none; an empty excerpt is nowhere. Pages that are searched more than once are
    better kept in a ``page_index``. The search runs when it is called.
    """
    return kept(pages.sparkSession, lambda: _matches(pages, excerpts, policy, False), "matches")


def _matches(pages: DataFrame, excerpts: DataFrame, policy: MatchPolicy, every: bool) -> DataFrame:
    from .page_index import passing_pages, search_index, search_index_all

    if policy.enable_fuzzy:
        return (search_index_all if every else search_index)(passing_pages(pages, policy), excerpts, policy)
    # what is looked for exactly and once needs no grams
    book, patterns = normalised_pages(pages), saved(deduplicate_excerpts(excerpts), "excerpts")
    exact = exact_hits(book, patterns)
    if every:
        return all_pages(patterns, exact, lambda open_: open_, policy, pages.schema["page"].dataType.simpleString())
    return best_pages(patterns, exact, lambda open_: open_, policy)


def best_pages(patterns: DataFrame, exact: DataFrame, near: Callable[[DataFrame], DataFrame], policy: MatchPolicy) -> DataFrame:
    """The rows of ``find_matches`` from exact hits, and from those of ``near`` for the patterns that have none."""
    exact = exact.groupBy("book_id", "pattern").agg(F.min(F.struct("idx", "page")).alias("o")).select("book_id", "pattern", F.col("o.page").alias("page"))
    found = exact = saved(exact, "exact-hits")
    if policy.enable_fuzzy:
        open_ = saved(patterns.select("book_id", "pattern").join(exact, ["book_id", "pattern"], "left_anti"), "open")
        # the first candidate without an edit ends the search, otherwise the first page of the least distance wins
        order = W.partitionBy("book_id", "pattern").orderBy("dist", F.when(F.col("dist") == 0, F.col("rank")).otherwise(F.col("idx")), "idx")
        best = near(open_).withColumn("k", F.row_number().over(order)).where("k = 1").select("book_id", "pattern", "page")
        found = exact.unionByName(best)
    ids = patterns.select("book_id", "pattern", F.explode("excerpt_ids").alias("excerpt_id"))
    return ids.join(found, ["book_id", "pattern"], "left").select("book_id", "excerpt_id", "page")


def collapse_seams(hits: Column) -> Column:
    """Hits (idx, seam, score, ...) by idx, of which of two neighbouring seams the weaker goes, the later on a tie; one after the other."""

    def add(kept: Column, h: Column) -> Column:
        last = F.element_at(kept, -1)
        meet = (F.size(kept) > 0) & last["seam"] & h["seam"] & (last["idx"] + 1 == h["idx"])
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(h))
        return F.when(~meet, F.concat(kept, F.array(h))).when(h["score"] > last["score"], swapped).otherwise(kept)

    return F.aggregate(hits, F.slice(hits, F.lit(1), F.lit(0)), add)


def find_matches_all(pages: DataFrame, excerpts: DataFrame, policy: MatchPolicy = DEFAULT_POLICY) -> DataFrame:
    """(book_id, excerpt_id, pages): all pages of each excerpt, exact ones in their order, else approximate ones by score; empty if there are none."""
    return kept(pages.sparkSession, lambda: _matches(pages, excerpts, policy, True), "matches")


def all_pages(patterns: DataFrame, exact: DataFrame, near: Callable[[DataFrame], DataFrame], policy: MatchPolicy, page_kind: str) -> DataFrame:
    """The rows of ``find_matches_all`` from exact hits, and from those of ``near`` for the patterns that have none."""
    exact = saved(exact, "exact-hits")
    ordered = lambda c: F.transform(F.array_sort(c), lambda s: s["page"])
    found = exact.groupBy("book_id", "pattern").agg(ordered(F.collect_list(F.struct("idx", "page"))).alias("pages"))
    if policy.enable_fuzzy:
        open_ = saved(patterns.select("book_id", "pattern").join(exact, ["book_id", "pattern"], "left_anti"), "open")
        scored = near(open_).withColumn("score", 1 - F.col("dist") / F.col("acceptance"))
        first = F.row_number().over(W.partitionBy("book_id", "pattern", "idx").orderBy(F.desc("score"), "rank"))
        best = scored.withColumn("k", first).where("k = 1")
        # at most max_candidates_per_excerpt hits
        hits = best.groupBy("book_id", "pattern").agg(F.array_sort(F.collect_list(F.struct("idx", "seam", "score", "page"))).alias("hits"))
        hits = hits.withColumn("hits", collapse_seams(F.col("hits")))
        covered = lambda h: F.exists("hits", lambda o: (o["idx"] == h["idx"] + 1) & ~o["seam"] & (o["score"] >= h["score"]))
        hits = hits.withColumn("hits", F.filter("hits", lambda h: ~(h["seam"] & covered(h))))
        ranked = F.array_sort(F.transform("hits", lambda h: F.struct((-h["score"]).alias("s"), h["idx"], h["page"])))
        found = found.unionByName(hits.select("book_id", "pattern", F.transform(ranked, lambda s: s["page"]).alias("pages")))
    ids = patterns.select("book_id", "pattern", F.explode("excerpt_ids").alias("excerpt_id"))
    none = F.array().cast(f"array<{page_kind}>")
    return ids.join(found, ["book_id", "pattern"], "left").select("book_id", "excerpt_id", F.coalesce("pages", none).alias("pages"))
