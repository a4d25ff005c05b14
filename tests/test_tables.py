"""Operators on tables: footnotes, page search, streams, and the driver contract."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from warraq.functions.sanitize import sanitize
from warraq.operators import footnotes, search
from warraq.plans.queries import Q
from warraq.streaming.lines import clean_lines, search_stream

LINES = "doc_id string, line_no int, text string, is_footnote boolean, extra int"


def corrected(spark, *lines):
    rows = [("d", i, text, note, 7) for i, (text, note) in enumerate(lines)]
    out = footnotes.correct_references(spark.createDataFrame(rows, LINES))
    assert out.columns == ["doc_id", "line_no", "text", "is_footnote", "extra"]
    return [r.text for r in out.orderBy("line_no").collect()]


def test_footnotes(spark):
    assert corrected(spark, ("Abcd (١) (٢) (٣)", False), ("() A", True), ("(٢) B", True), ("() C", True)) == ["Abcd (١) (٢) (٣)", "(١) A", "(٢) B", "(٣) C"]
    assert corrected(spark, ("a (O) b", None), ("(٥) x", True)) == ["a (٥) b", "(٥) x"]
    assert corrected(spark, ("a (١)", None), ("(١) x", True)) == ["a (١)", "(١) x"]
    assert corrected(spark, ("a () ()", None), ("() x", True)) == ["a (١) (٢)", "(٣) x"]
    assert corrected(spark, ("a ()", None), ("(٤) x", True), ("() y", True)) == ["a (٤)", "(٤) x", "(٥) y"]
    assert corrected(spark, (None, None), ("", True)) == [None, ""]


def following(pages, p, need):
    out, q = "", p + 1
    while need > 0 and q < len(pages) and pages[q]:
        add = pages[q][:need]
        out, need, q = out + " " + add, need - len(add), q + 1
    return out


def preceding(pages, p, need):
    bits, q = [], p - 1
    while need > 0 and q >= 0 and pages[q]:
        bits.insert(0, pages[q][-need:])
        need, q = need - len(bits[0]), q - 1
    return " ".join(bits) + " " if bits else ""


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def model(pages, excerpt):
    """Best page and all pages of one excerpt, by plain loops over normalised texts."""
    if not excerpt:
        return None, []
    book, starts, at = " ".join(pages), [], 0
    for p in pages:
        starts.append(at)
        at += len(p) + 1
    exact = sorted({max(i for i, s in enumerate(starts) if s <= k) for k in range(len(book)) if book.startswith(excerpt, k)})
    if exact:
        return exact[0], exact
    q, n = 4, len(excerpt)
    if n < q:
        return None, []
    seams = [pages[i][-512:] + " " + pages[i + 1][:512] for i in range(len(pages) - 1)]
    posts = {}
    for seam, texts in ((False, pages), (True, seams)):
        for i, t in enumerate(texts):
            for k in range(len(t) - q + 1):
                posts.setdefault(t[k : k + q], []).append((i, k, seam))
    grams = {}
    for k in range(n - q + 1):
        grams.setdefault(excerpt[k : k + q], k)
    seeds = sorted((len(posts[g]), k, g) for g, k in grams.items() if g in posts)[:5]
    places = []
    for _, k, g in seeds:
        for i, pos, seam in posts[g]:
            if pos - k >= -(n // 4) and (c := (i, max(0, pos - k), seam)) not in places:
                places.append(c)
    ceil = lambda x: -int(-x // 1)
    most = max(3, ceil(0.1 * n))
    extra = min(most, max(6, ceil(n * 0.12)))
    best, hits = None, {}
    for i, start, seam in places[:40]:
        base = seams[i] if seam else pages[i]
        b, want = start - extra // 2, n + extra
        end, begin = not seam and b + want > len(base), not seam and b < 0

        def window(tail, head):
            if seam:
                return base[max(0, b) : max(0, b) + want]
            w = preceding(pages, i, max(0, -b - head)) if b < 0 else ""
            s = max(0, b)
            w += base[s : max(s, min(len(base) - tail, s + want - len(w)))]
            return w + following(pages, i, want - len(w))

        windows = [window(0, 0)]
        if end and (cut := min(200, max(0, len(base) - max(0, b)))) > 0:
            windows.append(window(cut, 0))
        if begin:
            windows.append(window(0, min(200, -b)))
        accept = most + (min(80, ceil(n * 0.08)) if end or begin or seam else min(2, max(1, ceil(n * 0.005))))
        dist = min([edits(excerpt, w) for w in windows if w], default=accept + 1)
        if dist > accept:
            continue
        if best is None or best[0] != 0 and (dist, i) < best:
            best = (dist, i)
        score = 1 - dist / accept
        if i not in hits or score > hits[i][0]:
            hits[i] = (score, seam)
    for i in sorted(hits):
        if i in hits and i + 1 in hits and hits[i][1] and hits[i + 1][1]:
            del hits[i if hits[i + 1][0] > hits[i][0] else i + 1]
    for i in [i for i in hits if hits[i][1]]:
        if i + 1 in hits and not hits[i + 1][1] and hits[i + 1][0] >= hits[i][0]:
            del hits[i]
    return (best[1] if best else None), sorted(hits, key=lambda i: (-hits[i][0], i))


def test_page_search_agrees_with_a_plain_model(spark):
    r = random.Random(11)
    words = ["كتاب", "علم", "النحو", "باب", "الفاعل", "والصرف", "بيان", "قول", "الله", "تعالى", "في", "من"]
    pages, excerpts = {}, {}
    for b in ("x", "y", "z"):
        pages[b] = [" ".join(r.choices(words, k=r.choice([0, 3, 12, 25]))) for _ in range(9)]
        whole = " ".join(pages[b])
        some = ["", "اب", "لا شيء هنا"]
        for _ in range(14):
            k, n = r.randrange(len(whole) - 60), r.randint(12, 60)
            t = list(whole[k : k + n].strip())
            for _ in range(r.choice([0, 1, 3, 5])):
                t[r.randrange(len(t))] = r.choice("ابتثنم ")
            some.append(" ".join("".join(t).split()))
        excerpts[b] = [*some, some[3]]
    df = spark.createDataFrame([(b, i, t) for b, ts in pages.items() for i, t in enumerate(ts)], "book_id string, page int, text string")
    ex = spark.createDataFrame([(b, i, t) for b, ts in excerpts.items() for i, t in enumerate(ts)], "book_id string, excerpt_id int, text string")
    clean = {(x.book_id, x.excerpt_id): x.t for x in ex.select("book_id", "excerpt_id", sanitize("text", "aggressive").alias("t")).collect()}
    normal = {}
    for x in df.select("book_id", "page", sanitize("text", "aggressive").alias("t")).orderBy("page").collect():
        normal.setdefault(x.book_id, []).append(x.t)
    best = {(x.book_id, x.excerpt_id): x.page for x in search.find_matches(df, ex).collect()}
    every = {(x.book_id, x.excerpt_id): x.pages for x in search.find_matches_all(df, ex).collect()}
    want = {k: model(normal[k[0]], t) for k, t in clean.items()}
    assert best == {k: w[0] for k, w in want.items()}
    assert every == {k: w[1] for k, w in want.items()}
    only = search.find_matches(df, ex, search.MatchPolicy(enable_fuzzy=False)).collect()
    assert {(x.book_id, x.excerpt_id): x.page for x in only if x.page is not None}.items() <= best.items()


def test_exact_search_by_leading_grams(spark):
    pages = spark.createDataFrame([("b", i, t) for i, t in enumerate(["abcab", "cab", "", "abc"])], "book_id string, page int, text string").withColumn("idx", F.col("page"))
    patterns = spark.createDataFrame([("b", p) for p in ("ab", "abcab cab", "b cab", "c", "cab  abc", "zz", "")], "book_id string, pattern string")
    assert {(r.pattern, r.page) for r in search.exact_hits(pages, patterns).collect()} == {("ab", 0), ("ab", 1), ("ab", 3), ("abcab cab", 0), ("b cab", 0), ("c", 0), ("c", 1), ("c", 3), ("cab  abc", 1)}


def test_streams(spark, tmp_path):
    spark.createDataFrame([("هذا نصٌّ عربي",), ("---",), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = clean_lines(stream).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert [r.text for r in spark.table("cleaned").collect()] == ["هذا نص عربي"]
    spark.createDataFrame([("b", 1, "نص عربي")], "book_id string, excerpt_id int, text string").write.parquet(str(tmp_path / "ex"))
    pages = spark.createDataFrame([("b", 5, "هذا نص عربي")], "book_id string, page int, text string")
    found = []
    query = search_stream(spark.readStream.schema("book_id string, excerpt_id int, text string").parquet(str(tmp_path / "ex")), pages, lambda df, _: found.extend(df.collect())).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in found] == [("b", 1, 5)]


def test_confused_references_of_texts(spark, tmp_path):
    """Latin texts have references of their own; the query agrees with its SQL on them, the operator converts all that are confused."""
    texts = ["see (1) and (9)", "(1.9) (.) ()", "a (1O) b (V.9)", "(OV) (1)(9)", "", "(1", "x (11)"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    query, sql = next((q, s) for n, q, s in Q if n == "convert_confused")
    want = duckdb.sql(sql.replace("from documents", f"from '{path}/*.parquet'")).fetchall()
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(want)
    one = spark.createDataFrame([("(1) (9.O)",)], "x string").select(footnotes.convert_confused(F.col("x"))).first()[0]
    assert one == "(١) (٩٠٥)"


SMALL = ["sanitize_search", "sanitize_tatweel_safe", "noise_flag", "quote_balance", "standardize_hijri", "convert_confused", "edit_distance", "dedupe_excerpts", "build_book", "pos_to_page", "create_seams", "exact_page_search_all", "fuzzy_page_search_all", "noise_parts", "unbalanced_errors", "bracket_balance", "reference_repair", "needs_correction", "sanitize_factory", "segment_alignment", "segment_lines", "pattern_counts", "sanitize_batch", "similar_after_normalization"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_agree_with_sql(spark, name):
    query, sql = next((q, s) for n, q, s in Q if n == name)
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "part", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = query(spark, folder)
    names = sorted(df.columns)
    want = con.sql(sql).project(", ".join(f'"{n}"' for n in names)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))


def test_pattern_occurrences(spark):
    texts = spark.createDataFrame([(0, "aaaa"), (1, "test"), (2, ""), (3, "the quick brown fox jumps")], "text_id int, text string")
    patterns = spark.createDataFrame([(0, ""), (1, "aa"), (2, "test"), (3, "quick brown fox"), (4, "x"), (5, "quick brown cat")], "pattern_id int, pattern string")
    got = sorted(map(tuple, search.pattern_occurrences(texts, patterns).collect()))
    want = sorted((t.text_id, p.pattern_id, k + len(p.pattern)) for t in texts.collect() for p in patterns.collect() if p.pattern for k in range(len(t.text)) if t.text.startswith(p.pattern, k))
    assert got == want and search.pattern_occurrences(texts, patterns.limit(0)).collect() == []


def test_candidates_keep_their_order_and_bound(spark):
    pages = spark.createDataFrame([("b", i, "باب الفاعل في النحو") for i in range(30)], "book_id string, page int, text string")
    book = search.normalised_pages(pages)
    excerpts = spark.createDataFrame([("b", 0, "باب الفاعل في النهو")], "book_id string, excerpt_id int, text string")
    grams = search.excerpt_grams(search.deduplicate_excerpts(excerpts))
    postings = search.qgram_postings(book, search.create_seams(book))
    seeds = search.pick_rare(grams, postings, 5)
    rows = search.candidates(seeds, postings, search.MatchPolicy(max_candidates_per_excerpt=7)).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 8)) and seeds.count() == 5


def plain_repair(lines):
    """Both queues as lists, line by line."""
    found = lambda t, note: re.findall(r"\([٠-٩]+\)", t)[: 1 if note else None] if not note or re.match(r"\([٠-٩]+\)", t) else []
    body, foot = ([*dict.fromkeys(x for t, n in lines if n == side for x in found(t, n))] for side in (False, True))
    queues = {True: [x for x in body if x not in foot], False: [x for x in foot if x not in body]}
    number = max([int(x[1:-1].translate(str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789"))) for x in body + foot], default=0)
    out = []
    for text, note in lines:
        while "()" in text:
            if queues[note]:
                fill = queues[note].pop(0)
            else:
                number += 1
                fill = "(" + str(number).translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) + ")"
            text = text.replace("()", fill, 1)
        out.append(text)
    return out


def test_footnotes_of_a_long_document(spark):
    """One document of many lines, of which each range holds some; another one whose id is null."""
    r = random.Random(6)
    reference = lambda: "(" + str(r.randint(1, 9000)).translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) + ")"
    lines = []
    for _ in range(6000):
        note = r.random() < 0.4
        marks = [r.choice(["()", "", reference()]) for _ in range(1 if note else r.randint(0, 3))]
        lines.append((" ".join([*marks, "x"]) if note else " ".join(["x", *marks]), note))
    short = [("a () ()", False), ("() y", True)]
    df = spark.createDataFrame([("d", i, t, n, 7) for i, (t, n) in enumerate(lines)] + [(None, i, t, n, 7) for i, (t, n) in enumerate(short)], LINES).repartition(5)
    out = footnotes.correct_references(df).orderBy("line_no").collect()
    assert [x.text for x in out if x.doc_id == "d"] == plain_repair(lines)
    assert [x.text for x in out if x.doc_id is None] == plain_repair(short)


def test_positions_of_pages(spark):
    """Positions before the first start, on starts, between and beyond; of no book and of none at all; columns of clashing names."""
    book = spark.createDataFrame([("b", p, s) for p, s in ((7, 0), (8, 5), (9, 10), (10, 10_000))] + [("c", 1, 3)], "book_id string, page int, start bigint")
    want = {("b", -4): 7, ("b", 0): 7, ("b", 4): 7, ("b", 5): 8, ("b", 9999): 9, ("b", 10_000): 10, ("b", 1 << 40): 10, ("c", 0): 1, ("c", 3): 1, ("x", 3): None, (None, 3): None, ("b", None): None}
    asked = spark.createDataFrame([(b, p, 1) for b, p in want] + [("b", 5, 2)], "book_id string, pos bigint, asked int")
    got = search.pos_to_page(asked, book).collect()
    assert {(r.book_id, r.pos): r.page for r in got} == want and len(got) == len(want) + 1
    assert search.pos_to_page(asked.limit(0), book).collect() == []
