"""Fill-in-the-middle, ranked search and near vectors against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warraq.llm import lexical, middle, vectors

SCHEMA = "doc_id bigint, text string, output string, form string, n int, h1 string"


def fim(doc_id, text, rate=90, spm=20, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(n=400):
    r = random.Random(13)
    parts = ["word", "naïve", "中文", "\n", " ", "a1b", "<P", "<S", "<", ">", "S>", " ", "\x00", "😀", "Z", "'", "İ"]
    out = [None, "", " ", "x", "abc", "中", "<P>", "a <M> b", "<S", "P>", "a" * 5000, "1" * 3000, "é" * 700]
    return out + ["".join(r.choices(parts, k=r.randint(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("bound", [4 << 20, 600])
def test_fill_in_middle(spark, monkeypatch, bound):
    monkeypatch.setattr(middle, "SLICE", bound)
    rows = [(i, t, "x", "y", 1, "z") for i, t in enumerate(texts())]
    rows += [rows[8], rows[20], rows[20], (None, "null id text here", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for rate, spm, seed in ((90, 20, 1), (100, 50, 7), (0, 0, 2)):
        out = middle.fill_in_middle(docs, rate, spm, seed)
        assert Counter(map(tuple, out.collect())) == Counter(fim(r[0], r[1], rate, spm, seed) for r in rows)
    back = middle.fill_in_middle(docs).select("doc_id", middle.restored(F.col("output"), F.col("form")))
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in rows)
    assert middle.fill_in_middle(docs.limit(0)).collect() == []


def test_fill_in_middle_of_a_long_text(spark):
    """One text of 20 MiB, beside short ones, over all slices' bounds."""
    text = "some words, é " * (20 * (1 << 20) // 15)
    docs = spark.createDataFrame([(1, ""), (2, text), (3, "short text")], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in middle.fill_in_middle(docs, rate=100).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("h")).collect()}
    for i, t in ((1, ""), (2, text), (3, "short text")):
        want = fim(i, t, 100)
        assert tuple(got[i]) == (*want[:5], hashlib.sha256(want[5].encode()).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=3000), st.data())
def test_rank_and_select(bits, data):
    found = middle.RankSelect(np.asarray(bits, bool))
    at = np.asarray(data.draw(st.lists(st.integers(0, len(bits)), min_size=1, max_size=20)), np.int64)
    assert found.rank(at).tolist() == [sum(bits[:k]) for k in at]
    ones = [i for i, b in enumerate(bits) if b]
    k = np.arange(len(ones) + 3)
    assert found.select(k).tolist() == ones + [len(bits)] * 3


def ranked(rows, queries, k):
    """Brute force in whole numbers."""
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(queries):
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            scored += [(-score, i is None, i)] if score else []
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize(("shard", "block"), [(4 << 20, 256), (300, 2)])
def test_ranked_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    r = random.Random(11)
    words = ["the", "The", "naïve", "İx", "中文", "a1", "x-y", "_", "...", "\u00a0", "Zebra", *("w%d" % k for k in range(60))]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(300)]
    rows += [(1000 + i, "copy of a zebra text w1 w2") for i in range(70)] + [(2000, None), (2001, ""), (2002, "... --"), rows[5], rows[5], (None, "w3 w3 zebra"), (None, "w3 w3 zebra"), (2003, "w7 " * 9000)]
    queries = [(k, " ".join(r.choices(words, k=r.randint(1, 12)))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown terms alone"), (93, "copy zebra"), (94, "w7 w7 w7"), (95, "THE İX"), (None, "w1 w2"), (94, "w7 w7 w7"), (94, "w8")]
    docs = spark.createDataFrame([(i, t, "o", "f", 1, "h") for i, t in rows], SCHEMA).repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id bigint, text string, score int")
    for k in (1, 20):
        got = Counter(map(tuple, lexical.ranked_documents(docs, items, k).collect()))
        assert got == ranked(rows, queries, k)
    index = lexical.build_index(docs)
    again = lexical.search(index, items.where("item_id < 3"), 5)
    assert Counter(map(tuple, again.collect())) == ranked(rows, [q for q in queries if q[0] is not None and q[0] < 3], 5)
    assert lexical.ranked_documents(docs.limit(0), items).collect() == []
    assert lexical.ranked_documents(docs, items.limit(0)).collect() == []


def test_impacts_are_bounds():
    """A byte never stands for less than the exact impact, and its predecessor never for as much."""
    r = random.Random(3)
    tf = np.asarray([r.choice([1, 2, 5, 100, 10**6]) for _ in range(5000)], np.int64)
    m = np.asarray([r.choice([75, 80, 100, 1000, 10**7, 10**9]) for _ in range(5000)], np.int64)
    s = lexical.impacts(tf, m)
    u = -(-s // lexical.STEP)
    assert u.max() <= 255 and (s <= u * lexical.STEP).all() and (s > (u - 1) * lexical.STEP).all()


def test_ranked_search_of_a_long_text(spark):
    """A text of 20 MiB is a shard of its own."""
    docs = spark.createDataFrame([(1, "needle in hay"), (2, "hay " * (5 << 20) + "needle"), (3, "")], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(7, "needle hay")], "item_id int, text string")
    assert Counter(map(tuple, lexical.ranked_documents(docs, items).collect())) == ranked([(1, "needle in hay"), (2, "hay " * (5 << 20) + "needle"), (3, "")], [(7, "needle hay")], 20)


def planted_vectors(seed, dims=64):
    r = np.random.default_rng(seed)
    rows, base = [], r.standard_normal((500, dims))
    near = lambda v, c: c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * (lambda w: w / np.linalg.norm(w))(r.standard_normal(dims) - v * 0)
    for k, v in enumerate(base):
        rows.append((k, v.tolist(), k % 3))
    for k in range(0, 300, 2):  # pairs at and about the threshold
        rows.append((1000 + k, (near(base[k], r.uniform(0.97, 0.999)) * r.uniform(0.01, 90)).tolist(), k % 3))
    for k in range(120):  # a large group of near copies, and exact copies
        rows.append((2000 + k, near(base[1], 0.996).tolist(), 1))
        rows.append((3000 + k, base[4].tolist(), 1))
    rows += [(4000, base[4].tolist(), 2), (4001, base[4].tolist(), None), (4002, None, 1), (4003, [0.0] * dims, 1), (4004, [float("nan")] + [1.0] * (dims - 1), 1)]
    rows += [(4005, [None] + [1.0] * (dims - 1), 1), (4006, [float("inf")] * dims, 1), (4007, [], 1), (4008, [1.0, 2.0], 1), (4009, [2.0, 4.0], 1), (4010, (base[7] * 1e300).tolist(), 1)]
    rows += [(4011, (base[7] * 1e-300).tolist(), 1), (None, base[10].tolist(), 1), (None, base[10].tolist(), 1), (None, None, 1), rows[20], (4012, [*base[7].tolist(), 0.0], 1)]
    return rows


def brute_links(rows, threshold=0.98):
    units = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.asarray(v, float) / max(map(abs, v)) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    return [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]


def by_links(rows, links):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    count = Counter()
    for a, b in links:
        count[a] += 1
        count[b] += 1
        up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    return Counter((i, count[k], least[find(k)], i == least[find(k)]) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("dims", [64, 96, 5])
def test_near_vectors(spark, monkeypatch, dims):
    rows = planted_vectors(dims, dims)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, code int, home string").repartition(4)
    links = brute_links(rows)
    got = vectors.near_vectors(table).collect()
    # no link that is none, and nearly all that are: a part of the pairs near the threshold may be missed
    want = by_links(rows, links)
    found, exist = sum(r.n_links for r in got), 2 * len(links)
    assert found <= exist and found >= 0.97 * exist, (found, exist)
    assert len(got) == len(rows) and sum((Counter(map(tuple, got)) & want).values()) >= 0.95 * len(rows)
    # every pair at 0.99 and more in one component: 2000-2119 with their base, the copies, the scaled ones
    component = {r.vec_id: r.component_id for r in got}
    assert len({component[2000 + k] for k in range(120)} | {component[1]}) == 1
    assert {component[3000 + k] for k in range(120)} == {component[4]} and component[4000] == 4000 and component[4001] == 4001
    assert component[4010] == component[4011] == component[7] and component[4009] == component[4008] == 4008 and component[4012] == 4012
    # blocks of a bucket change nothing, nor does looking at places together
    monkeypatch.setattr(vectors, "CELL", 16)
    monkeypatch.setattr(vectors, "FEW", 5)
    assert Counter(map(tuple, vectors.near_vectors(table).collect())) == Counter(map(tuple, got))


def test_near_vectors_of_nothing(spark):
    table = spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (3, [1.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert {tuple(r) for r in vectors.near_vectors(table).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)}
    assert vectors.near_vectors(table.limit(0)).collect() == []
    two = spark.createDataFrame([(5, [1.0, 1.0], 1), (4, [2.0, 2.0], 1)], table.schema)
    assert {tuple(r) for r in vectors.near_vectors(two).collect()} == {(4, 1, 4, True), (5, 1, 4, False)}


def test_rotation_is_balanced():
    """Bits are cut at medians, and the learned rotation is one."""
    x = vectors.unit(np.random.default_rng(5).standard_normal((3000, 80)) * np.linspace(3, 0.1, 80) + 0.3)
    model = vectors.learn(x)
    ones = np.unpackbits(model.codes(x)[:, None].view(np.uint8), axis=1).mean(axis=0)
    assert model.bits == 64 and np.abs(ones - 0.5).max() < 0.01
    assert np.allclose(model.axes.T @ model.axes, np.eye(64))
