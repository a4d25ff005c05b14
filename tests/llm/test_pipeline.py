"""The pipeline, stage by stage, against brute force on a small corpus with planted cases."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from warraq.llm.registry import BPE_50K  # noqa: E402
from warraq.llm.tokens import text_encoder  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgéß", k=r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choices(words, k=n))
    passage, base = text(60), text(120)
    clean = [text(r.randint(30, 160)) for _ in range(25)]
    near = [" ".join(w if r.random() > 0.01 else r.choice(words) for w in base.split()) for _ in range(6)]
    shared = [text(40) + "\n" + passage + "\n" + text(30) for _ in range(4)]
    secret = [text(30) + f" password = hunter{k}abc " + text(10) for k in range(3)] + [text(20) + " token: example12345 " + text(12) for _ in range(5)]
    junk = ["short", "", "ha " * 60, " ".join(w + "###" for w in text(30).split()), text(40).upper()]
    return [*clean, base, base, *near, *shared, *secret, *junk, None]


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)])


def test_stages(spark, tmp_path):
    docs = [(i, t, "en", f"src{i % 9}", len(t or "")) for i, t in enumerate(corpus())]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "secret_scans", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.schema.names == [c.split()[0] for c in COLUMNS.split(", ")]
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
    junk = {i for i, t, *_ in docs if not t or len(t.split()) < 10 or "###" in t or t.isupper() or t.startswith("ha ha")}
    first = {r.doc_id: r for r in seen[0]}
    assert set(first) == {d[0] for d in docs} - junk

    ids = sorted(first)
    sets = {i: shingles(first[i].text) for i in ids}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    second = {r.doc_id: r for r in seen[1]}
    assert set(second) == {i for i in ids if find(i) == i} and len(second) < len(first)
    assert all(second[i] == first[i] for i in second)

    window, third = set(), {r.doc_id: r for r in seen[2]}
    for i in sorted(second):
        t = second[i].text.encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if t[k : k + 200] in window:
                gone[k : k + 200] = b"\1" * 200
            window.add(t[k : k + 200])
        # a character goes if all its bytes go
        kept, at = [], 0
        for c in second[i].text:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        assert third[i].text == "".join(kept) and third[i].n_chars == len(kept)
    assert sum(r.n_chars for r in seen[2]) < sum(r.n_chars for r in seen[1])

    fourth = {r.doc_id: r for r in seen[3]}
    for i, r in third.items():
        masked = re.sub(r"password = hunter\dabc", "[SECRET]", r.text)
        assert fourth[i].text == masked and fourth[i].n_chars == len(masked)

    pieces, bins = defaultdict(Counter), defaultdict(list)
    for r in seen[4]:
        pieces[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    tokenizer = text_encoder(BPE_50K).tokenizer
    for i, r in fourth.items():
        tokens = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        cut = [(a, tokens[a : a + 1024]) for a in range(0, len(tokens), 1024)]
        assert pieces[i] == Counter((a, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)), len(tokens)) for a, x in cut)
    assert set(pieces) == set(fourth)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, whole)) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen[4])
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
