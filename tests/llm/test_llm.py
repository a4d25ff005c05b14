"""The training-data operators against brute force, on small tables with the awkward rows that contracts name."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warraq.llm import byte_bpe, common, components, html_text, media, ngram_join, packing, quality, rans, registry, repeats, secrets, urls
from warraq.llm.tokens import text_encoder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, row string, failure_bits string, n_words string"


def corpus() -> list[str | None]:
    """Texts with nulls, copies, near copies, shared passages, repeats within a text, secrets and odd white space."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdeéñ", k=r.randint(1, 7))) for _ in range(60)] + ["don't", "12", "x1", "中文", "end."]
    text = lambda n: " ".join(r.choices(words, k=n))
    passage, base = text(70), text(90)
    out: list = [None, "", " ", "a", "  two  blanks \n\n lines\t", "one two", "A B c", base, base, base.upper().lower() + " tail", base.replace("a", "b", 2)]
    for k in range(12):
        t = base.split(" ")
        for _ in range(k // 3):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t))
    out += [text(30) + " " + passage + " " + text(20), passage + " " + text(40), text(25) + " " + passage, passage * 2, "ab " * 150, "na na " * 100]
    out += [f"token = '{'q7' * 9}' AKIA{'Z9' * 8} {'0a1b' * 9} x", "password: short", "api_key=abcdefgh12 token=secret: abcdefghij", "password: changeme99", "password: changeme99 again", "password: changeme99 third"]
    out += [text(400) for _ in range(3)] + ["word " * 4000, "é" * 300, "#" * 50]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 7}", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(corpus())]
    rows += [rows[8], (None, "null id " * 40, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_byte_bpe(docs, empty):
    import tiktoken

    path = registry.MULTI_RANKS
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for i, t in pairs(docs):
        ids = encoding.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    for hot in (0, 40, 100_000):  # the dictionary's bound changes nothing
        got = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, hot_words=hot, digests=True).collect()
        assert Counter(map(tuple, got)) == want, hot
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path)
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back.collect()) == Counter(pairs(docs))
    assert byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN, digests=True).collect() == []


def test_long_words(spark):
    """Long words: random letters, one letter, a repeated part, and lengths about the bound of the fold."""
    import tiktoken

    path, r = registry.MULTI_RANKS, random.Random(7)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    words = ["".join(r.choices("abcdefgé中", k=n)) for n in (9_000, 200, 230)] + ["a" * 9_000, "a" * 387, "tion" * 500, "#" * 3_000, "b" * 510, "b" * 511, "b" * 512]
    words.append("".join(r.choices("etaoinshrdlu", k=100_000)))
    docs = spark.createDataFrame([(i, f"x {w} y") for i, w in enumerate(words)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    assert got == {i: encoding.encode_ordinary(f"x {w} y") for i, w in enumerate(words)}


def test_byte_bpe_remembers_no_words():
    """What the encoder of a task holds does not grow with the words that it meets."""
    import tracemalloc

    none = np.zeros(0, np.int64)
    encoder = byte_bpe.HotEncoder(public_tokenizers.PATTERN, registry.MULTI_RANKS, byte_bpe.HotWords(none.astype(np.uint64), none.astype(np.uint32), none, none))
    r, held = random.Random(9), []
    tracemalloc.start()
    try:
        for _ in range(4):
            texts = pa.array([" ".join("".join(r.choices("abcdefghij", k=12)) for _ in range(2_000)) for _ in range(5)])
            encoder.rare = []
            encoder.encode(texts)
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert held[-1] - held[0] < 500_000, held


def test_byte_bpe_of_many_ids(spark, tmp_path):
    """Ids above 16 bits: tokens that no text has come between the bytes and the merges."""
    import base64

    import tiktoken

    ranks = byte_bpe.load_ranks(registry.MULTI_RANKS)
    tokens = sorted(ranks, key=ranks.get)
    single = [t for t in tokens if len(t) == 1]
    tokens = single + [b"\xff" + k.to_bytes(3, "big") + b"\xff" for k in range(66_000)] + [t for t in tokens if len(t) > 1]
    path = str(tmp_path / "many.tiktoken")
    Path(path).write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    texts = ["the words of a text, " * 3 + "qzxv wjk", "", "naïve 中文 text"]
    want = {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}
    assert byte_bpe.id_kind(path) == "<u4" and max(map(max, filter(None, want.values()))) > 0xFFFF
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for hot in (0, 100):
        assert {r.doc_id: r.ids for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, hot_words=hot).collect()} == want


def test_text_encoder():
    """Texts of every sort of white space, mark and letter, old and new, give the library's ids."""
    from warraq.llm.tokens import TextEncoder

    encoder, r = TextEncoder(registry.BPE_50K, 300), random.Random(5)
    letters = [*"abcXYZ'sdltrevm0129.,:;!?#&\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003éßñøŁͰ\u0378Ая中文字한글あ\u0300\u200b😀½²ªº_-\0\x01\x7f", *" " * 12]
    for _ in range(10):
        texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(200)]
        texts += [" ".join("".join(r.choices(letters[:60], k=r.randint(1, 9))).strip() or "x" for _ in range(12)) for _ in range(200)]
        ids, counts = encoder.encode(pa.array(texts))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_text_encoder_asks_once(monkeypatch):
    """A word that the memo has, in either half, is not given to the library again; the ids are the library's."""
    from warraq.llm.tokens import TextEncoder

    encoder, asked = TextEncoder(registry.BPE_50K, 6), []
    of_words = encoder._encode_words
    monkeypatch.setattr(encoder, "_encode_words", lambda words: asked.extend(words) or of_words(words))

    def new(text):
        asked.clear()
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        return sorted(asked)

    assert new("x qoshem drovaltin") == [" drovaltin", " qoshem", " x"]
    assert new("x qoshem&& drovaltin\nBreemo") == ["\n", "&&", "Breemo"]
    assert new("x vunk wask zorp") == [" vunk", " wask", " zorp"]  # the memo starts anew, what it had is the older half
    assert new("x drovaltin)") == [")"]
    assert new("x qoshem vunk pell ruvv zilm") == [" pell", " ruvv", " zilm"]  # anew again: what the older half had is kept


def test_text_encoder_cuts_before_lines():
    """A word that ends a line is the unit that it is elsewhere; the ids are the library's."""
    from warraq.llm.tokens import TextEncoder

    encoder = TextEncoder(registry.BPE_50K, 300)
    encoder.encode(pa.array(["x qoshem. vunk wask"]))
    texts = ["x wask qoshem.\nvunk wask.\nvunk", "\nvunk", "x\n", "\n", "", "x vunk\n\nvunk", "x vunk \n vunk", "x \nvunk", "x 'tis.\n's", "x\n\t"]
    ids, counts = encoder.encode(pa.array(texts))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert set(encoder.recent) == {"x", "qoshem", "vunk", "wask", "", "\nvunk", "\n", "'tis.", "\n's"}


def test_strings_and_byte_table():
    from warraq.llm.tokens import BYTE_TABLE, byte_characters, strings

    assert [BYTE_TABLE[b] for b in range(1, 256)] == [byte_characters().get(b, chr(b)) for b in range(1, 256)] and BYTE_TABLE[0] == "\0"
    texts = ["", "a", "é中😀\0", "x" * 300]
    for kind in (pa.string(), pa.large_string()):
        assert strings(pa.array(["-", *texts], kind).slice(1)) == texts and strings(pa.array([], kind)) == []


def test_fold_looks_for_a_place_once(spark):
    """A lambda evaluates an expression wherever it is named: the search for a merge's place stands once in a step."""
    table = spark.createDataFrame([(bytearray(b"abc"),)], "word binary")
    folded = table.select(byte_bpe.fold_merges(byte_bpe.byte_array(F.col("word")), registry.MULTI_RANKS).alias("ids"))
    plan = folded._jdf.queryExecution().analyzed().expressions().mkString(" ")
    assert plan.count("array_position(") == 1


def test_every_token_folds_to_itself(spark):
    ranks = byte_bpe.load_ranks(registry.MULTI_RANKS)
    some = dict(random.Random(2).sample(sorted(ranks.items()), 4000))
    df = spark.createDataFrame([(k, list(k)) for k in some], "w binary, b array<int>")
    assert all(r.ids == [some[bytes(r.w)]] for r in df.select("w", byte_bpe.fold_merges(F.col("b"), registry.MULTI_RANKS).alias("ids")).collect())


def tokens_of(texts):
    tokenizer = text_encoder(registry.BPE_50K).tokenizer
    return [e.ids + [0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, registry.BPE_50K, capacity=256, group_docs=20, with_ids=True).collect()
    got, bins = defaultdict(Counter), defaultdict(list)
    for r in rows:
        ids = list(struct.unpack(f"<{r.length}I", r.ids))
        got[r.doc_id][r.start, tuple(ids), r.doc_tokens] += 1
        bins[r.sequence_id].append((r.offset, r.length))
        assert crc(ids) == r.ids_crc32
    want = defaultdict(Counter)
    every = pairs(docs)
    for (i, _), ids in zip(every, tokens_of([t for _, t in every]), strict=True):
        for a in range(0, len(ids), 256):
            want[i][a, tuple(ids[a : a + 256]), len(ids)] += 1
    assert got == want
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, registry.BPE_50K).collect() == []


def test_first_fit_decreasing():
    import numpy as np

    r = np.random.default_rng(0)
    lengths = -np.sort(-r.integers(1, 101, 400))
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        k = next((k for k, x in enumerate(room) if x >= n), len(room))
        if k == len(room):
            room.append(100)
        assert (b, o) == (k, 100 - room[k])
        room[k] -= n


def test_token_files(spark, docs, empty, tmp_path):
    out = f"file://{tmp_path}/files"
    rans.write_token_files(docs, out, registry.BPE_50K, block_tokens=3000, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.read_token_files(spark, out, digests=True).collect()]
    want, at = [], 0
    every = sorted(pairs(docs), key=lambda p: (p[0] is not None, p[0]))
    for (i, _), ids in zip(every, tokens_of([t for _, t in every]), strict=True):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert sum(len(r.ids) for r in rans.read_token_files(spark, out).collect()) == 4 * at
    rans.write_token_files(empty, out + "-none", registry.BPE_50K)
    assert rans.read_token_files(spark, out + "-none").collect() == []


def test_rans_blocks():
    import numpy as np

    r = np.random.default_rng(1)
    for n, kinds in ((0, 3), (1, 1), (257, 2), (5000, 40000), (700_000, 900)):
        ids = r.zipf(1.3, n).clip(1, kinds).astype(np.uint32) - 1
        table = rans.Table(rans.scaled(np.bincount(ids, minlength=kinds)))
        block = rans.encode_block(ids, table)
        assert (rans.decode_segments(block, table) == ids).all()
        if len(block["checksums"]) > 1:  # a segment decodes alone
            size = rans.CHECKPOINT_STEPS * block["lanes"]
            assert (rans.decode_segments(block, table, 1, 2) == ids[size : 2 * size]).all()
    broken = block | {"words": b"\x01" + block["words"][1:]}
    with pytest.raises(ValueError):
        rans.decode_segments(broken, table)


def test_urls(spark):
    rules = [urls.UrlRule(*r) for r in registry.URL_RULES]
    cases = ["http://example.com/en/1", "https://www.EXAMPLE.com/en/x?y", "http://a.example.com/fr", "http://x.net/es/1", "http://net/fr/", "http://x.net/eso", "http://example.com", "http://notexample.com/en/", "ftp:/x", None, "", "http://a.org/casino/1", "://", "http://x.net/es/1", "http://h.com/a\nb#c", "HTTP://u:p@Ex.com:80/", "http://a.org/x.CASINO", "http://casinos.org/", "http://casino.net/es/", "http://a.org/?casino", "http://poker"]
    want = []
    for i, u in enumerate(cases):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(p), p, a) for a, p in registry.URL_RULES if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith("/" + p.partition("/")[2])]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if re.search("(?i)\\b(casino|poker)\\b", host + path) else "allow")
        want.append((i, host, path, rule, verdict))
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    assert sorted(map(tuple, urls.judge_urls(pages, rules).collect())) == want
    assert urls.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.rule for r in urls.judge_urls(pages, []).collect()} == {None}


def test_url_rules_without_token(spark):
    rules = [urls.UrlRule("block", "пример.рф/"), urls.UrlRule("allow", "example.com/en/")]
    cases = ["http://www.пример.рф/abc", "http://пример.рф/", "http://xпример.рф/abc", "http://example.com/en/1"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {0: ("пример.рф/", "block"), 1: ("пример.рф/", "block"), 2: (None, "allow"), 3: ("example.com/en/", "allow")}


BASE = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def test_secret_query(spark, tmp_path):
    """Counts and digest of the query where a text has several spans of several kinds."""
    r = random.Random(6)
    bits = ["password", "ToKen", "API_KEY", "secret", "=", ":", " = ", '"', "abcdefgh", "Ab+/_.=-", "\u017f", "\u212a", "é", "\U0001f600", "AKIA", "ABCDEF0123456789", "0a1b" * 9, " ", "\n"]
    texts = [None, ""] + ["".join(r.choices(bits, k=r.randint(1, 25))) for _ in range(300)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op6_secret_scans(spark, str(tmp_path)).collect()
    for row in got:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(texts[row.doc_id] or "") if len(m[g]) >= n)
        want = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        counts = tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == (*counts, hashlib.sha256(want.encode()).hexdigest())
    assert len(got) == len(texts)


def test_secrets_with_hot_values(docs, monkeypatch):
    """Values and documents' sets that many rows share give the same result by broadcast."""
    want = Counter(map(str, secrets.scan(docs).collect())), Counter(map(str, secrets.redact(docs).collect()))
    monkeypatch.setattr(secrets, "HOT", 1)
    assert (Counter(map(str, secrets.scan(docs).collect())), Counter(map(str, secrets.redact(docs).collect()))) == want


def test_secrets_by_hints(spark, docs, monkeypatch):
    rng, pieces = random.Random(5), ["password", "PassWD", "api_key", "apikey", "token", "'", " ", "=", ":", "abcdefg", "Zz.9+/_-", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "f" * 15, "é", "𝒳", "eyJ", "abcdefgh.", "ghp_", "x" * 36, "xoxb-", "-----BEGIN ", "PRIVATE KEY-----", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(3000)] + ["é" * k + "𝒳" * (k % 3) + "0a" * 16 + "g" for k in range(40)] + ["x" * 2_000_000 + "0a" * 16]
    spans = F.array_sort(F.concat(*(secrets.spans_of_kind(F.col("text"), k, *x) for k, x in enumerate(secrets.BASE + secrets.ADDED))))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(spans.alias("plain"), secrets.all_spans(F.col("text")).alias("hinted")).collect()
    assert all(r.plain == r.hinted for r in rows) and 500 < sum(bool(r.plain) for r in rows) < 3000
    clean = secrets.redact(docs)
    # the texts meet the verdicts without being searched again
    assert "RLIKE" not in clean._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(secrets, "SMALL", -1)
    assert Counter(map(str, secrets.redact(docs).collect())) == Counter(map(str, clean.collect()))


def test_secrets(docs, empty):
    rows = secrets.scan(docs).select("doc_id", secrets.joined(F.filter("spans", lambda s: s["rank"] < 3)).alias("base"), secrets.joined(F.col("live")).alias("live")).collect()
    want = Counter()
    for i, t in pairs(docs):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(t) if len(m[g]) >= n)
        want[i, ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)] += 1
    assert Counter((r.doc_id, r.base) for r in rows) == want
    by_text = {t: i for i, t in pairs(docs)}
    live = {r.doc_id: r.live for r in rows}
    assert not live[by_text["password: changeme99"]] and live[by_text["api_key=abcdefgh12 token=secret: abcdefghij"]]
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[by_text["api_key=abcdefgh12 token=secret: abcdefghij"]].text.startswith("[SECRET]")
    assert texts[by_text["password: changeme99"]].text == "password: changeme99"
    assert all(r.n_chars == len(r.text or "") for r in texts.values() if r.doc_id is not None)
    assert secrets.scan(empty).collect() == [] == secrets.redact(empty).collect()


PAGES = [
    (None, ""),
    ("", ""),
    ("<html><body><nav><a href=a>Menu</a></nav><article><h1>T &amp; U</h1><p>Some  longer\n text &lt;here&gt;<br>and on<p>Next &eacute;</article><footer>F</footer>", "T & U\n\nSome longer text <here> and on\n\nNext é"),
    ("<body><div id=wrap><div class=menu><a>H</a><a>I</a></div><div id=content><p>Hello world, this is <a href=x>long</a> text with words.<p>Second one has plenty of words too.</div><div class=sidebar>Buy</div><div class='comment'>Nice post, I agree very much</div></div>", "Hello world, this is long text with words.\n\nSecond one has plenty of words too."),
    ("<p>only <b>text", "only text"),
    ("<script>var a='<p>no</p>'", ""),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    got = html_text.extract_main_text(df).collect()
    assert sorted(map(tuple, got)) == [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)]
    assert html_text.extract_main_text(df.limit(0)).collect() == []
    assert html_text.main_text("<" * 3000 + "<a \"" * 3000) is not None


PROSE = "<p>The article's text is long enough to be the main part of its page, by far.</p><p>A second paragraph goes on with still more words that are worth reading.</p>"
WANT = "The article's text is long enough to be the main part of its page, by far.\n\nA second paragraph goes on with still more words that are worth reading."
MENU, FOOT = "<nav><a href=a>Home</a> <a href=b>News</a></nav>", "<footer>Copyright by us</footer>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body>{MENU}<div class='content has-sidebar'><article>{PROSE}</article><div class='sidebar'><p>side box</p></div></div>{FOOT}", WANT),
        (f"<body><form>{MENU}<div>{PROSE}</div><input>{FOOT}</form>", WANT),
        (f"<body>{MENU}<div class='no-comments'>{PROSE}</div>{FOOT}", WANT),
        (f"<body>{MENU}<article>{PROSE}<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul></article>{FOOT}", WANT + "\n\nSource one\n\nSource two"),
        (f"<body><article>{PROSE}</article><section id='comments'><article class='comment-body'><p>so nice</p></article>{PROSE * 3}</section>", WANT),
        (f"<body><div id=c>{PROSE}</div><section class='related'><article><p>Teaser words</p></article></section>", WANT),
        (f"<body><div class='widget page'>{MENU}{PROSE}<div class='comments'>{PROSE * 3}</div>{FOOT}</div>", WANT),
        (f"<body>{MENU}<div class='footer'><p>All rights</p></div>", ""),
        (f"<body><div class='menu-open'><div class='banner top'>{MENU}<div class='ad'>Buy</div>{PROSE}</div></div>", WANT),
        (f"<body><aside><main>{PROSE}</main></aside>{FOOT}", WANT),
        ("<div class=ad>" * 20_000 + PROSE, WANT),
    ],
)
def test_html_under_marked_wrappers(page, want):
    assert html_text.main_text(page) == want


LONG = "".join(f"<p>Paragraph {k} of a section that is long enough to be read as a part of the article, and it goes on.</p>" for k in range(4))
LONG_WANT = "\n\n".join(f"Paragraph {k} of a section that is long enough to be read as a part of the article, and it goes on." for k in range(4))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{PROSE}<section id='full-text-search'><h2>Search</h2>{LONG}</section></article>", f"{WANT}\n\nSearch\n\n{LONG_WANT}"),
        (f"<article>{PROSE}<section id='search'><h2>Search</h2>{LONG}</section></article>", f"{WANT}\n\nSearch\n\n{LONG_WANT}"),
        *((f"<article><h2 id='{i}'>A heading</h2>{PROSE}</article>", f"A heading\n\n{WANT}") for i in ("related-work", "social-impact", "form-of-government", "comments", "search")),
        *((f"<article>{PROSE}<{t} class='{c}'>Some words that stay</{t}></article>", f"{WANT}\n\nSome words that stay") for t, c in (("div", "social-history"), ("blockquote", "profit-share"), ("p", "box alert-none"), ("p", "notice"), ("div", "code-comment-style"))),
        (f"<article>{PROSE}<pre><span class='comment'># a remark</span> x = 1</pre></article>", f"{WANT}\n\n# a remark x = 1"),
        (f"<article>{PROSE}<p><label>Fig. 1</label> words</p></article>", f"{WANT}\n\nFig. 1 words"),
        (f"<body><div class=page><h1>Title</h1><p class=lead>The lead of it.</p>{MENU}<div class=text>{PROSE}</div></div>{FOOT}", f"Title\n\nThe lead of it.\n\n{WANT}"),
        (f"<body>{MENU}<h1>Title</h1><p>The lead of it.</p><div class=text>{PROSE}</div>{FOOT}", f"Title\n\nThe lead of it.\n\n{WANT}"),
        # what is furniture in an article goes all the same
        *((f"<article>{PROSE}<div class='{c}'>Some words to go</div>{PROSE}</article>", f"{WANT}\n\n{WANT}") for c in ("ad", "ad-300x250 top", "share-box", "notice", "related posts", "newsletter_box", "comments", "sidebar-left")),
        (f"<article>{PROSE}<div id='social-links'><a href=1>{'Share ' * 60}</a></div></article>", WANT),
        (f"<body>{MENU}<div id='site-footer'><p>All rights</p></div><div>{PROSE}</div><div class='sponsored-story'><p>Buy</p></div>", WANT),
        (f"<article>{PROSE}</article><div class=comment-list><p class=comment>{PROSE * 2}</p></div>", WANT),
    ],
)
def test_html_names_in_articles(page, want):
    assert html_text.main_text(page) == want


def test_html_generated():
    """Pages made of an article's blocks, marked boxes and wrappers at random: the text is what was put in."""
    r = random.Random(11)
    sentence = lambda: " ".join("".join(r.choices("abcdeilmnorstué", k=r.randint(2, 9))) for _ in range(r.randint(9, 40))) + "."
    for _ in range(300):
        blocks = [sentence() for _ in range(r.randint(3, 12))]
        tags = [r.choice(["p", "p", "p", "h2", "blockquote", "pre"]) for _ in blocks]
        name = lambda: r.choice(["", "", " id='related-work'", " id='search-and-form'", " class='profit-share'", " class='social history'", " class='text notice-none'", " id='comments-on-x'"])
        inner = "".join(f"<{t}{name()}>{r.choice(['', ' '])}{b.replace(' ', r.choice([' ', chr(10), '  ']), 1)}</{t}>" for t, b in zip(tags, blocks, strict=True))
        box = lambda: r.choice([MENU, FOOT, "", f"<div class='{r.choice(['ad', 'share-box', 'related posts', 'sidebar left'])}'>{r.choice(['', '<p>'])}{sentence()[:60]}</div>", f"<script>var x = '<p>{sentence()}</p>'</script>", "<!-- <p>no</p> -->"])
        core = f"<{(tag := r.choice(['article', 'main', 'div']))}>{inner}</{tag}>"
        page = box() + core + box()
        for _ in range(r.randint(0, 3)):
            page = f"<div class='{r.choice(['page', 'has-sidebar x', 'content', 'layout no-comments'])}'>{page}</div>"
        assert html_text.main_text(f"<html><head><title>t</title></head><body>{MENU}{page}{FOOT}</body></html>") == "\n\n".join(blocks)


def links(texts, size, num, den):
    sets = {}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "num", "den", "cell"), [(3, 9, 10, 192), (5, 8, 10, 192), (5, 8, 10, 2), (1, 5, 10, 3)])
def test_ngram_join(docs, empty, monkeypatch, size, num, den, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(common, "HOT", cell)
    monkeypatch.setattr(ngram_join, "HOT", cell)
    known = docs.where("doc_id is not null")
    want = links(dict(pairs(known)).items(), size, num, den)
    got = ngram_join.near_duplicates(known, size, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == known.count()
    assert ngram_join.near_duplicates(empty, size, num, den).collect() == []


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (5, 10)])
def test_similar_sets_share_a_bucket(num, den):
    r = random.Random(num)
    buckets, again = ngram_join.Buckets(num, den), 0
    for _ in range(1500):
        n = int(10 ** r.uniform(0, 3))
        x = {r.getrandbits(64) for _ in range(n)}
        gone = r.randint(0, max(0, n - (num * n + den - 1) // den))
        y = set(sorted(x)[gone:])  # the least go, whose buckets are side by side
        while (num * (len(x | y) + 1)) <= den * len(x & y) and r.random() < 0.9:
            y.add(r.getrandbits(64))
        if not x or not y or x == y or num * len(x | y) > den * len(x & y):
            continue
        band = max(buckets.bands(len(s))[0] for s in (x, y))
        names = [buckets.names(np.sort(np.fromiter(s, np.uint64, len(s))), band) for s in (x, y)]
        assert band in buckets.bands(len(x)) and band in buckets.bands(len(y)) and set(names[0].tolist()) & set(names[1].tolist())
        again += len(names[0]) > max(1, buckets.sizes(band)[1])
    assert again


def test_places_of_a_set():
    """A set goes to no more places than it needs: one more than it differs in from similar ones, in each band."""
    r, buckets, total = random.Random(2), ngram_join.Buckets(8, 10), 0
    for n in range(300, 400):
        x = np.sort(np.asarray([r.getrandbits(64) for _ in range(n)], np.uint64))
        for band in buckets.bands(n):
            h = buckets.apart(n, band)
            assert h <= buckets.sizes(band)[0] and h >= (min(n * 10 // 8, buckets.bounds[band + 1] - 1) - n)
            total += len(buckets.names(x, band))
    assert total <= 0.5 * sum(range(300, 400))


def test_unlike_sets_do_not_meet(spark, monkeypatch):
    """Texts of few words share most shingles with others by chance, as in a large corpus: only the similar ones are sent anywhere."""
    r, rows = random.Random(8), {}
    words = [f"w{k}" for k in range(25)]
    texts = [r.choices(words, k=300) for _ in range(300)]
    texts += [[*t[:150], "new", *t[151:]] for t in texts[:5]]
    old = ngram_join.saved

    def saved(df, label):
        out = old(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "saved", saved)
    table = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3), 3, 9, 10).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == links(table, 3, 9, 10)
    assert rows["meetings"] <= 100


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    want = links(dict(pairs(docs.where("doc_id is not null"))).items(), 5, 8, 10)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, c) in want.items() if i == c or not n} | {None}


def test_keep_one_row(spark):
    """One row of a component, however its rows share ids: repeated rows, near copies of one id, null ids."""
    r = random.Random(5)
    base, other, third, alone = (" ".join(str(r.randrange(10**6)) for _ in range(60)) for _ in range(4))
    rows = [(1, base), (1, base), (2, base), (1, base + " tail"), (None, base), (7, other), (7, other + " x"), (7, alone), (7, alone)]
    rows += [(None, third + f" {k % 3}") for k in range(40)] + [(9, "text"), (9, ""), (9, ""), (None, None), (None, " ")]
    kept = [tuple(x) for x in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    groups = lambda t: next((k for k, b in enumerate((base, other, third, alone)) if t and t.startswith(b)), None)
    assert Counter((i, groups(t)) for i, t in kept if groups(t) is not None) == {(1, 0): 1, (7, 1): 1, (None, 2): 1, (7, 3): 1}
    assert Counter(x for x in kept if groups(x[1]) is None) == Counter(rows[-5:])


def test_first_of_repeated_rows(spark):
    """All but the first of rows of equal id and text lose their text; columns of their own stay."""
    r = random.Random(6)
    text, passage = ("".join(r.choices("abcdefgh ", k=n)) for n in (300, 90))
    rows = [(2, text + passage, 0), (2, text + passage, 1), (2, text + passage, 2), (3, "é" + passage, 3), (None, passage, 4), (None, passage, 5), (4, "short", 6), (4, "short", 7)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3), 60).collect()
    assert Counter((x.doc_id, x.text) for x in got) == {(2, text): 1, (2, ""): 2, (3, "é"): 1, (None, passage): 1, (None, ""): 1, (4, "short"): 2}
    assert sorted(x.n for x in got) == list(range(8))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(400 + k, 401 + k) for k in range(90)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_quality(docs, empty):
    rows = quality.ledger(docs).collect()
    want = Counter()
    for i, t in pairs(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if found[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert (r.failure_bits & 3 != 0) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.failure_bits & quality.mask("v1") == 0 for r in rows)
    table = {r.rule: r for r in quality.ablation(quality.ledger(docs), "base").collect()}
    bits = [r.failure_bits & 3 for r in rows]
    assert (table["few_words"].n_fail, table["few_words"].n_fail_alone, table["few_words"].n_kept_without) == (sum(b & 1 for b in bits), bits.count(1), sum(b & 2 == 0 for b in bits))
    assert quality.ledger(empty).collect() == [] == quality.keep_documents(empty).collect()


def covered(texts, length, first):
    """Spans of repeated strings of each text; with ``first`` their first occurrence is left."""
    seen, count = set(), Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        goes = []
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if w in seen if first else count[w] > 1:
                goes.append(k)
            seen.add(w)
        spans = []
        for k in goes:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + length
            else:
                spans.append([k, k + length])
        out.append((i, [tuple(s) for s in spans]))
    return out


@pytest.mark.parametrize(("keep", "group"), [("none", 8192), ("none", 2), ("first", 8192), ("first", 2)])
def test_repeats(docs, empty, monkeypatch, keep, group):
    monkeypatch.setattr(repeats, "HOT", group)
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    if keep == "first":  # equal rows are told apart by nothing, so that no order holds between them
        texts = sorted({t for t in texts}, key=lambda p: (p[0] is not None, p[0] or 0))
        docs = docs.dropDuplicates(["doc_id"])
    want = covered(texts, 60, keep == "first")
    rows = repeats.repeat_digests(docs, 60, keep).collect()
    got = [(r.doc_id, [(s.start, s.end) for s in r.spans]) for r in rows]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    known = dict(texts)
    for r in rows:
        rest, at = b"", 0
        for s in r.spans:
            rest, at = rest + known[r.doc_id][at : s.start], s.end
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(known[r.doc_id]), sum(s.end - s.start for s in r.spans), len(r.spans))
        assert r.kept_sha256 == hashlib.sha256(rest + known[r.doc_id][at:]).hexdigest()
    assert repeats.repeat_digests(empty).collect() == []


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_around_a_common_passage(spark, monkeypatch, keep):
    """Many texts hold a passage just below the length, and some share more around it: no group of contexts is larger than GROUP."""
    monkeypatch.setattr(repeats, "GROUP", 6)
    monkeypatch.setattr(repeats, "SLICE", 600)
    divided, sizes = repeats._divided, []

    def watched(cut, *rest):
        few, lone = divided(cut, *rest)
        before, after = (df.groupBy("gram").count().agg({"count": "max"}).first()[0] or 0 for df in (cut, few))
        sizes.append((before, after, lone is not None))
        return few, lone

    monkeypatch.setattr(repeats, "_divided", watched)
    r = random.Random(21)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, more = text(58), [text(12) for _ in range(4)]
    texts = [text(90) + r.choice(["", *more]) + passage + r.choice(["", *more]) + text(90) for _ in range(150)] + [text(20) + more[0] + passage + more[1] + text(30)] * 2
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    if keep == "first":
        rows = sorted({(i if i % 9 else -i - 1, t) for i, t in enumerate(texts)})
    got = repeats.repeat_digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 60, keep).collect()
    want = covered([(i, t.encode()) for i, t in rows], 60, keep == "first")
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((x.doc_id, [(s.start, s.end) for s in x.spans]) for x in got), key=order) == sorted(want, key=order)
    (before, after, lone), = sizes
    assert before > 100 and after <= 6 and lone


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_of_long_texts(spark, monkeypatch, keep):
    """Texts above the bound, with empty and null texts before and after them in the same Arrow batch."""
    for name, size in (("SLICE", 256), ("LONG", 1024), ("STRETCH", 500)):
        monkeypatch.setattr(repeats, name, size)
    r = random.Random(12)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = text(200)
    texts = ["", None, text(900) + passage + text(700) + passage, "", passage + text(30), None, "", text(1500) + passage[:90], "", text(40) + passage[20:]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = repeats.repeat_digests(rows, 60, keep).collect()
    assert sorted((x.doc_id, [(s.start, s.end) for s in x.spans]) for x in got) == covered([(i, (t or "").encode()) for i, t in enumerate(texts)], 60, keep == "first")


def test_slices():
    size = lambda *sizes: list(common.slices(pa.array([None if n is None else "x" * n for n in sizes], pa.string()), 10))
    assert size(0, None, 30, 0, 4, 5, 30, None) == [(0, 2), (2, 3), (3, 6), (6, 7), (7, 8)]
    assert size(30) == [(0, 1)] and size(0, 0) == [(0, 2)] and size() == []


def new_shuffle_files(spark, old=frozenset()):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {f.rpartition("/")[2] for f in files if "/shuffle_" in f} - old


def test_repeats_leave_no_files(spark, docs):
    """Finished steps keep no shuffle files, and tables that nothing reads again are removed."""
    kept = lambda: set(Path(common.shared_dir(spark).removeprefix("file:")).glob("warraq/*anchors-*"))
    before, tables, conf = new_shuffle_files(spark), kept(), spark.conf.get(common.CLEANUP, None)
    table = common.saved(docs.groupBy("source").count(), "groups")
    got = repeats.repeat_digests(docs, 60)
    for _ in range(50):  # executors are told, not waited for
        if not (left := new_shuffle_files(spark, before)):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(common.CLEANUP, None) == conf
    assert {p.name.rpartition("-")[0] for p in kept() - tables} == {"repeated-anchors"}
    assert got.count() == docs.count() and table.count() == 8


def test_remove_repeats(docs, empty):
    out = repeats.remove_repeats(docs, 60)
    assert out.columns == docs.columns and out.count() == docs.count()
    before = {r.doc_id: r for r in docs.collect()}
    for r in out.collect():
        old = before[r.doc_id]
        assert (r.text is None) == (old.text is None) and (r.text == old.text or r.n_chars in (None, len(r.text))) and r.source == old.source
    assert repeats.remove_repeats(empty).collect() == []


def test_media(spark, docs, empty, tmp_path):
    uri = f"file://{tmp_path}/shards"
    index = media.store_payloads(docs, uri)
    rows = media.read_features(index, uri).collect()
    want = Counter()
    for i, t in pairs(docs):
        payload = media.padded(t.encode())
        assert len(payload) % 192 == 0 and len(payload) >= 192
        want[i, len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    heads = media.read_metadata(index, uri).collect()
    assert all((h.width, h.depth, h.height * 192) == (64, 8, h.payload_bytes) for h in heads)
    import tarfile

    for shard in tmp_path.glob("shards/*.tar"):
        with tarfile.open(shard) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))
            for m in tar.getmembers():
                assert hashlib.sha256(media.decode_image(tar.extractfile(m).read())).hexdigest() == m.name.removesuffix(".png")
    assert media.media_columns(empty).collect() == []


def test_media_sides_from_headers(docs, monkeypatch):
    """The query's width and height are those of the header reads."""
    whole = media.read_metadata
    monkeypatch.setattr(media, "read_metadata", lambda *a: whole(*a).withColumn("width", F.col("width") + 1000))
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count() and all(r.width == 1064 and r.height * 192 == r.payload_bytes for r in rows)
