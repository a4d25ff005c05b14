"""Repeated substrings across all documents, by sampled anchors and longest-previous-factor arrays.

A string of ``length`` bytes that stands at two places has the same anchor at both:
the ``ANCHOR``-byte gram in it whose hash is least (the leftmost of equals). Each
anchor of a document stands for the run of consecutive windows that choose it, and
the run's bytes are its context. Contexts that occur more than once are repeated as
a whole: their suffixes would be neighbours in suffix order, whose factors are as
long as they are, so that one of each is kept with their count. The others can be
repeated in part only where their anchor's gram occurs elsewhere; those few are
grouped by their anchor, and a suffix array over each block of groups gives, through
previous and next smaller positions in suffix order, the longest earlier (and later)
factor at each place.

A group of more than GROUP contexts is divided first. Equal windows have their anchor
at the same place, so that windows are dealt by the stretch of that place and by the
bytes that all windows of the stretch hold. Stretches are halved for parts that are
still larger; in the end a stretch is one place and a part one window, so that every
part has its suffix array and none is cut short.

``repeated_spans`` gives all occurrences of repeated strings (``keep="none"``), or
all but the first in the order of document ids and places (``keep="first"``).

Defined results: a null text is empty; texts shorter than ``length`` hold no
repeat; rows of equal id and text are two documents of which each repeats the
other (with ``keep="first"`` any one of them is the first); a null id is an id like others, and comes first; an empty table gives no
spans; other columns of the table are ignored or kept untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, binary, if_small, join_hot, lean, let_go, saved, slices, tidy

#: Bytes of the sampled gram, a power of two.
ANCHOR = 32
#: A group of more contexts than this is divided before its suffix array is made.
GROUP = 1024
#: Bytes of contexts that one suffix array covers, unless a single group has more.
BLOCK = 1 << 19
#: Keys of repeated rows (8 bytes each) that are broadcast to number these rows; beyond that the rows are shuffled.
SMALL = 1_000_000
#: Bytes of texts that are searched for anchors together; texts from LONG on (above SLICE) are taken by stretches of STRETCH windows.
SLICE, LONG, STRETCH = 1 << 20, 1 << 23, 1 << 21
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``size``-byte gram, by doubling (``size`` is a power of two), then mixed."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    h, width, power = values[data], 1, FACTOR
    while width < size:
        h = h[:-width] * power + h[width:]
        width, power = 2 * width, power * power
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys (prefix and suffix minima of blocks)."""
    n = len(keys)
    if n < width:
        return keys[:0]
    pad = -n % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, ends: np.ndarray, length: int, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, gram hash, anchor, first window, last window) of each anchor in concatenated documents, places within ``data``."""
    raw = np.frombuffer(data, np.uint8)
    grams = gram_hashes(raw, ANCHOR, values)
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    # a gram's rank: the upper bits of its hash, then its place, so that the leftmost of equals is least
    keys = (grams & ~low) | places
    least = window_minima(keys, length - ANCHOR + 1)
    if not len(least):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    at = (least & low).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(at)), side="right")
    whole = np.arange(len(at)) + length <= ends[np.minimum(doc, len(ends) - 1)]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(whole & change)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    stop = np.ones(len(at), bool)
    stop[:-1] = change[1:] | ~whole[1:]
    last = np.flatnonzero(whole & stop)
    return doc[begin], grams[at[begin]], at[begin], begin, last


def _find_anchors(length: int):
    """(row_key, doc_id, gram, context, first, last): the anchors of every text, the windows' places within the document."""

    @lean
    def run(batches):
        from xxhash import xxh3_128_digest

        values = _byte_values()
        for batch in batches:
            for i, j in slices(batch.column(2), SLICE):
                texts = binary(batch.column(2).slice(i, j - i))
                if sum(map(len, texts)) < LONG:
                    parts = [(texts, np.arange(i, j), 0)]
                else:  # very long texts: overlapping stretches, each window in exactly one
                    parts = [([t[a : a + STRETCH + length - 1]], np.asarray([k]), a) for k, t in enumerate(texts, i) for a in range(0, len(t), STRETCH)]
                for some, rows, shift in parts:
                    data = b"".join(some)
                    ends = np.cumsum([len(t) for t in some])
                    doc, gram, at, first, last = anchors(data, ends, length, values)
                    if not len(doc):
                        continue
                    spans = zip(first.tolist(), last.tolist(), at.tolist(), strict=True)
                    context = [xxh3_128_digest(data[a : b + length] + bytes([(p - a) & 255])) for a, b, p in spans]
                    base = np.concatenate([[0], ends[:-1]])[doc] - shift
                    own = pa.array(rows[doc])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(own),
                            batch.column(1).take(own),
                            pa.array(gram.view(np.int64)),
                            pa.array(context, pa.binary()),
                            pa.array((first - base).astype(np.int32)),
                            pa.array((last - base).astype(np.int32)),
                        ],
                        ["row_key", "doc_id", "gram", "context", "first", "last"],
                    )

    return run


def neighbours(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index of suffix order, the nearest one before and after it whose place is smaller (-1, n: none)."""
    n = len(place)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    for links, edge in ((before, -1), (after, n)):
        todo = np.flatnonzero((links != edge) & (place[np.clip(links, 0, n - 1)] > place))
        while len(todo):
            links[todo] = links[links[todo]]
            now = links[todo]
            todo = todo[(now != edge) & (place[np.clip(now, 0, n - 1)] > place[todo])]
    return before, after


def longest_factors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bytes, in the order of places: its longest common prefix with an earlier row, and with a later one.

    The rows are the suffixes at those places, as far as they matter. In their sorted
    order the nearest rows on both sides with a smaller place share the longest
    prefix of all with a smaller place.
    """
    n, length = windows.shape
    words = -(-length // 8)
    wide = np.zeros((n, 8 * words), np.uint8)
    wide[:, :length] = windows
    order = np.argsort(wide.view(f"S{8 * words}").reshape(-1), kind="stable")
    wide = wide.view("<u8")

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([some(a[k : k + 65536], b[k : k + 65536]) for k in range(0, max(len(a), 1), 65536)])

    def some(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        other = wide[a] ^ wide[b]
        differs = other != 0
        at = differs.argmax(axis=1)
        word = other[np.arange(len(a)), at]
        # the lowest byte that is not zero
        low = (word & (~word + np.uint64(1))).astype(np.float64)
        inside = np.where(word == 0, 0, np.log2(np.where(low == 0, 1, low)).astype(np.int64) // 8)
        return np.where(word == 0, length, np.minimum(length, 8 * at + inside))

    def side(place: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for links in neighbours(place):
            has = np.flatnonzero((links >= 0) & (links < n))
            mine = order[has]
            out[mine] = np.maximum(out[mine], common(mine, order[links[has]]))
        return out

    return side(order), side(n - 1 - order)


def _kept_runs(rows: list[dict], length: int, first_only: bool):
    """(row_key, first, last): runs of windows of whole groups (rows by gram, then order) that stay."""
    contexts = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(r["bytes"], np.uint8), length) for r in rows]
    earlier, later = longest_factors(np.concatenate(contexts))
    stays = earlier < length if first_only else (earlier < length) & (later < length)
    b = 0
    for r, windows in zip(rows, contexts, strict=True):
        a, b = b, b + len(windows)
        if r["n"] > 1 and not first_only:
            continue
        own = np.flatnonzero(stays[a:b])
        if len(own):
            cut = np.flatnonzero(np.diff(own) > 1)
            for x, y in zip(own[[0, *(cut + 1)]].tolist(), own[[*cut, len(own) - 1]].tolist(), strict=True):
                yield r["row_key"], r["first"] + x, r["first"] + y


RUN = "row_key bigint, first int, last int"


def _run_batch(runs: list[tuple]) -> pa.RecordBatch:
    keys, first, last = zip(*runs, strict=True) if runs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["row_key", "first", "last"])


def _settle(length: int, first_only: bool):
    @lean
    def run(batches):
        block, size, gram = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["gram"] != gram and size >= BLOCK:
                    yield _run_batch(list(_kept_runs(block, length, first_only)))
                    block, size = [], 0
                gram = row["gram"]
                block.append(row)
                size += len(row["bytes"])
        if block:
            yield _run_batch(list(_kept_runs(block, length, first_only)))

    return run


def _cut_contexts(length: int, text_col: str):
    """The bytes of the contexts that a row refers to."""

    @lean
    def run(batches):
        for batch in batches:
            texts = binary(batch.column(1).field(text_col)) if batch.num_rows else []
            rows, fields = [], []
            for k, refs in enumerate(batch.column(2).to_pylist()):
                text = texts[k] or b""
                for r in refs:
                    rows.append(k)
                    fields.append((r["gram"], r["m"], r["n"], r["first"], text[r["first"] : r["last"] + length]))
            gram, m, n, first, data = zip(*fields, strict=True) if fields else ((),) * 5
            columns = [pa.array(gram, pa.int64()), pa.array(m, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int32()), pa.array(data, pa.binary())]
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(3).take(own), *columns], ["row_key", "doc_id", "gram", "m", "n", "first", "bytes"])

    return run


def _pieces(length: int, width: int):
    """The pieces of contexts whose windows have their anchors in one stretch of ``width`` places, with the hash of what all such windows hold as their group."""

    @lean
    def run(batches):
        from xxhash import xxh3_64_intdigest

        values, most = _byte_values(), max(SLICE // length, 1)
        for batch in (whole.slice(i, most) for whole in batches for i in range(0, whole.num_rows, most)):
            data = batch.column("bytes").to_pylist()
            heads = np.arange(1, len(data) + 1) * length
            # each first window has one anchor, which is that of the whole context
            places = anchors(b"".join(x[:length] for x in data), heads, length, values)[2] - (heads - length)
            rows, part, begin, piece = [], [], [], []
            for k, (x, at) in enumerate(zip(data, places.tolist(), strict=True)):
                for low in range((at - len(x) + length) // width * width, at + 1, width):
                    high = min(low + width - 1, length - ANCHOR)
                    a, b = max(at - high, 0), min(at - low, len(x) - length)
                    rows.append(k)
                    part.append(xxh3_64_intdigest(x[at - low : at - high + length], low))
                    begin.append(a)
                    piece.append(x[a : b + length])
            own = batch.select(["row_key", "doc_id", "n", "first"]).take(pa.array(rows, pa.int64()))
            first = pa.array(own.column("first").to_numpy() + np.asarray(begin, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [own.column("row_key"), own.column("doc_id"), pa.array(np.asarray(part, np.uint64).view(np.int64)), own.column("n"), first, pa.array(piece, pa.binary())], ["row_key", "doc_id", "gram", "n", "first", "bytes"]
            )

    return run


def _divided(cut: DataFrame, length: int, first_only: bool) -> tuple[DataFrame, DataFrame | None]:
    """Contexts in groups of at most GROUP, and the runs (row_key, first, last) of pieces that are alone in their part."""
    kind = cut.schema["doc_id"].dataType.simpleString()
    few, alone = cut.where(F.col("m") <= GROUP), None
    rest, width = cut.where(F.col("m") > GROUP), length - ANCHOR + 1
    while width > 1 and not rest.isEmpty():
        width = (width + 1) // 2
        pieces = rest.mapInArrow(_pieces(length, width), f"row_key bigint, doc_id {kind}, gram bigint, n bigint, first int, bytes binary")
        unlike = pieces.groupBy("gram", "bytes").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "row_key", "first")).alias("o"))
        unlike = saved(unlike.select("o.*", "gram", "n", "bytes"), "pieces")
        sizes = saved(unlike.groupBy("gram").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("single")), "parts")
        now = saved(join_hot(unlike, sizes, "gram", "inner", sizes.where(F.col("m") > HOT).select("gram")).select("row_key", "doc_id", "gram", "m", "n", "first", "bytes", "single"), "divided")
        let_go(unlike, sizes)
        tidy(cut.sparkSession)
        lone = now.where("m = 1" if first_only else "m = 1 and n = 1").select("row_key", "first", (F.col("first") + F.octet_length("bytes") - length).alias("last"))
        alone = lone if alone is None else alone.unionByName(lone)
        open_ = now.where("m > 1" if first_only else "m > 1 and single > 0").drop("single")
        few, rest = few.unionByName(open_.where(F.col("m") <= GROUP)), open_.where(F.col("m") > GROUP)
    return few.unionByName(rest), alone


def repeated_runs(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, repeated, kept): rows as (row_key, row, copy), and for each row_key the lists of window runs that may go and that stay.

    A window goes if a run of ``repeated`` holds it and none of ``kept`` does. ``copy``
    numbers the rows of equal id and text from 1 with ``keep="first"``: ``kept`` is of copy 1 alone.
    """
    if length <= ANCHOR:
        raise ValueError("length must be above the anchor's")
    first_only = keep == "first"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kind = docs.schema[id_col].dataType
    of_kind = kind.simpleString()
    texts = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row_key"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    tidy(docs.sparkSession)
    all_ = saved(texts.mapInArrow(_find_anchors(length), f"row_key bigint, doc_id {of_kind}, gram bigint, context binary, first int, last int"), "anchors")
    again = saved(all_.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "repeated-grams")
    found = saved(join_hot(all_, again.select("gram"), "gram", "left_semi", again.where(F.col("c") > HOT).select("gram")), "repeated-anchors")
    let_go(all_, again)
    tidy(docs.sparkSession)

    order = F.struct("doc_id", "row_key", "first", "last")
    contexts = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    groups = saved(contexts.groupBy("gram").agg(F.count("*").alias("m"), F.sum((F.col("n") == 1).cast("bigint")).alias("single")), "anchor-groups")
    open_ = groups.where("m > 1" if first_only else "m > 1 and single > 0")
    refs = join_hot(contexts, open_.select("gram", "m"), "gram", "inner", open_.where(F.col("m") > HOT).select("gram")).select("gram", "m", "n", "o.*")
    refs = refs.groupBy("row_key", "doc_id").agg(F.collect_list(F.struct("gram", "m", "n", "first", "last")).alias("refs"))
    # equal rows have the same bytes: one of them is enough
    cut = rows.join(refs, "row_key").select("row_key", "row", "refs", "doc_id").mapInArrow(_cut_contexts(length, text_col), f"row_key bigint, doc_id {of_kind}, gram bigint, m bigint, n bigint, first int, bytes binary")
    cut = saved(cut.dropDuplicates(["row_key", "first", "gram"]), "contexts")
    tidy(docs.sparkSession)
    few, lone = _divided(cut, length, first_only)
    few = few.repartition("gram").sortWithinPartitions("gram", F.col("doc_id").asc_nulls_first(), "row_key", "first")
    kept = few.mapInArrow(_settle(length, first_only), RUN)
    if lone is not None:
        kept = kept.unionByName(lone)
    if first_only:  # the first of contexts that no other context of their gram can touch
        alone = contexts.join(groups.where("m = 1").select("gram"), "gram", "left_semi").select("o.row_key", "o.first", "o.last")
        kept = kept.unionByName(alone)
    rows = rows.withColumn("copy", F.lit(1))
    if first_only:
        # every text of at least ``length`` has one run that begins at 0
        twice = saved(found.where("first = 0").groupBy("row_key").agg(F.count("*").alias("c")).where("c > 1").select("row_key"), "repeated-rows")
        if n := twice.count():
            twice = if_small(twice, n, SMALL)
            again = rows.join(twice, "row_key", "left_semi").withColumn("copy", F.row_number().over(W.partitionBy("row_key").orderBy("copy")))
            rows = rows.join(twice, "row_key", "left_anti").unionByName(again)
    # equal rows have the same runs: a set holds each once
    lists = lambda df, name: df.groupBy("row_key").agg(F.collect_set(F.struct("first", "last")).alias(name))
    return rows, lists(found, "repeated"), lists(kept, "kept")


def removed_spans(n: int, repeated: list[dict] | None, kept: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the going windows of a text of ``n`` bytes cover."""
    if not repeated:
        return []
    goes = np.zeros(n + 1, bool)
    for r in repeated:
        goes[r["first"] : r["last"] + 1] = True
    for r in kept or ():
        goes[r["first"] : r["last"] + 1] = False
    at = np.flatnonzero(goes)
    if not len(at):
        return []
    # windows closer than their length touch each other
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[[0, *(cut + 1)]].tolist(), (at[[*cut, len(at) - 1]] + length).tolist(), strict=True))


def _joined(rows: DataFrame, repeated: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(repeated.join(kept, "row_key", "left"), "row_key", "left").select("row", "repeated", F.when(F.col("copy") == 1, F.col("kept")).alias("kept"))


def repeat_digests(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start,end>>) of every row, in bytes of UTF-8."""
    rows, repeated, kept = repeated_runs(docs.select(id_col, text_col), length, keep, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = binary(batch.column(0).field(text_col))
            out = []
            for t, r, k in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = t or b""
                spans = removed_spans(len(t), r, k, length)
                rest, at = hashlib.sha256(), 0
                for a, b in spans:
                    rest.update(t[at:a])
                    at = b
                rest.update(t[at:])
                out.append((len(t), sum(b - a for a, b in spans), len(spans), rest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            n, gone, count, digest, spans = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).field(id_col), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return _joined(rows, repeated, kept).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, length: int = 200, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without repeated strings of at least ``length`` bytes (whole characters only); ``chars_col``, if it is there, counts the new text's code points.

    All other columns stay as they are; texts without a repeat are untouched.
    """
    rows, repeated, kept = repeated_runs(docs, length, keep, id_col, text_col)

    def whole(text: bytes, a: int, b: int) -> tuple[int, int]:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        return a, b

    def run(batches):
        for batch in batches:
            texts = binary(batch.column(0).field(text_col))
            out, changed = [], []
            for t, r, k in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = removed_spans(len(t or b""), r, k, length)
                parts, at = [], 0
                for a, b in (whole(t, *s) for s in spans):
                    parts.append(t[at:a])
                    at = b
                out.append(b"".join([*parts, t[at:]]).decode() if spans else None)
                changed.append(bool(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(changed, pa.bool_())], ["row", "new_text", "changed"])

    schema = T.StructType([rows.schema["row"], T.StructField("new_text", T.StringType()), T.StructField("changed", T.BooleanType())])
    out = _joined(rows, repeated, kept).mapInArrow(run, schema)

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == text_col:
            return F.when(F.col("changed"), F.col("new_text")).otherwise(old).alias(name)
        if name == chars_col:
            return F.when(F.col("changed"), F.length("new_text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return out.select(*(column(c) for c in docs.columns))
