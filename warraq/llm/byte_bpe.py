"""Byte-level BPE: ranked merges folded by Spark higher-order functions.

``encode_documents`` splits every text with the published pattern, finds the
distinct words, folds the merges of each distinct word over its byte array with
``aggregate`` against a literal rank map, and puts the ids back in text order.
``decode_ids`` concatenates the byte strings of ids.

Words are folded once for the corpus when they are frequent (a dictionary of at
most ``hot_words`` entries, which is therefore safe to broadcast) and once per
document when they are rare, so nothing is shuffled but word counts.

Defined results: a null text is an empty text (no ids, the hash of no bytes);
repeated rows give repeated results; a null ``doc_id`` stays null; columns other
than the two named are ignored, whatever their names are; an empty table gives
an empty table. A word (a match of the pattern) of more than LONG bytes is merged by a
heap in Python, since the fold's work grows with the square of a word's length.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_view, lean, saved, uncollected
from .tokens import MARKS, TextEncoder, plain_texts, simple_parts, text_slices

#: Ranks are below this; the packed cells of the rank map hold left * NO_RANK + rank.
NO_RANK = 1 << 18
#: A token's number in the fold: rank, place (26 bits), id (18 bits).
ID_SIZE, PLACE_BITS = 1 << 18, 44
PLACES = 1 << PLACE_BITS
#: Places of a row of the rank map that are tried at once.
WINDOW = 8192


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is also the token id) of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_map(path: str) -> tuple[str, str, str]:
    """The literal rank map, as JSON: places of rows, packed cells, ids of the 256 bytes.

    A pair (left, right) has the cell ``places[left] + right``: the rows of the
    sparse matrix left x right lie over each other where they do not collide. A cell
    packs left and rank; xor with left leaves the rank, or at least ``NO_RANK`` for
    a pair that has none.
    """
    ranks = load_ranks(path)
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    n = len(ranks)
    taken = np.zeros(8 * n, bool)
    cells = np.full(8 * n, -1, np.int64)
    places = np.zeros(n, np.int64)
    low = 0
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.fromiter(row, np.int64)
        first = int(rights.min())
        while taken[low]:
            low += 1
        at = max(0, low - first)
        while True:  # the first place of the next WINDOW that suits every cell of the row
            clash = np.zeros(WINDOW, bool)
            for r in rights.tolist():
                clash |= taken[r + at : r + at + WINDOW]
            if not clash.all():
                at += int(np.argmin(clash))
                break
            at += WINDOW
        places[left] = at
        taken[rights + at] = True
        cells[rights + at] = left * NO_RANK + np.fromiter(row.values(), np.int64)
    end = int(max(np.flatnonzero(taken).max(initial=0) + 1, places.max() + n))
    cells = np.where(cells < 0, (n + 1) * NO_RANK, cells)[:end]
    dump = lambda x: json.dumps(x, separators=(",", ":"))
    return dump(places.tolist()), dump(cells.tolist()), dump([ranks[bytes([i])] for i in range(256)])


def pair_rank(places: Column, cells: Column, left: Column, right: Column) -> Column:
    """Rank (and id) of the token that a pair of ids makes, or a number of at least NO_RANK."""
    return F.get(cells, (F.get(places, left.cast("int")) + right).cast("int")).bitwiseXOR(left * NO_RANK)


#: Words of more bytes are merged by a heap: a step of the fold costs as many operations as the word has tokens.
LONG = 512


def fold_merges(word: Column, path: str) -> Column:
    """Token ids (array<bigint>) of one word, given as its byte array (array of numbers, not empty).

    The accumulator holds a number for each token: the rank of the pair that it
    begins, the place of its first byte and its id, in this order of bits. The least
    number is the leftmost pair of the lowest rank; a step merges it and looks up the
    two pairs that this changes, as long as a pair has a rank.
    """
    places_json, cells_json, bytes_json = rank_map(path)

    def with_tables(t: Column) -> Column:
        places, cells = t["places"], t["cells"]

        def rank(a: Column, b: Column) -> Column:
            return F.coalesce(F.least(pair_rank(places, cells, a, b), F.lit(NO_RANK)), F.lit(NO_RANK))

        def packed(rank_: Column, rest: Column) -> Column:
            return rank_ * PLACES + rest

        def merged(tokens: Column, m: Column) -> Column:
            """``tokens`` after the merge of the pair that number ``m`` begins."""
            id_ = F.shiftrightunsigned(m, PLACE_BITS)
            place = m.bitwiseAND(PLACES - ID_SIZE)

            def at(p: Column) -> Column:
                following = F.get(tokens, p + 1).bitwiseAND(ID_SIZE - 1)
                own = packed(rank(id_, following), place + id_)
                before = F.get(tokens, p - 2)
                left = packed(rank(before.bitwiseAND(ID_SIZE - 1), id_), before.bitwiseAND(PLACES - 1))
                changed = F.when(p > 1, F.array(left, own)).otherwise(F.array(own))
                return F.concat(F.slice(tokens, F.lit(1), F.greatest(p - 2, F.lit(0))), changed, F.slice(tokens, p + 2, F.size(tokens)))

            # bound to a variable: the place would be looked for wherever it is named
            return F.transform(F.array(F.array_position(tokens, m).cast("int")), at)[0]

        def step(acc: Column, _: Column) -> Column:
            return F.transform(F.array(F.array_min(acc)), lambda m: F.when(m < NO_RANK * PLACES, merged(acc, m)).otherwise(acc))[0]

        ids = F.transform(word, lambda b: F.get(t["bytes"], b.cast("int")))
        start = F.transform(F.array(ids), lambda a: F.transform(a, lambda x, i: packed(rank(x, F.get(a, i + 1)), i.cast("bigint") * ID_SIZE + x)))[0]
        # a word has at most one merge less than bytes
        return F.aggregate(F.slice(word, F.lit(2), F.size(word)), start, step, lambda acc: F.transform(acc, lambda v: v.bitwiseAND(ID_SIZE - 1)))

    tables = F.struct(
        F.from_json(F.lit(places_json), "array<bigint>").alias("places"),
        F.from_json(F.lit(cells_json), "array<bigint>").alias("cells"),
        F.from_json(F.lit(bytes_json), "array<bigint>").alias("bytes"),
    )
    # the tables stand once in the plan, bound to a variable
    return F.transform(F.array(tables), with_tables)[0]


def merge_long(word: bytes, path: str) -> list[int]:
    """Token ids of one word by the same merges; n bytes cost n log n."""
    ranks = load_ranks(path)
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins at a place; end 0: no token begins there

    def rank(i: int) -> int | None:
        return ranks.get(word[i : end[end[i]]]) if end[i] < n else None

    heap = [(r, i, i + 2) for i in range(n) if (r := rank(i)) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the pair has merged with another
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Splitter:
    """Splits texts into the words that the pattern matches.

    A text in which white space comes one at a time is cut at its blanks first: no
    match goes on over a blank between two other characters, so a part between
    blanks has the same words in every text. Most parts are letters, or letters and
    a mark, which need no pattern.
    """

    def __init__(self, pattern: str):
        import re

        import regex

        self.find = regex.compile(pattern).findall
        self.run = re.compile(r"\s\s").search

    def plain(self, column: pa.Array) -> np.ndarray:
        """Which texts are cut at their blanks."""
        return plain_texts(column, self.run)

    def after_blank(self, part: str) -> list[str]:
        """The words of a blank and a part."""
        if part.isalpha():
            return [" " + part]
        if part[:-1].isalpha() and part[-1] in ".,:;!?":
            return [" " + part[:-1], part[-1]]
        return self.find(" " + part)


def _count_words(pattern: str):
    @lean
    @uncollected
    def run(batches):
        from collections import Counter

        split = Splitter(pattern)
        for batch in batches:
            for _, column in text_slices(batch.column(0), 12 << 20):
                words: Counter = Counter()
                plain = split.plain(column)
                lists = pc.split_pattern(pc.if_else(pa.array(plain), column, pa.scalar("", column.type)), " ")
                first = pc.if_else(pa.array(plain), pc.list_element(lists, 0), column)
                for text in first.to_pylist():
                    words.update(split.find(text))
                # what follows the first blank of each text; a text without a blank gives nothing
                parts = pc.value_counts(pc.list_flatten(pc.list_slice(lists, 1, return_fixed_size_list=False)))
                part, n = parts.field(0), parts.field(1)
                unit, cut, plain = simple_parts(part)
                for p, k in zip(part.filter(pc.invert(plain)).to_pylist(), n.filter(pc.invert(plain)).to_pylist(), strict=True):
                    for w in split.find(" " + p):
                        words[w] += k
                keys = [pc.binary_join_element_wise("", unit.filter(plain), " "), pc.utf8_slice_codeunits(part.filter(cut), -1), pa.array(words.keys(), pa.string())]
                table = pa.table({"word": pa.concat_arrays(keys), "n": pa.concat_arrays([n.filter(plain), n.filter(cut), pa.array(words.values(), pa.int64())])})
                pa.default_memory_pool().release_unused()
                for batch_ in table.group_by("word").aggregate([("n", "sum")]).to_batches(50_000):
                    yield pa.RecordBatch.from_arrays([batch_.column("word").cast(pa.binary()), batch_.column("n_sum")], ["word", "n"])

    return run


class HotWords:
    """A compact dictionary of words (binary) and their ids: hashes of 64 and of 32 bits in order, and the ids in one block."""

    def __init__(self, words: np.ndarray, checks: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        """Hashes, second hashes, numbers of ids and all ids of the words."""
        order = np.argsort(words, kind="stable")
        ends = np.cumsum(counts)
        self.hashes, self.checks = words[order], checks[order]
        self.size, self.start = counts[order].astype(np.uint16), (ends - counts)[order].astype(np.uint32)
        self.ids = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")

    @staticmethod
    def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_64_intdigest, xxh32_intdigest

        return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit integers, None for a word that is missing."""
        if not len(self.hashes) or not words:
            return [None] * len(words)
        hashes, checks = self.hashed(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = (self.hashes[at] == hashes) & (self.checks[at] == checks)
        size = np.where(known, self.size[at], 0).astype(np.int64)
        ends = np.cumsum(size)
        raw = self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])].astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] if k else None for k, a, b in zip(known.tolist(), (ends - size).tolist(), ends.tolist(), strict=True)]


#: Stands in a text's ids for a word that the dictionary lacks; cut to 16 bits where ids have as many.
MARK = 0xFFFFFFFF


def id_kind(path: str) -> str:
    """How ids stand between the two passes: in 16 bits if they fit and the mark is none of them."""
    return "<u2" if max(load_ranks(path).values()) < 0xFFFF else "<u4"


class HotEncoder(TextEncoder):
    """Ids of texts from the dictionary, with a mark for each rare word.

    The dictionary is its only memo: a unit is looked up anew in every call, which
    costs less than to remember it, and nothing grows with the texts.
    """

    #: The pattern can take a line feed with the marks before it.
    cut_lines = False

    def __init__(self, pattern: str, path: str, hot: HotWords):
        self.path = path
        self.split, self.hot, self.mark = Splitter(pattern), hot, MARK.to_bytes(4, "little")
        self.run, self.mark_text = self.split.run, MARKS
        self.marked = self._known([[m] for m in self.mark_text])
        #: The rare words of the table's entries in this call, in three runs: units, marks, first parts.
        self.rare: list[list[tuple]] = []

    def _ids(self, words: list[str]) -> list[bytes | None]:
        """Ids of words, None for a rare one."""
        raw = [w.encode() for w in words]
        return [np.asarray(merge_long(x, self.path), "<u4").tobytes() if len(x) > LONG else i for x, i in zip(raw, self.hot.find(raw), strict=True)]

    def _known(self, parts: list[list[str]]) -> list[tuple[bytes, tuple]]:
        """Ids of parts given as lists of their words, and their rare words."""
        words = list({w for p in parts for w in p})
        ids, mark = dict(zip(words, self._ids(words), strict=True)), self.mark
        return [(b"".join([ids[w] or mark for w in p]), tuple([w for w in p if ids[w] is None])) for p in parts]

    def _noted(self, found: list[tuple[bytes, tuple]]) -> list[bytes]:
        self.rare.append([r for _, r in found])
        return [i for i, _ in found]

    def _resolve(self, units: list[str]) -> list[bytes]:
        # most units are letters, and so one word with their blank
        alone = np.fromiter(map(str.isalpha, units), bool, len(units))
        words = [" " + u for u in compress(units, alone)]
        found = [(self.mark, (w,)) if i is None else (i, ()) for w, i in zip(words, self._ids(words), strict=True)]
        found += self._known([self.split.after_blank(u) for u in compress(units, ~alone)])
        place = np.where(alone, np.cumsum(alone), len(words) + np.cumsum(~alone)) - 1
        table = self._noted([found[p] for p in place.tolist()])
        self.mark_ids = self._noted(self.marked)
        return table

    def _encode(self, texts: list[str]) -> list[bytes]:
        return self._noted(self._known([self.split.find(t) for t in texts]))

    def rare_words(self) -> tuple[list[str], np.ndarray]:
        """Of the last call: the rare words in the order of their marks, and how many each text has."""
        entries, begins = self.used
        rare = [r for run in self.rare for r in run]
        count = np.fromiter(map(len, rare), np.int32, len(rare))[entries]
        own = np.add.reduceat(count, begins) if len(begins) else count
        return [w for e in entries[count > 0].tolist() for w in rare[e]], own


def _encode_hot(pattern: str, path: str, hot, kind: str):
    """Ids (numbers of ``kind``) of each text with a mark for each rare word, the distinct rare words as byte arrays, and which of them each mark means."""

    @lean
    @uncollected
    def run(batches):
        encoder = HotEncoder(pattern, path, hot.value)
        for batch in batches:
            for i, column in text_slices(batch.column(1), 4 << 20):
                encoder.rare = []
                ids, counts = encoder.encode(column)
                rare, own = encoder.rare_words()
                flat, list_ends, places, at = [], [0], [], 0
                for n in own.tolist():
                    words = rare[at : at + n]
                    at += n
                    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                    places += map(number.__getitem__, words)
                    flat += map(str.encode, number)
                    list_ends.append(len(flat))
                word_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int32, len(flat)))]).astype(np.int32)
                pa.default_memory_pool().release_unused()
                words = pa.ListArray.from_arrays(pa.array(word_ends), pa.array(np.frombuffer(b"".join(flat), np.uint8).astype(np.int32)))
                ids = ids.astype(kind)
                ends = np.concatenate([[0], np.cumsum(ids.itemsize * counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(column)),
                        pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                        pa.ListArray.from_arrays(pa.array(list_ends, pa.int32()), words),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(places, pa.int32())),
                    ],
                    ["doc_id", "ids", "rare", "places"],
                )

    return run


def vocabulary_of(path: str) -> list[bytes]:
    """Byte string of each id; unused ids below the largest have none."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _fill_marks(numbers: np.ndarray, places: list[int], folded: list[bytes]) -> bytes:
    """Ids in 32 bits, with those of rare words in place of the marks."""
    ids = numbers.astype("<u4").tobytes()
    if not places:
        return ids
    at = np.flatnonzero(numbers == (MARK & np.iinfo(numbers.dtype).max)).tolist()
    out, begin = [], 0
    for k, p in zip(at, places, strict=True):
        out += (ids[4 * begin : 4 * k], folded[p])
        begin = k + 1
    return b"".join([*out, ids[4 * begin :]])


def _put_together(path: str, digests: bool, kind: str):
    @lean
    def run(batches):
        piece = vocabulary_of(path).__getitem__
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                lists, places = batch.column(3), batch.column(2)
                flat = lists.flatten()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(flat).to_numpy(zero_copy_only=False))]).astype(np.int64).tolist()
                numbers = flat.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
                folded = [numbers[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
                rows, at = [], 0
                for ids, p, n in zip(batch.column(1).to_pylist(), places.to_pylist(), pc.list_value_length(lists).to_pylist(), strict=True):
                    rows.append(_fill_marks(np.frombuffer(ids, kind), p, folded[at : at + n]))
                    at += n
                if digests:
                    # decoding concatenates the byte strings of the ids
                    texts = (b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in rows)
                    out = [pa.array([len(x) // 4 for x in rows], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (rows, texts))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    out = [np.frombuffer(x, "<u4").astype(np.int32) for x in rows]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def word_counts(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word binary, n): how often each word stands in all texts."""
    texts = documents_view(docs, id_col, text_col).select("text")
    return texts.mapInArrow(_count_words(pattern), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def hot_dictionary(counts: DataFrame, path: str, hot_words: int) -> HotWords:
    """Ids (little-endian unsigned 32 bits) of the most frequent words, folded by Spark; at most ``hot_words`` entries.

    All words with at least a count are taken, the least count that keeps the
    bound; it comes from the histogram of counts below 4096 and of larger ones by
    their power of two, so that no list of words is sorted.
    """
    n = F.col("n")
    size = F.when(n < 4096, n).otherwise(F.pow(F.lit(2), F.floor(F.log2(n))).cast("bigint"))
    total, least = 0, None
    for size, words in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += words
        if total > hot_words:
            break
        least = size
    least = (1 << 62) if least is None else least
    hot = counts.where((F.col("n") >= least) & (F.length("word") > 0) & (F.length("word") <= 64)).select("word")
    table = hot.select("word", fold_merges(byte_array(F.col("word")), path).cast("array<int>").alias("ids")).toArrow()
    hashes, counts, ids = [], [], []
    for part in table.to_batches(100_000):
        hashes.append(HotWords.hashed(part.column(0).to_pylist()))
        counts.append(pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
        ids.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
    none = np.zeros(0, np.int64)
    return HotWords(*(np.concatenate([none.astype(t), *x]) for t, x in ((np.uint64, [h for h, _ in hashes]), (np.uint32, [c for _, c in hashes]), (np.int64, counts), (np.int64, ids))))


def byte_array(word: Column) -> Column:
    """Numbers of a binary's bytes (not empty)."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int"))


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = 1_000_000,
    digests: bool = False,
) -> DataFrame:
    """(doc_id, ids array<int>) of every text, or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    ``path`` names a ``.tiktoken`` file that all machines have. ``hot_words`` bounds
    the broadcast dictionary (about 30 bytes an entry); any value gives the same ids.
    """
    spark = docs.sparkSession
    counts = saved(word_counts(docs, pattern, id_col, text_col), "word-counts")
    hot = spark.sparkContext.broadcast(hot_dictionary(counts, path, hot_words))
    texts = documents_view(docs, id_col, text_col)
    id_type, kind = texts.schema["doc_id"].dataType.simpleString(), id_kind(path)
    found = texts.mapInArrow(_encode_hot(pattern, path, hot, kind), f"doc_id {id_type}, ids binary, rare array<array<int>>, places array<int>")
    # rare words are folded in the JVM between the two passes over a batch
    folded = found.select("doc_id", "ids", "places", F.transform("rare", lambda w: fold_merges(w, path)).alias("folded"))
    schema = f"doc_id {id_type}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return folded.mapInArrow(_put_together(path, digests, kind), schema)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the byte strings of its ids, concatenated in the JVM.

    A null array decodes to null. An existing column ``decoded`` is replaced.
    """
    vocabulary = F.from_json(F.lit(json.dumps([t.hex() for t in vocabulary_of(path)], separators=(",", ":"))), "array<string>")
    pieces = F.transform(F.array(vocabulary), lambda v: F.transform(F.col(f"`{ids_col}`"), lambda i: F.get(v, i)))[0]
    return encoded.withColumn("decoded", F.unhex(F.array_join(pieces, "")))
