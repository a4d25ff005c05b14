"""Grams of texts without a row for each of them: counted where the texts are, or told only where wanted ones stand.

A task marks wanted grams by their slots, bits of a hash; what else falls into a slot is
told apart by the join that follows. So neither pass grows with the wanted grams, and
only sums and wanted places leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a slot, and characters of texts that are looked at once.
SLOT_BITS, SLICE = 22, 1 << 21


def slots(codes: np.ndarray, q: int) -> np.ndarray:
    """The slot of the gram at each place of ``codes``."""
    n = len(codes) - q + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(q if n > 0 else 0):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots_of(q: int):
    def run(batches):
        for batch in batches:
            codes = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(codes, q)[::q]))], ["slot"])

    return run


def wanted_slots(grams: DataFrame, q: int):
    """A broadcast of the slots of ``grams`` (gram, ...), however many there are: a byte each."""
    rows = grams.select("gram").where(F.length("gram") == q).distinct().mapInArrow(_slots_of(q), "slot bigint").distinct().toArrow()  # 2 ** SLOT_BITS numbers at most
    marked = np.zeros(1 << SLOT_BITS, bool)
    marked[rows["slot"].to_numpy()] = True
    return grams.sparkSession.sparkContext.broadcast(marked)


def _sliced(batch: pa.RecordBatch):
    """Parts of a batch of about SLICE characters; a longer text is a part of its own."""
    sizes = np.cumsum([len(t) for t in batch.column(6).to_pylist()])
    cut = np.flatnonzero(np.diff(sizes // SLICE, prepend=0)).tolist() if len(sizes) else []
    return [batch.slice(a, b - a) for a, b in zip([0, *cut], [*cut, len(sizes)], strict=True) if b > a]


def _marked(batch: pa.RecordBatch, marked: np.ndarray, q: int):
    """Codes of the texts, and of each place whose gram's slot is marked the place in them, its row and its place in the row."""
    texts = [t.encode("utf-32-le") for t in batch.column(6).to_pylist()]
    size = np.asarray([len(t) // 4 for t in texts])
    codes = np.frombuffer(b"".join(texts), np.uint32)
    at = np.flatnonzero(marked[slots(codes, q)])
    ends = np.cumsum(size)
    row = np.searchsorted(ends, at, "right")
    within = at - (ends - size)[row]
    low, high = (batch.column(k).to_numpy() for k in (4, 5))
    stay = (within >= low[row]) & (within < np.minimum(high, size - q + 1)[row])
    return codes, at[stay], row[stay], within[stay]


def _strings(codes: np.ndarray, q: int) -> pa.Array:
    text = codes.tobytes().decode("utf-32-le")
    return pa.array([text[k : k + q] for k in range(0, len(text), q)], pa.string())


def _counts(q: int, marked):
    def run(batches):
        for part in (p for b in batches for p in _sliced(b)):
            codes, at, row, _ = _marked(part, marked.value, q)
            if not len(at):
                continue
            books, kind = part.column(0).dictionary_encode(), part.column(1).to_numpy().astype(np.int64)
            home = books.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 3 + kind
            letters = np.unique(codes)
            number = np.searchsorted(letters, codes)
            key, base = np.zeros(len(at), np.int64), len(letters)
            if base**q * (int(home.max()) + 1) < 1 << 63:
                # the number of home and gram by its digits
                key += home[row]
                for k in range(q):
                    key = key * base + number[at + k]
                key, n = np.unique(key, return_counts=True)
                digits = np.empty((len(key), q), np.int64)
                for k in range(q - 1, -1, -1):
                    key, digits[:, k] = key // base, key % base
                grams = letters[digits]
            else:
                key = home[row]
                for k in range(q):
                    # numbers of what occurs, so that they stay small
                    key = np.unique(key * base + number[at + k], return_inverse=True)[1]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                key, grams = home[row[first]], codes[at[first][:, None] + np.arange(q)]
            own = books.dictionary.take(pa.array(key // 3))
            yield pa.RecordBatch.from_arrays([own, pa.array((key % 3).astype(np.int8)), _strings(np.ascontiguousarray(grams), q), pa.array(n.astype(np.int64))], ["book_id", "kind", "gram", "freq"])

    return run


def _found(q: int, marked):
    def run(batches):
        for part in (p for b in batches for p in _sliced(b)):
            codes, at, row, within = _marked(part, marked.value, q)
            for k in range(0, len(at), 1 << 16):
                some, rows = at[k : k + (1 << 16)], row[k : k + (1 << 16)]
                take = pa.array(rows)
                pos = within[k : k + (1 << 16)] + part.column(3).to_numpy()[rows]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), _strings(codes[some[:, None] + np.arange(q)], q), part.column(2).take(take), pa.array(pos.astype(np.int32))], ["book_id", "kind", "gram", "idx", "pos"])

    return run


def _kind(texts: DataFrame) -> str:
    return texts.schema["book_id"].dataType.simpleString()


def counted(texts: DataFrame, grams: DataFrame, q: int) -> DataFrame:
    """(book_id, kind, gram, freq): rows to be summed, how often texts (book_id, kind, idx, base, low, high, text) have the ``grams`` (gram, ...) that begin from ``low`` to before ``high``."""
    rows = texts.mapInArrow(_counts(q, wanted_slots(grams, q)), f"book_id {_kind(texts)}, kind tinyint, gram string, freq bigint")
    return rows.join(grams.select("gram").distinct(), "gram", "left_semi")


def places(texts: DataFrame, grams: DataFrame, q: int) -> DataFrame:
    """``grams`` (book_id, gram, ...) with (kind, idx, pos) of each place in such texts, counted from ``base``."""
    rows = texts.mapInArrow(_found(q, wanted_slots(grams, q)), f"book_id {_kind(texts)}, kind tinyint, gram string, idx int, pos int")
    return rows.join(grams, ["book_id", "gram"]).select(*grams.columns, "kind", "idx", "pos")
