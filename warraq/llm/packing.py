"""Packing of documents into fixed-length sequences by first-fit decreasing.

Every document is tokenised whole and closed by an end id. Pieces of ``capacity``
ids fill sequences of their own; what is left of each document is packed by
first-fit decreasing, with a tournament tree of the free room of open sequences,
independently in randomised groups of documents. Only piece descriptors are
shuffled, never texts or ids.

Defined results: a null text is an empty text, whose document is the end id
alone; repeated rows are packed once each; an empty table gives no pieces; the
other columns of the table are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view, lean, uncollected
from .tokens import text_encoder, text_slices


class TournamentTree:
    """Largest free room of bins by a complete binary tree; finds the first bin with enough room in log time."""

    def __init__(self, bins: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * (2 * self.size)

    def set(self, bin_: int, room: int) -> None:
        k = bin_ + self.size
        tree = self.room
        tree[k] = room
        while k > 1:
            k >>= 1
            most = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == most:
                break
            tree[k] = most

    def first(self, need: int) -> int:
        """The first bin with at least ``need`` free, or -1."""
        tree = self.room
        if tree[1] < need:
            return -1
        k = 1
        while k < self.size:
            k = 2 * k if tree[2 * k] >= need else 2 * k + 1
        return k - self.size


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the items come in decreasing length, each between 1 and ``capacity``."""
    tree = TournamentTree(len(lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k, need in enumerate(lengths.tolist()):
        at = tree.first(need)
        if at < 0:
            at, opened = opened, opened + 1
            room = capacity
        else:
            room = tree.room[at + tree.size]
        bins[k], offsets[k] = at, capacity - room
        tree.set(at, room - need)
    return bins, offsets


def _cut(path: str, capacity: int, end_id: int, with_ids: bool, memo: int):
    end = np.asarray([end_id], "<u4").tobytes()

    @uncollected
    @lean
    def run(batches):
        encoder = text_encoder(path, memo)
        step = 4 * capacity
        for batch in batches:
            for i, texts in text_slices(batch.column(1), 28 * memo):
                tokens, counts = encoder.encode(texts)
                raw, ends = tokens.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                rows, out, begin = [], [], 0
                for k, stop in enumerate(ends):
                    ids, begin = raw[begin:stop] + end, stop
                    for a in range(0, len(ids), step):
                        piece = ids[a : a + step]
                        rows.append(k)
                        out.append((a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None))
                at = pa.array(rows, pa.int64())
                start, length, crc, total, ids = zip(*out, strict=True)
                own = [batch.column(c).slice(i, len(texts)).take(at) for c in (0, 2)]
                columns = [own[0], *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), own[1]]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] * with_ids)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tie", *["ids"] * with_ids])

    return run


def _pack(capacity: int):
    def run(key, table):
        group = key[0].as_py()
        length, tie, start = (table.column(c).to_numpy() for c in ("length", "tie", "start"))
        order = np.lexsort((start, tie, -length))
        bins, offsets = first_fit_decreasing(length[order], capacity)
        keep = [c for c in table.column_names if c not in ("tie", "part")]
        return table.take(pa.array(order)).select(keep).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_docs: int = 2048,
    with_ids: bool = False,
    memo: int = 600_000,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset).

    ``group_docs`` is about how many documents are packed together: it bounds a
    task's memory and does not depend on the size of the table. ``with_ids`` adds the
    ids of each piece (little-endian unsigned 32-bit integers). ``memo`` is how many
    units a worker's tokenizer remembers (200 bytes each, twice): it trades memory
    for time and changes no result.
    """
    texts = documents_view(docs, id_col, text_col)
    groups = max(1, -(-docs.count() // group_docs))
    kind = texts.schema["doc_id"].dataType.simpleString()
    tied = texts.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit("packing")).alias("tie"))
    base = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    ids = ", ids binary" * with_ids
    pieces = tied.mapInArrow(_cut(path, capacity, end_id, with_ids, memo), f"{base}, tie bigint{ids}")
    grouped = pieces.withColumn("part", F.pmod("tie", F.lit(groups))).groupBy("part")
    return grouped.applyInArrow(_pack(capacity), f"{base}{ids}, sequence_id bigint, offset bigint")
