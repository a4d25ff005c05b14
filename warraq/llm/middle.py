"""Fill-in-the-middle transformation of documents, by succinct rank and select.

A document is cut into units (runs of ASCII letters, and every other code point). A
bitvector over its UTF-8 bytes has a one where a unit begins; a directory holds the
number of ones before each block of BLOCK bits. The total popcount is the number of
units n, and the k-th cut is ``select(k)``: the block by a search in the directory, the
word in the block by popcounts, the bit in the word. A second bitvector, of the bytes
that begin code points, turns byte cuts into characters by ``rank``. One pair of
bitvectors serves all texts of a slice of a batch; a text's ranks count from the rank
of its first byte. Two selects a document give the three parts; nothing is shuffled.

Which document is transformed, where it is cut and in which of the two orders it is
written follow from a hash of a seed and its id alone, so that a task that runs again
gives the same rows.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and
those that the rate leaves out are plain: their output is the text; a null id is hashed
as an empty string; rows of equal id and text have equal results; an empty table gives
an empty table; other columns are ignored. A text longer than a slice is one slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_view, lean, slices

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits that one entry of the directory covers, and bytes of texts of a slice.
BLOCK, SLICE = 512, 4 << 20


class RankSelect:
    """Ones of a packed bitvector: their number before a place, and the place of each."""

    def __init__(self, bits: np.ndarray):
        """``bits``: one bool for each place."""
        self.size = len(bits)
        words = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([words, np.zeros(-len(words) % (BLOCK // 8) + BLOCK // 8, np.uint8)]).view(np.uint64)
        self.counts = np.bitwise_count(self.words).reshape(-1, BLOCK // 64)
        self.directory = np.concatenate([[0], np.cumsum(self.counts.sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place; places go from 0 to the size."""
        block, word = at // BLOCK, at // 64
        within = self.counts[block].cumsum(axis=1, dtype=np.int64) - self.counts[block]
        below = self.words[word] & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1))
        return self.directory[block] + np.take_along_axis(within, (word % (BLOCK // 64))[:, None], 1)[:, 0] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that ``k`` others stand before; the size where there is none."""
        inside = k < self.directory[-1]
        k = np.where(inside, k, 0)
        block = np.minimum(np.searchsorted(self.directory, k, "right") - 1, len(self.counts) - 1)
        sums = self.counts[block].cumsum(axis=1, dtype=np.int64)
        left = k - self.directory[block]
        word = np.minimum((sums <= left[:, None]).sum(axis=1), BLOCK // 64 - 1)
        left = left - np.take_along_axis(sums, word[:, None], 1)[:, 0] + self.counts[block, word]
        ones = np.unpackbits(self.words[block * (BLOCK // 64) + word][:, None].view(np.uint8), axis=1, bitorder="little").cumsum(axis=1, dtype=np.int64)
        place = block * BLOCK + word * 64 + (ones <= left[:, None]).sum(axis=1)
        return np.where(inside, place, self.size)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where code points begin in the UTF-8 bytes of texts, which begin at ``starts``."""
    lower = data | 0x20
    letter = (lower >= 97) & (lower <= 122)
    point = (data & 0xC0) != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    unit[starts[starts < len(data)]] = True
    return unit, point


def _cut(column: pa.Array, h1: np.ndarray, h2: np.ndarray):
    """n, and the bytes and characters before both cuts, of each text of a slice."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    unit, point = boundaries(data, starts)
    units, points = RankSelect(unit), RankSelect(point)
    base = units.rank(starts)
    n = units.rank(ends) - base
    a, b = h1 % (n + 1), h2 % (n + 1)
    # the unit after a text's last one begins where the text ends, or the next that is not empty does
    cuts = [np.minimum(units.select(base + k), ends) for k in (np.minimum(a, b), np.maximum(a, b))]
    first, second = (points.rank(c) - points.rank(starts) for c in cuts)
    return n, cuts[0] - starts, cuts[1] - starts, first, second - first


def _transformed(rate: int, spm: int):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    @lean
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            hashes = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            for i, j in slices(column, SLICE):
                part = column.slice(i, j - i)
                h1, h2, h3, h4 = (h[i:j] for h in hashes)
                n, first, second, prefix, middle = _cut(part, h1, h2)
                forms, out = [], []
                for k, text in enumerate(part.cast(pa.large_binary()).to_pylist()):
                    if not text or h3[k] % 100 >= rate or any(m in text for m in marks):
                        forms.append("plain")
                        out.append(text)
                        continue
                    x, y, z = text[: first[k]], text[second[k] :], text[first[k] : second[k]]
                    forms.append("spm" if h4[k] % 100 < spm else "psm")
                    out.append(b"".join((marks[1], y, marks[0], x, marks[2], z) if forms[-1] == "spm" else (marks[0], x, marks[1], y, marks[2], z)))
                plain = np.asarray([f == "plain" for f in forms], bool)
                counts = [pa.array(c, pa.int64(), mask=plain) for c in (prefix, middle)]
                output = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *counts, output], names)

    return run


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``rate`` percent of the documents are transformed, ``spm`` percent of these with
    the suffix first; ``n`` counts units, the two lengths (null where plain) code points.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    return documents_view(docs, id_col, text_col).select("doc_id", "text", *parts).mapInArrow(_transformed(rate, spm), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made: sentinels stand in no text that was transformed, and none arises where parts meet."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = F.when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
    return F.when(form == "plain", output).otherwise(F.coalesce(order, F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))))
