"""Global alignment of token sequences.

Tokens are normalised by Spark's own functions; scores and the walk over their table are
numpy's, in Arrow batches. The edit distances of many pairs of distinct forms are
computed at once, and a row of the table needs no loop over its cells: the best way to a
cell from the left is a running maximum of score and place. Of a large table only every
k-th row stays, k being about the root of their number; the traceback computes the rows
between two of them again, from the last to the first, so that memory grows with the
tokens times that root. Small tables of a batch are filled in lock step, and the distances
of all their words are computed together.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import GAP, MISMATCH, PERFECT, SOFT
from .sanitize import sanitize_array

PAIR = "array<struct<a:string,b:string>>"
#: Steps of an alignment: both tokens, the first alone, the second alone.
BOTH, FIRST, SECOND = 0, 1, 2


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each and filled up with what no text has, and their lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full((len(words), int(size.max(initial=0))), 0xFFFFFFFF, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def _letters(codes: np.ndarray) -> np.ndarray:
    """A bit for the remainder of each of a word's code points; the filling has none."""
    bits = np.where(codes == 0xFFFFFFFF, np.uint64(0), np.uint64(1) << (codes % 64).astype(np.uint64))
    return np.bitwise_or.reduce(bits, axis=1)


def distances(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of words in rows, all pairs at once."""
    kind = np.int16 if max(x.shape[1], y.shape[1]) < 1 << 14 else np.int32
    # pairs stand side by side, so that a step along the words is one over all pairs
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    place = np.arange(len(y) + 1, dtype=kind)[:, None]
    row, out = np.repeat(place, x.shape[1], axis=1), ny.astype(np.int32)
    for i in range(len(x)):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (x[i] != y), out=new[1:])
        new -= place
        row = np.minimum.accumulate(new, axis=0, out=new)
        row += place
        done = np.flatnonzero(nx == i + 1)
        out[done] = row[ny[done], done]
    return out


class Scores:
    """Scores of the tokens of two sequences, by the distinct (token, form) of each."""

    #: Scores that are kept, and cells of distances that are computed at once.
    KEPT, CELLS = 1 << 22, 1 << 18

    def __init__(self, a: Sequence, b: Sequence, na: Sequence, nb: Sequence, symbols: Sequence[str], threshold: float):
        self.threshold, self.known = threshold, {}
        self.rows, self.columns = {}, {}
        self.a = np.asarray([self.rows.setdefault((t in symbols, n), len(self.rows)) for t, n in zip(a, na, strict=True)], np.int64)
        self.b = np.asarray([self.columns.setdefault((t in symbols, n), len(self.columns)) for t, n in zip(b, nb, strict=True)], np.int64)
        self.symbol_a, self.symbol_b = (np.asarray([s for s, _ in d], bool) for d in (self.rows, self.columns))
        self.x, self.nx = _codes([n for _, n in self.rows])
        self.y, self.ny = _codes([n for _, n in self.columns])
        self.bits_a, self.bits_b = _letters(self.x), _letters(self.y)

    def _of(self, rows: np.ndarray) -> np.ndarray:
        """Scores of some distinct first tokens with all distinct second ones."""
        longest = np.maximum(np.maximum(self.nx[rows][:, None], self.ny[None, :]), 1)
        # a letter that only one of two words has, and a difference in length, are edits
        bits = self.bits_a[rows][:, None], self.bits_b[None, :]
        gap = np.maximum(np.bitwise_count(bits[0] & ~bits[1]), np.bitwise_count(bits[1] & ~bits[0]))
        gap = np.maximum(gap, np.abs(self.nx[rows][:, None] - self.ny[None, :]))
        out = np.where(self.symbol_a[rows][:, None] | self.symbol_b[None, :], SOFT, MISMATCH).astype(np.int8)
        i, j = np.nonzero(gap <= np.maximum((1 - self.threshold) * longest, 0) + 1e-9)
        order = np.argsort(longest[i, j], kind="stable")
        i, j = i[order], j[order]
        begin = 0
        while begin < len(i):
            step = max(1, self.CELLS // (int(longest[i[begin], j[begin]]) + 1))
            k = slice(begin, begin + step)
            wide = int(longest[i[k], j[k]].max())
            r = rows[i[k]]
            d = distances(self.x[r][:, :wide], self.nx[r], self.y[j[k]][:, :wide], self.ny[j[k]])
            best = longest[i[k], j[k]]
            score = out[i[k], j[k]]
            score[(best - d) / best >= self.threshold] = SOFT
            score[(d == 0)] = PERFECT
            out[i[k], j[k]] = score
            begin += step
        return out

    def row(self, i: int) -> np.ndarray:
        """Scores of the ``i``-th first token with all second ones."""
        r = int(self.a[i])
        if r not in self.known:
            # some of the following tokens with it, as many as are computed at once
            width = max(1, self.CELLS // max(8 * len(self.ny), 1))
            some = np.asarray([k for k in dict.fromkeys(self.a[i : i + 4 * width].tolist()) if k not in self.known][:width])
            if (len(self.known) + len(some)) * len(self.ny) > self.KEPT:
                self.known = {}
            self.known |= zip(some.tolist(), self._of(some), strict=True)
        return self.known[r][self.b]


def _next_row(above: np.ndarray, score: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores of a row and the best step into each of its cells but the first; ties prefer both tokens, then the first alone."""
    both, up = above[:-1] + score, above[1:] + GAP
    reached = np.empty_like(above)
    reached[0] = above[0] + GAP
    np.maximum(both, up, out=reached[1:])
    row = np.maximum.accumulate(reached - GAP * place) + GAP * place
    step = np.where(both == row[1:], BOTH, np.where(up == row[1:], FIRST, SECOND)).astype(np.uint8)
    return row, step


def alignment_steps(a: Sequence, b: Sequence, na: Sequence, nb: Sequence, symbols: Sequence[str] = (), threshold: float = 0.6, keep: int | None = None) -> np.ndarray:
    """The steps of the best global alignment of tokens ``a`` and ``b`` with their normalised forms, from the first to the last.

    ``keep`` rows lie between two that stay (default: about the root of their number).
    """
    m, n = len(a), len(b)
    if not m or not n:
        return np.full(m + n, FIRST if m else SECOND, np.uint8)
    scores, place = Scores(a, b, na, nb, symbols, threshold), np.arange(n + 1, dtype=np.int64)
    keep = keep or (m if m * n <= 1 << 20 else isqrt(m) + 1)
    stay, row = [], GAP * place
    for i in range(m):
        if i % keep == 0:
            stay.append(row)
        if i < (len(range(0, m, keep)) - 1) * keep:
            row, _ = _next_row(row, scores.row(i), place)
    out, i, j = [], m, n
    for block in range(len(stay) - 1, -1, -1):
        first, steps, row = block * keep, [], stay.pop()
        for k in range(first, i):
            row, step = _next_row(row, scores.row(k), place)
            steps.append(step)
        while i > first:
            step = int(steps[i - 1 - first][j - 1]) if j else FIRST
            out.append(step)
            i -= step != SECOND
            j -= step != FIRST
    out += [SECOND] * j
    return np.asarray(out[::-1], np.uint8)


#: Cells of a table that is filled together with others, and of all tables of a group.
SMALL, GROUP = 1 << 18, 1 << 22


def _together(items: list[tuple[Sequence, Sequence, Sequence, Sequence]], symbols: Sequence[str], threshold: float) -> list[np.ndarray]:
    """``alignment_steps`` of some small pairs of sequences, whose tables are filled in lock step."""
    known: dict[str, int] = {}
    ids = [tuple(np.asarray([known.setdefault(n, len(known)) for n in side], np.int64) for side in x[2:]) for x in items]
    codes, size = _codes([*known])
    order = np.sort(np.where(codes == 0xFFFFFFFF, 0xFFFFFFFF, codes % 64), axis=1)
    # a bit for each letter, another for one that is there again
    again = np.zeros(order.shape, bool)
    again[:, 1:] = order[:, 1:] == order[:, :-1]
    bit = np.where(order == 0xFFFFFFFF, np.uint64(0), np.uint64(1) << (order % 64).astype(np.uint64))
    once, twice = _letters(codes), np.bitwise_or.reduce(np.where(again, bit, np.uint64(0)), axis=1)
    tables, places, keys = [], [], []
    for (a, b, _, _), (i, j) in zip(items, ids, strict=True):
        sa, sb = (np.asarray([t in symbols for t in side], bool) for side in (a, b))
        tables.append(np.where(sa[:, None] | sb[None, :], SOFT, MISMATCH).astype(np.int8))
        longest = np.maximum(np.maximum(size[i][:, None], size[j][None, :]), 1)
        less = np.zeros(longest.shape, np.int64), np.zeros(longest.shape, np.int64)
        for bits in (once, twice):
            x, y = bits[i][:, None], bits[j][None, :]
            less = less[0] + np.bitwise_count(x & ~y), less[1] + np.bitwise_count(y & ~x)
        gap = np.maximum(np.maximum(*less), np.abs(size[i][:, None] - size[j][None, :]))
        r, c = np.nonzero(gap <= np.maximum((1 - threshold) * longest, 0) + 1e-9)
        places.append((r, c))
        keys.append(i[r] * len(known) + j[c])
    pairs, back = np.unique(np.concatenate(keys), return_inverse=True)
    x, y = pairs // max(len(known), 1), pairs % max(len(known), 1)
    longest, score = np.maximum(np.maximum(size[x], size[y]), 1), np.zeros(len(pairs), np.int8)
    score[x == y] = PERFECT
    todo = np.flatnonzero(x != y)
    todo = todo[np.argsort(longest[todo], kind="stable")]
    begin = 0
    while begin < len(todo):
        k = todo[begin : begin + max(1, Scores.CELLS // (int(longest[todo[begin]]) + 1))]
        wide = int(longest[k].max())
        d = distances(codes[x[k]][:, :wide], size[x[k]], codes[y[k]][:, :wide], size[y[k]])
        score[k] = np.where((longest[k] - d) / longest[k] >= threshold, SOFT, 0)
        begin += len(k)
    m, n = max(len(x[0]) for x in items), max(len(x[1]) for x in items)
    scores, at = np.zeros((m, n, len(items)), np.int8), 0
    for k, ((r, c), table) in enumerate(zip(places, tables, strict=True)):
        found = score[back[at : at + len(r)]]
        table[r[found != 0], c[found != 0]] = found[found != 0]
        scores[: table.shape[0], : table.shape[1], k] = table
        at += len(r)
    place = np.arange(n + 1, dtype=np.int32)[:, None]
    row, steps = np.repeat(GAP * place, len(items), axis=1), np.empty((m, n, len(items)), np.uint8)
    for i in range(m):
        both, up, first = row[:-1] + scores[i], row[1:] + GAP, row[:1] + GAP
        row = np.concatenate([first, np.maximum(both, up)]) - GAP * place
        row = np.maximum.accumulate(row, axis=0) + GAP * place
        steps[i] = np.where(both == row[1:], BOTH, np.where(up == row[1:], FIRST, SECOND))
    found = []
    for k, (a, b, _, _) in enumerate(items):
        i, j, out = len(a), len(b), []
        table = steps[:i, :j, k].tolist()
        while i and j:
            step = table[i - 1][j - 1]
            out.append(step)
            i -= step != SECOND
            j -= step != FIRST
        found.append(np.asarray((out + [FIRST] * i + [SECOND] * j)[::-1], np.uint8))
    return found


def many_steps(items: list[tuple[Sequence, Sequence, Sequence, Sequence]], symbols: Sequence[str] = (), threshold: float = 0.6) -> list[np.ndarray]:
    """``alignment_steps`` of each (a, b, na, nb); small ones of about the same size together."""
    out, small = [None] * len(items), []
    for k, (a, b, na, nb) in enumerate(items):
        if len(a) and len(b) and len(a) * len(b) <= SMALL:
            small.append(k)
        else:
            out[k] = alignment_steps(a, b, na, nb, symbols, threshold)
    small.sort(key=lambda k: (len(items[k][0]), len(items[k][1])))
    group, wide = [], 0
    for k in [*small, None]:
        if k is not None:
            wide = max(wide, len(items[k][1]))
        # the last has the most tokens on its first side
        if group and (k is None or (len(group) + 1) * len(items[k][0]) * wide > GROUP):
            for g, steps in zip(group, _together([items[g] for g in group], symbols, threshold), strict=True):
                out[g] = steps
            group, wide = [], len(items[k][1]) if k is not None else 0
        group.append(k)
    return out


def backtrack(steps: np.ndarray, a: Sequence, b: Sequence) -> tuple[list, list]:
    """Both sides of the pairs along the steps; a gap is null."""
    left, right = np.full(len(steps), None, object), np.full(len(steps), None, object)
    left[steps != SECOND] = np.asarray([*a, None], object)[:-1]
    right[steps != FIRST] = np.asarray([*b, None], object)[:-1]
    return left.tolist(), right.tolist()


def align_tokens(a: Column | str, b: Column | str, symbols: Sequence[str] = (), threshold: float = 0.6) -> Column:
    """array<struct<a,b>>: the best global alignment of two arrays of tokens; a null array is an empty one."""
    symbols, kind = tuple(symbols), pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))

    @F.arrow_udf(PAIR)
    def aligned(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        ends, left, right = [0], [], []
        for k in range(0, len(a), 1024):
            items = [*zip(*(c.slice(k, 1024).to_pylist() for c in (a, b, na, nb)), strict=True)]
            for (x, y, _, _), steps in zip(items, many_steps(items, symbols, threshold), strict=True):
                for side, own in zip((left, right), backtrack(steps, x, y), strict=True):
                    side += own
                ends.append(len(left))
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(kind)

    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in (a, b))
    return aligned(x, y, sanitize_array(x), sanitize_array(y))
