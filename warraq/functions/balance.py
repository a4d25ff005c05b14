"""Balance of brackets and quotes, with places in code points from 0 (null is the empty string).

A closing bracket takes whatever opener stands on top, so that depths alone tell the
pairs: closers without an opener are those at which the running sum of openers less
closers reaches a new minimum; of the others, sorted by depth and then by place, each
closer stands behind its opener. It is done for all lines of a text at once, in time of
a sort; counts of quotes are Spark's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import text

BRACKETS = {"«": "»", "(": ")", "[": "]", "{": "}"}
OPEN_BRACKETS, CLOSE_BRACKETS = frozenset(BRACKETS), frozenset(BRACKETS.values())
_FIELDS = [T.StructField("char", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("type", T.StringType())]
ERROR, LINE_ERROR = (T.StructType([T.StructField(n, T.IntegerType()), *_FIELDS]) for n in ("index", "absolute_index"))
_OPEN, _CLOSE = (np.asarray([ord(c) for c in s], np.uint32) for s in (BRACKETS, BRACKETS.values()))
_REASONS = ("unmatched", "mismatched", "unclosed")
#: Lines of at most so many characters are not looked at.
SHORT_LINE = 10


def bracket_faults(codes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, reason) of brackets without their partners, each line by itself; ``line`` ascends along the code points.

    The order is that in which reading finds them: at a closer it and, if it does not
    fit, the opener before it; at a line's end the openers that are left.
    """
    place = np.flatnonzero(np.isin(codes, _OPEN) | np.isin(codes, _CLOSE))
    if not len(place):
        return place, place
    opens, own = np.isin(codes[place], _OPEN), line[place]
    n = len(place) + 1
    # lines begin further and further down, so that the minimum of one is below all of those before
    first = np.flatnonzero(np.diff(own, prepend=-1))
    step = np.where(opens, 1, -1)
    total = np.cumsum(step)
    ground = np.repeat(total[first] - step[first], np.diff(first, append=n - 1))
    number = np.repeat(np.arange(len(first)), np.diff(first, append=n - 1))
    height = total - ground - number * n
    lowest = np.minimum.accumulate(np.concatenate([[n], height]))[:-1]
    alone = ~opens & (height < np.minimum(lowest, -number * n))

    # without these the running sum of a line is the depth
    step[alone] = 0
    total = np.cumsum(step)
    depth = total - np.repeat(total[first] - step[first], np.diff(first, append=n - 1))
    rest = np.flatnonzero(~alone)
    level = (depth + ~opens)[rest]
    order = np.lexsort((np.arange(len(rest)), level, number[rest]))
    mark, lev, lin = rest[order], level[order], number[rest][order]
    paired = np.zeros(len(mark), bool)
    paired[:-1] = opens[mark[:-1]] & ~opens[mark[1:]] & (lev[:-1] == lev[1:]) & (lin[:-1] == lin[1:])
    left, right = mark[:-1][paired[:-1]], mark[1:][paired[:-1]]
    kinds = np.sort(_OPEN), np.argsort(_OPEN)
    partner = _CLOSE[kinds[1][np.searchsorted(kinds[0], codes[place[left]])]]
    wrong = partner != codes[place[right]]
    left, right = left[wrong], right[wrong]
    unclosed = np.sort(mark[opens[mark] & ~paired])
    lonely = np.flatnonzero(alone)
    found = np.concatenate([lonely, left, right, unclosed])
    reason = np.repeat([0, 1, 1, 2], [len(lonely), len(left), len(right), len(unclosed)])
    time = np.concatenate([lonely, right, right, np.full(len(unclosed), n)])
    order = np.lexsort((found, time, number[found]))
    return place[found[order]], reason[order]


def _codes(x: str | None) -> np.ndarray:
    return np.frombuffer((x or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _listed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], index: str) -> pa.Array:
    """Errors (place, code point, reason, is a quote) of each row as lists of structs."""
    ends = np.cumsum([0, *(len(f[0]) for f in found)])
    place, code, reason, quote = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    chars = pa.array(list(code.astype(np.uint32).tobytes().decode("utf-32-le")), pa.string())
    kinds = [pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(of)).cast(pa.string()) for at, of in ((reason, _REASONS), (quote, ("bracket", "quote")))]
    structs = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), chars, *kinds], [index, "char", "reason", "type"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


@F.arrow_udf(T.ArrayType(ERROR))
def _bracket_errors(texts: pa.Array) -> pa.Array:
    found = []
    for x in texts.to_pylist():
        codes = _codes(x)
        place, reason = bracket_faults(codes, np.zeros(len(codes), np.int8))
        found.append((place, codes[place], reason, np.zeros(len(place), np.int8)))
    return _listed(found, "index")


@F.arrow_udf(T.ArrayType(LINE_ERROR))
def _line_errors(texts: pa.Array) -> pa.Array:
    found = []
    for x in texts.to_pylist():
        codes = _codes(x)
        breaks = codes == 10
        line = np.cumsum(breaks) - breaks
        long = np.bincount(line[~breaks], minlength=int(line[-1]) + 1 if len(line) else 0) > SHORT_LINE
        looked = np.where(long[line] & ~breaks, codes, 0) if len(codes) else codes
        place, reason = bracket_faults(looked, line)
        # the last quote of a line that has an odd number
        quotes = np.flatnonzero(looked == 34)
        odd = np.flatnonzero(np.bincount(line[quotes]) % 2) if len(quotes) else quotes
        last = quotes[np.searchsorted(line[quotes], odd, "right") - 1] if len(quotes) else quotes
        places, reasons = np.concatenate([place, last]), np.concatenate([reason, np.zeros(len(last), np.int64)])
        is_quote = np.repeat([0, 1], [len(place), len(last)])
        order = np.argsort(places, kind="stable")
        found.append((places[order], codes[places[order]], reasons[order], is_quote[order]))
    return _listed(found, "absolute_index")


def _error(index: Column, char: Column, reason: str, kind: str) -> Column:
    return F.struct(index.cast("int").alias("index"), char.alias("char"), F.lit(reason).alias("reason"), F.lit(kind).alias("type"))


def _none() -> Column:
    return F.array().cast(T.ArrayType(ERROR))


def quote_errors(col: Column | str) -> Column:
    """The last of an odd number of quotes."""
    x = text(col)
    odd = F.regexp_count(x, F.lit('"')) % 2 == 1
    last = F.length(x) - F.instr(F.reverse(x), '"')
    return F.when(odd, F.array(_error(last, F.lit('"'), "unmatched", "quote"))).otherwise(_none())


def bracket_errors(col: Column | str) -> Column:
    """Closing brackets without an opener, pairs of different kinds (opener first), then openers left open."""
    return _bracket_errors(text(col))


def check_balance(col: Column | str) -> Column:
    """(errors, is_balanced): the errors of both kinds by their places."""
    errors = F.array_sort(F.concat(quote_errors(col), bracket_errors(col)))
    return F.struct(errors.alias("errors"), (F.size(errors) == 0).alias("is_balanced"))


def are_quotes_balanced(col: Column | str) -> Column:
    """Whether the number of quotes is even."""
    return F.regexp_count(text(col), F.lit('"')) % 2 == 0


def are_brackets_balanced(col: Column | str) -> Column:
    """Whether every bracket has its partner."""
    return F.size(bracket_errors(col)) == 0


def is_balanced(col: Column | str) -> Column:
    """Whether quotes and brackets are balanced."""
    return are_quotes_balanced(col) & are_brackets_balanced(col)


def unbalanced_errors(col: Column | str) -> Column:
    """Errors of all lines of more than SHORT_LINE characters by their places, counted from the start of the text."""
    return _line_errors(text(col))
