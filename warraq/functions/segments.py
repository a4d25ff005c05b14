"""Re-joining of split or reordered lines to their target lines, as one fold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distance import likeness, may_reach
from .normal import normalised

#: Rows whose lines are normalised at once.
ROWS = 256


def best_merge(target: str, a: str, b: str) -> str:
    """Two segments joined in the order that is more similar to the target, which is normalised; a tie keeps their order."""
    ahead, back = f"{a} {b}", f"{b} {a}"
    x, y = normalised([ahead, back])
    return ahead if x == target or likeness(target, x) >= likeness(target, y) else back


def fold(targets: list, segments: list, goals: list[str], normals: list[str], threshold: float = 0.6) -> list:
    """The lines of one row, from its texts and their normalised forms."""
    at, out = 0, []
    for target, goal in zip(targets, goals, strict=True):
        if at >= len(segments):
            break
        here = segments[at] or ""
        if not target:
            out.append(segments[at])
            at += 1
        elif may_reach(goal, normals[at], threshold) and likeness(goal, normals[at]) >= threshold:
            at += 1
            if here:
                out.append(here)
        elif here:
            following = (segments[at + 1] or "") if at + 1 < len(segments) else ""
            out.append(best_merge(goal, here, following) if following else here)
            at += 2 if following else 1
    return out + segments[at:]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _aligned(targets: pa.Array, segments: pa.Array) -> pa.Array:
    out = []
    for k in range(0, len(targets), ROWS):
        rows = [*zip(targets.slice(k, ROWS).to_pylist(), segments.slice(k, ROWS).to_pylist(), strict=True)]
        normals = iter(normalised([t for row in rows for side in row for t in side]))
        for t, s in rows:
            goals = [next(normals) for _ in t]
            out.append(fold(t, s, goals, [next(normals) for _ in s]))
    return pa.array(out, pa.list_(pa.string()))


def align_segments(targets: Column | str, segments: Column | str) -> Column:
    """array<string>: the segments, of which two that together make a target are one; what targets leave follows unchanged.

    An empty target takes the next segment as it is; an empty segment before another
    target takes no part and is met again by the next target.
    """
    return _aligned(*(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in (targets, segments)))
