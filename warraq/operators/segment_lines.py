"""Re-joining of split or reordered lines over books whose lines do not fit in one row.

The rows of ``functions.segments.align_segments``, for targets and segments that are tables
of lines. A line's place is the number of characters before it on its side, a running
sum over ranges. Each segment meets the one that follows it by its number, and what
they make together is normalised there, so that the costly part runs on all tasks.
Then both sides of a document stream by place through one pass, which holds the lines
that wait for their partner and no others: where the two sides have the same text,
that is a line or two.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import edit_distance, likeness, may_reach  # noqa: F401
from ..functions.normal import search_text
from ..functions.patterns import text
from ..sources.shared import kept
from .ranges import ranged

TARGET, SEGMENT = 0, 1


class _Fold:
    """One document: its targets and segments as they come, its lines as soon as they are settled."""

    def __init__(self, targets: int, segments: int, threshold: float):
        self.targets, self.segments, self.threshold = targets, segments, threshold
        self.goals: deque[dict] = deque()
        self.waiting: deque[dict] = deque()
        self.owed = 0  # segments that a merge has used before they came

    def take(self, row: dict) -> Iterator[str | None]:
        if row["side"] == SEGMENT:
            if self.owed:
                self.owed -= 1
            else:
                self.waiting.append(row)
        elif self.segments:
            self.goals.append(row)
        while self.goals and self.waiting:
            self.targets -= 1
            yield from self._step(self.goals.popleft(), self.waiting[0])
        if not self.segments:
            self.goals.clear()
        if not self.targets:
            while self.waiting:
                yield self.waiting.popleft()["text"]

    def _used(self, n: int) -> None:
        self.segments -= n
        self.waiting.popleft()
        if n == 2:
            if self.waiting:
                self.waiting.popleft()
            else:
                self.owed += 1

    def _step(self, target: dict, segment: dict) -> Iterator[str | None]:
        goal, here = target["normal"], segment["text"] or ""
        if not target["text"]:
            self._used(1)
            yield segment["text"]
        elif may_reach(goal, segment["normal"], self.threshold) and likeness(goal, segment["normal"]) >= self.threshold:
            self._used(1)
            if here:
                yield here
        elif here:
            following = segment["following"]
            self._used(2 if following else 1)
            if not following:
                yield here
            elif goal == segment["ahead"] or likeness(goal, segment["ahead"]) >= likeness(goal, segment["back"]):
                yield f"{here} {following}"
            else:
                yield f"{following} {here}"


def _fold(threshold: float):
    def run(batches):
        doc = fold = None
        for batch in batches:
            ids, rows, places, lines = batch.column("id"), [], [], []
            for k, row in enumerate(batch.drop_columns(["id"]).to_pylist()):
                if (row["doc"], row["nameless"]) != doc:
                    doc, fold, n = (row["doc"], row["nameless"]), _Fold(row["targets"], row["segments"], threshold), 0
                for line in fold.take(row):
                    rows.append(k)
                    places.append(n)
                    lines.append(line)
                    n += 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["id", "pos", "line"])

    return run


def align_lines(targets: DataFrame, segments: DataFrame, doc_col: str = "doc_id", line_col: str = "line_no", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """(doc_col, pos from 0, line): the lines that ``align_segments`` makes of each document's segments, in the order of ``line_col``.

    Defined results: a document without targets keeps its segments, one without
    segments has no line; an empty or null target takes the next segment as it is, a
    null one too; lines of equal ``line_col`` stand in the order of their texts, null
    numbers first; null documents are one; other columns are ignored. One document's
    lines pass through one task, which holds no more of them than the two sides
    differ by.
    """
    spark = targets.sparkSession
    kind = targets.schema[doc_col].dataType.simpleString()

    def side(df: DataFrame, number: int) -> DataFrame:
        key = F.col(f"`{doc_col}`").cast(kind)
        return df.select(key.alias("id"), F.coalesce(key.cast("string"), F.lit("")).alias("doc"), key.isNull().alias("nameless"), F.col(f"`{line_col}`").alias("at"), F.col(f"`{text_col}`").alias("text"), F.lit(number).alias("side"))

    def build() -> DataFrame:
        both = side(targets, TARGET).unionByName(side(segments, SEGMENT))
        dealt = ranged(both, ["doc", "nameless", "side"], ["at", "text"], "segment-ranges")
        counts = dealt.rows.groupBy("doc", "nameless").agg(F.count_if(F.col("side") == TARGET).alias("targets"), F.count_if(F.col("side") == SEGMENT).alias("segments"))
        facts = counts.withColumn("side", F.explode(F.array(F.lit(TARGET), F.lit(SEGMENT))))
        return dealt.along(sums={"n": F.lit(1), "place": F.length(text(F.col("text")))}, facts=facts)

    lines = kept(spark, build, "segment-lines").withColumn("n", F.col("n").cast("bigint"))
    near = ["doc", "nameless", "side", "n"]
    following = lines.where(F.col("side") == SEGMENT).select("doc", "nameless", "side", (F.col("n") - 1).alias("n"), text(F.col("text")).alias("following"))
    here, after = text(F.col("text")), F.col("following")
    made = lambda a, b: search_text(F.when(after != "", F.concat_ws(" ", a, b)))
    rows = lines.join(following, near, "left").select("id", "doc", "nameless", "side", "n", "place", "targets", "segments", "text", search_text(here).alias("normal"), "following", made(here, after).alias("ahead"), made(after, here).alias("back"))
    dealt = rows.repartition("doc", "nameless").sortWithinPartitions("doc", "nameless", "place", "side", "n")
    return dealt.mapInArrow(_fold(threshold), f"id {kind}, pos bigint, line string").withColumnRenamed("id", doc_col)
