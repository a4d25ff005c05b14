"""The operators on streams: those of single rows as they are, the the index of pages and its search batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions.noise import is_noise
from ..functions.sanitize import SanitizeOptions, sanitize
from ..operators.page_index import PageIndex, open_index, search_index
from ..operators.search import passing_index
from ..plans.policy import DEFAULT_POLICY, MatchPolicy
from ..sources.shared import scratch


def transform_stream(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A stream with columns added; the expressions hold no state."""
    return stream.withColumns(columns)


def clean_lines(stream: DataFrame, text_col: str = "text", options: str | SanitizeOptions = "search") -> DataFrame:
    """A stream of lines without noise, its text normalised."""
    return stream.where(~is_noise(text_col)).withColumn(text_col, sanitize(text_col, options))


def search_stream(excerpts: DataFrame, pages: DataFrame | PageIndex, write: Callable[[DataFrame, int], None], policy: MatchPolicy = DEFAULT_POLICY):
    """A stream writer that searches each batch of excerpts in an index of pages and hands the matches to ``write``.

    Pages that are given as a table are indexed once, before the stream begins. A
    batch reads the parts of the index that its excerpts need; what it writes on its
    way goes when ``write`` returns.
    """
    index = pages if isinstance(pages, PageIndex) else passing_index(pages, policy)

    def search(batch: DataFrame, epoch: int) -> None:
        with scratch():
            write(search_index(index, batch, policy), epoch)

    return excerpts.writeStream.foreachBatch(search)


def index_stream(pages: DataFrame, path: str, merge_every: int = 16):
    """A stream writer that adds each batch of pages to the index at ``path``, and folds it when it has ``merge_every`` generations.

    A batch that is tried again after a failure is not added twice.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        index = open_index(batch.sparkSession, path).add(batch, epoch)
        if len(index.generations) >= merge_every:
            index.merge()

    return pages.writeStream.foreachBatch(add)
