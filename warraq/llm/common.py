"""What the operators of this subpackage share: sessions' shared folder, texts in Arrow batches, blocks."""

from __future__ import annotations

import ctypes
import functools
import gc
import platform
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import CLEANUP, saved, shared_dir, shared_path  # noqa: F401

#: The six characters that separate words in the operators' contracts.
WORD_SPACE = " \t\n\x0b\x0c\r"


def if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (of a few dozen bytes); a larger one is joined by a shuffle."""
    return F.broadcast(df) if rows <= most else df


def let_go(*tables: DataFrame) -> None:
    """Removes tables that ``saved`` wrote and that no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are written: it does so once the driver's collectors have run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of one key that a join by shuffling may bring into one task, and keys (some 8 to 64 bytes each) that may be broadcast.
HOT, MOST_HOT = 1000, 1_000_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str | list[str], how: str, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``facts``, which has at most one row for each key (a column or several).

    Keys that more than HOT rows share are joined by a broadcast of their facts: there
    are at most a HOT-th as many as rows, and no more than MOST_HOT are broadcast.
    ``hot`` gives these keys where they are known.
    """
    if hot is None:
        hot = saved(rows.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > HOT).drop("c"), "hot-keys")
    n = hot.count()
    if not 0 < n <= MOST_HOT:
        return rows.join(facts, key, how)
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, how))


def documents_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, the text never null."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: Column) -> Column:
    """A key of a row that is never null; rows that are equal in all ``cols`` share it."""
    return F.xxhash64(*cols)


def binary(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts have about ``most`` bytes together; a longer text has a range of its own."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        n = n or 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(column):
        yield begin, len(column)


def uncollected(run):
    """A function of batches that runs without the collector of cycles: it makes none, and its memo's many small objects are dear to walk."""

    @functools.wraps(run)
    def without(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return without


def lean(run):
    """A function of batches that gives memory back: large arrays are mapped by themselves, and what is free is trimmed at the end.

    A Python worker serves many stages; the C library would otherwise keep, in each
    of an executor's workers, the most that any stage took. Results do not depend on it.
    """

    @functools.wraps(run)
    def leaner(batches):
        libc = ctypes.CDLL(None) if platform.libc_ver()[0] == "glibc" else None
        if libc is not None:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return leaner
