"""Readers and writers of the tables that the operators take: pages, excerpts, lines, pairs.

Formats are Spark's own (Parquet, ORC, JSON, CSV, plain text); schemas are explicit,
so that nothing is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()
SCHEMAS: dict[str, T.StructType] = {
    "pages": T.StructType([T.StructField("book_id", _S), T.StructField("page", _I), T.StructField("text", _S)]),
    "excerpts": T.StructType([T.StructField("book_id", _S), T.StructField("excerpt_id", _I), T.StructField("text", _S)]),
    "lines": T.StructType([T.StructField("doc_id", _S), T.StructField("line_no", _I), T.StructField("text", _S), T.StructField("is_footnote", T.BooleanType())]),
    "pairs": T.StructType([T.StructField("pair_id", _S), T.StructField("original", _S), T.StructField("correction", _S)]),
    "segments": T.StructType([T.StructField("doc_id", _S), T.StructField("targets", T.ArrayType(_S)), T.StructField("segments", T.ArrayType(_S))]),
}


def read_table(spark: SparkSession, kind: str, path: str, file_format: str = "parquet", **options) -> DataFrame:
    """A table of one of the SCHEMAS from files of any of Spark's formats."""
    return spark.read.schema(SCHEMAS[kind]).options(**options).format(file_format).load(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a table of fewer partitions than that, such as one file of one row group, is dealt out before the work on its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_book_text(spark: SparkSession, path: str, page_break: str = "\f") -> DataFrame:
    """Pages of plain-text books: one book a file, named by its path, pages between page breaks."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("book_id"), "value")
    return files.select("book_id", F.posexplode(F.split("value", page_break, -1)).alias("page", "text"))


def write_table(df: DataFrame, path: str, file_format: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Files of any of Spark's formats."""
    df.write.mode(mode).partitionBy(*partition_by).format(file_format).save(path)
