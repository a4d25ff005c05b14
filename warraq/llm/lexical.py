"""Ranked lexical search by a two-level index of quantised impacts.

The index is dealt by documents: a shard is some megabytes of consecutive documents of
a task, and has one row for each of its terms with the documents (numbers within the
shard), their exact frequencies and their impacts in a byte each. An impact is the
part of a document's score that does not depend on the query, s = 10^9 tf div (1000 tf +
12 m), rounded up to a multiple of STEP: u bytes stand for STEP * (u - 1) < s <= STEP * u.
No posting is shuffled to build it, and no term, however frequent, has more than a
shard's documents in a row.

Level one reads bytes alone: for each shard and block of queries it adds up weight * u,
which bounds every document's score from above and, with the weights that took part,
from below. A document goes on only if its upper bound reaches the k-th greatest lower
bound that its task knows so far, and then the k-th of all tasks. Level two reads the
exact frequencies of what is left, without any cut, and adds integers. A document of the
k best has a score, hence an upper bound, that is at least the k-th lower bound: none
is lost, ties included.

Defined results: a null text is empty; documents without terms count nowhere; each row
of documents is a document of its own, also where ids repeat; queries that are equal in
id and text are one query; a query without known terms, and an empty table on either
side, give no rows; null ids of documents come after others of the same score; other
columns are ignored. ``build_index`` and ``search`` run jobs when they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary, documents_view, lean, let_go, saved, shared_path, slices

#: Width of an impact's step; the greatest impact is below 10^6, so that 255 of them reach it.
STEP = 3922
#: Bytes of texts of a shard, and queries whose scores a task holds at once.
SHARD, BLOCK = 4 << 20, 256
#: What separates terms: ASCII but digits and letters. Everything else is part of one.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 bytes, A-Z lower-cased."""
    return text.translate(_BYTES).split()


def query_terms(text: Column) -> Column:
    """The same of a column."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), lambda t: F.translate(t, UPPER, LOWER))


@lean
def _lengths(batches):
    for batch in batches:
        sizes = [len(terms_of(t)) for t in binary(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["docs", "terms"])


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """10^9 tf div (1000 tf + 12 m)."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _shards(n_docs: int, n_terms: int, size: int):
    """Rows of the index: of each shard one without a term, with its documents' ids and m, and one for each term."""
    names = ["shard", "term", "docs", "tfs", "impacts", "ids", "ms"]

    @lean
    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in slices(batch.column(1), size):
                vocabulary: dict[bytes, int] = {}
                number = vocabulary.setdefault
                each = []
                for text in binary(batch.column(1).slice(i, j - i)):
                    words = terms_of(text)
                    each.append(np.fromiter([number(w, len(vocabulary)) for w in words], np.int64, len(words)))
                ms = np.asarray([100 - 25 + 25 * len(x) * n_docs // max(n_terms, 1) for x in each], np.int64)
                own, ids = pa.array([ms.tolist()], pa.list_(pa.int64())), batch.column(0).slice(i, j - i)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
                one = lambda kind: pa.nulls(1, kind)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), one(pa.string()), one(pa.list_(pa.int32())), one(pa.list_(pa.int32())), one(pa.binary()), listed, own], names)
                # by term, then by document
                keys, tf = np.unique(np.concatenate([*(x * (j - i) + k for k, x in enumerate(each)), np.zeros(0, np.int64)]), return_counts=True)
                term, docs = np.divmod(keys, j - i)
                begin = np.searchsorted(term, np.arange(len(vocabulary) + 1)).astype(np.int32)
                bound = (-(-impacts(tf, ms[docs]) // STEP)).astype(np.uint8)
                n = len(vocabulary)
                lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x.astype(np.int32))) for x in (docs, tf)]
                bytes_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(begin), pa.py_buffer(bound)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(list(vocabulary), pa.binary()).cast(pa.string()), *lists, bytes_, pa.nulls(n, listed.type), pa.nulls(n, own.type)], names)
                shard += 1

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """An index on disk: its rows, the number of documents with terms and of all terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Indexes every document below ``path`` (default: a new one in the shared folder)."""
    spark, path = docs.sparkSession, path or shared_path(docs.sparkSession, "lexical-index")
    texts = documents_view(docs, id_col, text_col)
    size = texts.select("text").mapInArrow(_lengths, "docs bigint, terms bigint").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("n_terms"))
    size.write.parquet(f"{path}/size")
    n = spark.read.parquet(f"{path}/size").first()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(_shards(n.n_docs, n.n_terms, SHARD), f"shard bigint, term string, docs array<int>, tfs array<int>, impacts binary, ids array<{kind}>, ms array<bigint>")
    rows.write.parquet(f"{path}/rows")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index that ``build_index`` wrote."""
    n = spark.read.parquet(f"{path}/size").first()
    return LexicalIndex(spark.read.parquet(f"{path}/rows"), n.n_docs, n.n_terms)


def _level_one(k: int):
    """(item, shard, doc, upper, lower) of documents that may be among the ``k`` best of an item; rows of a block and shard follow each other."""

    @lean
    def run(batches):
        block, group, rows, best = None, None, [], {}

        def scored():
            items = np.unique(np.concatenate([r[2] for r in rows]))
            width = 1 + max(int(r[0][-1]) for r in rows)
            upper, took = np.zeros((len(items), width), np.int64), np.zeros((len(items), width), np.int64)
            for docs, bound, own, weights in rows:
                where = np.ix_(np.searchsorted(items, own), docs)
                upper[where] += weights[:, None] * bound[None, :]
                took[where] += weights[:, None]
            upper *= STEP
            out = []
            for item, high, weight in zip(items.tolist(), upper, took, strict=True):
                some = np.flatnonzero(high)
                low = high[some] - (STEP - 1) * weight[some]
                known = np.concatenate([best.get(item, low[:0]), low])
                if len(known) > k:
                    known = np.partition(known, len(known) - k)[len(known) - k :]
                best[item] = known
                floor = known.min() if len(known) == k else 0
                stays = high[some] >= floor
                out.append((np.full(stays.sum(), item), some[stays], high[some][stays], low[stays]))
            item, doc, high, low = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.full(len(item), group[1])), pa.array(doc.astype(np.int32)), pa.array(high), pa.array(low)], ["item", "shard", "doc", "upper", "lower"])

        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            lists = [batch.column(i).flatten().to_numpy() for i in (2, 4, 5)]
            begins = [(batch.column(i).offsets.to_numpy() - batch.column(i).offsets[0].as_py()) for i in (2, 4, 5)]
            for r, at in enumerate(groups):
                if at != group:
                    if rows:
                        yield scored()
                    if at[0] != block:
                        block, best = at[0], {}
                    group, rows = at, []
                docs, items, weights = (x[b[r] : b[r + 1]].copy() for x, b in zip(lists, begins, strict=True))
                rows.append((docs, np.frombuffer(batch.column(3)[r].as_buffer(), np.uint8).astype(np.int64), items, weights))
        if rows:
            yield scored()

    return run


def search(index: LexicalIndex, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each query, equal scores by ascending id.

    A term t of a query counts as often as it stands there, with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))).
    """
    texts = queries.select(F.col(f"`{id_col}`").alias("item_id"), query_terms(F.col(f"`{text_col}`")).alias("terms"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("item"))
    texts = texts.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("terms").alias("terms"))
    asked = saved(texts.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "query-terms")
    postings = index.rows.where("term is not null")
    wanted = saved(asked.select("term").distinct(), "wanted-terms")
    df = postings.select("term", F.size("docs").cast("bigint").alias("n")).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    blocks = -(-max(asked.select("item").distinct().count(), 1) // BLOCK)
    weights = saved(asked.join(df, "term").select("item", "item_id", "term", (weight * F.col("times")).alias("weight")).where("weight > 0").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "query-weights")

    lists = saved(weights.groupBy("block", "term").agg(F.collect_list(F.struct("item", "weight")).alias("o")).select("block", "term", "o.item", "o.weight"), "query-lists")
    met = postings.select("shard", "term", "docs", "impacts").join(lists, "term").select("block", "shard", "docs", "impacts", "item", "weight")
    met = met.repartition("block", "shard").sortWithinPartitions("block", "shard")
    bounded = saved(met.mapInArrow(_level_one(k), "item bigint, shard bigint, doc int, upper bigint, lower bigint"), "bounded")
    greatest = F.row_number().over(W.partitionBy("item").orderBy(F.desc("lower")))
    floors = bounded.select("item", "lower").withColumn("r", greatest).where(F.col("r") <= k).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(0).alias("floor"))
    left = saved(bounded.join(floors, "item").where("upper >= floor").select("item", "shard", "doc"), "candidates")

    held = index.rows.where("term is null").select("shard", F.posexplode(F.arrays_zip("ids", "ms")).alias("doc", "o")).select("shard", "doc", F.col("o.ids").alias("doc_id"), F.col("o.ms").alias("m"))
    pairs = left.join(held, ["shard", "doc"]).join(weights.drop("block"), "item")
    place = F.array_position("docs", F.col("doc")).cast("int")
    exact = pairs.join(postings.select("shard", "term", "docs", "tfs"), ["shard", "term"]).withColumn("at", place).where("at > 0").withColumn("tf", F.element_at("tfs", F.col("at")).cast("bigint"))
    part = F.expr("weight * ((1000000000L * tf) div (1000L * tf + 12L * m))")
    scores = exact.groupBy("item", "item_id", "shard", "doc", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``search`` of all documents by an index that is built for it and removed once the result is written."""
    index = build_index(docs)
    found = saved(search(index, queries, k), "ranked")
    let_go(index.rows)
    return found
