"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

The tokens of all documents are counted once; the counts, scaled to a power of
two, are the frequency table that all blocks share. Documents are put in
ascending order of their ids over the shards. A block holds the ids of whole
documents, dealt over interleaved lanes that numpy codes side by side; it carries
checkpoints (lane states and word positions) from which its segments decode
independently, and a checksum of each segment.

The files are Parquet files of blocks: Spark commits them as a whole, so a lost
executor leaves no half-written file, and every file system that Spark reaches
will do.

Defined results: a null text is an empty text (its end id alone); a null
``doc_id`` comes first; rows of the same id stand next to each other, in the
order of a hash of their texts; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_view, saved, shuffle_partitions, uncollected
from .tokens import text_encoder, text_slices, vocabulary_size

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 128


class Table:
    """Frequencies (summing to 2 ** SCALE_BITS), their running sums and the symbol of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2 ** SCALE_BITS; a symbol that occurs keeps at least 1."""
    whole = 1 << SCALE_BITS
    if (counts > 0).sum() > whole:
        raise ValueError("more different tokens than slots")
    total = int(counts.sum())
    if not total:
        return counts.astype(np.int64)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * whole / total).astype(np.int64)), 0)
    left = whole - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    if left >= 0:
        freq[order[0]] += left
    for k in order:  # at most a step for each symbol: the largest give back what the rounding up took
        if left >= 0:
            break
        give = min(-left, int(freq[k]) // 2)
        freq[k] -= give
        left += give
    return freq


def encode_block(ids: np.ndarray, table: Table) -> dict:
    """A block: lanes, words, checkpoints (steps, word positions, states) and checksums of its segments."""
    n = len(ids)
    lanes = min(LANES, 1 << max(0, (n // CHECKPOINT_STEPS).bit_length() - 1)) if n >= CHECKPOINT_STEPS else 1
    steps = -(-n // lanes)
    sym = np.zeros(steps * lanes, np.int64)
    sym[:n] = ids
    sym[n:] = ids[-1] if n else 0
    sym = sym.reshape(steps, lanes)
    freq, start, bits, wide = table.freq.take(sym), table.start.take(sym), np.uint64(SCALE_BITS), np.uint64(32)
    x = np.full(lanes, LOW, np.uint64)
    chunks, marks, used = [None] * steps, [], 0
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        full = np.flatnonzero(x >= (f << np.uint64(63 - SCALE_BITS)))
        over = x.take(full)
        chunks[t] = over.astype(np.uint32)
        x[full] = over >> wide
        q = x // f
        x -= q * f
        x += q << bits
        x += start[t]
        used += len(full)
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, used, x.tobytes()))
    marks.reverse()
    size = CHECKPOINT_STEPS * lanes
    return {
        "lanes": lanes,
        "n_tokens": n,
        "words": (np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)).astype("<u4").tobytes(),
        "mark_words": [used - m[1] for m in marks],
        "mark_states": b"".join(m[2] for m in marks),
        "checksums": [zlib.crc32(np.ascontiguousarray(ids[a : a + size], "<u4")) for a in range(0, n, size)],
    }


def decode_segments(block: dict, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the segments ``first`` to ``last`` (exclusive; all if None); their checksums are verified."""
    lanes, n = block["lanes"], block["n_tokens"]
    segments = len(block["checksums"])
    last = segments if last is None else last
    size = CHECKPOINT_STEPS * lanes
    words = np.frombuffer(block["words"], "<u4")
    states = np.frombuffer(block["mark_states"], "<u8").reshape(segments, lanes) if segments else None
    mask, bits, wide = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    out = []
    for s in range(first, last):
        x, at = states[s].astype(np.uint64), block["mark_words"][s]
        steps = min(CHECKPOINT_STEPS, -(-(n - s * size) // lanes))
        got = np.empty((steps, lanes), np.uint32)
        for t in range(steps):
            slot = x & mask
            got[t] = table.symbol.take(slot.view(np.int64))
            sym = got[t].astype(np.int64)
            x >>= bits
            x *= table.freq.take(sym)
            x += slot
            x -= table.start.take(sym)
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << wide) | words[at : at + len(low)].astype(np.uint64)
                at += len(low)
        ids = got.reshape(-1)[: min(size, n - s * size)]
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != block["checksums"][s]:
            raise ValueError(f"segment {s} of a block does not match its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


#: Columns of a block before and after coding; the first six are the same.
HEAD = "shard int, block int, start_in_shard bigint, n_tokens bigint, doc_ids array<{kind}>, doc_tokens array<bigint>"
RAW = HEAD + ", ids binary, counts binary"
CODED = HEAD + ", lanes int, words binary, mark_words array<bigint>, mark_states binary, checksums array<bigint>"
HEAD_NAMES = ["shard", "block", "start_in_shard", "n_tokens", "doc_ids", "doc_tokens"]


def _tokenise(path: str, end_id: int, block_tokens: int, width: str):
    """Blocks of whole documents' ids, in the order of the rows, and last a row (block -1) of how often each id stands in them; ``width`` is the ids' number type."""

    @uncollected
    def run(batches):
        from pyspark import TaskContext

        shard, number, done = TaskContext.get().partitionId(), 0, 0
        encoder, end = text_encoder(path, 600_000), np.asarray([end_id], width)
        doc_ids, parts, sizes, size = [], [], [], 0
        totals, kind = np.zeros(end_id + 1, np.int64), None

        def block():
            nonlocal number, done, doc_ids, parts, sizes, size
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([done], pa.int64()), pa.array([size], pa.int64())]
            ids = pa.concat_arrays(doc_ids)
            columns += [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.concatenate(parts).tobytes()], pa.binary()), pa.nulls(1, pa.binary())]
            number, done = number + 1, done + size
            doc_ids, parts, sizes, size = [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, [*HEAD_NAMES, "ids", "counts"])

        for batch in batches:
            for i, texts in text_slices(batch.column(1), 16 << 20):
                tokens, counts = encoder.encode(texts)
                more = np.bincount(tokens, minlength=len(totals))
                more[: len(totals)] += totals
                more[end_id] += len(counts)
                totals, kind = more, batch.column(0).type
                tokens, ends, at = tokens.astype(width), np.cumsum(counts).tolist(), 0
                first = 0
                for k, stop in enumerate(ends):
                    parts += (tokens[at:stop], end)
                    sizes.append(stop - at + 1)
                    size, at = size + stop - at + 1, stop
                    if size >= block_tokens or k == len(ends) - 1:
                        doc_ids.append(batch.column(0).slice(i + first, k + 1 - first))
                        first = k + 1
                    if size >= block_tokens:
                        yield block()
        if sizes:
            yield block()
        if kind is not None:
            empty = [pa.array([x], t) for x, t in ((shard, pa.int32()), (-1, pa.int32()), (done, pa.int64()), (0, pa.int64()), (None, pa.list_(kind)), (None, pa.list_(pa.int64())), (None, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([totals.astype("<i8").tobytes()], pa.binary())], [*HEAD_NAMES, "ids", "counts"])

    return run


def _count():
    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                more = np.frombuffer(raw, "<i8").copy()
                if len(more) < len(counts):
                    more, counts = counts, more
                more[: len(counts)] += counts
                counts = more
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["token", "n"])

    return run


def _encode(frequencies, width: str):
    def run(batches):
        table = Table(frequencies.value)
        for batch in batches:
            for k in range(batch.num_rows):
                b = encode_block(np.frombuffer(batch.column(6)[k].as_py(), width).astype(np.uint32), table)
                more = [pa.array([b["lanes"]], pa.int32()), pa.array([b["words"]], pa.binary()), pa.array([b["mark_words"]], pa.list_(pa.int64())), pa.array([b["mark_states"]], pa.binary()), pa.array([b["checksums"]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:6], *more], [*HEAD_NAMES, "lanes", "words", "mark_words", "mark_states", "checksums"])

    return run


def write_token_files(
    docs: DataFrame,
    out: str,
    path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    block_tokens: int = 1 << 19,
) -> None:
    """Writes ``out``/frequencies and ``out``/blocks; ``shards`` is the number of ranges of ids (the session's shuffle partitions if None).

    The texts are dealt by ranges and tokenised once; their ids wait in the shared
    folder until all tokens are counted.
    """
    spark = docs.sparkSession
    texts = documents_view(docs, id_col, text_col)
    width = "<u2" if max(end_id, vocabulary_size(path)) < 1 << 16 else "<u4"
    first = F.col("doc_id").asc_nulls_first()
    ordered = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards or shuffle_partitions(spark), first, "tie").sortWithinPartitions(first, "tie")
    kind = texts.schema["doc_id"].dataType.simpleString()
    raw = saved(ordered.select("doc_id", "text").mapInArrow(_tokenise(path, end_id, block_tokens, width), RAW.format(kind=kind)), "token-blocks")
    counts = raw.where("block < 0").select("counts").mapInArrow(_count(), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    every = np.zeros(end_id + 1, np.int64)
    for r in counts.collect():  # at most one row for each id of the vocabulary
        if r.token >= len(every):
            every = np.concatenate([every, np.zeros(r.token + 1 - len(every), np.int64)])
        every[r.token] = r.n
    freq = scaled(every)
    spark.createDataFrame([(k, int(f)) for k, f in enumerate(freq) if f], "token bigint, freq bigint").coalesce(1).write.parquet(f"{out}/frequencies")
    blocks = raw.where("block >= 0").drop("counts").mapInArrow(_encode(spark.sparkContext.broadcast(freq), width), CODED.format(kind=kind))
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")


def _read(frequencies, before, digests: bool):
    def run(batches):
        table, starts = Table(frequencies.value), before.value
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = decode_segments(row, table).astype("<u4").tobytes()
                sizes = np.asarray(row["doc_tokens"])
                ends = np.cumsum(sizes)
                own = [raw[4 * a : 4 * b] for a, b in zip(ends - sizes, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digests else pa.array(own, pa.binary())
                start = starts[row["shard"]] + row["start_in_shard"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], kind), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def read_token_files(spark: SparkSession, out: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of the files' documents, or ids_crc32 instead of the ids; every checksum is verified."""
    freq = np.zeros(0, np.int64)
    if rows := spark.read.parquet(f"{out}/frequencies").collect():
        freq = np.zeros(max(r.token for r in rows) + 1, np.int64)
        freq[[r.token for r in rows]] = [r.freq for r in rows]
    blocks = spark.read.parquet(f"{out}/blocks")
    totals, before = 0, {}
    # one row for each file
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        before[r.shard], totals = totals, totals + r.n
    share = spark.sparkContext.broadcast
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids_crc32 bigint" if digests else "ids binary"
    return blocks.mapInArrow(_read(share(freq), share(before), digests), f"doc_id {kind}, start bigint, n_tokens bigint, {last}")
