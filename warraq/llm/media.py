"""Media columns: payloads in tar shards, addressed by their content.

Every payload is stored losslessly as an image of 8-bit samples (PNG, three samples
a pixel, ROW bytes a row) and becomes a member of a tar shard, named by the SHA-256
of what it holds. A shard holds a digest once. Rows carry the digest, the shard, and
the offset and length of the stored bytes. Metadata columns come from range reads of
the first bytes alone; payloads from range reads of the whole member.

A task writes shards under names of its own, and the index of rows is written only
when all tasks are done: shards that a lost task left are in no row.

Defined results: a null text is empty and stores one row of blanks; equal texts have
equal payloads, stored forms and features; a null id stays null; an empty table
gives an empty index; other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import binary, documents_view, saved, shared_path, shuffle_partitions

#: Bytes of a row of samples.
ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold an image's signature and header.
HEADER = 33
#: Fixed values of the format: RGB, 8 bits.
COLOUR, DEPTH = 2, 8
#: A shard is closed beyond so many bytes.
SHARD_BYTES = 64 << 20


def padded(text: bytes) -> bytes:
    """Bytes of value 32 appended up to a positive multiple of ROW."""
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A PNG whose samples are the payload (a positive multiple of ROW bytes), all rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), DEPTH, COLOUR, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> dict:
    """Width, height, depth and colour type from the first HEADER bytes; their checksum is verified."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of an image")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def decode_image(data: bytes) -> bytes:
    """The samples of an image that ``encode_image`` made; chunk checksums are verified."""
    head, at, parts = read_header(data), 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk does not match its checksum")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(head["height"], head["width"] * 3 + 1)
    if lines[:, 0].any():
        raise ValueError("a row is filtered")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def feature_of(payload: bytes, head: dict) -> str:
    """Rows, sum, sum of squares, extremes and the mean of neighbouring differences of the samples, as integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    return f"rows={head['height']};sum={x.sum()};squares={(x * x).sum()};min={x.min()};max={x.max()};steps={np.abs(np.diff(x)).sum()}"


def _folder(uri: str):
    """File system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Tar shards in a folder; a digest is stored once a shard."""

    def __init__(self, uri: str):
        self.fs, self.root = _folder(uri)
        self.uri, self.out, self.known, self.at = uri, None, {}, 0

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the stored bytes."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.known, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}"), {}, 0
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
            self.known[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        found = self.known[digest]
        if self.at > SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            self.out.close()
            self.out = None


def _store(uri: str):
    def run(batches):
        writer = ShardWriter(uri)
        for batch in batches:
            rows = []
            for text in binary(batch.column(1)):
                payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                image = None if writer.out is not None and digest in writer.known else encode_image(payload)
                rows.append((len(text), len(payload), digest, *writer.add(digest, image)))
            n, size, digest, shard, offset, length = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [pa.array(x, pa.int64()) for x in (n, size)] + [pa.array(x, pa.string()) for x in (digest, shard)] + [pa.array(x, pa.int64()) for x in (offset, length)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return run


def store_payloads(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes tar shards to the folder ``uri`` and returns the index (doc_id, n_bytes, payload_bytes, digest, shard, offset, length)."""
    texts = documents_view(docs, id_col, text_col)
    filesystem, root = _folder(uri)
    filesystem.create_dir(root, recursive=True)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return saved(texts.mapInArrow(_store(uri), f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, digest string, shard string, offset bigint, length bigint"), "media-index")


def _ranges(index: DataFrame, partitions: int | None) -> DataFrame:
    """The index dealt by ranges of the stored bytes, so that a task reads each stretch of a shard once and in order."""
    n = partitions or shuffle_partitions(index.sparkSession)
    return index.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _each_stored(batches, uri: str, read):
    """Batches with what ``read`` makes of each row's stored bytes (called once for rows of the same place that follow each other)."""
    filesystem, root = _folder(uri)
    name = stream = place = value = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
            if row[:2] != place:
                if row[0] != name:
                    if stream is not None:
                        stream.close()
                    name, stream = row[0], filesystem.open_input_file(f"{root}/{row[0]}")
                value, place = read(lambda size, offset=row[1], file=stream: file.read_at(size, offset), row[2], row[3]), row[:2]
            out.append(value)
        yield batch, out
    if stream is not None:
        stream.close()


def read_metadata(index: DataFrame, uri: str, partitions: int | None = None) -> DataFrame:
    """``index`` with width, height, depth and colour, from range reads of the headers alone."""
    names = ("width", "height", "depth", "colour")

    def run(batches):
        for batch, heads in _each_stored(batches, uri, lambda get, length, digest: read_header(get(HEADER))):
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[n] for h in heads], pa.int32()) for n in names)], [*batch.schema.names, *names])

    schema = T.StructType([*index.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)])
    return _ranges(index, partitions).mapInArrow(run, schema)


def read_features(index: DataFrame, uri: str, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height) from the stored bytes read back.

    Width and height come from range reads of the headers (``read_metadata``), the rest from whole members.
    """

    def read(get, length: int, digest: str):
        data = get(length)
        head, payload = read_header(data[:HEADER]), decode_image(data)
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError("a payload does not match its digest")
        return found, zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload, head)

    names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch, values in _each_stored(batches, uri, read):
            columns = list(zip(*values, strict=True)) or [()] * len(names)
            kept, sides = ([batch.column(c) for c in some] for some in (("doc_id", "n_bytes", "payload_bytes"), ("width", "height")))
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True)), *sides], ["doc_id", "n_bytes", "payload_bytes", *names, "width", "height"])

    kind = index.schema["doc_id"].dataType.simpleString()
    # the rows stay as read_metadata deals them
    return read_metadata(index, uri, partitions).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int")


def new_shard_folder(docs: DataFrame) -> str:
    """A new folder for shards in the session's shared folder."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "media"))
    # a path without a scheme belongs to the cluster's default file system
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def media_columns(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the payloads of all rows and reads them back: ``read_features`` of ``store_payloads``."""
    uri = uri or new_shard_folder(docs)
    return read_features(store_payloads(docs, uri, id_col, text_col), uri)


