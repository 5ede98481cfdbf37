"""Token ids as binary files of bit planes or byte planes, and back.

:func:`write_ids` sorts the rows by doc_id (a range shuffle, so every task has its part of the order),
encodes each text, appends the end id and packs the ids into segments of about ``SEGMENT_IDS`` ids, one
file each. :func:`read_ids` reads the files as bytes with Spark and returns the ids of each document with
their place in the whole order; :func:`read_lengths` its digest. Files are written by Spark's own committer into any file system
that Spark can write to, one row a file; so a file has the line end that closes a row as its last byte.

A file, little-endian: MAGIC; the chunks; the directory of its documents (ids, null marks, numbers of ids),
compressed; the chunk index (offset of each chunk, then the length of each of its planes); the footer
(`FOOTER`); one line end. A chunk holds BLOCK ids (the last may hold less): the ids are transposed into planes,
lowest first, plane b holding bit (or byte) b of every id, and each plane is one zstandard frame. Planes
above the highest id of a file are left out. A reader that wants one document reads the footer, the
directory, the index and the chunks that the document lies in (:func:`decode_range`).

Defined results: a null text has no ids but the end id, as an empty one; rows without doc_id come last; rows
with the same doc_id are ordered by the hash of their text, equal rows in any order; an empty table makes no file;
a very long text makes one long segment. Other columns are not read. A doc_id that a third of the rows share is split by
text hash and row number, so no task gets them all.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comparo.llm import pieces as P
from comparo.llm.tables import materialize, scratch_dir, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK = 1 << 16             # ids of a chunk
SEGMENT_IDS = 1 << 22       # a segment is closed at the document that reaches so many ids
MAGIC = b"IDPLANE1"
#: part, segment, ids, documents, directory offset and length, index offset, chunks, ids of a chunk, planes, bits of a plane's item, magic
FOOTER = struct.Struct("<QQQQQQQIIBB6x8s")


# ---- planes ----

def planes_of(ids: np.ndarray, planes: int, width: int) -> list[bytes]:
    """The ids of a chunk, transposed: `planes` planes of `width` bits (1 or 8) of each id."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if width == 8:
        return [rows[b].tobytes() for b in range(planes)]
    return [np.packbits(rows[b >> 3] & np.uint8(1 << (b & 7)), bitorder="little").tobytes() for b in range(planes)]


def ids_of(planes: list[bytes], n: int, width: int) -> np.ndarray:
    rows = np.zeros((4, n), np.uint8)
    for b, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if width == 8:
            rows[b] = raw
        else:
            rows[b >> 3] |= np.unpackbits(raw, count=n, bitorder="little") << np.uint8(b & 7)
    return np.ascontiguousarray(rows.T).view("<u4").ravel().astype(np.uint32)


def pack(part: int, segment: int, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray, *,
         width: int = 1, block: int = BLOCK) -> bytes:
    """One file: ids of some documents, `lengths` of them each."""
    press = zstandard.ZstdCompressor(level=3).compress
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, -(-top.bit_length() // width))
    body, at, index = [MAGIC], len(MAGIC), []
    for i in range(0, len(ids), block):
        frames = [press(p) for p in planes_of(ids[i:i + block], planes, width)]
        index.append([at, *map(len, frames)])
        body += frames
        at += sum(map(len, frames))
    nulls = np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False), bitorder="little")
    directory = press(doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + lengths.astype("<u8").tobytes()
                      + nulls.tobytes())
    entries = np.array(index, "<u8").tobytes()
    footer = FOOTER.pack(part, segment, len(ids), len(lengths), at, len(directory), at + len(directory), len(index),
                         block, planes, width, MAGIC)
    return b"".join([*body, directory, entries, footer])


class Segment:
    """The documents, chunk index and chunks of a file's bytes (with or without the closing line end)."""

    def __init__(self, raw: bytes):
        end = len(raw) - (raw[-8:] != MAGIC)
        (self.part, self.segment, self.n_ids, docs, at, length, index, chunks, self.block, self.planes, self.width,
         magic) = FOOTER.unpack(raw[end - FOOTER.size:end])
        if magic != MAGIC or raw[:len(MAGIC)] != MAGIC:
            raise ValueError("not a file of id planes")
        self.raw = raw
        self.index = np.frombuffer(raw, "<u8", chunks * (self.planes + 1), index).reshape(chunks, self.planes + 1)
        plain = zstandard.ZstdDecompressor().decompress(raw[at:at + length])
        nulls = np.unpackbits(np.frombuffer(plain, np.uint8, -(-docs // 8), 16 * docs), count=docs, bitorder="little")
        self.doc_ids = pa.array(np.frombuffer(plain, "<i8", docs), pa.int64(), mask=nulls.astype(bool))
        self.lengths = np.frombuffer(plain, "<u8", docs, 8 * docs).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, *sizes = self.index[k].tolist()
        undo = zstandard.ZstdDecompressor().decompress
        frames = []
        for size in sizes:
            frames.append(undo(self.raw[at:at + size]))
            at += size
        return ids_of(frames, min(self.block, self.n_ids - k * self.block), self.width)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file; reads the chunks that they lie in alone."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // self.block
        out = np.concatenate([self.chunk(k) for k in range(first, -(-stop // self.block))])
        return out[start - first * self.block:stop - first * self.block]


def decode_range(raw: bytes, start: int, stop: int) -> np.ndarray:
    return Segment(raw).range(start, stop)


# ---- tables ----

def write_ids(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY, end_id: int = END_ID, planes: str = "bit",
              block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of `docs` (doc_id, text), in order of doc_id, to files in the new folder `path`."""
    width = {"bit": 1, "byte": 8}[planes]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, held, names, lengths = P.ids_of(vocabulary), [], [], []

        def closed() -> pa.RecordBatch:
            nonlocal made
            content = pack(part, made, pa.concat_arrays(names), np.concatenate(lengths), np.concatenate(held),
                           width=width, block=block)
            made += 1
            for x in (held, names, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for i, j, data, bounds in P.chunks_of(batch.column("text")):
                values, edges = ids.of(data, bounds)
                values = np.insert(values, edges[1:], np.uint32(end_id))
                edges = edges + np.arange(len(edges))
                own, first = batch.column("doc_id")[i:j], 0
                while first < j - i:    # up to the document that fills the segment
                    room = segment_ids - sum(map(len, held))
                    last = min(j - i, int(np.searchsorted(edges, edges[first] + room)))
                    held.append(values[edges[first]:edges[last]])
                    names.append(own[first:last])
                    lengths.append(np.diff(edges[first:last + 1]))
                    if edges[last] - edges[first] >= room:
                        yield closed()
                    first = last
        if held:
            yield closed()

    files = rows.mapInArrow(run, "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\n").option("compression", "none").text(path)


def _read(spark: SparkSession, path: str, per_document, schema: str) -> DataFrame:
    """Rows (part, segment, at: place in the file, doc_id, n_tokens, *per_document(ids)) of every document of the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                file = Segment(raw.as_buffer().to_pybytes())
                edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(file.lengths)])
                n = len(file.lengths)
                for i in range(0, n, 1 << 12):      # some documents at a time
                    j = min(n, i + (1 << 12))
                    own = file.range(int(edges[i]), int(edges[j])).astype("<u4")
                    made = per_document(own, edges[i:j + 1] - edges[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(j - i, file.part), pa.int64()), pa.array(np.full(j - i, file.segment), pa.int64()),
                         pa.array(edges[i:j]), file.doc_ids[i:j], pa.array(file.lengths[i:j]), made],
                        names=["part", "segment", "at", "doc_id", "n_tokens", "made"])

    return spark.read.format("binaryFile").load(path).where("length > 1").select("content").mapInArrow(
        run, f"part long, segment long, at long, doc_id long, n_tokens long, made {schema}")


def _placed(rows: DataFrame) -> DataFrame:
    """`rows` with `start`, the number of ids of all documents before it.

    Sums are taken by file, then by part (one row for each task that wrote), and carried on in that order.
    """
    files = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("ids"))
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = lambda window: F.coalesce(F.sum("ids").over(
        window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    files = files.withColumn("inside", before(Window.partitionBy("part").orderBy("segment"))).join(parts, "part").select(
        "part", "segment", (F.col("part_start") + F.col("inside")).alias("file_start"))
    return rows.join(files, ["part", "segment"]).withColumn("start", F.col("file_start") + F.col("at"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) of every document of the files in `path`."""
    def lists(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64)))
    return _placed(materialize(_read(spark, path, lists, "array<long>"), "ids")).select(
        "doc_id", "start", "n_tokens", F.col("made").alias("ids"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document; the CRC is of its ids as 32-bit integers."""
    def digests(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        raw, e = ids.tobytes(), (4 * edges).tolist()
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(e[:-1], e[1:])], pa.int64())
    return _placed(materialize(_read(spark, path, digests, "long"), "digests")).select(
        "doc_id", "start", "n_tokens", F.col("made").alias("ids_crc32"))


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to files of bit planes; place, length and checksum of each as read from them."""
    path = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}/planes"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_lengths(spark, path)
