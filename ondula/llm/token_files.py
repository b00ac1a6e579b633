"""Token-id files in patched frame-of-reference blocks.

Ids are written in ascending doc_id order. A file is a Parquet table in a folder of one's choice; a row is a segment: a document index
and a byte string of blocks. A block holds BLOCK ids: their minimum is subtracted, the differences are packed at a width that covers PERCENTILE of
them, and the rest (exceptions) are listed by position with their high bits. The segment starts with a table of block starts, so that any id is
reached by decoding one block.

    segment := "PFR1" | u32 n_ids | u32 n_blocks | u32 byte start of each block, counted from the segment's start | blocks
    block   := u32 minimum | u8 width | u8 0 | u16 n_exceptions | packed low bits, little-endian, padded to a byte
               | u16 position of each exception | u32 high bits of each exception

Order and recovery: a range shuffle by doc_id brings texts into order, each task encodes and packs its sorted range in one stream, and a task that is run again
writes the same rows. Only one number per partition (its ids) is gathered to turn local starts into global ones.

Defined cases: a null or empty text is the end id alone. Rows that repeat a doc_id stand side by side in the order of their texts. A null doc_id stands first. A
very long text may fill many segments; segments do not cut documents' index entries, which carry their global start. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondula.llm.common import arrow_map, documents, slices, written
from ondula.llm.tokens import default_path, worker_encoder

BLOCK = 128
PERCENTILE = 90
END_ID = 2
#: A segment is closed when it holds this many ids; it holds whole documents.
SEGMENT_IDS = 1 << 18
MAGIC = b"PFR1"
FILE_SCHEMA = "part int, segment int, n_ids long, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>, data binary"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values below 2^width as little-endian bits."""
    if not width or not len(values):
        return b""
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def _pack_blocks(values: np.ndarray, width: int) -> np.ndarray:
    """pack_bits of each row of BLOCK values, as rows of bytes: 64 bits at a time over all rows."""
    columns = values.T.astype(np.uint64, order="C")
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for i, column in enumerate(columns):
        word, shift = divmod(i * width, 64)
        words[word] |= column << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8)


def _unpack_blocks(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack_blocks."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    columns = np.empty((BLOCK, len(packed)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        columns[i] = value & mask
    return columns.T


def encode_segment(ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint32, copy=False)
    count = len(ids)
    n_blocks = -(-count // BLOCK)
    if not n_blocks:
        return MAGIC + struct.pack("<II", 0, 0)
    padded = np.append(ids, np.full(n_blocks * BLOCK - count, ids[-1], np.uint32)).reshape(n_blocks, BLOCK)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = _bit_length(np.partition(rest, rank, axis=1)[:, rank]).astype(np.int64)
    row, column = np.nonzero(rest.astype(np.uint64) >> width[:, None].astype(np.uint64))
    exceptions = np.bincount(row, minlength=n_blocks)
    sizes = 8 + BLOCK // 8 * width + 6 * exceptions
    at = np.cumsum(sizes) - sizes  # of each block, counted from the first
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.zeros(n_blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")]))
    heads["low"], heads["width"], heads["exceptions"] = low, width, exceptions
    out[at[:, None] + np.arange(8)] = heads.view(np.uint8).reshape(n_blocks, 8)
    for w in np.unique(width).tolist():  # blocks of one width are packed together
        own = np.flatnonzero(width == w)
        if w:
            out[(at[own] + 8)[:, None] + np.arange(BLOCK // 8 * w)] = _pack_blocks(rest[own] & np.uint32((1 << w) - 1), w)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        where = (at + 8 + BLOCK // 8 * width)[row]
        out[(where + 2 * nth)[:, None] + np.arange(2)] = column.astype("<u2")[:, None].view(np.uint8)
        high = (rest[row, column].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
        out[(where + 2 * exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = high[:, None].view(np.uint8)
    starts = at + len(MAGIC) + 8 + 4 * n_blocks
    return MAGIC + struct.pack("<II", count, n_blocks) + starts.astype("<u4").tobytes() + out.tobytes()


def block_starts(data: bytes) -> tuple[int, np.ndarray]:
    """The number of ids and the byte start of each block."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    count, n_blocks = struct.unpack_from("<II", data, 4)
    return count, np.frombuffer(data, "<u4", n_blocks, 12)


def decode_block(data: bytes, start: int) -> np.ndarray:
    """The BLOCK ids of one block."""
    low, width, _, k = struct.unpack_from("<IBBH", data, start)
    at = start + 8
    size = BLOCK * width // 8
    values = unpack_bits(data[at : at + size], width, BLOCK)
    if k:
        where = np.frombuffer(data, "<u2", k, at + size)
        values[where] |= np.frombuffer(data, "<u4", k, at + size + 2 * k) << np.uint32(width)
    return values + np.uint32(low)


def decode_segment(data: bytes) -> np.ndarray:
    count, starts = block_starts(data)
    if not count:
        return np.zeros(0, np.uint32)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    at = starts.astype(np.int64)
    heads = raw[at[:, None] + np.arange(8)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    width, exceptions = heads[:, 4].astype(np.int64), heads[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            out[own] = _unpack_blocks(raw[(at[own] + 8)[:, None] + np.arange(BLOCK // 8 * w)], w)
    row = np.repeat(np.arange(len(starts)), exceptions)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        where = (at + 8 + BLOCK // 8 * width)[row]
        column = raw[(where + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
        high = raw[(where + 2 * exceptions[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
        out[row, column] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (out + low[:, None]).ravel()[:count]


def _encode(path: str, end_id: int, kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(kind, path)
        part, segment, at = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        starts: list[int] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, docs, starts, lengths, held
            ids = np.concatenate(held)
            row = [[part], [segment], [len(ids)], [docs], [starts], [lengths], [encode_segment(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            segment, docs, starts, lengths, held = segment + 1, [], [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "segment", "n_ids", "doc_ids", "doc_starts", "doc_lengths", "data"])

        tail = np.array([end_id], np.uint32)
        inside = 0
        for batch in slices(batches):
            ids, sizes = encoder(batch.column("text"))
            ends = np.cumsum(sizes)
            for doc, end, size in zip(batch.column("doc_id").to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                docs.append(doc)
                starts.append(at)
                lengths.append(size + 1)
                held += [ids[end - size : end], tail]
                at += size + 1
                inside += size + 1
                if inside >= SEGMENT_IDS:
                    yield close()
                    inside = 0
        if docs:
            yield close()

    return work


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, kind: str = "word", id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; returns the written files as a DataFrame of segments.

    to: the folder for the files, which must not exist yet. Without it they lie in the cluster's shared folder and go when the driver ends.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments = arrow_map(ordered, _encode(path or default_path("word_bpe_49k.json"), end_id, kind), FILE_SCHEMA)
    if to is None:
        return written(segments, "token-files")
    segments.write.parquet(to)
    return open_files(docs.sparkSession, to)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a folder that write_tokens has written."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_segment(row["data"]).astype("<u4")
            ends = np.cumsum(row["doc_lengths"])
            sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["doc_lengths"], strict=True)]
            columns = [pa.array([row["part"]] * len(sums), pa.int32()), *(pa.array(v, pa.int64()) for v in (row["doc_ids"], row["doc_starts"], row["doc_lengths"], sums))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_index(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per partition
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    read = arrow_map(files.select("part", "doc_ids", "doc_starts", "doc_lengths", "data"), _read, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark, sf_dir: str) -> DataFrame:
    return read_index(write_tokens(documents(spark, sf_dir)))
