"""Token ids in binary files: patched frame-of-reference blocks.

A block holds up to ``BLOCK`` numbers of 32 bits. The block's least number is
subtracted, the rest is packed at the least width that holds ``PERCENTILE`` of the
block, and the few larger ones go to an exception list (place and bits above the
width). A block of equal numbers takes no bits.

A file holds the ids of consecutive documents in ascending order of their ids::

    magic, file number, ids per block         16 bytes
    id blocks                                 all documents' ids in one row
    document blocks                           per run of documents: low and high half
                                              of the id, null flag, number of tokens
    index                                     start of every id block, then of every
                                              document block (unsigned 64 bit)
    numbers of ids, id blocks, documents and document blocks, magic

Files are written by Spark's text writer, one block a row (hence one new-line byte
behind each block, which the block starts take into account), and are read with
``binaryFile``; ``FILE_BYTES`` bounds the text, so a file, of one task.
``ids_between`` reads any range of ids from the blocks that hold it alone.

Defined cases: a null or empty text has only the end id. Null ids come before all
others. Rows with equal ids are documents of their own, ordered by the hash of the
text and then by place. Empty tables write no block and read as no rows. A document
is in one file whole. Other columns are not read; ids must fit a 64-bit integer.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import column, save, text_batches
from .piece_encoder import Encoder

BLOCK = 4096
PERCENTILE = 0.9
#: Bytes of text of one file.
FILE_BYTES = 64 << 20
#: Bytes of text encoded at once.
PIECE = 3_000_000
#: Id blocks decoded at once while reading.
RUN = 256
_MAGIC = b"PFORIDS1"
_HEAD, _TAIL = "<8sII", "<QQQQ8s"
_BLOCK = "<HHB3xII"  # numbers, exceptions, width, least, crc32 of the numbers


def pack(numbers: np.ndarray) -> bytes:
    """One block of up to ``BLOCK`` unsigned 32-bit numbers."""
    n = len(numbers)
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    least = int(numbers.min()) if n else 0
    delta = numbers - np.uint32(least)
    # how many bits each number takes, and the width that holds the percentile of them
    bits = np.zeros(n, np.uint8)
    bits[delta > 0] = np.frexp(delta[delta > 0].astype(np.float64))[1]
    width = int(np.sort(bits)[max(0, math.ceil(PERCENTILE * n) - 1)]) if n else 0
    over = np.flatnonzero(bits > width)
    body = b""
    if width:
        places = np.unpackbits(delta.view(np.uint8).reshape(n, 4), axis=1, bitorder="little")[:, :width]
        body = np.packbits(places, bitorder="little").tobytes()
    patch = over.astype("<u2").tobytes() + (delta[over].astype(np.uint64) >> np.uint64(width)).astype("<u4").tobytes()
    return struct.pack(_BLOCK, n, len(over), width, least, zlib.crc32(numbers)) + body + patch


def unpack(data: memoryview, at: int) -> np.ndarray:
    """The numbers of the block that starts at ``at``."""
    n, patches, width, least, crc = struct.unpack_from(_BLOCK, data, at)
    at += struct.calcsize(_BLOCK)
    out = np.zeros(n, np.uint64)
    if width and n:
        size = (n * width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        whole = np.zeros((n, 32), np.uint8)
        whole[:, :width] = bits
        out = np.packbits(whole, axis=1, bitorder="little").view("<u4")[:, 0].astype(np.uint64)
        at += size
    if patches:
        where = np.frombuffer(data, "<u2", patches, at)
        out[where] |= np.frombuffer(data, "<u4", patches, at + 2 * patches).astype(np.uint64) << np.uint64(width)
    numbers = (out + np.uint64(least)).astype("<u4")
    if zlib.crc32(numbers) != crc:
        raise ValueError("a block's numbers do not match their checksum")
    return numbers


class Writer:
    """Turns documents into the rows (blocks) of one file."""

    def __init__(self, number: int):
        self.head = struct.pack(_HEAD, _MAGIC, number, BLOCK)
        self.at, self.starts, self.doc_starts = 0, [], []
        self.rest, self.ids, self.docs = np.zeros(0, np.uint32), 0, 0
        self.table: list[list] = [[], [], []]

    def _row(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def add(self, ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, null: np.ndarray) -> Iterator[bytes]:
        if not self.at:
            yield self._row(self.head)
        for held, new in zip(self.table, (keys, null, counts)):
            held.append(new)
        self.docs, self.ids = self.docs + len(counts), self.ids + len(ids)
        row = np.concatenate([self.rest, ids])
        whole = len(row) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            self.starts.append(self.at)
            yield self._row(pack(row[a : a + BLOCK]))
        self.rest = row[whole:]

    def close(self) -> Iterator[bytes]:
        if not self.at:
            return
        if len(self.rest):
            self.starts.append(self.at)
            yield self._row(pack(self.rest))
        keys, null, counts = (np.concatenate(x) for x in self.table)
        key = keys.astype("<i8").view("<u4").reshape(-1, 2)
        for a in range(0, len(counts), BLOCK):
            for part in (key[:, 0], key[:, 1], null, counts):
                self.doc_starts.append(self.at)
                yield self._row(pack(part[a : a + BLOCK]))
        index = np.array(self.starts + self.doc_starts, "<u8").tobytes()
        yield self._row(index + struct.pack(_TAIL, self.ids, len(self.starts), self.docs, len(self.doc_starts), _MAGIC))


class Reader:
    """The ids and documents of one file's bytes."""

    def __init__(self, data: memoryview):
        self.data = data
        magic, self.number, self.block = struct.unpack_from(_HEAD, data, 0)
        tail = len(data) - 1 - struct.calcsize(_TAIL)  # the writer's new line comes last
        self.ids, blocks, self.docs, doc_blocks, end = struct.unpack_from(_TAIL, data, tail)
        if magic != _MAGIC or end != _MAGIC:
            raise ValueError("not a file of token ids, or cut off")
        index = np.frombuffer(data, "<u8", blocks + doc_blocks, tail - 8 * (blocks + doc_blocks))
        self.starts, self.doc_starts = index[:blocks].tolist(), index[blocks:].tolist()

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, null flags and token counts of the documents."""
        parts = [np.concatenate([np.zeros(0, "<u4"), *(unpack(self.data, at) for at in self.doc_starts[k::4])]) for k in range(4)]
        return np.stack(parts[:2], axis=1).astype("<u4").reshape(-1).view("<i8"), parts[2] > 0, parts[3].astype(np.int64)

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids at the places [start, stop), read from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first = start // self.block
        row = np.concatenate([unpack(self.data, at) for at in self.starts[first : (stop - 1) // self.block + 1]])
        return row[start - first * self.block : stop - first * self.block]


def ids_between(data: bytes, start: int, stop: int) -> np.ndarray:
    """The ids [start, stop) of a file's bytes."""
    return Reader(memoryview(data)).between(start, stop)


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = Encoder(path), Writer(TaskContext.get().partitionId())
        for batch in text_batches(batches, "text", PIECE):
            ids, n = encode([t or "" for t in batch.column("text").to_pylist()])
            row = np.insert(ids, np.cumsum(n), end)
            keys = batch.column("id")
            null = keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint32)
            rows = list(writer.add(row, n + 1, keys.fill_null(0).to_numpy(), null))
            yield pa.record_batch([pa.array(rows, pa.binary())], ["value"])
        yield pa.record_batch([pa.array(list(writer.close()), pa.binary())], ["value"])

    return run


def write(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0,
          file_bytes: int = FILE_BYTES) -> None:
    """Encode the texts of ``df`` and write them below ``path`` in ascending order of
    their ids, ``end`` behind each document, about ``file_bytes`` of text a file."""
    rows = df.select(column(df, id_col).cast("long").alias("id"), column(df, text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows.select("id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    order = [F.asc_nulls_first("id"), F.asc("mark"), F.asc("place")]
    dealt = keyed.repartitionByRange(max(1, math.ceil(size / file_bytes)), *order).sortWithinPartitions(*order).select("id", "text")
    dealt.mapInArrow(_encoder(vocabulary, end), "value binary").select(F.col("value").cast("string")).write.text(path)


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("content"):
                raw = cell.as_buffer()
                if not raw.size:
                    continue
                file = Reader(memoryview(raw))
                keys, null, counts = file.documents()
                ends = np.cumsum(counts)
                step = file.block * RUN
                a = 0
                while a < len(counts):
                    begin = int(ends[a] - counts[a])
                    b = max(a + 1, int(np.searchsorted(ends, begin + step, "right")))
                    row = file.between(begin, int(ends[b - 1])).tobytes()
                    cuts = [(int(ends[k] - counts[k] - begin) * 4, int(ends[k] - begin) * 4) for k in range(a, b)]
                    out = [pa.array([file.number] * (b - a), pa.int32()), pa.array(keys[a:b], mask=null[a:b]), pa.array(ends[a:b] - counts[a:b]),
                           pa.array(counts[a:b]), pa.array([zlib.crc32(row[x:y]) for x, y in cuts], pa.int64())]
                    names = ["file", "id", "offset", "n", "crc32"]
                    if with_ids:
                        out, names = [*out, pa.array([row[x:y] for x, y in cuts], pa.binary())], [*names, "ids"]
                    yield pa.record_batch(out, names)
                    a = b

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """file, id, offset (ids of the file before the document), n, crc32 and, if
    wanted, ids (little-endian unsigned 32 bit) of each document below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(with_ids), "file int, id long, offset long, n long, crc32 long" + (", ids binary" if with_ids else ""))


def starts(found: DataFrame, span: int = 1024) -> DataFrame:
    """``found`` (as ``read`` gives it) with ``start``, the ids of all documents
    before. Running sums go over files, ``span`` at a time, then over the spans."""
    files = found.groupBy("file").agg(F.sum("n").alias("size")).withColumn("span", F.floor(F.col("file") / span))
    spans = files.groupBy("span").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("span").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = (files.withColumn("inside", inside).join(spans.withColumn("before", before).select("span", "before"), "span")
            .select("file", (F.col("inside") + F.col("before")).alias("base")))
    return found.join(base, "file").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0,
               file_bytes: int = FILE_BYTES, with_ids: bool = False) -> DataFrame:
    """Write ``df`` to files in the shared checkpoint folder and read them back."""
    path = scratch_path(df.sparkSession, f"ids-{uuid.uuid4().hex}")
    write(df, path, vocabulary, id_col, text_col, end, file_bytes)
    return starts(save(read(df.sparkSession, path, with_ids), "documents"))
