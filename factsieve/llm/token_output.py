"""Token ids in binary files: patched frame-of-reference blocks with an index.

A file holds the ids of a contiguous range of documents in ascending order of their ids:

* header: magic, version, block length
* blocks of ``BLOCK`` ids (the last may be shorter). Block: least id (4 bytes), width (1),
  number of exceptions (2), the low ``width`` bits of ``id - least`` packed one after
  another (little end first), then places (2 bytes each) and high parts (4 bytes each) of
  the exceptions. The width holds the differences up to a percentile of the block; what
  needs more bits is an exception.
* index: start of each block (8 bytes), document ids (8) with a byte each for null, and
  first id of each document (8, one more than documents)
* footer: numbers of blocks, documents and ids, place of the index, magic

Files are written by the tasks of a range partitioning of the documents through
``pyarrow.fs``, under a name of their own per attempt; the stored table of finished files
names those that count. A reader gets any document from the index and the blocks it
touches, a whole file block by block.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm.packing import _groups
from factsieve.llm.store import Scratch, text_of
from factsieve.llm.tokens import encoder, tokenizer_path

MAGIC = b"FSPF"
BLOCK = 256
PERCENTILE = 90
# Pieces that a writing task keeps of its tokenizer, twice.
KEPT = 1_000_000
# Bytes of ids that are packed together; a multiple of any whole block.
_AT_ONCE = 4 * BLOCK * 256
_FOOT = struct.Struct("<QQQQ4s")
_HEAD = struct.Struct("<4sII")
FILES = "path string, n_docs long, n_ids long, first_doc long, part int"


def _encoded(part: np.ndarray, percentile: int) -> list[bytes]:
    """Blocks of equal length, the rows of ``part``; all blocks of one width are packed together."""
    n = part.shape[1]
    least = part.min(1)
    high = part - least[:, None]
    edge = np.partition(high, min(n - 1, n * percentile // 100), axis=1)[:, min(n - 1, n * percentile // 100)]
    width = np.frexp(edge.astype(np.float64))[1]  # bits of the number
    rest = (high.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype("<u4")
    row, place = np.nonzero(rest)
    at = np.searchsorted(row, np.arange(len(part) + 1))
    places, values = place.astype("<u2"), rest[row, place]
    packed: list[bytes] = [b""] * len(part)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low_first = high[rows].astype("<u4").view(np.uint8).reshape(len(rows), n, 4)
        bits = np.unpackbits(low_first, axis=2, count=w, bitorder="little")
        for i, data in zip(rows.tolist(), np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little"), strict=True):
            packed[i] = data.tobytes()
    return [
        struct.pack("<IBH", low, w, b - a) + bits + places[a:b].tobytes() + values[a:b].tobytes()
        for low, w, a, b, bits in zip(least.tolist(), width.tolist(), at[:-1].tolist(), at[1:].tolist(), packed, strict=True)
    ]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit ids."""
    ids = ids.astype(np.uint32)
    full = len(ids) // block * block
    out = _encoded(ids[:full].reshape(-1, block), percentile) if full else []
    return out + (_encoded(ids[full:].reshape(1, -1), percentile) if full < len(ids) else [])


def decode_blocks(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids of blocks of ``n`` ids each, which begin at ``starts``."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(7)].astype(np.int64)
    least = head[:, 0] | head[:, 1] << 8 | head[:, 2] << 16 | head[:, 3] << 24
    width, odd = head[:, 4], head[:, 5] | head[:, 6] << 8
    size = (n * width + 7) // 8
    values = np.zeros((len(starts), n), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = raw[starts[rows][:, None] + 7 + np.arange((n * w + 7) // 8)]
        bits = np.unpackbits(packed, axis=1, count=n * w, bitorder="little").reshape(len(rows), n, w)
        values[rows] = bits.astype(np.float32) @ (2.0 ** np.arange(w)).astype(np.float32) if w <= 24 else (
            bits.astype(np.int64) << np.arange(w)
        ).sum(2)
    row = np.repeat(np.arange(len(starts)), odd)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
    at = (starts + 7 + size)[row] + 2 * nth
    place = raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8
    at = (starts + 7 + size + 2 * odd)[row] + 4 * nth
    high = sum(raw[at + k].astype(np.int64) << (8 * k) for k in range(4)) if len(row) else np.zeros(0, np.int64)
    values[row, place] |= high << width[row]
    return (values + least[:, None]).astype("<u4").ravel()


class FileWriter:
    def __init__(self, stream, block: int = BLOCK):
        self.out, self.block = stream, block
        self.starts, self.docs, self.nulls, self.firsts = [], [], [], [0]
        self.held, self.waiting, self.at = [], 0, _HEAD.size
        self.out.write(_HEAD.pack(MAGIC, 1, block))

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.firsts.append(self.firsts[-1] + len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= _AT_ONCE:
            self._flush(self.block)

    def _flush(self, unit: int) -> None:
        data = b"".join(self.held)
        for low in range(0, len(data) // (4 * unit) * 4 * unit, _AT_ONCE):
            self._blocks(data[low : min(low + _AT_ONCE, len(data) // (4 * unit) * 4 * unit)])
        rest = data[len(data) // (4 * unit) * 4 * unit :]
        self.held, self.waiting = [rest], len(rest)

    def _blocks(self, data: bytes) -> None:
        for b in encode_blocks(np.frombuffer(data, "<u4"), self.block):
            self.starts.append(self.at)
            self.at += len(b)
            self.out.write(b)

    def close(self) -> None:
        self._flush(1)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes())
        self.out.write(np.array(self.firsts, "<u8").tobytes())
        self.out.write(_FOOT.pack(len(self.starts), len(self.docs), self.firsts[-1], self.at, MAGIC))


class FileReader:
    """Random access to one file."""

    def __init__(self, stream):
        self.file = stream
        size = stream.size()
        stream.seek(size - _FOOT.size)
        blocks, docs, self.n_ids, self.index, magic = _FOOT.unpack(stream.read(_FOOT.size))
        stream.seek(0)
        head, _, self.block = _HEAD.unpack(stream.read(_HEAD.size))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a file of token ids")
        stream.seek(self.index)
        rest = stream.read(size - _FOOT.size - self.index)
        self.starts = np.concatenate([np.frombuffer(rest, "<u8", blocks), [self.index]]).astype(np.int64)
        at = 8 * blocks
        self.docs = np.frombuffer(rest, "<i8", docs, at)
        self.nulls = np.frombuffer(rest, np.uint8, docs, at + 8 * docs).astype(bool)
        self.firsts = np.frombuffer(rest, "<u8", docs + 1, at + 9 * docs).astype(np.int64)

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids at places low to high, from the blocks that hold them."""
        if high <= low:
            return np.empty(0, "<u4")
        a, b = low // self.block, -(-high // self.block)
        self.file.seek(int(self.starts[a]))
        data = self.file.read(int(self.starts[b] - self.starts[a]))
        starts, whole = self.starts[a:b] - self.starts[a], min(b, self.n_ids // self.block) - a
        out = [decode_blocks(data, starts[k : min(k + 256, whole)], self.block) for k in range(0, whole, 256)]
        if a + whole < b:
            out.append(decode_blocks(data, starts[whole:], self.n_ids % self.block))
        return np.concatenate(out)[low - a * self.block : high - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_tokens(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Write all documents in ascending order of their ids; the table of files, in order of ``part``.

    Null ids come first; rows with one id are ordered by text. Null texts are empty.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path, kept=KEPT).encode, np.array([end_id], "<u4").tobytes()
        where, base = _located(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pfor"
        stream = writer = None
        for ids, texts in _groups(batches):
            if not ids:
                continue
            if writer is None:
                stream = where.open_output_stream(name)
                writer = FileWriter(stream)
            for doc, data in zip(ids, encode(texts), strict=True):
                writer.add(doc, data + end)
        if writer is not None:
            writer.close()
            stream.close()
            part = TaskContext.get().partitionId()
            row = [[name], [len(writer.docs)], [writer.firsts[-1]], [writer.docs[0]], [part]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(row, kinds, strict=True)],
                ["path", "n_docs", "n_ids", "first_doc", "part"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col))
    ordered = rows.repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "text"
    )
    return Scratch(spark, "token-files").table(ordered.mapInArrow(write, FILES), "files")


def read_tokens(spark: SparkSession, files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32`` and maybe ``ids``.

    The files' sizes (one number per file) are summed up on the driver to get the starts.
    """
    listed = sorted(files.collect(), key=lambda r: r["part"])
    places, at = [], 0
    for r in listed:
        places.append((r["path"], at))
        at += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _located(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_file(name) as stream:
                    reader = FileReader(stream)
                    low = 0
                    while low < len(reader.docs):
                        # whole documents of about a million ids at a time
                        high = int(np.searchsorted(reader.firsts, reader.firsts[low] + (1 << 20), "right"))
                        high = min(max(high - 1, low + 1), len(reader.docs))
                        first = reader.firsts[low : high + 1]
                        ids = reader.ids(int(first[0]), int(first[-1])).tobytes()
                        cuts = [ids[4 * (a - first[0]) : 4 * (b - first[0])] for a, b in zip(first, first[1:])]  # noqa: B905
                        columns = [
                            pa.array(reader.docs[low:high], pa.int64(), mask=reader.nulls[low:high]),
                            pa.array(base + first[:-1], pa.int64()),
                            pa.array(np.diff(first), pa.int64()),
                            pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                        ] + ([pa.array(cuts, pa.binary())] if with_ids else [])
                        yield pa.RecordBatch.from_arrays(
                            columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
                        )
                        low = high

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    table = spark.createDataFrame(places, "path string, base long")
    return table.repartition(max(1, len(places))).mapInArrow(read, schema)
