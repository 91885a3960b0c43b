"""Line deduplication across documents, as compressed keep bitmaps.

Lines that occur in several documents stay only in the document with the smallest id.
A line's hash, document and position are range-partitioned and sorted; each task streams
its range once, so the first document of a hash is the one that keeps it. A hash may go
on over any number of ranges (ranges are cut by document and position too, so a line that
a third of all rows holds is spread out): a task cannot know the first document of the
hash its range begins with, so those rows are put aside, and settled afterwards from one
row per range. What is dropped returns to the documents as a bitmap; texts never move for
the search.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import Scratch, only, text_bytes
from factsieve.llm.words import BLANKS

MIN_CHARS = 10
_NONE = -1


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def _hashes(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, doc, row, pos = [], [], [], [], []
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d is None:
                    continue
                of_row = xxhash.xxh3_64_intdigest(data)
                for i, line in enumerate(data.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, least):
                        h = xxhash.xxh3_128_intdigest(key)
                        h1.append(h >> 64)
                        h2.append(h & (2**64 - 1))
                        doc.append(d)
                        row.append(of_row)
                        pos.append(i)
            unsigned = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h1, h2, row)]
            yield pa.RecordBatch.from_arrays(
                [unsigned[0], unsigned[1], pa.array(doc, pa.int64()), unsigned[2], pa.array(pos, pa.int32())],
                ["h1", "h2", "doc", "row", "pos"],
            )

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, row long, pos int")


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows to drop (kind 0), rows of each range's first hash (1), and first and last hash per range (2, 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None  # (h1, h2) and smallest document, as far as this range shows
        names = ["kind", "part", "h1", "h2", "doc", "row", "pos"]
        kinds = [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

        def out(kind, h1, h2, doc, row, pos):
            n = len(doc)
            columns = [np.full(n, kind), np.full(n, part), h1, h2, doc, row, pos]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, row, pos = (batch.column(i).to_numpy() for i in range(5))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if last is not None and (h1[0], h2[0]) == last[0]:
                new[0] = False
            group = np.cumsum(new) - 1  # -1: goes on from the batch before
            begin = np.flatnonzero(new)
            owner = np.where(group >= 0, doc[begin[np.maximum(group, 0)]] if len(begin) else _NONE, 0)
            if not new[0]:
                owner[group < 0] = last[1]
            if first is None:
                first = ((h1[0], h2[0]), int(doc[0]))
            opening = (h1 == first[0][0]) & (h2 == first[0][1])
            drop = (doc != owner) & ~opening
            yield out(0, h1[drop], h2[drop], doc[drop], row[drop], pos[drop])
            yield out(1, h1[opening], h2[opening], doc[opening], row[opening], pos[opening])
            last = ((h1[-1], h2[-1]), int(owner[-1]))
        if first is not None:
            for kind, (h, d) in ((2, first), (3, last)):
                yield out(kind, [h[0]], [h[1]], [d], [0], [0])

    return rows.mapInArrow(run, "kind byte, part int, h1 long, h2 long, doc long, row long, pos int")


def _first_owners(borders: list) -> list[tuple[int, int]]:
    """Per range the first document of the hash it begins with; ranges are in order."""
    firsts = {r["part"]: ((r["h1"], r["h2"]), r["doc"]) for r in borders if r["kind"] == 2}
    lasts = {r["part"]: ((r["h1"], r["h2"]), r["doc"]) for r in borders if r["kind"] == 3}
    out, carried = [], None
    for part in sorted(firsts):
        key, doc = firsts[part]
        owner = carried[1] if carried and carried[0] == key else doc
        out.append((part, owner))
        end, end_doc = lasts[part]
        carried = (end, owner if end == key else end_doc)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, row, pos`` of every line to drop; ``row`` is a hash of the document's text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = only(docs, [id_col, text_col]).select(
        F.col(f"`{id_col}`").cast("long").alias("doc"), text_bytes(text_col).alias("text")
    )
    order = ["h1", "h2", "doc", "pos", "row"]
    ranged = _hashes(rows, min_chars).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = scratch.table(_streamed(ranged), "streamed")
    # two rows per range
    owners = _first_owners(found.where("kind >= 2").collect())
    owner = spark.createDataFrame(owners, "at int, owner long")
    late = found.where("kind = 1").join(F.broadcast(owner), F.col("part") == F.col("at")).where("doc <> owner")
    return found.where("kind = 0").select("doc", "row", "pos").union(late.select("doc", "row", "pos"))


def keep_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """One bit per line, 1: stays; filled up to whole bytes with ones, packed and compressed."""
    keep = np.ones(-(-n_lines // 8) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(bitmap), np.uint8)
    return np.unpackbits(raw, count=n_lines, bitorder="little").astype(bool)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, row, bitmap`` of the documents that lose lines (all others keep every line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for places in batch.column(2):
                p = places.values.to_numpy()
                bits.append(keep_bitmap(int(p.max()) + 1, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["doc", "row", "bitmap"]
            )

    # a document's positions are at most its own lines
    lost = dropped_lines(docs, id_col, text_col, min_chars).groupBy("doc", "row").agg(F.collect_set("pos").alias("p"))
    return lost.mapInArrow(run, "doc long, row long, bitmap binary")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """All columns with the repeated lines gone from the text, ``n_lines`` and ``n_dropped``.

    A line is what lies between ``\\n``; its key is the stripped, lower-cased line. Keys of
    fewer than ``min_chars`` code points stay. A null text becomes an empty one (one
    empty line). Rows that repeat an id are one document, so their lines are no copies of
    each other. Rows without an id keep all lines and take none from others. An input
    column named like one of the two new ones is replaced. An empty table gives an empty result.
    """
    names = docs.columns
    place = names.index(text_col)
    # own names for the job; the table's columns get theirs back at the end
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{place}"
    bitmaps = Scratch(docs.sparkSession, "line-bitmaps").table(line_bitmaps(inner, key, text, min_chars), "bitmaps")
    kept = [c for c in inner.columns if c != text]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([xxhash.xxh3_64_intdigest(t.as_buffer()) for t in batch.column("text")], np.uint64)
            yield batch.append_column("row", pa.array(rows.view(np.int64)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for data, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist(), strict=True):
                lines = data.split(b"\n")
                n = len(lines)
                if bitmap is not None:
                    # lines behind the last dropped one stay
                    known = min(n, 8 * len(zlib.decompress(bitmap)))
                    keep = np.ones(n, bool)
                    keep[:known] = kept_lines(bitmap, known)
                    lines = [x for x, k in zip(lines, keep.tolist(), strict=True) if k]
                texts.append(b"\n".join(lines))
                total.append(n)
                gone.append(n - len(lines))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                [*kept, "text", "n_lines", "n_dropped"],
            )

    base = inner.select(*kept, text_bytes(text).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in base.schema}
    ddl = ", ".join(f"{c} {types[c]}" for c in kept)
    rowed = base.mapInArrow(hashed, f"{ddl}, text binary, row long".lstrip(", "))
    joined = rowed.join(
        bitmaps.select(F.col("doc").alias("b_doc"), F.col("row").alias("b_row"), "bitmap"),
        (F.col(key) == F.col("b_doc")) & (F.col("row") == F.col("b_row")),
        "left",
    ).select(*kept, "text", "bitmap")
    done = joined.mapInArrow(apply, f"{ddl}, text binary, n_lines long, n_dropped long".lstrip(", "))
    order = [f"c{i}" if i != place else "text" for i in range(len(names))]
    columns = [
        (F.col("text").cast("string") if o == "text" else F.col(o)).alias(n)
        for o, n in zip(order, names, strict=True)
        if n not in ("n_lines", "n_dropped")
    ]
    return done.select(*columns, "n_lines", "n_dropped")

