"""Packing texts into windows of a fixed number of tokens by multiway differencing.

Every document is cut into full windows and a rest; rests longer than ``piece`` are cut
again, so that windows can be filled. Blocks of rests are then divided into windows by the
Karmarkar-Karp method: partial partitions, each with a sum per window, are merged two at a
time, those with the largest spread first, the large sums of one upon the small sums of
the other. The sums end up nearly equal; where one exceeds the capacity, the block is
divided anew into more windows.

It is one map over the table without any shuffle: a block holds only rows of its task,
and sequence numbers are built from the task's partition number.
"""

import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import share_code, text_of
from factsieve.llm.tokens import KEPT_PIECES, encoder, tokenizer_path

WINDOW = 2048
# Rests are cut into pieces of at most this many tokens, and divided so many at a time.
PIECE = 700
BLOCK = 1024
# Texts encoded at once, in characters: by default, and beside the rests held here.
BATCH_BYTES = 4 << 20
PACK_BYTES = 1 << 20
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)


def difference(sizes: Sequence[int], windows: int) -> np.ndarray:
    """The window of each item after Karmarkar-Karp differencing into ``windows`` parts.

    A partial partition is kept without its zero sums: ascending sums and, for each, the
    items below it as a tree of pairs. Ties go to the partition made first.
    """
    if not len(sizes):
        return np.empty(0, np.int64)
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    # (-spread, age, ascending sums, their trees)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    age = n
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            sums, trees = np.concatenate([a, b]), np.concatenate([ta, tb])
        else:
            # the largest of one meet the smallest of the other
            sums = np.concatenate([a[:over] + b[:over][::-1], a[over:], b[over:]])
            first = len(left)
            left.extend(ta[:over].tolist())
            right.extend(tb[:over][::-1].tolist())
            trees = np.concatenate([np.arange(first, first + over), ta[over:], tb[over:]])
        order = np.argsort(sums, kind="stable")
        sums, trees = sums[order], trees[order]
        if len(sums) == windows:
            sums = sums - sums[0]
        heapq.heappush(heap, (-int(sums[-1]), age, sums, trees))
        age += 1
    where = np.empty(n, np.int64)
    for window, tree in enumerate(heap[0][3].tolist()):
        todo = [tree]
        while todo:
            t = todo.pop()
            if t < n:
                where[t] = window
            else:
                todo += [left[t], right[t]]
    return where


def into_windows(sizes: Sequence[int], capacity: int = WINDOW) -> np.ndarray:
    """The window of each item, none above ``capacity``; as few windows as differencing allows."""
    sizes = np.asarray(sizes, np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where = difference(sizes, windows)
        sums = np.bincount(where, weights=sizes, minlength=1)
        if sums.max(initial=0) <= capacity:
            return where
        # the excess above the mean tells how many windows are missing at least
        windows += max(1, int((sums.max() - capacity) * windows // (4 * capacity)))


def _groups(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some megabytes at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = text.as_py()
            ids.append(i)
            texts.append(value)
            size += len(value)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
        yield ids, texts


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    piece: int = PIECE,
    with_ids: bool = False,
    kept: int = KEPT_PIECES,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on demand,
    ``ids`` (the piece as little-endian 32-bit ids). A null or empty text consists of the
    end id alone. Null and repeated ids are packed like others, row by row. Other columns
    are ignored. An empty table gives an empty result.
    """
    share_code(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    names = SCHEMA.replace(" long", "").split(", ") + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, kept=kept).encode, np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        rests: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        def part(doc, data, start, length):
            cut = data[4 * start : 4 * (start + length)]
            return (doc, start, length, zlib.crc32(cut), len(data) // 4), (cut,) if with_ids else ()

        def flush(rests):
            nonlocal sequence
            where = into_windows([r[0][2] for r in rests], window)
            filled: dict[int, int] = {}
            rows = []
            for (row, cut), w in zip(rests, where.tolist(), strict=True):
                at = filled.get(w, 0)
                filled[w] = at + row[2]
                rows.append((*row, sequence + w, at, *cut))
            sequence += int(where.max(initial=-1)) + 1
            return batch_of(rows)

        for docs_, texts in _groups(batches, PACK_BYTES):
            rows = []
            for doc, data in zip(docs_, encode(texts), strict=True):
                data += end
                total = len(data) // 4
                full = total // window * window
                for start in range(0, full, window):
                    row, cut = part(doc, data, start, window)
                    rows.append((*row, sequence, 0, *cut))
                    sequence += 1
                parts = -(-(total - full) // piece)
                borders = [full + (total - full) * i // parts for i in range(parts + 1)] if parts else []
                rests += [part(doc, data, a, b - a) for a, b in zip(borders, borders[1:])]  # noqa: B905
            yield batch_of(rows)
            while len(rests) >= BLOCK:
                yield flush(rests[:BLOCK])
                rests = rests[BLOCK:]
        yield flush(rests)

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        text_of(text_col),
    )
    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
