"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and
carriage return; A-Z count as a-z. All words of a batch are hashed together: a
polynomial over random byte values, taken from running sums, then mixed with the length.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLANKS = b" \t\n\x0b\x0c\r"

_WORD = np.ones(256, bool)
_WORD[list(BLANKS)] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20_11)).integers(1, 2**64, 256, np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
# Bytes hashed at once; a longer word is still hashed whole.
_WINDOW = 1 << 20
# Text bytes that a task works on at once.
_ROWS_BYTES = 1 << 21
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, _WINDOW), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, borders of the rows) of a binary column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[borders[0] : borders[-1]], borders - borders[0]


def some_rows(batches: Iterable[pa.RecordBatch], column: int, most: int = _ROWS_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``most`` bytes of text (or one row), which bounds the memory of a task."""
    for batch in batches:
        _, borders = buffer_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(borders, borders[at] + most, "right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, borders of the rows among them) of a binary column."""
    data, borders = buffer_of(column)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(borders), np.int64)
    word = _WORD[data]
    fresh = np.zeros(n + 1, bool)
    fresh[borders] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | fresh[1:n]
    finish = word.copy()
    finish[:-1] &= ~word[1:] | fresh[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(int(np.searchsorted(ends, low + _WINDOW, "right")), at + 1)
        high = ends[to - 1]
        m = int(high - low)
        sums = np.empty(m + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[data[low:high]] * _power(_BASE, m), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        raw = (sums[e] - sums[s]) * _power(_BACK, m)[s]
        out[at:to] = mix(raw + (e - s).astype(np.uint64) * _STEP)
        at = to
    return out, np.searchsorted(starts, borders)


def shingle_hashes(words: np.ndarray, borders: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``n`` words, borders); a shorter row counts as one run of its own length."""
    sizes = np.diff(borders)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_borders = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_borders[-1], np.uint64)
    total = len(words)
    if total >= n:
        run = words[: total - n + 1].copy()
        for k in range(1, n):
            run = run * _BASE + words[k : total - n + 1 + k]
        run = mix(run + np.uint64(n))
    full = sizes >= n
    if full.any():
        # places of the full rows in the input and in the output
        first, number = borders[:-1][full], count[full]
        shift = np.repeat(first - out_borders[:-1][full], number)
        place = np.repeat(out_borders[:-1][full] - np.concatenate([[0], np.cumsum(number)[:-1]]), number)
        place += np.arange(number.sum())
        out[place] = run[place + shift]
    for i in np.flatnonzero((sizes > 0) & ~full):
        h = 0
        for w in words[borders[i] : borders[i + 1]].tolist():
            h = (h * int(_BASE) + w) % 2**64
        out[out_borders[i]] = mix(np.array([(h + int(sizes[i])) % 2**64], np.uint64))[0]
    return out, out_borders


def row_sets(hashes: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    return [np.unique(hashes[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
