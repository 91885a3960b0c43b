"""Runs of words that repeat with a period, found on suffix and LCP arrays.

A run is a stretch of words with smallest period ``q`` that cannot be made longer on either
side. Where it ends, a square of period ``q`` ends that cannot be rotated to the right: two
suffixes ``i`` and ``i + q`` that agree in exactly ``q`` words. Such a pair meets at a
boundary of the suffix array whose LCP is ``q``, one suffix on either side of it. So for
each boundary the suffixes of the smaller side (n log n in all) look up the suffix ``q``
words before and behind them in the inverse suffix array: a square is there if that rank
lies on the other side. No tree is built; the sides are the ranges up to the next smaller
LCP. The squares found are rotated to the left as far as the words allow, which gives the
runs; squares of a multiple of a run's period inside that run are dropped.

A run that holds its period ``k`` times has each of its words ``k`` times. Stretches
without rarer words are all that is sorted, which leaves little of ordinary prose.

All texts of a batch are worked on together in numpy; a stretch is compared within its own
text alone, since its suffixes are sorted by stretch first.
"""

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import share_code, text_bytes
from factsieve.llm.words import some_rows

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Text taken at once, suffixes looked up at once, and steps taken for all before the rest go on by blocks.
ROWS_BYTES = 1 << 21
_LOOKED_UP = 1 << 20
_STEPS = 16
# Rounds in which stretches lose rare words; more would only make the sorted part smaller.
_ROUNDS = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _agree(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places ``i`` and ``j`` on, ``most`` at most, forwards (1) or backwards (-1)."""
    out = np.zeros(len(i), np.int64)
    todo = np.flatnonzero(most > 0)
    for n in range(_STEPS):
        todo = todo[words[i[todo] + step * n] == words[j[todo] + step * n]]
        out[todo] = n + 1
        todo = todo[most[todo] > n + 1]
        if not len(todo):
            return out
    for k in todo.tolist():
        a, b, n, size, end = int(i[k]), int(j[k]), _STEPS, _STEPS, int(most[k])
        while n < end:
            size = min(2 * size, end - n)
            x, y = (words[p + n : p + n + size] if step > 0 else words[p - n - size + 1 : p - n + 1] for p in (a, b))
            apart = np.flatnonzero(x != y)
            if len(apart):
                n += int(apart[0] if step > 0 else size - 1 - apart[-1])
                break
            n += size
        out[k] = n
    return out


def suffix_ranks(words: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of each suffix in the order of its stretch, by doubling; ``rank`` orders the first words.

    A rank is the place of the first suffix of its group of equal beginnings; only groups
    of more than one are sorted further. A suffix that is over sorts first.
    """
    sizes = np.bincount(rank)
    rank = (np.cumsum(sizes) - sizes)[rank]
    h, n = 1, len(words)
    todo = np.flatnonzero(sizes[np.searchsorted(np.cumsum(sizes), rank, "right")] > 1)
    while len(todo):
        after = np.where(todo + h < ends[todo], rank[np.minimum(todo + h, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[todo]))
        todo, after = todo[by], after[by]
        old = rank[todo]
        group = np.r_[True, old[1:] != old[:-1]]
        fresh = group | np.r_[True, after[1:] != after[:-1]]
        place = np.arange(len(todo))
        first = np.maximum.accumulate(np.where(group, place, 0))
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[todo] = old + start - first
        same = np.r_[~fresh[1:], False] | ~fresh
        todo = todo[same]
        h *= 2
    return rank


def lcp_array(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Agreement of each suffix with the one before it in the order, 0 across stretches.

    In text order it falls by one from a suffix to the next, as long as the words before the
    two compared suffixes are equal; only the others are compared, n log n words in all.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    before[(before >= 0) & (begins[before] != begins)] = -1
    alone = (before < 0) | (here == begins) | (before == begins)
    alone |= words[here - 1] != words[before - 1]
    i = np.flatnonzero(alone & (before >= 0))
    value = np.zeros(n, np.int64)
    value[i] = _agree(words, i, before[i], ends[i] - np.maximum(i, before[i]), 1)
    last = np.maximum.accumulate(np.where(alone, here, 0))
    value = np.where(before >= 0, value[last] - (here - last), 0)
    return value[order]


def smaller_before(values: np.ndarray, equal: bool) -> np.ndarray:
    """The last place before each one with a smaller value (or an equal one); -1 if there is none.

    All follow the answers of their neighbours together; the few with a long way go one by
    one, where every step skips places that nothing later asks again.
    """
    n = len(values)
    out = np.arange(n) - 1

    def too_large(k):
        at = out[k]
        return (at >= 0) & ((values[at] > values[k]) if equal else (values[at] >= values[k]))

    todo = np.arange(n)
    for _ in range(_STEPS):
        todo = todo[too_large(todo)]
        if not len(todo):
            return out
        out[todo] = out[out[todo]]
    numbers, places = values.tolist(), out.tolist()
    for k in todo.tolist():
        at, own = places[k], numbers[k]
        while at >= 0 and (numbers[at] > own or (not equal and numbers[at] == own)):
            at = places[at]
        places[k] = at
    return np.array(places, np.int64)


def _squares(rank: np.ndarray, order: np.ndarray, lcp: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: np.ndarray):
    """(starts, periods) of the squares that cannot be rotated to the right; ``most`` bounds the period."""
    n = len(rank)
    left = smaller_before(lcp, True)
    right = n - 1 - smaller_before(lcp[::-1], False)[::-1]
    at = np.flatnonzero((lcp > 0) & (lcp <= most[order]))
    low, high = np.maximum(left[at], 0), right[at]
    small_left = at - low <= high - at
    first, last = np.where(small_left, low, at), np.where(small_left, at, high)
    other, beyond = np.where(small_left, at, low), np.where(small_left, high, at)
    sizes = last - first
    ends_of = np.cumsum(sizes)
    starts, periods = [], []
    k = 0
    while k < len(at):
        to = max(k + 1, int(np.searchsorted(ends_of, ends_of[k] - sizes[k] + _LOOKED_UP, "right")))
        number = sizes[k:to]
        which = np.repeat(np.arange(k, to), number)
        i = order[first[which] + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)]
        d = lcp[at[which]]
        for j, inside in ((i + d, i + d < ends[i]), (i - d, i - d >= begins[i])):
            j, me, w = j[inside], i[inside], which[inside]
            hit = (rank[j] >= other[w]) & (rank[j] < beyond[w])
            starts.append(np.minimum(me, j)[hit])
            periods.append(d[inside][hit])
        k = to
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _stretches(words: np.ndarray, texts: np.ndarray, min_length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of the stretch of each) of all words that can be in a run."""
    here = np.flatnonzero(np.bincount(words)[words] >= times) if len(words) else np.empty(0, np.int64)
    part = texts[here]
    for _ in range(_ROUNDS):
        new = np.r_[True, (np.diff(here) > 1) | (np.diff(part) != 0)][: len(here)]
        part = np.cumsum(new) - 1
        sizes = np.bincount(part)
        _, group, n = np.unique(part * len(words) + words[here], return_inverse=True, return_counts=True)
        keep = (n[group] >= times) & (sizes[part] >= min_length)
        if keep.all():
            break
        here, part = here[keep], part[keep]
    new = np.r_[True, (np.diff(here) > 1) | (np.diff(part) != 0)][: len(here)]
    return here, np.cumsum(new) - 1


def find_runs(
    words: np.ndarray, texts: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``max(min_length, min_exponent * period)`` words.

    ``words``: numbers of the words of all texts, one below the number of words, different in
    different texts; ``texts``: the text of each. ``min_exponent`` is 2 or more. By start, then period.
    """
    here, part = _stretches(words, texts, min_length, min_exponent)
    none = np.empty(0, np.int64)
    if not len(here):
        return none, none, none
    w = words[here]
    sizes = np.bincount(part)
    last = np.cumsum(sizes)
    ends, begins = last[part], (last - sizes)[part]
    rank = suffix_ranks(w, ends, np.unique(part * len(words) + w, return_inverse=True)[1])
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    lcp = lcp_array(w, begins, ends, order)
    start, period = _squares(rank, order, lcp, begins, ends, sizes[part] // min_exponent)
    by = np.lexsort((period, start + 2 * period))
    start, period = start[by], period[by]
    found = []
    while len(start):
        end = start + 2 * period
        first = np.r_[True, end[1:] != end[:-1]]
        s, p, e = start[first], period[first], end[first]
        s = s - _agree(w, s - 1, s + p - 1, s - begins[s], -1)
        found.append((s, e - s, p))
        of = np.cumsum(first) - 1
        rest = ~first & ~((period % p[of] == 0) & (start >= s[of]))
        start, period = start[rest], period[rest]
    if not found:
        return none, none, none
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    long = length >= np.maximum(min_length, min_exponent * period)
    start, length, period = here[start[long]], length[long], period[long]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, number of each word, borders); a number is the place of the word's first use in its text."""
    lists = [t.split() for t in texts]
    borders = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    numbers = np.empty(borders[-1], np.int64)
    for a, b, x in zip(borders.tolist(), borders[1:].tolist(), lists, strict=False):
        numbers[a:b] = np.fromiter(map({}.setdefault, x, count(a)), np.int64, b - a)
    return lists, numbers, borders


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Per row ``doc_id, n_words, runs, text``: its runs and its text with each run cut to one period.

    Words are separated by blanks, tabs and line breaks and compared as they are. ``runs``
    has first word (from 0), length and smallest period, by start and period. ``text`` joins
    the words that stay by single blanks: a word goes if it lies behind the first period of
    some run. A null or empty text, or one of blanks, has no words and no runs. Ids may be
    null or repeat; every row is worked on by itself. Other columns are ignored. An empty
    table gives an empty result.
    """
    share_code(docs.sparkSession)
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, 1, ROWS_BYTES):
            lists, numbers, borders = _numbered(batch.column(1).to_pylist())
            texts = np.repeat(np.arange(len(lists)), np.diff(borders))
            start, length, period = find_runs(numbers, texts, min_length, min_exponent)
            change = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change)[:-1] > 0
            row = texts[start]
            touched = set(row.tolist())
            kept = []
            for i, x in enumerate(lists):
                if i in touched:
                    out = gone[borders[i] : borders[i + 1]].tolist()
                    x = [word for word, g in zip(x, out, strict=True) if not g]
                kept.append(b" ".join(x))
            parts = [start - borders[row], length, period]
            cells = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["start", "length", "period"])
            at = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(borders)),
                    pa.ListArray.from_arrays(at, cells),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, text string")
