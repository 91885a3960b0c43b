"""Language-model scores by prediction by partial matching, and a unigram base.

The model is a trie of byte contexts, learned from the training texts: how often each
symbol followed each context of up to ``ORDER`` bytes. A symbol is coded in the longest
context the trie knows. If the context has not seen it, an escape is coded with a weight
equal to the number of different symbols seen (less those excluded), and the next shorter
context is asked without the symbols that the longer one has already ruled out. At the end
all symbols left are equally likely. The code lengths of a document add up to its score.

Texts are coded as their words, A-Z in lower case, with one blank between, and an end.

Counting is combined in the tasks and shuffled. All counted runs stay in stored tables, one
of continuations and one of contexts per order. The code length of a symbol depends on the
``ORDER`` bytes before it alone, so each different run of the table, learned or not, is
coded once: a learned one in its own context, the others by joins from order to order.
Broadcast are only the code lengths of the runs that are most frequent in all rows and the
counts of the most frequent words, as a cache; all others are joined. ``Model`` is the same
in memory.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import Scratch, only, text_bytes
from factsieve.llm.words import _LOWER, _WORD, buffer_of, mix, some_rows, word_hashes

ORDER = 5
END = 256
SYMBOLS = 257
# Runs whose code lengths are broadcast, and words whose counts are, at most.
MAX_NODES = 1 << 20
MAX_WORDS = 1 << 17
# Counts collected in a task before they are combined, bytes of rows taken at once, and of a text coded at once.
_HELD = 1 << 20
_ROWS = 1 << 19
_PIECE = 1 << 19
# Marks the runs of rows that are not learned from while they are counted.
_NOT_LEARNED = 62


def held_out(doc_id: Column) -> Column:
    """Fixed rule of the fold: CRC-32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each closed by ``END``; borders of the texts)."""
    data, borders = buffer_of(column)
    n = len(borders) - 1
    word = _WORD[data]
    row = np.repeat(np.arange(n), np.diff(borders))
    keep = word.copy()
    if len(data):
        # a blank stays before a word that is not the first of its text
        before = np.concatenate([[0], np.cumsum(word)])
        later = before[:-1] > before[borders[:-1]][row]
        follows = np.zeros(len(data), bool)
        follows[:-1] = word[1:] & (row[1:] == row[:-1])
        keep |= ~word & follows & later
    sizes = np.bincount(row[keep], minlength=n) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(at[-1], END, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = np.where(word[keep], _LOWER[data[keep]], 32)
    return out, at


def contexts(stream: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each symbol, nearest lowest; 0 before the text begins."""
    place = np.arange(len(stream)) - np.repeat(at[:-1], np.diff(at))
    out = np.zeros(len(stream), np.int64)
    for k in range(1, order + 1):
        if len(stream) > k:
            out[k:] |= np.where(place[k:] >= k, stream[:-k], 0) << (8 * (k - 1))
    return out


def _coded(stream: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    return (contexts(stream, at, order) << 9) | stream


def _long_codes(data: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """As :func:`codes` for one long text, cut at blanks; each piece goes on from the symbols before it."""
    low, before = 0, np.empty(0, np.int64)
    while low < len(data):
        high = min(low + _PIECE, len(data))
        while high < len(data) and _WORD[data[high]]:
            blank = np.flatnonzero(~_WORD[data[high : high + 4096]])
            high += int(blank[0]) if len(blank) else 4096
        high = min(high, len(data))
        stream = symbols(pa.array([data[low:high].tobytes()], pa.binary()))[0][:-1]
        if len(stream) and len(before):
            stream = np.append(32, stream)
        whole = np.append(before, stream)
        yield _coded(whole, np.array([0, len(whole)]), order)[len(before) :]
        low, before = high, whole[max(len(whole) - order, 0) :] if order else whole[-1:]
    whole = np.append(before, END)
    yield _coded(whole, np.array([0, len(whole)]), order)[len(before) :]


def codes(column: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each symbol, context and symbol) of all texts, a piece at a time; no text's order is lost."""
    data, borders = buffer_of(column)
    sizes = np.diff(borders)
    stops = [*np.flatnonzero(sizes > _PIECE).tolist(), len(sizes)]
    at = 0
    for stop in stops:
        if at < stop:
            stream, starts = symbols(column.slice(at, stop - at))
            yield np.repeat(np.arange(at, stop), np.diff(starts)), _coded(stream, starts, order)
        if stop < len(sizes):
            for code in _long_codes(data[borders[stop] : borders[stop + 1]], order):
                yield np.full(len(code), stop), code
        at = stop + 1


class Table:
    """Places of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = max(16, 1 << int(3 * max(len(keys), 1)).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            place = self.slots[slot].astype(np.int64)
            hit = (place >= 0) & (self.keys[place] == keys[todo])
            out[todo[hit]] = place[hit]
            more = (place >= 0) & ~hit
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out


@dataclass
class Level:
    """One order of the trie: continuations, and per context what escaping needs."""

    grams: Table
    counts: np.ndarray
    known: Table
    total: np.ndarray
    kinds: np.ndarray
    ruled_out: np.ndarray  # count, in the next shorter context, of the symbols this one has seen


class Model:
    """``tables``: per order (keys, counts); a key is the context times 512 plus the symbol."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        for order, (keys, counts) in enumerate(tables):
            by = np.argsort(keys, kind="stable")
            keys, counts = keys[by], counts[by].astype(np.float64)
            context = keys >> 9
            known, first = np.unique(context, return_index=True)
            last = np.append(first[1:], len(keys))
            ruled_out = np.zeros(len(known))
            if order and len(keys):
                below = self.levels[-1]
                shorter = ((context & ((1 << (8 * (order - 1))) - 1)) << 9) | (keys & 511)
                ruled_out = np.add.reduceat(below.counts[below.grams.find(shorter)], first)
            total = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
            self.levels.append(
                Level(Table(keys), counts, Table(known), total, (last - first).astype(np.float64), ruled_out)
            )

    def log10(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        out = np.zeros(len(symbol))
        todo = np.arange(len(symbol))
        gone_count, gone_kinds = np.zeros(len(symbol)), np.zeros(len(symbol))
        for order in range(len(self.levels) - 1, -1, -1):
            level = self.levels[order]
            near = context[todo] & ((1 << (8 * order)) - 1)
            node = level.known.find(near)
            gram = np.full(len(todo), -1, np.int64)
            seen = node >= 0
            gram[seen] = level.grams.find((near[seen] << 9) | symbol[todo[seen]])
            kinds = np.where(seen, level.kinds[node], 0) - gone_kinds if len(level.kinds) else -gone_kinds
            total = np.where(seen, level.total[node], 0) - gone_count if len(level.total) else -gone_count
            hit = gram >= 0
            out[todo[hit]] += np.log10(level.counts[gram[hit]] / (total[hit] + kinds[hit]))
            escape = seen & ~hit & (kinds > 0)
            out[todo[escape]] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            rest = ~hit
            node = node[rest]
            todo = todo[rest]
            if len(level.kinds):
                gone_count = np.where(node >= 0, level.ruled_out[node], 0)
                gone_kinds = np.where(node >= 0, level.kinds[node], 0)
            else:
                gone_count, gone_kinds = np.zeros(len(todo)), np.zeros(len(todo))
        out[todo] -= np.log10(np.maximum(SYMBOLS - gone_kinds, 1))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """log10 of the probability of each text of a binary column."""
        stream, at = symbols(column)
        context = contexts(stream, at, len(self.levels) - 1)
        sums = np.zeros(len(stream) + 1)
        for low in range(0, len(stream), _PIECE):
            sums[low + 1 : low + 1 + _PIECE] = self.log10(context[low : low + _PIECE], stream[low : low + _PIECE])
        # sums over each text, not differences of one long running sum
        return np.add.reduceat(sums[1:], at[:-1]) if len(at) > 1 else np.zeros(0)


class _Counter:
    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(n)
        self.held += len(found)
        if self.held > _HELD and len(self.keys) > 1:
            self.combine()

    def combine(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], 0
        return keys, counts


def count_corpus(
    docs: DataFrame, text_col: str, scratch: Scratch, order: int = ORDER, learned: Column | None = None
) -> DataFrame:
    """``kind, key, n, n_all``: words (0), runs of context and symbol (1) and texts (2).

    ``n`` sums over the rows that are learned from (all, if not told). ``n_all`` sums runs over
    all rows; words and texts are counted in learned rows only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, texts = _Counter(), _Counter(), 0
        for batch in some_rows(batches, 0, _ROWS):
            learn_from = batch.column(1)
            known = batch.column(0).filter(learn_from)
            texts += len(known)
            words.add(word_hashes(known)[0].view(np.int64))
            mark = (~learn_from.to_numpy(zero_copy_only=False)).astype(np.int64) << _NOT_LEARNED
            for row, code in codes(batch.column(0), order):
                grams.add(code | mark[row])
        yield counted_rows(2, np.zeros(1, np.int64), np.array([texts]), np.array([texts]))
        keys, counts = words.combine()
        yield counted_rows(0, keys, counts, counts)
        keys, counts = grams.combine()
        marked = keys >> _NOT_LEARNED
        yield counted_rows(1, keys ^ (marked << _NOT_LEARNED), np.where(marked == 1, 0, counts), counts)

    def counted_rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        kinds = np.full(len(columns[0]), kind, np.int8)
        return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, columns)], ["kind", "key", "n", "n_all"])

    learned = F.lit(True) if learned is None else learned
    counted = docs.select(text_bytes(text_col), learned.alias("learned")).mapInArrow(
        run, "kind byte, key long, n long, n_all long"
    )
    sums = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
    return scratch.table(sums, "counts")


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy()


def _at_most(df: DataFrame, most: int) -> DataFrame:
    """Rows above a threshold of ``n`` that leaves ``most`` rows or fewer."""
    bits = {r["b"]: r["c"] for r in df.groupBy(F.ceil(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
    rows, threshold = 0, 1
    for b in sorted(bits, reverse=True):
        if rows + bits[b] > most:
            threshold = (1 << int(b)) + 1
            break
        rows += bits[b]
    return df.where(F.col("n") >= threshold)


def _context(k: int) -> Column:
    return F.shiftright("key", 9).bitwiseAND(F.lit((1 << (8 * k)) - 1))


def _run(k: int) -> Column:
    """The run of ``k`` bytes and a symbol that ends a longer one."""
    return F.shiftleft(_context(k), 9).bitwiseOR(F.col("key").bitwiseAND(F.lit(511)))


def learn(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per order the stored continuations ``gram, n`` and contexts ``context, total, kinds, ruled_out``."""
    grams = counts.where("kind = 1 and n > 0").select("key", "n")
    levels = []
    for k in range(order, -1, -1):
        if k:
            shorter = scratch.table(grams.groupBy(_run(k - 1).alias("key")).agg(F.sum("n").alias("n")), "runs")
            below = shorter.select(F.col("key").alias("gram"), F.col("n").alias("m"))
            both = grams.join(below, _run(k - 1) == F.col("gram"))
        else:
            shorter, both = grams, grams.withColumn("m", F.lit(0))
        contexts_ = both.groupBy(_context(k).alias("context")).agg(
            F.sum("n").cast("double").alias("total"),
            F.count("*").cast("double").alias("kinds"),
            F.sum("m").cast("double").alias("ruled_out"),
        )
        levels.append((grams.select(F.col("key").alias("gram"), "n"), scratch.table(contexts_, "contexts")))
        grams = shorter
    return levels[::-1]


def code_lengths(keys: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``key, log``: log10 of the probability of each run's symbol after its context."""
    zero = F.lit(0.0)
    found = keys.select("key", F.lit(None).cast("double").alias("log"), *[zero.alias(c) for c in ("acc", "gone", "out")])
    for k in range(len(levels) - 1, -1, -1):
        grams, known = levels[k]
        # a few short contexts have most of the runs; those tables are small by their key
        grams = F.broadcast(grams) if k < 2 else grams
        known = F.broadcast(known) if k < 3 else known
        found = found.join(known, _context(k) == F.col("context"), "left").join(grams, _run(k) == F.col("gram"), "left")
        kinds, total = F.col("kinds") - F.col("out"), F.col("total") - F.col("gone")
        escape = F.when(F.col("n").isNull() & (kinds > 0), F.log10(kinds / (total + kinds))).otherwise(zero)
        found = found.select(
            "key",
            F.coalesce("log", F.col("acc") + F.log10(F.col("n") / (total + kinds))).alias("log"),
            (F.col("acc") + escape).alias("acc"),
            F.coalesce("ruled_out", zero).alias("gone"),
            F.coalesce("kinds", zero).alias("out"),
        )
    last = F.col("acc") - F.log10(F.greatest(SYMBOLS - F.col("out"), F.lit(1.0)))
    return found.select("key", F.coalesce("log", last).alias("log"))


def code_all(counts: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``key, n, log`` of each counted run: how often it is in all rows, and its code length.

    A learned run is coded in its own context; only the others look into shorter ones.
    """
    grams = counts.where("kind = 1")
    learned = grams.where("n > 0").join(levels[-1][1], _context(len(levels) - 1) == F.col("context"))
    learned = learned.select("key", "n_all", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log"))
    other = grams.where("n = 0").select("key", F.col("n_all").alias("times"))
    coded = code_lengths(other.select("key"), levels).join(other, "key").select("key", "times", "log")
    return learned.union(coded).withColumnRenamed("n_all", "n")


def _tally(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The different keys of each of ``n`` rows, and how often they occur."""
    by = np.lexsort((keys, rows))
    rows, keys = rows[by], keys[by]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])][: len(keys)])
    times = np.diff(np.append(first, len(keys)))
    borders = pa.array(np.searchsorted(rows[first], np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(borders, pa.array(keys[first])), pa.ListArray.from_arrays(borders, pa.array(times))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of all rows under models of the rows that are not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: words and one
    end; how many of them the training rows have; the log10 probability under word
    frequencies and under the trie. A null or empty text is an end alone. A row without an
    id belongs to the training rows; repeated rows are counted and scored each. Other
    columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    docs = only(docs, [id_col, text_col])
    counts = count_corpus(docs, text_col, scratch, order, ~held_out(F.col(f"`{id_col}`")))
    words = counts.where("kind = 0")
    sums = counts.where("kind <> 1").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    of_kind = {r["kind"]: (r["n"], r["c"]) for r in sums}
    n_words, n_kinds = of_kind.get(0, (0, 0))
    n_texts = of_kind.get(2, (0, 0))[0]
    n_all, v = n_words + n_texts, n_kinds + (n_texts > 0)
    below = n_all + 0.5 * (v + 1)
    keys, n = _arrays(_at_most(words, MAX_WORDS).select("key", "n"))
    logs = np.log10((n + 0.5) / below)
    levels = learn(counts, scratch, order)
    coded = scratch.table(code_all(counts, levels), "coded")
    run_keys, run_logs = _arrays(_at_most(coded, MAX_NODES).select("key", "log"))
    shared = spark.sparkContext.broadcast((Table(run_keys), run_logs, Table(keys), logs))
    end = float(np.log10((n_texts + 0.5) / below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached, cached_logs, common, known_logs = shared.value
        for batch in some_rows(batches, 1, _ROWS):
            column, rows = batch.column(1), batch.num_rows
            hashes, at = word_hashes(column)
            place = common.find(hashes.view(np.int64))
            row = np.repeat(np.arange(rows), np.diff(at))
            hit = place >= 0
            known = np.bincount(row[hit], minlength=rows)
            base = np.bincount(row[hit], weights=known_logs[place[hit]], minlength=rows)
            rare = hashes[~hit].view(np.int64)
            borders = np.searchsorted(row[~hit], np.arange(rows + 1))
            value, far = np.zeros(rows), []
            for of_row, code in codes(column, order):
                found = cached.find(code)
                hit = found >= 0
                value += np.bincount(of_row[hit], weights=cached_logs[found[hit]], minlength=rows)
                far.append((of_row[~hit], code[~hit]))
            far_rows, far_codes = (np.concatenate(c) for c in zip(*far, strict=True)) if far else (at[:0], at[:0])
            far_keys, far_times = _tally(far_rows, far_codes, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at) + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(value),
                    pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(rare)),
                    far_keys,
                    far_times,
                ],
                ["doc_id", "n_tokens", "known", "base", "score", "rare", "far", "far_times"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col)).mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, known long, base double, score double, "
        "rare array<long>, far array<long>, far_times array<long>",
    )
    scored = scratch.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    missing = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    looked = missing.join(words.select("key", "n"), "key", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(below))
    added = looked.groupBy("row").agg(
        F.sum(log * F.col("times")).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("found")
    )
    joined = scored.drop("rare", "far", "far_times").join(added, "row", "left")
    zipped = F.explode(F.arrays_zip("far", "far_times")).alias("f")
    apart = scored.select("row", zipped).select("row", F.col("f.far").alias("key"), F.col("f.far_times").alias("times"))
    summed = apart.join(coded.select("key", "log"), "key").groupBy("row").agg(F.sum(F.col("log") * F.col("times")).alias("apart"))
    joined = joined.join(summed, "row", "left")
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0)) + F.lit(int(n_texts > 0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("score") + F.coalesce("apart", F.lit(0.0))).alias("score"),
    )
