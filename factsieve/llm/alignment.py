"""Alignment of two tokenizers: byte groups on which both agree, and corpus-wide pair counts.

Both tokenizations of a text divide the same bytes. Where tokens of both end, a group ends.
Tokens taken from a range of bytes (those whose last byte lies in it) form a *fragment*: an
open prefix up to the first common end, the closed groups behind it, and an open suffix; a
range without a common end is all prefix. Fragments compose: the suffix of one and the
prefix of the next make one group, the rest stays. That is associative, so fragments of a
very long document, from slices encoded by different tasks, are composed in a tree over
Spark tasks; only the open ends travel, closed groups stay where they were found.

A text is one row of a task up to ``SLICE`` characters. Longer ones are cut at blanks that
both tokenizers respect, their slices spread over the tasks. In a task everything is done
for many texts at once: with the ends of both marked on their bytes, each stretch between
two marks is one link, a token of one overlapping a token of the other.

Pairs of ids are counted over all texts, combined in the tasks and shuffled. Texts are then
met with the counts: the most frequent pairs are broadcast as a cache of at most
``MAX_PAIRS``, the links to all others are joined.
"""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.ppm import Table, _arrays, _at_most, _Counter, _tally
from factsieve.llm.store import Scratch, only, text_of
from factsieve.llm.token_counts import segments
from factsieve.llm.tokens import DEFAULT_PIECES, DEFAULT_TOKENIZER, Encoder, Pieces, encoder, tokenizer_path
from factsieve.llm.words import some_rows

# Characters of a slice; bytes of a range that becomes a fragment; fragments composed by one task.
SLICE = 1 << 16
RANGE = 1 << 13
FAN = 16
# Text bytes (or bytes of ids) worked on at once; pairs that are broadcast at most.
ROWS_BYTES = 1 << 20
MAX_PAIRS = 1 << 20
# Pieces that a worker keeps of each tokenizer, twice.
KEPT = 200_000
# Pairs handed on in one row, and different ones that a task holds before it hands them on.
_PAIRS_A_ROW = 1 << 16
_PAIRS_HELD = 1 << 20
_NONE = np.empty(0, np.uint32)


def letters_of_bytes() -> dict[str, int]:
    """How byte-level vocabularies write each byte: visible Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(source: Encoder | Pieces) -> list[bytes]:
    """The bytes of each id."""
    if isinstance(source, Encoder):
        letters = letters_of_bytes()
        vocab = source.tokenizer.get_vocab()
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in letters for c in token)
            out[i] = bytes(letters[c] for c in token) if known else token.encode()
        return out
    model = source.model
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
    ]


Tokens = tuple[np.ndarray, np.ndarray]


def _joined(*parts: Tokens) -> Tokens:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Fragment:
    """Ids of both sides: ``prefix`` up to the first common end, groups in ``closed``, ``suffix`` behind the last."""

    cut: bool
    prefix: Tokens = (_NONE, _NONE)
    closed: list[Tokens] = field(default_factory=list)
    suffix: Tokens = (_NONE, _NONE)

    def __add__(self, other: "Fragment") -> "Fragment":
        if not self.cut:
            return Fragment(other.cut, _joined(self.prefix, other.prefix), other.closed, other.suffix)
        if not other.cut:
            return Fragment(True, self.prefix, self.closed, _joined(self.suffix, other.prefix))
        middle = _joined(self.suffix, other.prefix)
        return Fragment(True, self.prefix, [*self.closed, middle, *other.closed], other.suffix)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of tokens of one range, with the places where they end."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return Fragment(False, (a, b))
    p, q = np.searchsorted(a_ends, common[[0, -1]], "right")
    r, s = np.searchsorted(b_ends, common[[0, -1]], "right")
    return Fragment(True, (a[:p], b[:r]), [(a[p:q], b[r:s])], (a[q:], b[s:]))


def composed(fragments: Iterable[Fragment]) -> Fragment:
    """All of them in order, neighbours first."""
    level = list(fragments)
    while len(level) > 1:
        level = [reduce(Fragment.__add__, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else Fragment(False)


@dataclass
class Links:
    """All overlaps of tokens of some texts."""

    keys: np.ndarray  # id of b times 2^32 plus id of a
    row: np.ndarray
    a_group: np.ndarray  # the group of each token
    b_group: np.ndarray
    group_row: np.ndarray


class Vocabulary:
    def __init__(self, source: Encoder | Pieces):
        names = token_bytes(source)
        self.sizes = np.array([len(n) for n in names], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        self.within = np.array([b"%d," % i for i in range(len(names))], object)
        self.last = {c: np.array([b"%d" % i + c for i in range(len(names))], object) for c in (b"|", b";")}

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """All bytes of the tokens."""
        sizes = self.sizes[ids]
        return self.flat[np.repeat(self.at[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Aligner:
    """Two tokenizers of a worker."""

    def __init__(self, first: str, second: str):
        self.sources = encoder(first, True, KEPT), encoder(second, True, KEPT)
        self.a, self.b = (Vocabulary(s) for s in self.sources)

    def encode(self, texts: list[str]) -> tuple[list[Tokens], np.ndarray]:
        """Ids of a blank and each text by both, and whether both spell just that. Those that do not get no ids."""
        ids = []
        for source in self.sources:
            given = [" " + t for t in texts] if isinstance(source, Encoder) else texts
            ids.append([np.frombuffer(x, "<u4") for x in source.encode(given)])
        wanted = [b" " + t.encode() for t in texts]
        sizes = np.array([len(w) for w in wanted], np.int64)
        good = np.array([bool(t) for t in texts], bool)
        for vocabulary, found in zip((self.a, self.b), ids, strict=True):
            good &= np.array([vocabulary.sizes[x].sum() for x in found], np.int64) == sizes
        some = np.flatnonzero(good)
        if len(some):
            row = np.repeat(some, sizes[some])
            text = np.frombuffer(b"".join([wanted[i] for i in some]), np.uint8)
            for vocabulary, found in zip((self.a, self.b), ids, strict=True):
                good[row[vocabulary.spelled(np.concatenate([found[i] for i in some])) != text]] = False
        pairs = zip(*ids, strict=True)
        return [(a, b) if g else (_NONE, _NONE) for (a, b), g in zip(pairs, good.tolist(), strict=True)], good

    def links(self, rows: list[Tokens]) -> tuple[np.ndarray, np.ndarray, Links]:
        """(all ids of one side, of the other, links) of rows that each begin and end on a common border."""
        if not rows:
            return _NONE, _NONE, Links(*[np.empty(0, np.int64)] * 5)
        a, b = _joined(*rows)
        a_ends, b_ends = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        n = int(a_ends[-1]) if len(a) else 0
        in_a, in_b = np.zeros(n, bool), np.zeros(n, bool)
        in_a[a_ends - 1] = True
        in_b[b_ends - 1] = True
        ends = np.flatnonzero(in_a | in_b)
        of_a, of_b = in_a[ends], in_b[ends]
        ia, ib = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        close = of_a & of_b
        group = np.cumsum(close) - close
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        keys = (b[ib].astype(np.int64) << 32) | a[ia]
        return a, b, Links(keys, row[ia], group[of_a], group[of_b], row[ia[close]])

    def written(self, a: np.ndarray, b: np.ndarray, links: Links, rows: int) -> list[bytes]:
        """Per row its groups, ``a1,a2|b1;...``, each with its semicolon."""
        n_groups = len(links.group_row)
        a_size, b_size = (np.bincount(g, minlength=n_groups) for g in (links.a_group, links.b_group))
        out = np.empty(len(a) + len(b), object)
        b_before = np.cumsum(b_size) - b_size
        a_last = np.r_[links.a_group[1:] != links.a_group[:-1], True][: len(a)]
        b_last = np.r_[links.b_group[1:] != links.b_group[:-1], True][: len(b)]
        out[np.arange(len(a)) + b_before[links.a_group]] = np.where(a_last, self.a.last[b"|"][a], self.a.within[a])
        out[np.arange(len(b)) + np.cumsum(a_size)[links.b_group]] = np.where(b_last, self.b.last[b";"][b], self.b.within[b])
        size = np.bincount(links.group_row, weights=a_size + b_size, minlength=rows).astype(np.int64)
        borders = np.concatenate([[0], np.cumsum(size)]).tolist()
        return [b"".join(out[x:y].tolist()) for x, y in zip(borders, borders[1:], strict=False)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def _small(ids: np.ndarray) -> bytes:
    """Ids in two bytes each if they fit, behind a byte that tells the width."""
    wide = len(ids) and ids.max() > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype(np.uint32)


_FIRST = [
    ("kind", "byte", pa.int8()),
    ("row", "long", pa.int64()),
    ("k", "int", pa.int32()),
    ("n_a", "long", pa.int64()),
    ("n_b", "long", pa.int64()),
    ("n_groups", "long", pa.int64()),
    ("n_links", "long", pa.int64()),
    ("digest", "string", pa.string()),
    ("groups", "string", pa.string()),
    ("a", "binary", pa.binary()),
    ("b", "binary", pa.binary()),
    ("slice", "string", pa.string()),
    ("keys", "array<long>", pa.list_(pa.int64())),
    ("times", "array<long>", pa.list_(pa.int64())),
]
_DONE, _SLICE, _PAIRS = 0, 1, 2
_ENDS = ("pa", "pb", "sa", "sb")
_MERGED = "row long, k int, cut boolean, pa binary, pb binary, sa binary, sb binary, closed array<struct<k:int,a:binary,b:binary>>"


def _pair_rows(counter: _Counter) -> Iterator[dict]:
    keys, times = counter.combine()
    for i in range(0, len(keys), _PAIRS_A_ROW):
        yield {"kind": _PAIRS, "keys": keys[i : i + _PAIRS_A_ROW], "times": times[i : i + _PAIRS_A_ROW]}


def _batch(rows: list[dict], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], kind) for n, _, kind in columns], [n for n, _, _ in columns]
    )


def _encoded(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], with_groups: bool) -> DataFrame:
    """Finished documents, slices of long ones, and pair counts of the former."""
    from pyspark import TaskContext

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, counter = aligner(*paths), _Counter()
        row = TaskContext.get().partitionId() << 40
        columns = [("doc_id", "", None), *_FIRST]
        for batch in some_rows(batches, 1, ROWS_BYTES):
            if not batch.num_rows:
                continue
            columns[0] = ("doc_id", "", batch.column(0).type)
            out, short = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) > SLICE:
                    out += [
                        {"doc_id": i, "kind": _SLICE, "row": row, "k": k, "slice": s}
                        for k, s in enumerate(segments(text, SLICE))
                    ]
                else:
                    short.append((i, row, text))
                row += 1
            tokens, _ = work.encode([t for _, _, t in short])
            a, b, links = work.links(tokens)
            counter.add(links.keys)
            n_links, n_groups = (np.bincount(x, minlength=len(short)).tolist() for x in (links.row, links.group_row))
            written = work.written(a, b, links, len(short))
            for (i, at, _), (x, y), text, n, g in zip(short, tokens, written, n_links, n_groups, strict=True):
                out.append(
                    {
                        "doc_id": i, "kind": _DONE, "row": at, "n_a": len(x), "n_b": len(y), "n_groups": g, "n_links": n,
                        "digest": hashlib.sha256(text[:-1]).hexdigest() if text else "",
                        "groups": text[:-1].decode() if with_groups else None,
                        "a": _small(x), "b": _small(y),
                    }
                )
            yield _batch(out, columns)
            if counter.held > _PAIRS_HELD:
                yield from (_batch([r], columns) for r in _pair_rows(counter))
                counter = _Counter()
        if columns[0][2] is not None:
            yield from (_batch([r], columns) for r in _pair_rows(counter))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col))
    return rows.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {t}" for n, t, _ in _FIRST))


def _slice_fragments(slices: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The fragment of each slice: its open ends, and its closed groups one after another."""
    columns = [
        ("row", "long", pa.int64()), ("k", "int", pa.int32()), ("ok", "boolean", pa.bool_()), ("cut", "boolean", pa.bool_()),
        *[(n, "binary", pa.binary()) for n in (*_ENDS, "a", "b")],
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(*paths)
        for batch in some_rows(batches, 2, ROWS_BYTES):
            out = []
            for row, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ((a, b),), (ok,) = work.encode([text])
                ends = np.cumsum(work.a.sizes[a]), np.cumsum(work.b.sizes[b])
                borders = range(RANGE, int(ends[0][-1]) + RANGE, RANGE) if len(a) else ()
                places = [[0, *np.searchsorted(e, list(borders), "right").tolist()] for e in ends]
                whole = composed(
                    fragment(a[p:q], ends[0][p:q], b[r:s], ends[1][r:s])
                    for p, q, r, s in zip(places[0], places[0][1:], places[1], places[1][1:], strict=False)
                )
                inner = _joined((_NONE, _NONE), *whole.closed)
                parts = (*whole.prefix, *whole.suffix, *inner)
                names = (*_ENDS, "a", "b")
                out.append({"row": row, "k": k, "ok": bool(ok), "cut": whole.cut} | dict(zip(names, map(_small, parts), strict=True)))
            yield _batch(out, columns)

    return slices.select("row", "k", "slice").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in columns))


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Neighbouring fragments of one document composed; the groups that this closes are handed out."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    whole, closed = None, []
    for r in rows:
        prefix, suffix = (_ids(r["pa"]), _ids(r["pb"])), (_ids(r["sa"]), _ids(r["sb"]))
        one = Fragment(r["cut"], prefix, [], suffix)
        whole = one if whole is None else whole + one
        closed += [{"k": r["k"], "a": _small(x), "b": _small(y)} for x, y in whole.closed]
        whole.closed = []
    ends = dict(zip(_ENDS, map(_small, (*whole.prefix, *whole.suffix)), strict=True))
    kinds = [("row", pa.int64()), ("k", pa.int32()), ("cut", pa.bool_()), *[(n, pa.binary()) for n in _ENDS]]
    kinds.append(("closed", pa.list_(pa.struct([("k", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]))))
    row = {"row": key[0].as_py(), "k": key[1].as_py(), "cut": whole.cut, "closed": closed} | ends
    return pa.table({n: pa.array([row[n]], t) for n, t in kinds})


def _long_parts(slices: DataFrame, paths: tuple[str, str], most: int, scratch: Scratch) -> DataFrame:
    """``row, k, inner, a, b``: stretches of whole groups of long documents, in order of ``k, inner``.

    ``most`` is the largest number of slices of a document. A document that one of the
    tokenizers does not spell as it is has no parts.
    """
    tasks = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.table(_slice_fragments(slices.repartition(tasks, "row", "k"), paths), "fragments")
    parts = [found.select("row", "k", F.lit(1).alias("inner"), "a", "b")]
    level = found.select("row", "k", "cut", *_ENDS)
    times = 1  # slices that one fragment stands for
    while True:
        merged = level.groupBy("row", F.floor(F.col("k") / FAN).alias("part")).applyInArrow(_merge, _MERGED)
        merged = scratch.table(merged, "merged")
        closed = merged.select("row", F.explode("closed").alias("c"))
        # a group closed where two fragments meet stands before all others of the second
        parts.append(closed.select("row", (F.col("c.k") * times).alias("k"), F.lit(0).alias("inner"), "c.a", "c.b"))
        level, times, most = merged.drop("closed"), times * FAN, -(-most // FAN)
        if most == 1:
            break
    parts.append(level.select("row", F.lit(-1).alias("k"), F.lit(0).alias("inner"), F.col("pa").alias("a"), F.col("pb").alias("b")))
    good = found.groupBy("row").agg(F.min("ok").alias("ok")).where("ok").select(F.col("row").alias("good"))
    whole = reduce(DataFrame.unionByName, parts)
    return scratch.table(whole.join(good, F.col("row") == F.col("good"), "left_semi"), "parts")


def _long_documents(parts: DataFrame, paths: tuple[str, str], with_groups: bool) -> DataFrame:
    """Numbers, digest and pair counts of long documents, part after part."""
    columns = _FIRST
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, counter = aligner(*paths), _Counter()
        now, sums, digest, kept, begun = None, [0, 0, 0, 0], None, [], False

        def done() -> pa.RecordBatch:
            names = ("n_a", "n_b", "n_groups", "n_links")
            groups = b"".join(kept).decode() if with_groups else None
            row = {"kind": _DONE, "row": now, "digest": digest.hexdigest(), "groups": groups}
            return _batch([row | dict(zip(names, sums, strict=True))], columns)

        for batch in some_rows(batches, 3, ROWS_BYTES):
            rows = batch.column(0).to_pylist()
            tokens = [(_ids(x), _ids(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            a, b, links = work.links(tokens)
            counter.add(links.keys)
            written = work.written(a, b, links, len(rows))
            n_links, n_groups = (np.bincount(x, minlength=len(rows)).tolist() for x in (links.row, links.group_row))
            for row, (x, y), text, g, n in zip(rows, tokens, written, n_groups, n_links, strict=True):
                if row != now:
                    if now is not None:
                        yield done()
                    now, sums, digest, kept, begun = row, [0, 0, 0, 0], hashlib.sha256(), [], False
                sums = [s + v for s, v in zip(sums, (len(x), len(y), g, n), strict=True)]
                if text:
                    text = (b";" if begun else b"") + text[:-1]
                    begun = True
                    digest.update(text)
                    if with_groups:
                        kept.append(text)
        if now is not None:
            yield done()
        for r in _pair_rows(counter):
            yield _batch([r], columns)

    ordered = parts.repartition(tasks, "row").sortWithinPartitions("row", "k", "inner")
    return ordered.select("row", "k", "inner", "a", "b").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in columns))


def _rated(parts: DataFrame, counts: DataFrame, paths: tuple[str, str], scratch: Scratch) -> DataFrame:
    """``row, n_best, count_sum`` per row of ``row, a, b`` and of what is joined for it."""
    known = counts.select("key", "n", "best")
    cached = _at_most(known, MAX_PAIRS).select("key", (F.col("n") * 2 + F.col("best").cast("int")).alias("n"))
    keys, values = _arrays(cached)
    shared = parts.sparkSession.sparkContext.broadcast((Table(keys), values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(*paths)
        cache, values = shared.value
        for batch in some_rows(batches, 1, ROWS_BYTES):
            n = batch.num_rows
            tokens = [(_ids(x), _ids(y)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            links = work.links(tokens)[2]
            place = cache.find(links.keys)
            hit = place >= 0
            value = values[place[hit]] if len(values) else place[hit]
            row = links.row[hit]
            sums = [np.zeros(n, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, value & 1)
            np.add.at(sums[1], row, value >> 1)
            far, times = _tally(links.row[~hit], links.keys[~hit], n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, sums), far, times.cast(pa.list_(pa.int64()))],
                ["row", "n_best", "count_sum", "far", "times"],
            )

    schema = "row long, n_best long, count_sum long, far array<long>, times array<long>"
    rated = scratch.table(parts.select("row", "a", "b").mapInArrow(run, schema), "rated")
    zipped = rated.select("row", F.explode(F.arrays_zip("far", "times")).alias("f"))
    joined = zipped.select("row", F.col("f.far").alias("key"), F.col("f.times").alias("times")).join(known, "key")
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
    )
    both = rated.select("row", "n_best", "count_sum").unionByName(more)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first: str | None = None,
    second: str | None = None,
    with_groups: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): how two tokenizations of each text fit, and how often ids meet.

    ``first`` is a byte-level ``.json`` and gets a blank and the text, ``second`` a ``.model``
    that puts a blank first by itself; special strings are ordinary text.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and,
    on demand, ``groups`` (``a1,a2|b1;a3|b2,b3``). Links are pairs of tokens that share a
    byte; ``count_sum`` adds up how many links of all texts have a link's pair of ids;
    ``n_best`` counts links whose pair is the most frequent of its second id, ties too. A
    null or empty text, or one that a tokenizer does not spell byte by byte, has no tokens:
    zeros and empty strings. Ids may be null or repeat; every row counts. Other columns are
    ignored. Pairs: ``a, b, n, best``. Empty tables give empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    paths = first or tokenizer_path(DEFAULT_TOKENIZER), second or tokenizer_path(DEFAULT_PIECES)
    docs = only(docs, [id_col, text_col])
    found = scratch.table(_encoded(docs, id_col, text_col, paths, with_groups), "encoded")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "digest", "groups"]
    done = found.where(F.col("kind") == _DONE).select("row", "doc_id", *numbers)
    parts = found.where((F.col("kind") == _DONE) & (F.col("n_links") > 0)).select("row", "a", "b")
    counted = found.where(F.col("kind") == _PAIRS).select("keys", "times")
    slices = found.where(F.col("kind") == _SLICE)
    most = slices.agg(F.max("k")).first()[0]
    if most is not None:
        long = _long_parts(slices, paths, most + 1, scratch)
        sums = scratch.table(_long_documents(long, paths, with_groups), "long")
        heads = slices.where("k = 0").select("row", "doc_id")
        rows = heads.join(sums.where(F.col("kind") == _DONE).select("row", *numbers), "row", "left")
        done = done.unionByName(rows.fillna(0, numbers[:4]).fillna("", numbers[4:]))
        parts = parts.unionByName(long.select("row", "a", "b"))
        counted = counted.unionByName(sums.where(F.col("kind") == _PAIRS).select("keys", "times"))
    pairs = counted.select(F.explode(F.arrays_zip("keys", "times")).alias("p")).groupBy(F.col("p.keys").alias("key"))
    pairs = scratch.table(pairs.agg(F.sum("p.times").alias("n")), "pairs")
    of = F.shiftright("key", 32)
    # one row per id of the second vocabulary
    top = F.broadcast(pairs.groupBy(of.alias("id")).agg(F.max("n").alias("top")))
    counts = scratch.table(pairs.join(top, of == F.col("id")).select("key", "n", (F.col("n") == F.col("top")).alias("best")), "counts")
    rated = _rated(parts, counts, paths, scratch)
    out = done.join(rated, "row", "left").select(
        "doc_id",
        *numbers[:4],
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        F.col("digest").alias("groups_sha256"),
        *[F.coalesce("groups", F.lit("")).alias("groups")] * with_groups,
    )
    a, b = F.col("key").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("key", 32)
    return out, counts.select(a.alias("a"), b.alias("b"), "n", "best")
