"""Near copies among vectors by a pivot-permutation index.

Every vector is described by its nearest reference points in their order. Two vectors are
candidates if they share at least two reference points whose places add up to at most
``reach`` in both descriptions; so an inverted list is kept per pair of reference points,
and whoever meets in one shares enough. The exact cosine decides.

Reference points are random directions and not drawn from the vectors: whether two vectors
share some then depends on their angle alone, and not on how many others lie around them.
Their number grows with the square root of the rows, the number of lists therefore with the
rows, and the lists of unrelated vectors stay nearly as short as they were (4.7 candidate
pairs a row among 2,000 random vectors, 13.1 among 32,000, 17.1 among 128,000). ``reach`` is
the least with which all but ``MISSED`` of random pairs at the threshold meet; where none
will do, as with two dimensions, there are fewer reference points.

Equal vectors are one row with a size. Only ids go through the lists. Those of short lists
become different pairs, and vectors are joined to these. Long lists are cut into blocks by
hash, vectors are joined to pairs of blocks, and a list of any length is spread over many
tasks of bounded size. A pair that shares long lists is judged in the first of these alone.
A task returns sums and a spanning forest of the links it found in a block, never all pairs.
"""

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.graph import components
from factsieve.llm.store import Scratch, only
from factsieve.llm.vectors import matrix, usable

# Reference points: so many times the square root of the number of vectors.
PIVOTS_PER_ROOT = 24
MIN_PIVOTS = 32
# Sums of two places that are tried, the least first.
REACHES = (7, 9, 11, 13, 15, 17)
# Part of the pairs at the threshold that may fail to meet, and how many are tried.
MISSED = 0.0005
TRIED = 4096
# Members of a list whose pairs are listed, of a block, and rows multiplied at once.
SHORT = 32
BLOCK = 8192
_ROWS = 1024
_CELLS = 1 << 21


@lru_cache(maxsize=8)
def directions(length: int, n: int) -> np.ndarray:
    """``n`` reference points for vectors of a length, the same in every process."""
    x = np.random.default_rng(length).standard_normal((n, length), np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The indexes of each row's nearest reference points, nearest first; both sides of unit length."""
    k = min(length, len(pivots))
    out = np.empty((len(x), k), np.int64)
    step = max(_CELLS // len(pivots), 1)
    for low in range(0, len(x), step):
        cosines = x[low : low + step].astype(np.float32) @ pivots.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(cosines, near, 1), axis=1, kind="stable")
        out[low : low + step] = np.take_along_axis(near, order, 1)
    return out


def lists_of(x: np.ndarray, pivots: np.ndarray, reach: int) -> np.ndarray:
    """The lists of each row: pairs of reference points whose places, from 0, add up to ``reach`` at most."""
    near = nearest_pivots(x, pivots, reach + 1)
    i, j = np.triu_indices(near.shape[1], 1)
    i, j = i[i + j <= reach], j[i + j <= reach]
    return (np.minimum(near[:, i], near[:, j]) << 31) | np.maximum(near[:, i], near[:, j])


def met(length: int, n: int, threshold: float, reach: int) -> float:
    """The part of random pairs with a cosine of ``threshold`` that meet among ``n`` reference points."""
    rng = np.random.default_rng(1)
    x, z = rng.standard_normal((2, TRIED, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    norms = np.linalg.norm(z, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(max(1 - threshold**2, 0.0)) * np.divide(z, norms, out=np.zeros_like(z), where=norms > 1e-9)
    a, b = (lists_of(v, directions(length, n), reach) for v in (x, y))
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    return float((both[:, 1:] == both[:, :-1]).any(1).mean())


def index_for(length: int, rows: int, threshold: float) -> tuple[int, int]:
    """How many reference points serve so many vectors of a length, and the reach of a description.

    Two reference points are shared by all, so there is always an answer.
    """
    n = max(PIVOTS_PER_ROOT * isqrt(rows), MIN_PIVOTS)
    while True:
        for reach in REACHES:
            if met(length, n, threshold, reach) >= 1 - MISSED:
                return n, reach
        n = max(n // 2, 2)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])


def _members(lists: pa.ListArray, here: int) -> np.ndarray:
    """Which rows are in which of the lists before ``here`` that more than one row has."""
    at, names = lists.offsets.to_numpy(), lists.values.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    names = names[at[0] : at[-1]]
    row, names = row[names < here], names[names < here]
    known, place, times = np.unique(names, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times > 1)
    column = np.full(len(known), -1)
    column[kept] = np.arange(len(kept))
    column = column[place]
    out = np.zeros((len(lists), len(kept)), np.float32)
    out[row[column >= 0], column[column >= 0]] = 1
    return out


def block_links(
    x: np.ndarray, member: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Which of the rows ``left`` and ``right`` link and share no list of ``member``."""
    first = (member[left] @ member[right].T) == 0
    return first & (_cosines(x[left], x[right]) >= threshold) if first.any() else first


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest index of each row's component under a symmetric relation."""
    label = np.arange(len(linked))
    while True:
        seen = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, seen)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cut(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[low : low + _ROWS] for low in range(0, len(rows), _ROWS)]


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    short: int = SHORT,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing;
    so do vectors of different lengths, and rows without an id (their component is null).
    Rows that repeat an id count as one vector and get the same answer. Other columns are
    ignored. An empty table gives an empty result. Lists of up to ``short`` members are
    turned into pairs, others into pairs of blocks of about ``block`` members.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    vectors = only(vectors, [id_col, vector_col])
    rows = scratch.table(usable(vectors, id_col, vector_col), "vectors")
    classes = scratch.table(
        rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.any_value("v").alias("v")),
        "classes",
    )
    by_length = classes.groupBy((F.length("v") / 8).cast("int").alias("length")).agg(F.count("*").alias("rows"))
    known = {r["length"]: index_for(r["length"], r["rows"], threshold) for r in by_length.collect()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                lengths = np.array([len(v) // 8 for v in batch.column(1).to_pylist()], np.int64)
                for n in np.unique(lengths).tolist():
                    part = batch.filter(pa.array(lengths == n))
                    x = matrix(part.column(1))
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    pivots, reach = known[n]
                    lists = lists_of(x, directions(n, pivots), reach)
                    reps = np.repeat(part.column(0).to_numpy(), lists.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(lists.size, n, np.int32)), pa.array(lists.ravel()), pa.array(reps)],
                        ["length", "list", "rep"],
                    )

    described = classes.select("rep", "v").mapInArrow(describe, "length int, list long, rep long")
    described = scratch.table(described, "described")
    counted = described.groupBy("length", "list").agg(F.count("*").alias("members")).where("members > 1")
    near = scratch.table(described.join(counted, ["length", "list"]), "near")
    scratch.drop(described)
    longs = near.where(F.col("members") > short)
    # at most as many lists a vector as a description has
    of_rep = longs.groupBy("rep").agg(F.sort_array(F.collect_list("list")).alias("lists"))
    items = classes.select("rep", "size", "v").join(of_rep, "rep", "left")
    items = items.withColumn("lists", F.coalesce("lists", F.expr("cast(array() as array<bigint>)")))
    items = scratch.table(items, "items")

    # at most ``short`` ids
    met_in = near.where(F.col("members") <= short).groupBy("length", "list").agg(F.collect_list("rep").alias("reps"))
    pairs = met_in.select("reps", F.explode("reps").alias("a"))
    pairs = pairs.select("a", F.explode(F.expr("filter(reps, r -> r > a)")).alias("b")).distinct()
    of_a, of_b = (items.select(*[F.col(c).alias(f"{c}_{s}") for c in items.columns]) for s in "ab")
    pairs = pairs.join(of_a, F.col("a") == F.col("rep_a")).join(of_b, F.col("b") == F.col("rep_b"))
    pairs = pairs.where(~F.arrays_overlap("lists_a", "lists_b")).select("a", "b", "size_a", "size_b", "v_a", "v_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, size_b = (batch.column(i).to_numpy() for i in range(4))
            lengths = np.array([len(v) for v in batch.column(4).to_pylist()], np.int64)
            linked = np.zeros(len(a), bool)
            for n in np.unique(lengths):
                part = np.flatnonzero(lengths == n)
                x, y = (matrix(batch.column(i).take(pa.array(part))) for i in (4, 5))
                products = np.einsum("ij,ij->i", x, y)
                linked[part] = products / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= threshold
            a, b, size_a, size_b = a[linked], b[linked], size_a[linked], size_b[linked]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(b, a)), pa.array(np.append(size_a, size_b)), pa.array(np.append(a, a))],
                ["rep", "add", "root"],
            )

    of_pairs = pairs.mapInArrow(verify, "rep long, add long, root long")

    pair = "transform(sequence(0, blocks - 1), j -> struct(least(j, mine) as bi, greatest(j, mine) as bj))"
    blocks = (
        longs.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .join(items, "rep")
        .withColumn("pair", F.explode(F.expr(pair)))
        .select("length", "list", "pair.bi", "pair.bj", "mine", "rep", "size", "v", "lists")
    )

    def compare(table: pa.Table) -> pa.Table:
        here, bi, bj = (table.column(i)[0].as_py() for i in range(1, 4))
        table = table.sort_by("rep")
        mine = table.column("mine").to_numpy()
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
        x = matrix(table.column("v"))
        member = _members(table.column("lists").combine_chunks(), here)
        found = []
        for i in _cut(np.flatnonzero(mine == bi)):
            for j in _cut(np.flatnonzero(mine == bj)):
                if bi == bj and i[0] > j[0]:
                    continue
                # both in one order, so that the smallest is first
                of = np.union1d(i, j)
                left, right = np.searchsorted(of, i), np.searchsorted(of, j)
                linked = np.zeros((len(of), len(of)), bool)
                linked[np.ix_(left, right)] = block_links(x, member, threshold, i, j)
                linked |= linked.T
                np.fill_diagonal(linked, False)
                add, root = linked.astype(np.float64) @ size[of], rep[of][_forest(linked)]
                found.append((rep[of][add > 0], add[add > 0].astype(np.int64), root[add > 0]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [rep[:0]] * 3
        return pa.table(dict(zip(("rep", "add", "root"), columns, strict=True)))

    of_blocks = blocks.groupBy("length", "list", "bi", "bj").applyInArrow(compare, "rep long, add long, root long")
    found = scratch.table(of_pairs.unionByName(of_blocks), "found")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    sums = found.groupBy("rep").agg(F.sum("add").alias("add"))
    of_class = scratch.table(
        classes.select("key", "rep", "size")
        .join(sums, "rep", "left")
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select(
            F.col("key").alias("k"),
            (F.col("size") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"),
            F.coalesce("root", "rep").alias("root"),
        ),
        "answers",
    )
    answers = rows.select("id", "key").join(of_class, F.col("key") == F.col("k")).select("id", "n_links", "root")
    answers = scratch.table(answers, "by_id")
    every = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))
    return every.join(answers, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
