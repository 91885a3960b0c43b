"""Nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

A shard is indexed by inserting its vectors in a seeded order, some at a time. A greedy
beam search from the entry point proposes neighbours of each new vector; of these the
nearest is kept, and every other one that it is nearer to, by the relaxation factor, is
dropped, and so on. Kept edges are also added in the other direction, and a vector with too
many is pruned alike. Queries run the same beam search on every shard.

Inner products become distances by one more coordinate that makes all vectors of a shard
equally long. Equal vectors are one node. Scores are computed anew from the original
numbers in double precision.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import Scratch, only
from factsieve.llm.vectors import matrix, usable

SHARD_ROWS = 2048
DEGREE = 24
BEAM = 48
RELAX = 1.2
# Nodes expanded per step of a search, and vectors inserted or queries run side by side.
WIDTH = 4
TOGETHER = 128
# Queries that travel together to a shard.
CHUNK = 4096
_MERGED = 64


class Graph:
    """Nodes, edges (-1: none) and entry point of one shard."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entry: int):
        self.points, self.edges, self.entry = points, edges, entry
        self.squares = (points**2).sum(1)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances up to a constant per query), nearest first; -1 fills short rows."""
        n, m = len(queries), len(self.points)
        nodes = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True  # -1 points here
        nodes[:, 0] = self.entry
        far[:, 0] = self.squares[self.entry] - 2 * queries @ self.points[self.entry]
        done[:, 0] = False
        seen[:, self.entry] = True
        while True:
            live = np.flatnonzero(~done.all(1))
            if not len(live):
                return nodes, far
            # the nearest nodes not expanded yet
            order = np.argsort(done[live], axis=1, kind="stable")[:, :WIDTH]
            pick = np.where(np.take_along_axis(done[live], order, 1), -1, np.take_along_axis(nodes[live], order, 1))
            done[live[:, None], order] = True
            new = self.edges[pick].reshape(len(live), -1)
            new[np.repeat(pick < 0, self.edges.shape[1], axis=1)] = -1
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], new]] = -1
            seen[live[:, None], new] = True
            d = self.squares[new] - 2 * np.matmul(self.points[new], queries[live][:, :, None])[:, :, 0]
            d[new < 0] = np.inf
            all_nodes = np.concatenate([nodes[live], new], axis=1)
            all_far = np.concatenate([far[live], d], axis=1)
            all_done = np.concatenate([done[live], new < 0], axis=1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            nodes[live] = np.take_along_axis(all_nodes, keep, 1)
            far[live] = np.take_along_axis(all_far, keep, 1)
            done[live] = np.take_along_axis(all_done, keep, 1)


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """The kept neighbours of the nodes ``of``, out of rows of candidates (-1: none)."""
    here = points[of]
    c = candidates.copy()
    c.sort(axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == of[:, None]] = -1
    x = points[c]
    far = ((x - here[:, None, :]) ** 2).sum(2)
    far[c < 0] = np.inf
    # more candidates than this never matter much; the nearest ones are looked at
    look = min(c.shape[1], 3 * degree)
    near = np.argsort(far, axis=1, kind="stable")[:, :look]
    c, far, x = np.take_along_axis(c, near, 1), np.take_along_axis(far, near, 1), x[np.arange(len(c))[:, None], near]
    squares = (x**2).sum(2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    out = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(degree):
        best = far.argmin(1)
        some = np.isfinite(far[rows, best])
        if not some.any():
            break
        out[some, k] = c[rows, best][some]
        hidden = relax**2 * between[rows, best] <= far
        hidden[rows, best] = True
        far[hidden & some[:, None]] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 7) -> Graph:
    """Index of the rows of ``points``, which must differ."""
    n = len(points)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
    graph = Graph(points, np.full((n, degree), -1, np.int64), entry)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int64)
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        found, _ = graph.search(points[new], beam)
        # vectors inserted together see each other as candidates too
        mates = np.broadcast_to(new, (len(new), len(new))) if len(new) <= 2 * degree else new[np.arange(len(new))[:, None] - np.arange(1, 9)]
        graph.edges[new] = robust_prune(points, new, np.concatenate([found, mates], axis=1), degree, relax)
        source = np.repeat(new, degree)
        target = graph.edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 256):
            q, f, c = nodes[low : low + 256], first[low : low + 256], count[low : low + 256]
            more = np.full((len(q), c.max()), -1, np.int64)
            more[np.arange(c.max())[None, :] < c[:, None]] = source[f[0] : f[-1] + c[-1]]
            both = np.concatenate([graph.edges[q], more], axis=1)
            full = (both >= 0).sum(1) > degree
            if full.any():
                graph.edges[q[full]] = robust_prune(points, q[full], both[full], degree, relax)
            if not full.all():
                rest = np.sort(both[~full], axis=1)[:, ::-1]
                rest[:, 1:][rest[:, 1:] == rest[:, :-1]] = -1
                graph.edges[q[~full]] = np.sort(rest, axis=1)[:, ::-1][:, :degree]
        at += len(new)
        size = min(TOGETHER, at)
    return graph


def _lifted(x: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)
    top = squares.max(initial=0.0)
    return np.concatenate([x, np.sqrt(np.maximum(top - squares, 0))[:, None]], axis=1).astype(np.float32)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length: ids, vectors and graph, as bytes; stored.

    Shards are dealt by a hash of the id, so copies and clusters spread over all of them.
    """
    scratch = Scratch(vectors.sparkSession, "graph-index")
    rows = scratch.table(usable(only(vectors, [id_col, vector_col]), id_col, vector_col), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.octet_length("v").alias("bytes"), "id", "key", "v"
    )

    def build(table: pa.Table) -> pa.Table:
        # nodes are the different vectors, each with its ids in ascending order
        table = table.sort_by([("key", "ascending"), ("id", "ascending")])
        keys = table.column("key").to_pylist()
        begin = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
        x = matrix(table.column("v").take(pa.array(begin)))
        graph = build_graph(_lifted(x))
        row = {
            "shard": [table.column("shard")[0].as_py()],
            "bytes": [table.column("bytes")[0].as_py()],
            "entry": [graph.entry],
            "ids": [table.column("id").to_numpy().astype("<i8").tobytes()],
            "begins": [np.array([*begin, len(keys)], "<i8").tobytes()],
            "vectors": [x.astype("<f8").tobytes()],
            "edges": [graph.edges.astype("<i4").tobytes()],
        }
        return pa.table(row, schema=pa.schema(
            [("shard", pa.int32()), ("bytes", pa.int32()), ("entry", pa.int64())]
            + [(c, pa.binary()) for c in ("ids", "begins", "vectors", "edges")]
        ))

    schema = "shard int, bytes int, entry long, ids binary, begins binary, vectors binary, edges binary"
    return scratch.table(dealt.groupBy("shard", "bytes").applyInArrow(build, schema), "shards")


def search_index(
    index: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found but itself, nearest first.

    Ties go to the smaller id. Queries that are null, zero or hold null or non-finite
    numbers have no rows, nor have such vectors. Vectors of other lengths are not compared.
    """
    scratch = Scratch(index.sparkSession, "graph-search")
    asked = scratch.table(usable(queries, id_col, vector_col).select("id", F.octet_length("v").alias("bytes"), "v"), "queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    shards = index.select("shard").distinct().count()

    def gather(table: pa.Table) -> pa.Table:
        return pa.table(
            {
                "bytes": table.column("bytes").slice(0, 1),
                "chunk": table.column("chunk").slice(0, 1),
                "q_ids": [table.column("id").to_numpy().astype("<i8").tobytes()],
                "q": [b"".join(table.column("v").to_pylist())],
            }
        )

    together = (
        asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
        .groupBy("bytes", "chunk")
        .applyInArrow(gather, "bytes int, chunk int, q_ids binary, q binary")
    )
    # every chunk of queries meets every shard once
    left = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = together.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))

    def run(shard: pa.Table, chunk: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "part": [], "found": []}
        schema = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("found", pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))])
        if not shard.num_rows or not chunk.num_rows:
            return pa.table(out, schema=schema)
        s, c = shard.to_pylist()[0], chunk.to_pylist()[0]
        width = s["bytes"] // 8
        x = np.frombuffer(s["vectors"], "<f8").reshape(-1, width)
        edges = np.frombuffer(s["edges"], "<i4").reshape(len(x), -1).astype(np.int64)
        ids, begins = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["begins"], "<i8")
        graph = Graph(_lifted(x), edges, s["entry"])
        q_ids, q = np.frombuffer(c["q_ids"], "<i8"), np.frombuffer(c["q"], "<f8").reshape(-1, width)
        flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        for at in range(0, len(q), TOGETHER):
            nodes, _ = graph.search(flat[at : at + TOGETHER], max(beam, 2 * k))
            for j, row in enumerate(nodes):
                row = row[row >= 0]
                scores = x[row] @ q[at + j]
                near = row[np.argsort(-scores, kind="stable")]
                scores = np.sort(-scores)
                best = []
                for node, far in zip(near[: k + 1].tolist(), scores[: k + 1].tolist(), strict=True):
                    # of equal vectors the smallest ids are enough
                    same = ids[begins[node] : min(begins[node + 1], begins[node] + k + 1)]
                    best += [(far, i) for i in same.tolist() if i != q_ids[at + j]]
                best.sort()
                out["query_id"].append(int(q_ids[at + j]))
                out["part"].append(s["shard"] // _MERGED)
                out["found"].append([{"far": f, "vec_id": i} for f, i in best[:k]])
        return pa.table(out, schema=schema)

    found = (
        left.groupBy("shard", "bytes", "chunk")
        .cogroup(right.groupBy("shard", "bytes", "chunk"))
        .applyInArrow(run, "query_id long, part int, found array<struct<far:double,vec_id:long>>")
    )

    def merged(df: DataFrame, keys: list[str]) -> DataFrame:
        lists = F.sort_array(F.flatten(F.collect_list("found")))
        return df.groupBy(*keys).agg(F.slice(lists, 1, k).alias("found"))

    if shards > _MERGED:
        found = merged(found, ["query_id", "part"])
    best = merged(found, ["query_id"])
    return best.select("query_id", F.posexplode("found").alias("pos", "f")).select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("f.vec_id").alias("vec_id"),
        (-F.col("f.far")).alias("score"),
    )
