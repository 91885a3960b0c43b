"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are hashed runs of three letters and, as terms of their own, runs of three kinds of
characters and words that repeat the word before them. Latent directions are the leading
singular vectors of a bounded sample of labelled texts. The sample's latent vectors, at most
``2 * PER_CLASS``, are broadcast with their labels; every document is projected, blocks of
documents are multiplied with all labelled vectors, and the nearest ones vote with their
cosine as weight.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factsieve.llm.store import share_code, text_bytes
from factsieve.llm.words import buffer_of, mix, word_hashes

# Labelled texts per class that the model is fitted on, at most.
PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
# A cosine counts with this power, so that near neighbours outvote far ones.
SHARPNESS = 8
_LETTER_TERMS = 1024
_SHAPE_TERMS = 512
_REPEAT_TERMS = 16
TERMS = _LETTER_TERMS + _SHAPE_TERMS + _REPEAT_TERMS
_ROWS = 256

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_KIND = np.full(256, 1, np.uint64)  # other bytes, among them all of other scripts
_KIND[list(b" \t")] = 0
_KIND[10] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 1
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 5 + _i


def _runs(values: np.ndarray) -> np.ndarray:
    return values[:-2] * np.uint64(1 << 20) + values[1:-1] * np.uint64(1 << 10) + values[2:]


def term_counts(column: pa.Array) -> np.ndarray:
    """A row of term counts per text."""
    data, borders = buffer_of(column)
    n = len(borders) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data) >= 3:
        row = np.repeat(np.arange(n), np.diff(borders))
        inside = row[2:] == row[:-2]
        rows = row[2:][inside]
        letters = (mix(_runs(_FOLD[data])) % np.uint64(_LETTER_TERMS)).astype(np.int64)[inside]
        shapes = (mix(_runs(_KIND[data]) + np.uint64(7)) % np.uint64(_SHAPE_TERMS)).astype(np.int64)[inside]
        for terms, size, at in ((letters, _LETTER_TERMS, 0), (shapes, _SHAPE_TERMS, _LETTER_TERMS)):
            found = np.bincount(rows * size + terms, minlength=n * size)
            out[:, at : at + size] = found.reshape(n, size)
    words, at = word_hashes(column)
    if len(words) > 1:
        row = np.repeat(np.arange(n), np.diff(at))
        again = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        repeats = np.bincount(row[1:][again], minlength=n)
        out[:, TERMS - _REPEAT_TERMS :] = (repeats * 4 / _REPEAT_TERMS)[:, None]
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each term
    directions: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled texts x dimensions, unit length
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = x @ self.directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors; the share of good labels for an empty text."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        # ties go to the labelled text that comes first
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if k == len(self.labels) else _nearest(cosines, k)
        votes = np.clip(np.take_along_axis(cosines, near, 1), 0, None).astype(np.float64) ** SHARPNESS
        weight = votes.sum(1)
        voted = (votes * self.labels[near]).sum(1) / np.maximum(weight, 1e-300)
        return np.where((weight > 0) & (counts.sum(1) > 0), voted, self.prior)


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    edge = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(cosines), k), np.int64)
    for i, (row, e) in enumerate(zip(cosines, edge, strict=True)):
        above = np.flatnonzero(row > e)
        out[i] = np.concatenate([above, np.flatnonzero(row == e)[: k - len(above)]])
    return out


def fit_counts(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent directions and labelled vectors of a sample."""
    if not len(labels):
        empty = np.zeros((0, DIMENSIONS))
        return Model(np.ones(TERMS), np.zeros((TERMS, DIMENSIONS)), empty, np.zeros(0), 0.5)
    weights = np.log1p(len(counts) / (1 + (counts > 0).sum(0))).astype(np.float32)
    model = Model(weights, np.eye(TERMS, dtype=np.float32), None, labels.astype(np.float64), float(labels.mean()))
    x = np.sqrt(counts) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    model.directions = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Fixed rule of the fold: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
) -> Model:
    """The model of a sample of labelled training rows, up to ``per_class`` texts of each label.

    The sample is the rows with the least hash of their id, so it does not depend on the
    table's layout. Several labels of one id are averaged and rounded; null labels and ids
    are left out. Only the sample reaches the driver.
    """
    share_code(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    known = known.where("label is not null and id is not null").groupBy("id").agg(F.round(F.avg("label")).alias("label"))
    known = known.where(~held_out(F.col("id")))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    ids = chosen.collect()
    by_id = {r["id"]: r["label"] for r in ids}
    wanted = docs.sparkSession.createDataFrame([(i,) for i in by_id], "wanted long")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col))
    sample = texts.join(F.broadcast(wanted), F.col("id") == F.col("wanted"), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                counts = term_counts(part.column(1))
                rows = [c.astype("<f4").tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["id", "counts"])

    found = sorted(sample.mapInArrow(count, "id long, counts binary").dropDuplicates(["id"]).collect())
    counts = np.array([np.frombuffer(r["counts"], "<f4") for r in found]).reshape(-1, TERMS)
    return fit_counts(counts, np.array([by_id[r["id"]] for r in found], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` columns of ``docs`` plus ``score`` (0 to 1; higher: better text) and ``predicted``.

    Every text is used whole. An empty or null text gets the sample's share of good labels.
    Ids only pass through; null and repeated ids are scored row by row. Input columns with
    the names of the new ones are replaced. An empty table gives an empty result.
    """
    share_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    n, at_text = len(kept), kept.index(text_col)
    if not isinstance(inner.schema[at_text].dataType, StringType):
        inner, at_text = inner.withColumn("text", text_bytes(f"c{at_text}")), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                scores = shared.value.scores(term_counts(part.column(at_text)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array(scores, pa.float64())], [*part.schema.names[:n], "score"]
                )

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema[:n])
    done = inner.mapInArrow(run, f"{ddl}, score double")
    return done.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
