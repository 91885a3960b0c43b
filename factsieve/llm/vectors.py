"""Vector columns: which rows can be compared, and their numbers as bytes."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, key, v`` of each id with a comparable vector: not null or empty or all zero, all numbers finite.

    ``v`` holds doubles, ``key`` is a digest of them. Of several vectors with one id the one
    with the least digest counts; rows without an id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, out = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                data = x.tobytes()
                ids.append(i)
                keys.append(hashlib.blake2b(data, digest_size=16).digest())
                out.append(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["id", "key", "v"]
            )

    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    found = rows.mapInArrow(run, "id long, key binary, v binary")
    return found.groupBy("id").agg(F.min(F.struct("key", "v")).alias("s")).select("id", "s.key", "s.v")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from a binary column of doubles."""
    return np.array([np.frombuffer(x, "<f8") for x in column.to_pylist()])
