"""Numeric grounding between tables: band semi and anti joins.

Answers and contexts are number tables (see ``extract_numerics``): key columns and
a value column. Every value falls into a bucket some tolerances wide; a context
value is put into each bucket its tolerance reaches (mostly one), so the join is an
equi-join on key and bucket with an exact residual test.

Context values are reduced before any of that: within a cell half the tolerance
wide only the smallest and the largest value can decide, so a key and bucket
never holds more than a few context rows, however often its numbers repeat. No job runs
while the plan is built; hot buckets on the answer side are left to adaptive execution,
which splits the left side of semi and anti joins by map output.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.grounding import DEFAULT_TOLERANCE, within

# Bucket width in tolerances: wider means fewer copies of context values, but more
# of them to test per answer number.
_BUCKET_WIDTH = 8.0
# The residual test rounds; the reach must not fall short of what it accepts.
_REACH = 1.0 + 2.0**-40
# Above tolerance * 2^60 two different doubles are always further apart than the
# tolerance: only equal values match, and the value itself is the bucket.
_BUCKETS_BELOW = 2.0**60
# Above tolerance * 2^40 rounding could blur the cells: each value is its own cell.
_CELLS_BELOW = 2.0**40


def _as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _number_of(value: Column, tol: float) -> Column:
    return F.floor(value / (_BUCKET_WIDTH * tol))


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def _near(value: Column, tol: float) -> Column:
    return F.abs(value) < tol * _BUCKETS_BELOW if tol > 0 else F.lit(False)


def _bucket(value: Column, tol: float) -> tuple[Column, Column]:
    """(bucket number, value for values that match only themselves); NULLs match nothing."""
    finite, near, none = _finite(value), _near(value, tol), F.lit(0).cast("bigint")
    number = F.when(near, _number_of(value, tol)).otherwise(none) if tol > 0 else none
    return F.when(finite, number), F.when(finite, F.when(near, 0.0).otherwise(value))


def _reduced_contexts(contexts: DataFrame, key: list[str], value: str, tol: float) -> DataFrame:
    """Key, ``_bucket``, ``_exact`` and the outermost values ``_lo``, ``_hi`` of each cell."""
    v = F.col("_v")
    celled = F.abs(v) < tol * _CELLS_BELOW if tol > 0 else F.lit(False)
    cell = F.when(celled, F.floor(v / (tol / 2))) if tol > 0 else F.lit(None).cast("bigint")
    cells = (
        contexts.select(*key, F.col(value).alias("_v"))
        .where(_finite(v))
        .select(*key, "_v", cell.alias("_cell"), F.when(~celled, v).alias("_own"))
        .groupBy(*key, "_cell", "_own")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    alone = F.array(F.lit(0).cast("bigint"))
    reached = (
        F.when(
            _near(lo, tol),
            F.sequence(_number_of(lo - tol * _REACH, tol), _number_of(hi + tol * _REACH, tol)),
        ).otherwise(alone)
        if tol > 0
        else alone
    )
    exact = F.when(_near(lo, tol), 0.0).otherwise(lo)
    return cells.select(*key, F.explode(reached).alias("_bucket"), exact.alias("_exact"), "_lo", "_hi")


# Types whose equal values hash alike on both sides of a join.
_HASHED_KEYS = ("bigint", "int", "smallint", "tinyint", "string", "date", "boolean")
# Bits of one bitmap, as the built-in aggregate makes it.
_BITMAP_BITS = 1 << 15


def _possible(left: DataFrame, right: DataFrame, on: list[str], bits: int) -> DataFrame:
    """Rows of ``left`` whose join columns may occur in ``right``; no row with a partner is lost.

    The hashes of ``right`` set bits in at most ``2^bits / 2^15`` bitmaps of 4 KB, combined
    before their shuffle and broadcast. They have the same size however large ``right`` is; a
    full one lets every row through.
    """
    if not 15 <= bits <= 30:
        raise ValueError("bits must be from 15 to 30")
    ltypes, rtypes = dict(left.dtypes), dict(right.dtypes)
    same = [c for c in on if c == "_bucket" or (ltypes[c] == rtypes[c] and ltypes[c] in _HASHED_KEYS)]
    # -0.0 equals 0.0
    values = [*[F.col(c) for c in same], F.when(F.col("_exact") == 0, 0.0).otherwise(F.col("_exact"))]
    place = F.pmod(F.xxhash64(*values), F.lit(1 << bits))
    number, bit = F.floor(place / _BITMAP_BITS), F.pmod(place, F.lit(_BITMAP_BITS))
    bitmaps = (
        right.select(number.alias("_number"), bit.alias("_bit"))
        .groupBy("_number")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )
    placed = left.withColumns({"_place": number, "_bit": bit}).join(
        F.broadcast(bitmaps), F.col("_place") == F.col("_number")
    )
    byte = F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))
    word = F.conv(F.hex(byte), 16, 10).cast("int")
    return placed.where(F.getbit(word, (F.col("_bit") % 8).cast("int")) == 1).select(*left.columns)


def _band_join(
    answers: DataFrame,
    contexts: DataFrame,
    key: list[str],
    tol: float,
    value: str,
    how: str,
    prune_bits: int | None = None,
) -> DataFrame:
    if not math.isfinite(tol):
        raise ValueError("tolerance must be finite")
    bucket, exact = _bucket(F.col(value), tol)
    left = answers.withColumns({"_bucket": bucket, "_exact": exact})
    right = _reduced_contexts(contexts, key, value, tol)
    on = [*key, "_bucket", "_exact"]
    if prune_bits is not None:
        left = _possible(left, right, on, prune_bits)
    right = right.select(
        *[F.col(c).alias(f"_key_{i}") for i, c in enumerate(on)], "_lo", "_hi"
    )
    match = within(F.col("_lo"), F.col(value), tol) | within(F.col("_hi"), F.col(value), tol)
    for i, c in enumerate(on):
        match = (F.col(c) == F.col(f"_key_{i}")) & match
    return left.join(right, match, how).select(*answers.columns)


def grounded_numbers(
    answers: DataFrame,
    contexts: DataFrame,
    key: str | Sequence[str],
    tol: float = DEFAULT_TOLERANCE,
    value: str = "value",
    prune_bits: int | None = None,
) -> DataFrame:
    """Answer numbers with a context number of the same key within the tolerance.

    ``prune_bits`` drops answer numbers that cannot match before the join shuffles them: the
    contexts' keys and buckets go into a filter of ``2^prune_bits`` bits (15 to 30;
    24 are 2 MB), which reads the contexts once more. It pays where most answers find
    nothing. The result is the same.
    """
    return _band_join(answers, contexts, _as_list(key), tol, value, "left_semi", prune_bits)


def grounded_against_facts(
    answers: DataFrame,
    facts: DataFrame,
    tol: float = DEFAULT_TOLERANCE,
    value: str = "value",
    prune_bits: int | None = 24,
) -> DataFrame:
    """Answer numbers that occur in one fact table shared by all answers.

    Numbers that cannot be among the facts are dropped before the shuffle, see
    :func:`grounded_numbers`.
    """
    return _band_join(answers, facts, [], tol, value, "left_semi", prune_bits)


def unmatched_numerics(
    answers: DataFrame,
    contexts: DataFrame,
    key: str | Sequence[str],
    tol: float = DEFAULT_TOLERANCE,
    value: str = "value",
) -> DataFrame:
    """Answer numbers without a context number of the same key within the tolerance.

    Duplicates stay; one context number may ground many answer numbers.
    """
    return _band_join(answers, contexts, _as_list(key), tol, value, "left_anti")


def unmatched_against_facts(
    answers: DataFrame,
    facts: DataFrame,
    tol: float = DEFAULT_TOLERANCE,
    value: str = "value",
) -> DataFrame:
    """Answer numbers that occur nowhere in one fact table shared by all answers."""
    return _band_join(answers, facts, [], tol, value, "left_anti")


def answers_grounded(
    answers: DataFrame,
    numbers: DataFrame,
    contexts: DataFrame,
    id_cols: str | Sequence[str],
    key: str | Sequence[str],
    tol: float = DEFAULT_TOLERANCE,
) -> DataFrame:
    """``id_cols`` of every answer and ``grounded``: no number of it is unmatched."""
    ids = _as_list(id_cols)
    bad = (
        unmatched_numerics(numbers, contexts, key, tol)
        .select(*ids)
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    return (
        answers.select(*ids)
        .join(bad, ids, "left")
        .select(*ids, F.col("_bad").isNull().alias("grounded"))
    )
