"""Hot groups: find them, and order them without one task per group.

A group with more rows than ``rows_per_task`` is *hot*. Before a window is planned, one job
counts the groups (combined before its shuffle) and keeps the hot ones, a row per group, on
the executors. Usually there are none and the plain plan is used. ``rows_per_task=None``
skips the count and leaves every group to one task. Joins need none of this: adaptive
execution splits their skewed sides.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
_SAMPLES_PER_BLOCK = 16
# The borders of a group are searched in so many halving steps, enough for any array.
_STEPS = 31
_TIE = "_tie"


def hot_groups(
    df: DataFrame, keys: Sequence[str], rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame | None:
    """``keys`` + ``_rows`` of the groups above the limit; None if there are none.

    There is at most one hot group per ``rows_per_task`` rows. The list is kept in memory or
    on disk by the executors and counted anew if one of them is lost.
    """
    if rows_per_task is None or not keys:
        return None
    hot = (
        df.select(*keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .persist()
    )
    if hot.isEmpty():
        hot.unpersist()
        return None
    return hot


def _join_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with the list on keys that may be NULL; key columns come from ``df``."""
    renamed = hot.select(
        *[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)],
        *[c for c in hot.columns if c not in keys],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)],
    )
    joined = df.join(renamed, same, how)
    return joined.drop(*[f"_hot_{i}" for i in range(len(keys))])


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups with ``_rows``)."""
    return _join_hot(df, hot, keys, "left_anti"), _join_hot(df, hot, keys, "inner")


def _with_blocks(
    hot: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int
) -> DataFrame:
    """Number contiguous blocks of each hot group along ``order``, as ``_block``.

    Block borders are picked evenly from a hash sample of the group, so they are the same
    in every evaluation. Among equal order values the hash of the whole row, ``_tie``,
    decides; only rows alike in every column share a block for certain.
    """
    hot = hot.withColumn(_TIE, F.xxhash64(*[c for c in hot.columns if c != "_rows"]))
    place = F.struct(*order, _TIE)
    parts = F.ceil(F.col("_rows") / rows_per_task).cast("int")
    one_in = F.greatest(F.floor(F.col("_rows") / (parts * _SAMPLES_PER_BLOCK)), F.lit(1))
    borders = (
        hot.where(F.pmod(F.xxhash64(*keys, *order, _TIE), one_in) == 0)
        .groupBy(*keys)
        .agg(F.first(parts).alias("_parts"), F.sort_array(F.collect_set(place)).alias("_sample"))
        .select(
            *keys,
            F.transform(
                F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda i: i > 0),
                lambda i: F.get(
                    F.col("_sample"),
                    F.floor(i * F.size("_sample") / F.col("_parts")).cast("int"),
                ),
            ).alias("_borders"),
        )
    )
    # Borders at or before the row, by binary search.
    steps = F.array(*[F.lit(1 << i) for i in range(_STEPS - 1, -1, -1)])
    block = F.aggregate(
        F.filter(steps, lambda step: step <= F.size("_borders")),
        F.lit(0),
        lambda at, step: F.when(
            F.get(F.col("_borders"), at + step - 1) <= F.col("_place"), at + step
        ).otherwise(at),
    )
    return (
        _join_hot(hot.withColumn("_place", place), borders, keys, "left")
        .withColumn("_block", F.coalesce(block, F.lit(0)))
        .drop("_borders", "_place")
    )


def hot_running_totals(
    hot: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Running totals inside hot groups: totals within blocks plus totals of earlier blocks."""
    blocked = _with_blocks(hot, keys, order, rows_per_task)
    within = Window.partitionBy(*keys, "_block").orderBy(*order, _TIE).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocked.groupBy(*keys, "_block")
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
        .select(
            *keys,
            "_block",
            *[
                F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}")
                for n in totals
            ],
        )
    )
    local = blocked.withColumns({n: F.sum(c).over(within) for n, c in totals.items()})
    on = [*keys, "_block"]
    joined = local.join(
        before.select(
            *[F.col(c).alias(f"_key_{i}") for i, c in enumerate(on)],
            *[f"_before_{n}" for n in totals],
        ),
        reduce(
            lambda a, b: a & b,
            [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(on)],
        ),
    )
    return joined.select(
        *[c for c in hot.columns if c not in totals],
        *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in totals],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    rows_per_task: int | None = ROWS_PER_TASK,
    hot: DataFrame | None = None,
    hot_keys: Sequence[str] | None = None,
) -> DataFrame:
    """``sum(...) over (partition by keys order by order)`` for each entry of ``totals``.

    ``hot`` is the result of :func:`hot_groups` (None: no hot group) on the same keys or on
    ``hot_keys``, some of them.
    """
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = {n: F.sum(c).over(frame) for n, c in totals.items()}
    if hot is None:
        return df.withColumns(sums)
    cold, hot_rows = split_hot(df, hot_keys or keys, hot)
    return cold.withColumns(sums).unionByName(
        hot_running_totals(hot_rows, keys, order, totals, rows_per_task).drop("_rows")
    )
