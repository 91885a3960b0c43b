"""Last-N token windows per session, over tables of (session, order, token, position)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.functions.arrays import empty
from factsieve.plans.skew import (
    ROWS_PER_TASK,
    hot_groups,
    hot_running_totals,
    running_totals,
    split_hot,
)

# Fixed value: tokens a session keeps unless told otherwise.
DEFAULT_CAPACITY = 4096


def check_capacity(capacity: int) -> int:
    if capacity <= 0:
        raise ValueError("capacity must be > 0")
    return capacity


def check_n(n: int) -> int:
    if n < 0:
        raise ValueError("n must not be negative")
    return n


def _list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def last_n_tokens(
    df: DataFrame,
    n: int,
    capacity: int = DEFAULT_CAPACITY,
    key: str | Sequence[str] = "session_id",
    order: str | Sequence[str] = "seq",
    token: str = "token_id",
    position: str = "position",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``last_n``: the newest ``min(n, capacity)`` (token, position) pairs as of each
    row, oldest first."""
    size = min(check_n(n), check_capacity(capacity))
    keys, order = _list(key), _list(order)
    if size == 0:
        return df.withColumn("last_n", empty("struct<token_id:bigint,position:bigint>"))
    pair = F.struct(
        F.col(token).cast("bigint").alias("token_id"),
        F.col(position).cast("bigint").alias("position"),
    )

    def window(rows: DataFrame, groups: list[str]) -> DataFrame:
        frame = Window.partitionBy(*groups).orderBy(*order).rowsBetween(1 - size, Window.currentRow)
        return rows.withColumn("last_n", F.collect_list(pair).over(frame))

    hot = hot_groups(df, keys, rows_per_task)
    if hot is None:
        return window(df, keys)
    cold, hot = split_hot(df, keys, hot)
    # A hot session is cut into pieces by exact row number; each piece also gets
    # the rows before it that its first windows reach back to.
    length = max(size, rows_per_task)
    numbered = hot_running_totals(hot, keys, order, {"_at": F.lit(1)}, rows_per_task)
    piece = F.floor((F.col("_at") - 1) / length)
    reaches_on = (F.col("_at") - 1) % length > length - size
    pieces = numbered.withColumn(
        "_piece",
        F.explode(F.when(reaches_on, F.array(piece, piece + 1)).otherwise(F.array(piece))),
    ).withColumn("_own", F.col("_piece") == piece)
    parts = window(pieces, [*keys, "_piece"]).where("_own")
    return window(cold, keys).unionByName(parts.drop("_rows", "_at", "_piece", "_own"))


def retain_last(
    df: DataFrame,
    capacity: int = DEFAULT_CAPACITY,
    key: str | Sequence[str] = "session_id",
    order: str | Sequence[str] = "seq",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """The newest ``capacity`` rows of each session: what is left after evicting the oldest."""
    check_capacity(capacity)
    keys, order = _list(key), _list(order)
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])

    def newest(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("_rank", F.row_number().over(newest_first))
        return ranked.where(F.col("_rank") <= capacity).drop("_rank")

    hot = hot_groups(df, keys, rows_per_task)
    if hot is None:
        return newest(df)
    cold, hot = split_hot(df, keys, hot)
    numbered = hot_running_totals(hot, keys, order, {"_at": F.lit(1)}, rows_per_task)
    return newest(cold).unionByName(
        numbered.where(F.col("_at") > F.col("_rows") - capacity).drop("_at", "_rows")
    )


def latest_tokens(
    df: DataFrame,
    n: int,
    capacity: int = DEFAULT_CAPACITY,
    key: str | Sequence[str] = "session_id",
    order: str | Sequence[str] = "seq",
    token: str = "token_id",
    position: str = "position",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """One row per session: ``last_n`` of its final state, oldest first."""
    size = min(check_n(n), check_capacity(capacity))
    keys, order = _list(key), _list(order)
    if size == 0:
        return df.select(*keys).distinct().withColumn(
            "last_n", empty("struct<token_id:bigint,position:bigint>")
        )
    ordered = F.struct(
        *order,
        F.struct(
            F.col(token).cast("bigint").alias("token_id"),
            F.col(position).cast("bigint").alias("position"),
        ).alias("_pair"),
    )
    return (
        retain_last(df, size, keys, order, rows_per_task)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(ordered)).alias("_kept"))
        .select(*keys, F.transform("_kept", lambda e: e["_pair"]).alias("last_n"))
    )


def token_segments(
    df: DataFrame,
    is_reset: Column | str = "is_reset",
    key: str | Sequence[str] = "session_id",
    order: str | Sequence[str] = "seq",
    keep_resets: bool = False,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``segment``, counting the clears before each row.

    A cleared session starts anew, so windows over key and segment see no token
    from before the clear. Clear markers are no tokens and are left out.
    """
    keys, order = _list(key), _list(order)
    hot = hot_groups(df, keys, rows_per_task)
    return _segments(df, is_reset, keys, order, keep_resets, rows_per_task, hot)


def _segments(
    df: DataFrame,
    is_reset: Column | str,
    keys: list[str],
    order: list[str],
    keep_resets: bool,
    rows_per_task: int | None,
    hot: DataFrame | None,
) -> DataFrame:
    reset = F.coalesce(F.col(is_reset) if isinstance(is_reset, str) else is_reset, F.lit(False))
    total = {"segment": F.col("_reset").cast("bigint")}
    counted = running_totals(df.withColumn("_reset", reset), keys, order, total, rows_per_task, hot)
    return (counted if keep_resets else counted.where(~F.col("_reset"))).drop("_reset")


def window_length(
    df: DataFrame,
    capacity: int = DEFAULT_CAPACITY,
    key: str | Sequence[str] = "session_id",
    order: str | Sequence[str] = "seq",
    is_reset: str | None = None,
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``window_len``, ``is_empty`` and ``capacity`` as of each row (push or clear)."""
    check_capacity(capacity)
    keys, order = _list(key), _list(order)
    pushed, groups = F.lit(1), keys
    # One count of the raw sessions serves both windows; segments are parts of sessions.
    hot = hot_groups(df, keys, rows_per_task)
    if is_reset is not None:
        df = _segments(df, is_reset, keys, order, True, rows_per_task, hot)
        pushed = F.when(F.coalesce(F.col(is_reset), F.lit(False)), 0).otherwise(1)
        groups = [*keys, "segment"]
    counted = running_totals(df, groups, order, {"_held": pushed}, rows_per_task, hot, keys)
    length = F.least(F.col("_held"), F.lit(capacity).cast("bigint"))
    return counted.withColumns(
        {
            "window_len": length,
            "is_empty": length == 0,
            "capacity": F.lit(capacity).cast("bigint"),
        }
    ).drop("_held")
