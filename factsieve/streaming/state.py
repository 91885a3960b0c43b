"""Shared plumbing of the keyed stream operators."""

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_WHOLE = ("tinyint", "smallint", "int", "bigint")
# One session's rows of a micro-batch by column, ordered by ``seq``.
Columns = dict[str, np.ndarray]
# (key values, rows, state or None) -> (state or None, output rows)
Step = Callable[[tuple, Columns, tuple | None], tuple[tuple | None, list[tuple]]]


def plain(values: np.ndarray) -> list:
    """The values as Python objects, times as timestamps."""
    return pd.Series(values).tolist() if values.dtype.kind in "mM" else values.tolist()


def _joined(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _in_order(rows: pd.DataFrame, seq: str) -> pd.DataFrame:
    """Rows by ``seq`` (equal values keep arrival order)."""
    return rows if rows[seq].is_monotonic_increasing else rows.sort_values(seq, kind="stable")


def _sessions(rows: pd.DataFrame, keys: Sequence[str], seq: str, whole: Sequence[str]) -> Iterator[tuple[tuple, Columns]]:
    """Key values and rows of each session; bit i of ``_nulls`` says that ``whole[i]`` is null."""
    nulls = rows["_nulls"].to_numpy()
    gone = {c: (nulls >> i & 1).astype(bool) for i, c in enumerate(whole)} if nulls.any() else {}
    if seq in gone:
        rows = rows.assign(_gone=gone[seq]).sort_values(["_gone", seq], kind="stable")
    else:
        rows = _in_order(rows, seq)
    place = rows.index.to_numpy()
    values = [rows[k].tolist() for k in keys]
    for i, k in enumerate(keys):
        if k in gone:
            values[i] = [None if g else v for v, g in zip(values[i], gone[k][place], strict=True)]
    codes: dict[tuple, int] = {}
    code = np.fromiter((codes.setdefault(s, len(codes)) for s in zip(*values, strict=True)), np.int64, len(rows))
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(codes))).tolist()
    columns = {c: rows[c].to_numpy()[order] for c in rows.columns if c not in keys}
    lost = {c: g[place][order] for c, g in gone.items() if c not in keys}
    begin = 0
    for session, end in zip(codes, ends, strict=True):
        one = {c: v[begin:end] for c, v in columns.items()}
        for c, g in lost.items():
            if g[begin:end].any():  # as pandas has it
                one[c] = np.where(g[begin:end], np.nan, one[c])
        yield session, one
        begin = end


def _frame(rows: list[tuple], output: Sequence[tuple[str, str]]) -> pd.DataFrame:
    if not rows:
        return pd.DataFrame(columns=[c for c, _ in output])
    columns = {}
    for (name, kind), values in zip(output, zip(*rows, strict=True), strict=True):
        if kind in _WHOLE and any(v is None or v != v for v in values):
            # a null makes no floats of the numbers beside it
            values = pd.Series([None if v is None or v != v else int(v) for v in values], dtype=object)
        columns[name] = values if isinstance(values, pd.Series) else list(values)
    return pd.DataFrame(columns)


def keyed_state(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    step: Step,
    output: Sequence[tuple[str, str]],
    state: str,
    idle_timeout_ms: int | None,
    left: Callable[[tuple, tuple], list[tuple]] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Run ``step(key, rows, state) -> (state, output rows)`` per session and micro-batch.

    A step that returns None for the state ends the session. ``left(key, state)`` gives the
    last rows of a session that is dropped for its silence.

    With ``idle_timeout_ms`` the state of a session that stays silent that long is
    dropped, unless a last row has ended the session before. It is for
    queries that keep running: Spark keeps triggering batches to check for silence,
    so an ``availableNow`` query with a timeout does not end by itself.

    Passing a group to Python costs Spark milliseconds, whatever its size. With ``buckets``
    sessions are dealt by a hash of their key, and Spark's groups are the buckets: so many at
    most, however many sessions there are. The step still sees one session at a time. The
    price is that a micro-batch writes the state of all sessions of the buckets it meets, and
    that silence is not watched, so it does not go with ``idle_timeout_ms``.
    """

    # The functions travel with the job, so workers need not have the package installed.
    cloudpickle.register_pickle_by_value(sys.modules["factsieve"])
    types = dict(df.dtypes)
    ddl = ", ".join(f"{c} {t}" for c, t in output)

    if buckets is not None:
        if idle_timeout_ms is not None:
            raise ValueError("buckets do not go with idle_timeout_ms")
        if buckets < 1 or any(types[k] not in (*_WHOLE, "string") for k in keys):
            raise ValueError("buckets must be positive and keys strings or whole numbers")
        # pandas would make floats of all whole numbers of a bucket for one null among them
        whole = [c for c, t in df.dtypes if t in _WHOLE]
        bits = sum((F.shiftleft(F.col(c).isNull().cast("bigint"), i) for i, c in enumerate(whole)), F.lit(0).cast("bigint"))
        dealt = df.select(
            F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"),
            bits.alias("_nulls"),
            *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) if c in whole else F.col(c) for c, t in df.dtypes],
        )

        def update_bucket(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
            known = pickle.loads(held.get[0]) if held.exists else {}
            out = []
            for session, rows in _sessions(_joined(batches), keys, seq, whole):
                new, some = step(session, rows, known.get(session))
                if new is None:
                    known.pop(session, None)
                else:
                    known[session] = new
                out += some
            if known:
                held.update((pickle.dumps(known, 5),))
            elif held.exists:
                held.remove()
            yield _frame(out, output)

        return dealt.groupBy("_bucket").applyInPandasWithState(
            update_bucket, ddl, "sessions binary", "append", GroupStateTimeout.NoTimeout
        )

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            if left is not None:
                yield _frame(left(key, held.get), output)
            held.remove()
            return
        rows = _in_order(_joined(batches), seq)
        new, out = step(key, {c: rows[c].to_numpy() for c in rows.columns}, held.get if held.exists else None)
        if new is None:
            if held.exists:
                held.remove()
        else:
            held.update(new)
            if idle_timeout_ms is not None:
                held.setTimeoutDuration(idle_timeout_ms)
        yield _frame(out, output)

    timeout = (
        GroupStateTimeout.NoTimeout
        if idle_timeout_ms is None
        else GroupStateTimeout.ProcessingTimeTimeout
    )
    return df.groupBy(*keys).applyInPandasWithState(update, ddl, state, "append", timeout)
