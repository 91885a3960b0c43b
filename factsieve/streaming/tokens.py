"""Last-N token window of live sessions, with keyed state bounded by the capacity."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.operators.tokens import DEFAULT_CAPACITY, check_capacity, check_n
from factsieve.streaming.state import Columns, keyed_state

_STATE = "tokens array<bigint>, positions array<bigint>"
# New tokens of a session that travel in one row, with what their windows reach back to.
_TOGETHER = 1024


def last_n_stream(
    df: DataFrame,
    n: int,
    capacity: int = DEFAULT_CAPACITY,
    key: str | Sequence[str] = "session_id",
    seq: str = "seq",
    token: str = "token_id",
    position: str = "position",
    is_reset: str | None = None,
    idle_timeout_ms: int | None = None,
    is_last: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Session key, ``seq``, ``last_n`` (oldest first) and ``window_len`` as of each token.

    A row with ``is_reset`` clears the session and gives no output row. One with ``is_last``
    is a token like others and ends the session: its state goes. The stateful step only puts
    held and new tokens together, in bulk; windows are cut from them by built-in functions.
    ``buckets``: sessions share so many groups; see :func:`keyed_state`.
    """
    check_capacity(capacity)
    check_n(n)
    keys = [key] if isinstance(key, str) else list(key)

    def flag(name: str | None):
        return F.lit(False) if name is None else F.coalesce(F.col(name), F.lit(False))

    rows = df.select(
        *keys,
        seq,
        F.col(token).cast("bigint").alias("_token"),
        F.col(position).cast("bigint").alias("_position"),
        flag(is_reset).alias("_reset"),
        flag(is_last).alias("_last"),
    )
    types = dict(rows.dtypes)
    output = [(c, types[c]) for c in keys]
    output += [("_seq", f"array<{types[seq]}>"), ("_to", "array<int>"), ("_len", "array<int>")]
    output += [("_tokens", "array<bigint>"), ("_positions", "array<bigint>")]
    size = min(n, capacity)

    def step(key_values: tuple, ordered: Columns, state: tuple | None):
        reset, last = ordered["_reset"].astype(bool), ordered["_last"].astype(bool)
        held = len(state[0]) if state else 0
        push = ~reset
        tokens, places = (
            np.concatenate([np.asarray(s, np.int64), ordered[c][push]])
            for s, c in zip(state or ([], []), ("_token", "_position"), strict=True)
        )
        # place of each row's newest token, and of the first one since the last clear or end
        to = held + np.cumsum(push) - 1
        clears = reset | np.concatenate([[False], last[:-1]])
        begins = np.where(clears, to + reset, 0)
        start = np.maximum.accumulate(begins) if len(begins) else begins
        lengths = np.minimum(to - start + 1, capacity)[push]
        to, seqs = to[push], ordered[seq][push]
        out = []
        for at in range(0, len(to), _TOGETHER):
            ends = to[at : at + _TOGETHER]
            low = max(int(ends[0]) - size + 1, 0)
            cut = slice(low, int(ends[-1]) + 1)
            chunk = slice(at, at + _TOGETHER)
            out.append((*key_values, seqs[chunk], ends - low, lengths[chunk], tokens[cut], places[cut]))
        kept = slice(max(int(start[-1]), len(tokens) - capacity), None) if len(start) else slice(None)
        ended = len(last) and bool(last[-1])
        new = None if ended else (tokens[kept].tolist(), places[kept].tolist())
        return new, out

    held = keyed_state(rows, keys, seq, step, output, _STATE, idle_timeout_ms, buckets=buckets)

    def window(z):
        k = F.least(z["_len"], F.lit(size))
        cut = F.arrays_zip(
            F.slice("_tokens", z["_to"] - k + 2, k).alias("token_id"),
            F.slice("_positions", z["_to"] - k + 2, k).alias("position"),
        )
        return F.struct(z["_seq"].alias(seq), cut.alias("last_n"), z["_len"].cast("bigint").alias("window_len"))

    return held.select(*keys, F.inline(F.transform(F.arrays_zip("_seq", "_to", "_len"), window)))
