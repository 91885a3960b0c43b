import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factsieve import last_n_tokens, latest_tokens, retain_last, token_segments, window_length

SCHEMA = "session_id string, seq bigint, token_id bigint, position bigint, is_reset boolean"


def table(spark, sessions):
    rows = [
        (s, i, t, p, r) for s, items in sessions.items() for i, (t, p, r) in enumerate(items)
    ]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def pushes(pairs):
    return [(t, p, False) for t, p in pairs]


def pairs_of(cells):
    return [(c["token_id"], c["position"]) for c in cells]


@pytest.mark.parametrize(
    "capacity,items,n,want,length",
    [
        (16, [(i, i * 10) for i in range(10)], 3, [(7, 70), (8, 80), (9, 90)], 10),
        (4, [(i, i) for i in range(14)], 4, [(10, 10), (11, 11), (12, 12), (13, 13)], 4),
        (8, [(1, 0), (2, 1)], 100, [(1, 0), (2, 1)], 2),
        (8, [(1, 0), (2, 1)], 0, [], 2),
        (4, [(i, i) for i in range(14)], 9, [(10, 10), (11, 11), (12, 12), (13, 13)], 4),
    ],
)
def test_golden(spark, capacity, items, n, want, length):
    df = table(spark, {"a": pushes(items)})
    last = df.agg(F.max("seq")).first()[0]
    as_of = last_n_tokens(df, n, capacity).where(F.col("seq") == last).first()
    assert pairs_of(as_of.last_n) == want
    assert pairs_of(latest_tokens(df, n, capacity).first().last_n) == want
    row = window_length(df, capacity).where(F.col("seq") == last).first()
    assert (row.window_len, row.is_empty, row.capacity) == (length, False, capacity)
    assert retain_last(df, capacity).count() == length


def test_clear(spark):
    log = [(1, 0, False), (2, 1, False), (0, 0, True), (9, 99, False)]
    df = table(spark, {"a": log})
    segments = token_segments(df)
    got = last_n_tokens(segments, 1, 8, key=["session_id", "segment"]).orderBy("seq").collect()
    assert [pairs_of(r.last_n) for r in got] == [[(1, 0)], [(2, 1)], [(9, 99)]]
    lengths = window_length(df, 8, is_reset="is_reset").orderBy("seq").collect()
    assert [(r.window_len, r.is_empty) for r in lengths] == [
        (1, False), (2, False), (0, True), (1, False),
    ]


def test_arguments(spark):
    df = table(spark, {"a": pushes([(1, 0)])})
    for bad in (0, -1):
        with pytest.raises(ValueError):
            last_n_tokens(df, 1, bad)
        with pytest.raises(ValueError):
            retain_last(df, bad)
        with pytest.raises(ValueError):
            window_length(df, bad)
    with pytest.raises(ValueError):
        last_n_tokens(df, -1)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    capacity=st.integers(1, 12),
    n=st.integers(0, 16),
    values=st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=60),
)
def test_tail_of_log(spark, capacity, n, values):
    df = table(spark, {"a": pushes([(v, i) for i, v in enumerate(values)])})
    held = deque(maxlen=capacity)
    want = {}
    for i, v in enumerate(values):
        held.append((v, i))
        want[i] = list(held)[max(len(held) - n, 0) :]
    for rows_per_task in (10**6, 7):
        got = last_n_tokens(df, n, capacity, rows_per_task=rows_per_task).collect()
        assert {r.seq: pairs_of(r.last_n) for r in got} == want


@pytest.mark.parametrize("rows_per_task", [10**6, 50, 9])
def test_hot_session(spark, rows_per_task):
    """One session holds most rows; results must not depend on how it is split."""
    rng = random.Random(5)
    sessions = {
        s: [(rng.randint(0, 99), i, rng.random() < 0.05) for i in range(size)]
        for s, size in {"hot": 700, "b": 40, "c": 9, None: 120}.items()
    }
    df = table(spark, sessions)
    capacity, n = 12, 10
    want_n, want_len, want_kept, want_seg = {}, {}, set(), {}
    for s, items in sessions.items():
        held, segment = deque(maxlen=capacity), 0
        plain = deque(maxlen=capacity)
        for i, (t, p, r) in enumerate(items):
            plain.append(i)
            if r:
                held.clear()
                segment += 1
            else:
                held.append((t, p))
                want_n[s, i] = list(held)[max(len(held) - n, 0) :]
                want_seg[s, i] = segment
            want_len[s, i] = len(held)
        want_kept |= {(s, i) for i in plain}
    segments = token_segments(df, rows_per_task=rows_per_task)
    assert {(r.session_id, r.seq): r.segment for r in segments.collect()} == want_seg
    got = last_n_tokens(
        segments, n, capacity, key=["session_id", "segment"], rows_per_task=rows_per_task
    ).collect()
    assert {(r.session_id, r.seq): pairs_of(r.last_n) for r in got} == want_n
    lengths = window_length(df, capacity, is_reset="is_reset", rows_per_task=rows_per_task).collect()
    assert {(r.session_id, r.seq): r.window_len for r in lengths} == want_len
    kept = retain_last(df, capacity, rows_per_task=rows_per_task).collect()
    assert len(kept) == len(want_kept) and {(r.session_id, r.seq) for r in kept} == want_kept
