import os
import random
import time

import pytest
import regex

from factsieve import (
    accumulate_text,
    last_n_stream,
    last_n_tokens,
    read_token_batches,
    text_digests,
    token_segments,
    verify_deltas,
    verify_deltas_by_rescan,
    verify_stream,
    write_verdict_stream,
)
from factsieve.functions import patterns
from factsieve.functions.verdicts import NO_TEXT_RULE, REASON_NO_TEXT, REASON_OK, REASON_PII
from factsieve.sources.schemas import TOKEN_BATCHES, TOKENS
from factsieve.streaming.verdicts import _Scanner

GOLDEN = [
    ("a", 0, [1, 2], "", "FLAG", ["missing_text_delta"]),
    ("a", 1, [], "", "PASS", []),
    ("a", 2, [], "mail user@exam", "PASS", []),
    ("a", 3, [], "ple.com ", "BLOCK", ["email"]),
    ("a", 4, [7], "", "BLOCK", ["email"]),
    ("b", 0, [], "card 4111111111111111", "BLOCK", ["credit_card"]),
    ("b", 1, [], "1", "PASS", []),
    ("c", 0, None, None, "PASS", []),
    ("c", 1, [3], None, "FLAG", ["missing_text_delta"]),
    ("c", 2, [3], "x", "PASS", []),
    ("c", 3, [3], "", "PASS", []),
    ("d", 0, [], "555-123-4567, a@b.com", "BLOCK", ["email", "phone"]),
    ("d", 1, [], "x", "BLOCK", ["email", "phone"]),
    ("d", 2, [], " 123-45-6789", "BLOCK", ["email", "phone", "ssn"]),
    ("d", 3, [], "ж", "BLOCK", ["email", "phone"]),
]

PIECES = [
    "a@b.com", "x.y@mail.example.com", "@", ".", "4111 1111 1111 1111", "4111111111111111",
    "123-45-6789", "+1 (555) 123-4567", "+7 999 123-45-67", "555.123.4567", "(555) 123-4567",
    "word", "é", "ж", ",", ";", " ", "\n", " ", "٣", "1", "12", "-", "_", "😀", "ſ", "́",
    "tel", "the and", "com", "a@b.co",
]


def split_text(rng, text):
    out = []
    while text:
        n = rng.randint(0, 9)
        out.append(text[:n])
        text = text[n:]
    return out


def sessions(seed, count):
    rng = random.Random(seed)
    rows = []
    for s in range(count):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        deltas = split_text(rng, text)
        for i, d in enumerate(deltas):
            rows.append((f"s{s}", i, rng.choice([[], None, [1]]), rng.choice([d, d, d or None]), "t"))
    return rows


def expected(rows):
    """Straight from the definition: rescan everything with each delta."""
    acc, out = {}, {}
    for session, seq, ids, delta, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        text = acc[session] = acc.get(session, "") + (delta or "")
        found = [t for t, p in patterns.PII_PATTERNS.items() for _ in regex.finditer(p, text)]
        if found:
            out[session, seq] = ("BLOCK", REASON_PII, found)
        elif not text and ids:
            out[session, seq] = ("FLAG", REASON_NO_TEXT, [NO_TEXT_RULE])
        else:
            out[session, seq] = ("PASS", REASON_OK, [])
    return out


def verdicts(df):
    rows = df.collect()
    got = {(r.session_id, r.seq): (r.action, r.reason, list(r.matched_rules)) for r in rows}
    assert len(got) == len(rows)
    return got


def run_stream(spark, tmp_path, batches, schema, build):
    """Feed the batches as one file each, in order, and return what was written."""
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    os.makedirs(source)
    for i, rows in enumerate(batches):
        staged = str(tmp_path / f"stage{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(staged)
        part = next(f for f in os.listdir(staged) if f.endswith(".parquet"))
        target = f"{source}/{i:05d}.parquet"
        os.link(f"{staged}/{part}", target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_token_batches(spark, source, schema=schema, max_files_per_trigger=1)
    query = write_verdict_stream(build(stream), sink, checkpoint, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(sink)


def test_golden(spark):
    df = spark.createDataFrame([(s, q, i, d, "t") for s, q, i, d, *_ in GOLDEN], TOKEN_BATCHES)
    want = {(s, q): (a, m) for s, q, _, _, a, m in GOLDEN}
    for f in (verify_deltas, verify_deltas_by_rescan):
        assert {k: (v[0], v[2]) for k, v in verdicts(f(df)).items()} == want


def test_accumulate(spark):
    df = spark.createDataFrame([(s, q, i, d, "t") for s, q, i, d, *_ in GOLDEN], TOKEN_BATCHES)
    got = {(r.session_id, r.seq): r.text for r in accumulate_text(df).collect()}
    assert got["a", 3] == "mail user@example.com " and got["c", 1] == "" and got["b", 1].endswith("11")


@pytest.mark.parametrize("rows_in_a_task", [1000, 7, None])
def test_digests_are_those_of_the_whole_text(spark, rows_in_a_task):
    rng = random.Random(5)
    some = ["", None, "a", "\n", "é", "日本", "🙂x", "long " * 300]
    rows = [(s, i, [], rng.choice(some)) for s, n in (("a", 60), ("b", 3), (None, 20), ("empty", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id string, seq long, token_ids array<long>, text_delta string")
    got = {(r.session_id, r.seq): (r.chars, r.digest) for r in text_digests(df, rows_per_task=rows_in_a_task).collect()}
    text = {}
    for s, i, _, delta in rows:
        text[s] = text.get(s, "") + (delta or "")
        digest = sum(ord(c) * pow(1_000_003, k, 2**31 - 1) for k, c in enumerate(text[s])) % (2**31 - 1)
        assert got[s, i] == (len(text[s]), digest)
    assert len(got) == len(rows)
    assert text_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_task", [10**6, 8])
def test_linear_equals_rescan(spark, rows_per_task):
    rows = sessions(1, 150) + [("big", i, [], d, "t") for i, d in enumerate(
        split_text(random.Random(2), "".join(random.Random(3).choices(PIECES, k=300))))]
    df = spark.createDataFrame(rows, TOKEN_BATCHES)
    want = expected(rows)
    assert verdicts(verify_deltas(df, rows_per_task=rows_per_task)) == want
    if rows_per_task > 8:
        assert verdicts(verify_deltas_by_rescan(df)) == want


def test_stream_equals_batch(spark, tmp_path):
    rows = sessions(4, 40) + [(s, q, i, d, "t") for s, q, i, d, *_ in GOLDEN]
    cut = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 2), (2, 5), (5, 10**6))]
    out = run_stream(spark, tmp_path, cut, TOKEN_BATCHES, verify_stream)
    assert verdicts(out) == expected(rows)


def test_stream_late_rows(spark, tmp_path):
    batches = [[("a", 5, [], "x@y", "t")], [("a", 3, [], ".com", "t"), ("a", 6, [], "", "t")]]
    out = run_stream(
        spark, tmp_path, batches, TOKEN_BATCHES,
        lambda s: verify_stream(s, report_late=True),
    )
    got = {r.seq: (r.action, r.late) for r in out.collect()}
    assert got == {5: ("PASS", False), 3: ("BLOCK", True), 6: ("BLOCK", False)}


def test_token_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [
        (f"s{s}", i, rng.randint(0, 2**32 - 1), i * 3, rng.random() < 0.1)
        for s in range(6) for i in range(rng.randint(1, 30))
    ]
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 4), (4, 9), (9, 99))]
    out = run_stream(
        spark, tmp_path, batches, TOKENS,
        lambda s: last_n_stream(s, n=3, capacity=5, is_reset="is_reset"),
    )
    got = {(r.session_id, r.seq): r.last_n for r in out.collect()}
    segments = token_segments(spark.createDataFrame(rows, TOKENS))
    batch = last_n_tokens(segments, 3, 5, key=["session_id", "segment"]).collect()
    assert got == {(r.session_id, r.seq): r.last_n for r in batch}


def test_last_row_ends_a_session(spark, tmp_path):
    schema = TOKEN_BATCHES + ", is_last boolean"
    batches = [
        [("a", 0, [], "mail x@y.com", "t", False), ("b", 0, [], "x@y.com", "t", True), ("b", 1, [], "fine", "t", False)],
        [("a", 1, [], " more", "t", True), ("b", 2, [], "", "t", None)],
        [("a", 2, [], "clean", "t", None)],
    ]
    out = run_stream(spark, tmp_path, batches, schema, lambda s: verify_stream(s, is_last="is_last"))
    got = {(r.session_id, r.seq): r.action for r in out.collect()}
    assert got == {
        ("a", 0): "BLOCK", ("a", 1): "BLOCK", ("a", 2): "PASS",
        ("b", 0): "BLOCK", ("b", 1): "PASS", ("b", 2): "PASS",
    }


def test_last_token_ends_a_session(spark, tmp_path):
    schema = TOKENS + ", is_last boolean"
    batches = [
        [("a", 0, 10, 0, False, False), ("a", 1, 11, 1, False, True), ("a", 2, 12, 2, False, False)],
        [("a", 3, 13, 3, False, True)],
        [("a", 4, 14, 4, False, False)],
    ]
    out = run_stream(
        spark, tmp_path, batches, schema,
        lambda s: last_n_stream(s, n=5, capacity=5, is_reset="is_reset", is_last="is_last"),
    )
    got = {r.seq: [t.token_id for t in r.last_n] for r in out.collect()}
    assert got == {0: [10], 1: [10, 11], 2: [12], 3: [12, 13], 4: [14]}


def test_silent_sessions_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)
    rows = [("a", 0, [], "mail x@y.com", "t")]
    spark.createDataFrame(rows, TOKEN_BATCHES).coalesce(1).write.mode("append").parquet(source)
    stream = read_token_batches(spark, source)
    query = write_verdict_stream(
        verify_stream(stream, idle_timeout_ms=500), str(tmp_path / "out"), str(tmp_path / "state"),
        processing_time="200 milliseconds",
    )
    held = lambda: [o["numRowsTotal"] for p in query.recentProgress for o in p.stateOperators]

    def wait(done):
        for _ in range(200):
            if done():
                return
            time.sleep(0.2)
        raise AssertionError("the stream did not get there in time")

    try:
        wait(lambda: 1 in held() and held()[-1] == 0)
        rows = [("a", 1, [], "clean", "t")]
        spark.createDataFrame(rows, TOKEN_BATCHES).coalesce(1).write.mode("append").parquet(source)
        # a query with a timeout never rests, so what it has written is looked at instead
        wait(lambda: spark.read.parquet(str(tmp_path / "out")).count() == 2)
    finally:
        query.stop()
    got = {r.seq: r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "BLOCK", 1: "PASS"}


def test_scanner_in_bulk_equals_a_scan_of_each_beginning():
    rng = random.Random(11)
    parts = ["4111 1111 ", "1111 1111", "4111111111111111", "123-45-", "6789", "user@exam", "ple.com", "@", "x.co", " ", ".",
             "é", "a", "\n", "555.123.", "4567", "+1 (555) ", "123", "!", "b@c.de", "1"]
    for _ in range(300):
        deltas = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))]
        scanner, got = _Scanner("", [0] * 4), []
        at = 0
        while at < len(deltas):  # some deltas at a time
            n = rng.randint(1, 5)
            got += scanner.add(deltas[at : at + n])
            at += n
        want = [[len(e) for e in _Scanner._ends("".join(deltas[: i + 1]))] for i in range(len(deltas))]
        assert got == want, deltas


def test_rows_out_of_order_between_batches(spark, tmp_path):
    rng = random.Random(21)
    rows = sessions(6, 30) + [(s, q, i, d, "t") for s, q, i, d, *_ in GOLDEN]
    by_place = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 6))
    batches = [by_place[i : i + 40] for i in range(0, len(by_place), 40)]
    out = run_stream(spark, tmp_path, batches, TOKEN_BATCHES, lambda s: verify_stream(s, reorder=50))
    assert verdicts(out) == expected(rows)


def test_a_gap_is_passed_when_too_many_rows_wait(spark, tmp_path):
    batches = [
        [("a", 1, [], "x@y", "t"), ("a", 2, [], ".com", "t")],
        [("a", 3, [], " ", "t")],
        [("a", 0, [], "late", "t")],
    ]
    out = run_stream(spark, tmp_path, batches, TOKEN_BATCHES, lambda s: verify_stream(s, reorder=2, report_late=True))
    got = {r.seq: (r.action, r.late) for r in out.collect()}
    # 1 goes when three wait, 2 and 3 follow on it; 0 comes too late
    assert got == {1: ("PASS", False), 2: ("BLOCK", False), 3: ("BLOCK", False), 0: ("BLOCK", True)}


def test_micro_batches_stay_below_the_bytes(spark, tmp_path):
    source = tmp_path / "in"
    rng = random.Random(3)
    sizes = [40_000, *[400] * 12]
    for i, n in enumerate(sizes):
        text = "".join(chr(rng.randint(97, 122)) for _ in range(n))
        one = spark.createDataFrame([(f"s{i}", 0, [], text, "t")], TOKEN_BATCHES).coalesce(1)
        one.write.mode("append").parquet(str(source))
    files = {p.stat().st_size for p in source.iterdir() if p.name.endswith(".parquet")}
    most = 4 * min(files)
    stream = read_token_batches(spark, str(source), max_bytes_per_trigger=most)
    seen = []

    def see(batch, _):
        seen.append({r["f"] for r in batch.selectExpr("input_file_name() AS f").collect()})

    query = stream.writeStream.foreachBatch(see).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = [[os.path.getsize(f.removeprefix("file://")) for f in s] for s in seen if s]
    assert sum(map(len, found)) == len(sizes)
    assert len(found) > 3
    assert all(sum(b) <= most or len(b) == 1 for b in found)


def test_waiting_rows_are_judged_when_a_session_falls_silent(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", 2, [], "b.com", "t"), ("a", 1, [], "mail x@", "t")]
    spark.createDataFrame(rows, TOKEN_BATCHES).coalesce(1).write.parquet(source)
    query = write_verdict_stream(
        verify_stream(read_token_batches(spark, source), idle_timeout_ms=500, reorder=5),
        str(tmp_path / "out"), str(tmp_path / "state"), processing_time="200 milliseconds",
    )
    try:
        for _ in range(200):
            if os.path.isdir(tmp_path / "out") and spark.read.schema("seq bigint, action string").parquet(str(tmp_path / "out")).count() == 2:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    got = {r.seq: r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "PASS", 2: "BLOCK"}


def test_sessions_share_groups(spark, tmp_path):
    """As many groups as buckets, not as sessions; nulls and large numbers stay what they are."""
    big = 2**60 + 1
    schema = TOKEN_BATCHES.replace("session_id string", "tenant bigint, session_id string") + ", is_last boolean"
    rows = [(t, s, q, i, d, "t", False) for s, q, i, d, *_ in sessions(9, 40) for t in (None, big)]
    rows += [(t, None, q, [], d, "t", False) for t in (None, big) for q, d in ((big, "x@"), (big + 1, "y.com"), (None, " "))]
    cut = [[r for r in rows if r[2] is not None and r[2] < 2], [r for r in rows if r[2] is None or r[2] >= 2]]
    plain, shared = (
        run_stream(spark, tmp_path / str(b), cut, schema, lambda s, b=b: verify_stream(s, ["tenant", "session_id"], buckets=b))
        for b in (None, 3)
    )
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted(map(tuple, shared.collect()), key=key)
    assert got == sorted(map(tuple, plain.collect()), key=key) and len(got) == len(rows)
    states = [spark.read.format("statestore").load(str(tmp_path / str(b) / "cp")).count() for b in (None, 3)]
    assert states == [len({r[:2] for r in rows}), 3]
    with pytest.raises(ValueError):
        verify_stream(spark.createDataFrame([], TOKEN_BATCHES), buckets=3, idle_timeout_ms=500)


def test_ended_sessions_leave_their_group(spark, tmp_path):
    schema = TOKEN_BATCHES + ", is_last boolean"
    batches = [
        [("a", 0, [], "x@", "t", False), ("b", 0, [], "x@y.com", "t", True), ("b", 1, [], "fine", "t", False)],
        [("a", 1, [], "y.com", "t", True), ("b", 2, [], "", "t", True)],
        [("a", 2, [], "clean", "t", None)],
    ]
    out = run_stream(spark, tmp_path, batches, schema, lambda s: verify_stream(s, is_last="is_last", buckets=1))
    got = {(r.session_id, r.seq): r.action for r in out.collect()}
    assert got == {
        ("a", 0): "PASS", ("a", 1): "BLOCK", ("a", 2): "PASS",
        ("b", 0): "BLOCK", ("b", 1): "PASS", ("b", 2): "PASS",
    }


def test_token_sessions_share_groups(spark, tmp_path):
    rng = random.Random(8)
    rows = [
        (f"s{s}", i, rng.randint(0, 2**32 - 1), i * 3, rng.random() < 0.1)
        for s in range(6) for i in range(rng.randint(1, 30))
    ]
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, 4), (4, 9), (9, 99))]
    out = run_stream(
        spark, tmp_path, batches, TOKENS,
        lambda s: last_n_stream(s, n=3, capacity=5, is_reset="is_reset", buckets=2),
    )
    got = {(r.session_id, r.seq): r.last_n for r in out.collect()}
    segments = token_segments(spark.createDataFrame(rows, TOKENS))
    batch = last_n_tokens(segments, 3, 5, key=["session_id", "segment"]).collect()
    assert got == {(r.session_id, r.seq): r.last_n for r in batch}
