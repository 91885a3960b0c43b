import random
import time

import pytest
from pyspark.sql import functions as F

from factsieve import detect_pii, filter_pii
from factsieve.functions import patterns
from factsieve.functions.emails import any_email, email_spans
from factsieve.functions.personal_data import (
    contains_pii,
    has_credit_card,
    has_email,
    has_phone,
    has_ssn,
    matched_types,
    pii_violations,
)
from factsieve.functions.spans import find_spans
from factsieve.streaming.verdicts import _Scanner

SPANS = [
    ("Contact user@example.com please", [("email", "u***@example.com")]),
    ("Call +1 (555) 123-4567 now", [("phone", "***-***-4567")]),
    ("Call 555.123.4567 now", [("phone", "***-***-4567")]),
    ("Call +7 999 123-45-67 now", [("phone", "***-***-4567")]),
    ("SSN 123-45-6789", [("ssn", "***-**-6789")]),
    ("card 4111 1111 1111 1111", [("credit_card", "**** **** **** 1111")]),
    ("4111111111111111", [("credit_card", "**** **** **** 1111")]),
    ("4111-1111-1111-1111x", []),
    ("41111111111111111", []),
    ("version 1.2.3 released", []),
    ("order #123-456 shipped", []),
    ("build 2024.07.27", []),
    ("call (555) 123-4567", []),
    ("tel(555) 123-4567", [("phone", "***-***-4567")]),
    ("+1(555)12345678999", [("phone", "***-***-4567")]),
    ("почтаuser@example.com", []),
    ("kſK@exampſe.Kom", [("email", "k***@exampſe.Kom")]),
    ("a@b.com-x@c.org", [("email", "a***@b.com"), ("email", "-***@c.org")]),
    ("a@b.c", []),
    ("a@b.co1", []),
    ("٤١١١-1111-1111-1111", [("credit_card", "**** **** **** 1111")]),
    ("+1 (555) 123-4567", [("phone", "***-***-4567")]),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPANS)], "id int, text string")


def test_spans(spark, texts):
    rows = detect_pii(texts).collect()
    got = {}
    for r in rows:
        text = SPANS[r.id][0]
        assert text[r.start_char : r.end_char] == r.raw
        assert text.encode()[r.start : r.end].decode() == r.raw
        got.setdefault(r.id, []).append((r.pii_type, r.masked))
    for i, (text, want) in enumerate(SPANS):
        assert got.get(i, []) == want, text
    flags = {r[0]: r[1] for r in texts.select("id", contains_pii("text")).collect()}
    assert flags == {i: bool(w) for i, (_, w) in enumerate(SPANS)}
    assert {r.id for r in filter_pii(texts).collect()} == {i for i, w in flags.items() if w}


def test_overlap_and_order(spark):
    text = "card 4111111111111111, 123-45-6789@x.com then 555-123-4567"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = detect_pii(df).collect()
    assert [r.pii_type for r in rows] == ["credit_card", "ssn", "email", "phone"]
    assert [(r.start, r.end) for r in rows] == sorted((r.start, r.end) for r in rows)
    r = df.select(matched_types("text"), pii_violations("text")).first()
    assert r[0] == ["email", "phone", "ssn", "credit_card"]
    assert r[1] == [
        "pii:email:1***@x.com",
        "pii:phone:***-***-4567",
        "pii:ssn:***-**-6789",
        "pii:credit_card:**** **** **** 1111",
    ]
    one = df.select(
        has_email("text"), has_phone("text"), has_ssn("text"), has_credit_card("text")
    ).first()
    assert list(one) == [True] * 4


def test_chosen_types(spark, texts):
    rows = detect_pii(texts, types=["ssn", "phone"]).collect()
    assert {r.pii_type for r in rows} == {"ssn", "phone"}
    assert detect_pii(texts, types=[]).count() == 0
    with pytest.raises(ValueError):
        detect_pii(texts, types=["iban"])


def test_emails_equal_the_plain_search(spark):
    rng = random.Random(4)
    parts = ["@", "@", ".", "-", "a", "b", "c.com", "b.io", "x@y.org", "é", "_", "9", " ", "\n", "%", "+",
             "ſ", "K", "co", "@a.bc", "ا", "́", "😀", "a@b.com-x@c.org", "com@"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    span = [F.col(f"s.{c}") for c in ("start", "end", "start_char", "end_char", "raw")]
    plain = df.select("id", F.explode(find_spans(F.col("text"), patterns.EMAIL)).alias("s"))
    want = sorted(plain.select("id", *span).collect())
    got = sorted(df.select("id", F.explode(email_spans(F.col("text"))).alias("s")).select("id", *span).collect())
    assert got == want and len(want) > 1000
    with_email = {r.id for r in want}
    assert {r.id for r in df.where(any_email(F.col("text"))).collect()} == with_email
    counts = {i: 0 for i in range(len(texts))}
    for r in want:
        counts[r.id] += 1
    assert counts == {i: _Scanner._emails(t) for i, t in enumerate(texts)}


def test_long_unbroken_runs_take_linear_time(spark):
    n = 500_000
    for text in ("a." * n + " x@", "x@" + "a." * n):
        df = spark.createDataFrame([(text,)], "text string")
        df.select(contains_pii("text")).first()
        began = time.perf_counter()
        assert not df.select(contains_pii("text")).first()[0]
        assert time.perf_counter() - began < 20  # a rescan per word boundary takes hours
        began = time.perf_counter()
        assert _Scanner._emails(text) == 0
        assert time.perf_counter() - began < 20
