import random

import pytest
from pyspark.sql import functions as F

from factsieve import (
    answers_grounded,
    extract_numerics,
    grounded_against_facts,
    grounded_numbers,
    unmatched_against_facts,
    unmatched_numerics,
)
from factsieve.functions.grounding import (
    answer_grounded,
    unmatched_numbers,
    unmatched_values,
    verify_numeric,
)
from factsieve.operators.grounding import _possible

PAIRS = [
    ("Выручка 14 млн", "В отчёте указано 14,000,000", []),
    ("Выручка 15 млн", "В отчёте указано 14,000,000", [15e6]),
    ("No digits here", "also none", []),
    ("No digits here", None, []),
    ("Margin 72%", "No digits in text.", [72.0]),
    ("Margin 72%", None, [72.0]),
    ("14.01", "14.0", []),
    ("92.51", "92.5", [92.51]),
    ("3 and 3 and 4", "3", [4.0]),
    ("4 then 5 then 4", "", [4.0, 5.0, 4.0]),
    ("20%", "20", []),
    ("9" * 400, "9" * 400, [float("inf")]),
]


def test_rows(spark):
    df = spark.createDataFrame(
        [(i, a, c) for i, (a, c, _) in enumerate(PAIRS)], "id int, answer string, context string"
    )
    rows = df.select(
        "id", unmatched_numbers("answer", "context").alias("u"), answer_grounded("answer", "context").alias("g")
    ).collect()
    for r in rows:
        assert r.u == PAIRS[r.id][2], PAIRS[r.id]
        assert r.g == (not PAIRS[r.id][2])


def test_verify_numeric(spark):
    df = spark.createDataFrame([(14e6, [14e6]), (15e6, [14e6]), (1.0, [])], "v double, c array<double>")
    got = [r[0] for r in df.select(verify_numeric(F.col("v"), F.col("c"))).collect()]
    assert got == [True, False, False]


def _values(rng, n):
    kinds = [
        lambda: round(rng.uniform(-5, 5), 2),
        lambda: rng.uniform(-0.05, 0.05),
        lambda: float(rng.randint(-50, 50)),
        lambda: rng.uniform(1, 10) * 10.0 ** rng.randint(-3, 20),
        lambda: 1e15 + rng.randint(-3, 3) * 0.125,
        lambda: 5e13 + rng.randint(-4, 4) * 2**-7,
        lambda: 1.1e10 + rng.randint(-9, 9) * 0.004,
        lambda: rng.choice([float("inf"), float("-inf"), 0.0, -0.0, 1e300]),
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def brute(answer, context, tol):
    return [v for v in answer if not any(abs(c - v) <= tol for c in context)]


def test_sorted_sweep_equals_all_pairs(spark):
    rng = random.Random(7)
    cases = [(i, _values(rng, rng.randint(0, 60)), _values(rng, rng.randint(0, 60))) for i in range(150)]
    df = spark.createDataFrame(cases, "id int, a array<double>, c array<double>")
    got = dict(df.select("id", unmatched_values(F.col("a"), F.col("c"))).collect())
    for i, a, c in cases:
        assert got[i] == brute(a, c, 0.01)


def test_nulls_match_nothing(spark):
    cases = [
        ([5.0, 7.0], [None, 7.0], [5.0]),
        ([None, 7.0], [7.0], [None]),
        ([None, 7.0], [None], [None, 7.0]),
        ([7.0], None, [7.0]),
        ([], None, []),
    ]
    df = spark.createDataFrame([(a, c) for a, c, _ in cases], "a array<double>, c array<double>")
    got = [r[0] for r in df.select(unmatched_values(F.col("a"), F.col("c"))).collect()]
    assert got == [want for _, _, want in cases]
    found = [r[0] for r in df.select(verify_numeric(F.lit(7.0), F.col("c"))).collect()]
    assert found == [True, True, False, False, False]


@pytest.mark.parametrize("tol", [0.01, 0.5, 0.0, 1e-6, -1.0])
def test_band_joins_equal_brute_force(spark, tol):
    rng = random.Random(11)
    near = lambda vs: [v + rng.choice([0, 0.005, -0.01, 0.01, 0.02, 1e-6]) for v in vs]
    # One key holds a third of all rows, on both sides; one value repeats a lot.
    keys = [rng.choice([1, rng.randint(2, 9), rng.randint(2, 9)]) for _ in range(400)]
    context = list(zip(keys, _values(rng, 400), strict=True))
    base = [v for _, v in context]
    answer = [
        (i, rng.choice([1, rng.randint(1, 12)]), v)
        for i, v in enumerate(_values(rng, 100) + near(rng.sample(base, 150)) + [0.004] * 150)
    ] + [(900, None, 1.0), (901, 1, None)]
    a = spark.createDataFrame(answer, "id int, k int, value double")
    c = spark.createDataFrame(context + [(None, 1.0), (1, None)], "k int, value double")
    bad = set()
    for i, k, v in answer:
        mine = [x for kk, x in context if kk == k and k is not None]
        if v is None or brute([v], mine, tol):
            bad.add(i)
    got_bad = [r.id for r in unmatched_numerics(a, c, "k", tol).collect()]
    got_good = [r.id for r in grounded_numbers(a, c, "k", tol).collect()]
    assert sorted(got_bad) == sorted(bad)
    assert sorted(got_good) == sorted({i for i, _, _ in answer} - bad)
    lonely = [i for i, _, v in answer if v is None or brute([v], base + [1.0], tol)]
    got = unmatched_against_facts(a, c, tol).collect()
    assert sorted(r.id for r in got) == sorted(lonely)
    # the filter before the shuffle changes nothing, whatever its size
    wide = c.withColumn("k", F.col("k").cast("long"))
    for bits, contexts in ((15, c), (24, c), (24, wide)):
        got = grounded_numbers(a, contexts, "k", tol, prune_bits=bits).collect()
        assert sorted(r.id for r in got) == sorted(got_good)
    for bits in (15, 24, None):
        got = grounded_against_facts(a, c, tol, prune_bits=bits).collect()
        assert sorted(r.id for r in got) == sorted({i for i, _, _ in answer} - set(lonely))


def test_filter_of_facts(spark):
    facts = spark.range(2000).select(F.col("id").cast("double").alias("_exact"), (F.col("id") * 7).alias("_bucket"))
    rows = spark.range(40_000).select("id", (F.col("id") % 20_000).alias("_bucket"), F.lit(1.0).alias("other"))
    left = rows.withColumn("_exact", (F.col("id") % 2000).cast("double"))
    on = ["_bucket", "_exact"]
    partners = {r.id for r in left.join(facts, on, "left_semi").collect()}
    for bits, most in ((15, 0.1), (24, 0.001)):
        possible = _possible(left, facts, on, bits)
        assert possible.columns == left.columns
        got = [r.id for r in possible.collect()]
        assert partners <= set(got) and len(got) == len(set(got)) <= len(partners) + most * 40_000
    zeros = spark.createDataFrame([(0, -0.0)], "_bucket long, _exact double")
    assert _possible(zeros, zeros.select("_bucket", F.lit(0.0).alias("_exact")), on, 15).count() == 1
    assert _possible(left, facts.limit(0), on, 15).count() == 0
    full = spark.range(600_000).select((F.col("id") * 7).alias("_bucket"), F.lit(0.0).alias("_exact"))
    assert _possible(left, full, on, 15).count() == 40_000
    for bits in (14, 31):
        with pytest.raises(ValueError):
            _possible(left, facts, on, bits)
    pruned = grounded_against_facts(rows.withColumnRenamed("other", "value"), rows.select(F.col("other").alias("value")))
    assert "Python" not in pruned._jdf.queryExecution().executedPlan().toString()


def test_tables_equal_rows(spark):
    df = spark.createDataFrame(
        [(i, a, c) for i, (a, c, _) in enumerate(PAIRS)], "id int, answer string, context string"
    )
    numbers = extract_numerics(df, "answer", ["id"])
    contexts = extract_numerics(df, "context", ["id"])
    bad = unmatched_numerics(numbers, contexts, "id").orderBy("id", "ord").collect()
    want = [(i, v) for i, (_, _, u) in enumerate(PAIRS) for v in u]
    assert [(r.id, r.value) for r in bad] == want
    flags = dict(answers_grounded(df, numbers, contexts, "id", "id").collect())
    assert flags == {i: not u for i, (_, _, u) in enumerate(PAIRS)}


def test_tolerance_must_be_finite(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, value double")
    with pytest.raises(ValueError):
        grounded_numbers(df, df, "k", float("inf"))
