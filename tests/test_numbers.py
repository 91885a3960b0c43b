import math
import random

import pytest
from pyspark.sql import functions as F

from factsieve import extract_numerics
from factsieve.functions.numbers import (
    format_number_text,
    multiplier_factor,
    normalize_digits,
    numeric_lexemes,
    numeric_values,
    parse_numeric,
)

VALUES = [
    ("Выручка составила 14,000,000 рублей", [14000000.0]),
    ("Ставка НДС 20%", [20.0]),
    ("Курс 92.5 ₽/$", [92.5]),
    ("±0.01", [0.01]),
    ("Выручка 14 млн", [14000000.0]),
    ("Growth 748.5 cm and 31.8%", [748.5, 31.8]),
    ("2024-07-27", [2024.0, -7.0, -27.0]),
    ("1,234.567 x 1.234,567", [1234.567, 1234.567]),
    ("1.234", [1.234]),
    ("14.000.000", [14000000.0]),
    ("92,5", [92.5]),
    ("0,123", [123.0]),
    ("12345,678", [12345678.0]),
    ("1,2345", [1234.0, 5.0]),
    ("192.168.1.1", [192.168, 1.1]),
    ("233.233.171.252", [233233171252.0]),
    ("14 millions", [14.0]),
    ("14 миллионами", [14.0]),
    ("14 million.", [14e6]),
    ("14 million", [14e6]),
    ("5 тыс. руб", [5000.0]),
    ("5 тысяч", [5000.0]),
    ("5 тыс.руб", [5000.0]),
    ("14 МЛН", [14000000.0]),
    ("2.5 Billion and 3 миллиарда", [2.5e9, 3e9]),
    ("20% million", [20e6]),
    ("+5 -3 ±2", [5.0, -3.0, 2.0]),
    ("14000.123", [14000.123]),
    ("1٢", []),
    ("1,٢٣٤", []),
    ("", []),
    (None, []),
    ("none", []),
    ("9" * 400, [math.inf]),
]


def test_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VALUES)], "id int, text string")
    got = {r.id: r.v for r in df.select("id", numeric_values("text").alias("v")).collect()}
    for i, (text, want) in enumerate(VALUES):
        assert got[i] == want, text


def test_spans_and_raw(spark):
    texts = [
        "5 тыс. руб и 5 тысяч",
        "é 1,234 млн ☃ 2 % x😀7",
        "1٢ then 3",
        "plain",
        None,
        " ".join(str(i) for i in range(500)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = extract_numerics(df).orderBy("id", "ord").collect()
    for r in rows:
        text = texts[r.id]
        assert text[r.start_char : r.end_char] == r.raw
        assert text.encode()[r.start : r.end].decode() == r.raw
    raws = {}
    for r in rows:
        raws.setdefault(r.id, []).append(r.raw)
    assert raws[0] == ["5 тыс", "5 тысяч"]
    assert raws[1] == ["1,234 млн", "2 %", "7"]
    assert raws[2] == ["3"]
    assert raws[5] == [str(i) for i in range(500)]
    assert set(raws) == {0, 1, 2, 5}
    short = extract_numerics(df, offsets=False).orderBy("id", "ord").collect()
    assert [(r.id, r.ord, r.value) for r in short] == [(r.id, r.ord, r.value) for r in rows]


def test_scalar_parts(spark):
    cases = {
        "1.234,56": "1234.56",
        "1,234.56": "1234.56",
        "14,000,000": "14000000",
        "92,5": "92.5",
        "1,23,4": "1234",
        "1.234.567": "1234567",
        "1.234": "1.234",
        "1.23.4": "1.23.4",
        "7": "7",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = dict(df.select("c", normalize_digits(F.col("c"))).collect())
    assert got == cases
    words = {"МЛРД": 1e9, "billion": 1e9, " миллионов": 1e6, "тыс.": 1e3, "Thousand": 1e3, "x": 1.0}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert dict(df.select("w", multiplier_factor(F.col("w"))).collect()) == words
    lex = {"-1,5%": -1.5, "+ 3": 3.0, "±4 млн": 4e6, "x": None, "-0": 0.0}
    df = spark.createDataFrame([(w,) for w in lex], "w string")
    assert dict(df.select("w", parse_numeric(F.col("w"))).collect()) == lex


def shortest(v: float) -> str:
    """The same layout from Python's own shortest digits."""
    if math.isnan(v) or math.isinf(v):
        return {math.inf: "+Inf", -math.inf: "-Inf"}.get(v, "NaN")
    sign = "-" if math.copysign(1, v) < 0 else ""
    if v == 0:
        return sign + "0"
    mantissa, exp = f"{abs(v):.16e}".split("e")
    for p in range(17):
        mantissa, exp = f"{abs(v):.{p}e}".split("e")
        if float(f"{mantissa}e{exp}") == abs(v):
            break
    e = int(exp)
    if e < -4 or e >= 6:
        return f"{sign}{mantissa}e{exp}"
    return sign + f"{abs(v):.{max(len(mantissa.replace('.', '')) - 1 - e, 0)}f}"


@pytest.mark.parametrize("seed", [1])
def test_number_text(spark, seed):
    rng = random.Random(seed)
    values = [72.0, 92.5, 100000.0, 1e6, 1.5e7, 4.785380592391139e15, 0.0, -0.0, 0.0001, 0.00001,
              2e23, 1e23, 5e-324, 1.2e-320, 2.5e-310, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 123456.789,
              999999.5, 0.1, 0.3, 1 / 3, 2 / 3, 1e100, -4567.0]
    values += [rng.uniform(-1e7, 1e7) for _ in range(300)]
    values += [round(rng.uniform(-1e4, 1e4), 2) for _ in range(300)]
    values += [rng.random() * 10 ** rng.randint(-300, 300) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = dict(df.select("i", format_number_text(F.col("v"))).collect())
    assert got[3] == "1e+06" and got[5] == "4.785380592391139e+15" and got[2] == "100000"
    wrong = [(v, got[i], shortest(v)) for i, v in enumerate(values) if got[i] != shortest(v)]
    assert not wrong, wrong[:5]


def test_values_of_joined_lexemes_equal_those_of_single_ones(spark):
    rng = random.Random(17)
    digits = ["1", "12", "123", "1234", "000", "5"]
    parts = [*digits, *digits, ",", ".", ",", ".", "-", "+", "±", "%", " %", " ", " млн", "тыс.", " Thousand", " billion", "x", "|", "_", "٢", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    single = F.transform(numeric_lexemes("text"), parse_numeric)
    for r in rows.select("text", numeric_values("text").alias("got"), single.alias("want")).collect():
        assert list(map(repr, r["got"])) == list(map(repr, r["want"])), r["text"]


def test_spans_of_texts_with_the_mark(spark):
    texts = ["a 1 b 22", "a 1\0 b 22", "\0", "3\0", "no number", "é 1,5 日 7\0 8"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in extract_numerics(rows).join(rows, "id").collect():
        assert r["text"][r["start_char"] : r["end_char"]] == r["raw"]
        assert r["text"].encode()[r["start"] : r["end"]].decode() == r["raw"]
    counts = {r["id"]: r["count"] for r in extract_numerics(rows).groupBy("id").count().collect()}
    assert counts == {0: 2, 1: 2, 3: 1, 5: 3}


def test_short_number_texts(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(-1e6, 1e6), rng.randint(0, 9)) for _ in range(3000)]
    values += [rng.uniform(1e-4, 1.0) for _ in range(500)] + [999999.5, 1e6, 0.0001, 123456.789012, 999998.999999, 0.1 + 0.2]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", format_number_text(F.col("v")).alias("s")).collect():
        if 1e-4 <= abs(r["v"]) < 1e6:
            assert r["s"] == repr(r["v"]).removesuffix(".0"), r["v"]
        assert float(r["s"]) == r["v"]
