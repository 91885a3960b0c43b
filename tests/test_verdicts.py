from pyspark.sql import functions as F

from factsieve import read_requests, verify_text, write_verdicts
from factsieve.functions.verdicts import action_code, rule_enabled
from factsieve.sources.schemas import REQUESTS

MIXED = "Contact user@example.com for 15 млн"
CASES = [
    ("Revenue was 14 млн per report.", "Annual report lists 14,000,000.", [], []),
    (MIXED, "14,000,000 only", [], ["pii:email:u***@example.com", "numeric_unmatched:1.5e+07"]),
    (MIXED, "14,000,000 only", [" pii_block "], ["pii:email:u***@example.com"]),
    (MIXED, "14,000,000 only", ["numeric_verify"], ["numeric_unmatched:1.5e+07"]),
    (MIXED, "14,000,000 only", ["unknown"], []),
    (MIXED, "14,000,000 only", ["PII_BLOCK"], []),
    ("72%, 72%", None, None, ["numeric_unmatched:72", "numeric_unmatched:72"]),
    (None, None, None, []),
    (
        "+1 (555) 123-4567",
        "",
        [],
        ["pii:phone:***-***-4567"] + [f"numeric_unmatched:{n}" for n in ("1", "555", "123", "-4567")],
    ),
]


def rows(spark):
    return spark.createDataFrame(
        [(i, t, c, "tenant", r) for i, (t, c, r, _) in enumerate(CASES)], REQUESTS
    )


def test_verdicts(spark):
    got = {r.request_id: r for r in verify_text(rows(spark)).collect()}
    for i, (_, _, _, want) in enumerate(CASES):
        assert got[i].violations == want and got[i].passed == (not want)
        assert len(got[i].unmatched) == sum(v.startswith("numeric") for v in want)


def test_one_stage_without_shuffle(spark):
    plan = verify_text(rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_files(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "requests"))
    requests = read_requests(spark, str(tmp_path / "requests"))
    write_verdicts(verify_text(requests), str(tmp_path / "verdicts"))
    back = spark.read.parquet(str(tmp_path / "verdicts"))
    assert back.count() == len(CASES)
    assert back.where(~F.col("passed")).count() == sum(bool(w) for *_, w in CASES)


def test_rules_and_codes(spark):
    df = spark.createDataFrame(
        [([],), (None,), (["\tpii_block\n"],), (["x"],), ([None],)], "rules array<string>"
    )
    got = [r[0] for r in df.select(rule_enabled(F.col("rules"), "pii_block")).collect()]
    assert got == [True, True, True, False, False]
    df = spark.createDataFrame([("PASS",), ("BLOCK",), ("FLAG",)], "action string")
    assert [r[0] for r in df.select(action_code(F.col("action"))).collect()] == [0, 1, 2]
