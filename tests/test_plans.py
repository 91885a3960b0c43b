"""Plans and splitting at scale: what is shuffled, and what a hot group does."""

import random

from pyspark.sql import functions as F

from factsieve import detect_pii, extract_numerics, unmatched_numerics
from factsieve.plans import inputs
from factsieve.plans.queries import QUERIES
from factsieve.plans.skew import _with_blocks, hot_groups, running_totals, split_hot


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_span_jobs_are_maps(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.com 12", "x")], "id int, text string, other string").write.parquet(
        str(tmp_path / "t")
    )
    df = spark.read.parquet(str(tmp_path / "t"))
    for job in (detect_pii(df), extract_numerics(df)):
        text = plan(job)
        assert "Exchange" not in text and "Python" not in text
        assert "ReadSchema: struct<id:int,text:string>" in text


def test_band_join_is_an_equi_join(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.col("id").cast("double").alias("value"))
    text = plan(unmatched_numerics(df, df, "k"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_identical_rows_of_a_hot_key(spark):
    answers = spark.createDataFrame([(1, 2.0)] * 900 + [(2, 5.0)] * 3, "k int, value double")
    contexts = spark.createDataFrame([(1, 2.005), (2, 9.0)], "k int, value double")
    assert unmatched_numerics(answers, contexts, "k").groupBy("k").count().collect() == [(2, 3)]


def _jobs(spark, build):
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_grounding_plans_run_no_job(spark, sf_dir):
    # every table read from files looks up its schema with one job; nothing else runs
    tables = {"unmatched_numerics_by_order": 3, "grounded_numbers_by_order": 3,
              "answers_grounded_by_order": 4, "unmatched_against_all_lines": 2}
    for name, reads in tables.items():
        assert _jobs(spark, lambda name=name: QUERIES[name](spark, sf_dir)) <= reads, name


def test_no_query_deals_small_tables_out(spark, sf_dir):
    for name, query in QUERIES.items():
        if "stream" not in name:
            assert "REPARTITION_BY_NUM" not in plan(query(spark, sf_dir)), name


def test_equal_order_values_are_split(spark):
    rows = [(1, i % 2, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, a int, x int")
    hot = hot_groups(df, ["k"], 50)
    _, hot_rows = split_hot(df, ["k"], hot)
    sizes = [r["count"] for r in _with_blocks(hot_rows, ["k"], ["a"], 50).groupBy("_block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150
    got = running_totals(df, ["k"], ["a"], {"t": F.lit(1)}, 50, hot).collect()
    assert sorted(r.t for r in got) == list(range(1, 1001))
    assert max(r.t for r in got if r.a == 0) == 500


def test_hot_groups(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)] * 5 + [(None,)] * 20, "k int")
    assert hot_groups(df, ["k"], 100) is None
    assert hot_groups(df, ["k"], None) is None
    assert {(r.k, r._rows) for r in hot_groups(df, ["k"], 10).collect()} == {(1, 30), (None, 20)}


def test_running_totals_in_blocks(spark):
    rng = random.Random(2)
    # Ties in the first order column, and one far outlier.
    rows = [(rng.choice([1, 1, 2, None]), rng.randint(0, 50), i, rng.randint(-5, 5)) for i in range(600)]
    rows.append((1, 10**9, 600, 3))
    df = spark.createDataFrame(rows, "k int, a int, b int, x int")
    want, acc = {}, {}
    for k, a, b, x in sorted(rows, key=lambda r: (r[1], r[2])):
        acc[k] = acc.get(k, 0) + x
        want[k, a, b] = acc[k]
    for limit in (20, 7):
        hot = hot_groups(df, ["k"], limit)
        got = running_totals(df, ["k"], ["a", "b"], {"t": F.col("x")}, limit, hot).collect()
        assert {(r.k, r.a, r.b): r.t for r in got} == want and len(got) == len(rows)


def test_contacts_of_one_row_group_keep_all_tasks_busy(spark, tmp_path):
    keys = spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("c_custkey"))
    keys.union(keys.limit(5)).union(spark.sql("SELECT CAST(NULL AS bigint)")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    contacts = inputs.contacts(spark, str(tmp_path))
    tasks = [r["count"] for r in contacts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3006 and len(tasks) >= 4 and max(tasks) < 2 * 3006 / len(tasks)
    assert [r["count"] for r in contacts.where("id < 5").groupBy("id").count().collect()] == [2] * 5
