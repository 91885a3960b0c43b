"""A corpus from raw documents to packed sequences, one stored table per stage."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm import line_dedup, mixing, ngram_join, packing, quality
from factsieve.llm.store import Scratch, docs_of, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Pieces of a generation that a worker knows in packing: what it knows lies beside all other stages.
KEPT_PIECES = 100_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts vote for."""
    model = quality.fit(docs, docs_of(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays in one document; ``n_chars`` follows the new text."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to a stored table of ids ``k_id``."""
    return docs.join(ngram_join.bounded(ids), F.col("doc_id") == F.col("k_id"), how)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay.

    Of rows that repeat that id and its text one stays; other texts of the id stay too.
    """
    scratch = Scratch(spark, "groups")
    found = ngram_join.jaccard_components(docs).where("doc_id is not null")
    found = scratch.table(found.select("doc_id", "component_id"), "found")
    first = F.count(F.when(F.col("doc_id") == F.col("component_id"), True))
    rows = found.groupBy(F.col("doc_id").alias("k_id")).agg(first.alias("n_rows"))
    # the copies are far fewer than the documents that stay
    kept = by_ids(docs, scratch.slim(rows.where("n_rows = 0").select("k_id"), "copies"), "left_anti")
    repeated = scratch.slim(rows.where("n_rows > 1").select("k_id"), "repeated")
    if not repeated.isEmpty():
        once = by_ids(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = by_ids(kept, repeated, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weight, each as often as the mix takes it."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, kept=KEPT_PIECES)


def with_small_batches(stage: Stage) -> Stage:
    """All stages share the executors' workers, so none leaves large buffers to the next."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality", with_small_batches(good_quality)),
    ("line_dedup", with_small_batches(without_repeated_lines)),
    ("ngram_jaccard", with_small_batches(one_of_each_group)),
    ("mixing", with_small_batches(mixed)),
    ("packing", with_small_batches(packed)),
]

# The votes of a fitted model and tokenizer ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
