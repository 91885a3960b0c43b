"""One registered query per operator, over whole tables, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm import (
    alignment,
    embedding_dedup,
    graph_search,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    ppm,
    quality,
    token_counts,
    token_output,
)
from factsieve.llm.store import Scratch, docs_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = docs_of(spark, folder).select("doc_id", "text")
    model = quality.fit(docs, docs_of(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(docs_of(spark, folder))


def op3_differencing_pack(spark: SparkSession, folder: str) -> DataFrame:
    # alone on its executors, a worker may know more pieces than in the pipeline
    return packing.pack(docs_of(spark, folder), kept=token_output.KEPT)


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(docs_of(spark, folder))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs_of(spark, folder).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_pivot_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.embedding_components(docs_of(spark, folder, "embeddings"))


def op7_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = docs_of(spark, folder, "embeddings")
    index = graph_search.build_index(vectors)
    return graph_search.search_index(index, vectors.where("vec_id % 20 = 0"))


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(docs_of(spark, folder))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op9_patched_ids(spark: SparkSession, folder: str) -> DataFrame:
    where = Scratch(spark, "token-ids").path("ids")
    files = token_output.write_tokens(docs_of(spark, folder), where)
    return token_output.read_tokens(spark, files, where)


def op10_ppm_score(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score(docs_of(spark, folder))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(docs_of(spark, folder))


def op12_fragment_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(docs_of(spark, folder))[0]


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents the words repeat with a period from some place on.

    The tenth, the place and the period follow from the CRC-32 of the id as text; a row
    without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size("words").cast("long")
    a = F.col("g") % n
    rest = n - a
    p = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    period = F.slice("words", (a + 1).cast("int"), p)
    cycled = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / p).cast("int"))), F.lit(1), rest.cast("int"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), cycled), " ")
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(docs_of(spark, folder)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(line) > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    # runs come by start and period, so the first of equals stays
    better = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    return found.select("doc_id", "runs", "text", better.alias("best"), listed.alias("listed")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start"),
        F.col("best.length"),
        F.col("best.period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("listed"), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality_votes,
        op2_ngram_jaccard,
        op3_differencing_pack,
        op4_license_scan,
        op5_line_dedup,
        op6_pivot_near_copies,
        op7_graph_neighbours,
        op8_source_mix,
        op9_patched_ids,
        op10_ppm_score,
        op11_token_counts,
        op12_fragment_alignment,
        op13_periodic_runs,
    )
}
