"""The registered queries: each reads whole tables and returns a flat DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.functions import numbers as num
from factsieve.functions import personal_data as pii
from factsieve.functions.grounding import answer_grounded, unmatched_numbers, verify_numeric
from factsieve.functions.verdicts import action_code
from factsieve.operators.deltas import accumulate_text, text_digests, verify_deltas
from factsieve.operators.grounding import (
    answers_grounded,
    grounded_against_facts,
    grounded_numbers,
    unmatched_against_facts,
    unmatched_numerics,
)
from factsieve.operators.numbers import extract_numerics
from factsieve.operators.personal_data import detect_pii, filter_pii
from factsieve.operators.tokens import (
    last_n_tokens,
    latest_tokens,
    retain_last,
    token_segments,
    window_length,
)
from factsieve.operators.verdicts import verify_text
from factsieve.plans import inputs
from factsieve.sources.io import (
    read_requests,
    read_token_batches,
    shared_folder,
    write_verdict_stream,
    write_verdicts,
)
from factsieve.streaming.tokens import last_n_stream
from factsieve.streaming.verdicts import verify_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Personal data


@_query
def contains_pii(spark, folder):
    return inputs.documents(spark, folder).select("id", pii.contains_pii("text").alias("has_pii"))


def _flag(name: str, source: Callable, test: Callable) -> None:
    QUERIES[name] = lambda spark, folder: source(spark, folder).select(
        "id", test("text").alias("flag")
    )


_flag("contains_pii_pages", inputs.pages, pii.contains_pii)
_flag("has_email", inputs.documents, pii.has_email)
_flag("has_phone", inputs.documents, pii.has_phone)
_flag("has_credit_card", inputs.documents, pii.has_credit_card)
_flag("has_ssn", inputs.contacts, pii.has_ssn)


@_query
def filter_documents_with_pii(spark, folder):
    return filter_pii(inputs.documents(spark, folder)).select("id", F.char_length("text").alias("chars"))


def _spans(name: str, source: Callable, types: list[str] | None = None) -> None:
    QUERIES[name] = lambda spark, folder: detect_pii(source(spark, folder), types=types)


_spans("detect_pii", inputs.documents)
_spans("detect_pii_pages", inputs.pages)
_spans("detect_pii_contacts", inputs.contacts)
_spans("email_spans", inputs.contacts, ["email"])
_spans("phone_spans", inputs.contacts, ["phone"])
_spans("ssn_spans", inputs.contacts, ["ssn"])
_spans("credit_card_spans", inputs.contacts, ["credit_card"])


@_query
def pii_violations(spark, folder):
    texts = inputs.documents(spark, folder).select("id", "text")
    both = texts.unionByName(inputs.contacts(spark, folder).withColumn("id", -F.col("id") - 1))
    return both.select("id", F.posexplode(pii.pii_violations("text")).alias("ord", "violation"))


@_query
def matched_rules(spark, folder):
    return filter_pii(inputs.documents(spark, folder)).select(
        "id", F.array_join(pii.matched_types("text"), ",").alias("matched_rules")
    )


@_query
def pii_by_type(spark, folder):
    return (
        detect_pii(inputs.documents(spark, folder), id_cols=["id", "source", "lang"])
        .groupBy("source", "lang", "pii_type")
        .agg(F.count("*").alias("matches"), F.sum(F.col("end") - F.col("start")).alias("bytes"))
    )


# Numbers


@_query
def extract_numerics_documents(spark, folder):
    return extract_numerics(inputs.documents(spark, folder))


@_query
def extract_numerics_pages(spark, folder):
    return extract_numerics(inputs.pages(spark, folder))


@_query
def numeric_values(spark, folder):
    return inputs.claims(spark, folder).select(
        "request_id", F.posexplode(num.numeric_values("text")).alias("ord", "value")
    )


@_query
def lexeme_values(spark, folder):
    raw = F.col("raw")
    claims = inputs.claims(spark, folder)
    texts = claims.select("text").union(claims.select("context"))
    return (
        extract_numerics(texts, "text", [])
        .select("raw")
        .groupBy("raw")
        .agg(F.count("*").alias("n"))
        .select(
            "raw",
            "n",
            num.parse_numeric(raw).alias("value"),
            num.normalize_digits(F.regexp_extract(raw, "[0-9.,]+", 0)).alias("digits"),
            num.multiplier_factor(F.regexp_extract(raw, "[A-Za-z]+", 0)).alias("factor"),
        )
    )


# Grounding


def _claim_numbers(spark, folder):
    return extract_numerics(inputs.claims(spark, folder), "text", ["request_id"], offsets=False)


def _evidence_numbers(spark, folder):
    return extract_numerics(inputs.evidence(spark, folder), "text", ["request_id"], offsets=False)


@_query
def grounded_numbers_by_order(spark, folder):
    return grounded_numbers(
        _claim_numbers(spark, folder), _evidence_numbers(spark, folder), "request_id"
    )


@_query
def unmatched_numerics_by_order(spark, folder):
    return unmatched_numerics(
        _claim_numbers(spark, folder), _evidence_numbers(spark, folder), "request_id"
    )


@_query
def answers_grounded_by_order(spark, folder):
    return answers_grounded(
        inputs.claims(spark, folder),
        _claim_numbers(spark, folder),
        _evidence_numbers(spark, folder),
        "request_id",
        "request_id",
    )


@_query
def unmatched_numerics_in_row(spark, folder):
    return inputs.claims(spark, folder).select(
        "request_id", F.posexplode(unmatched_numbers("text", "context")).alias("ord", "value")
    )


@_query
def answer_grounded_in_row(spark, folder):
    return inputs.claims(spark, folder).select(
        "request_id", answer_grounded("text", "context").alias("grounded")
    )


@_query
def verify_total(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias("request_id"), "o_totalprice"
    )
    return orders.join(inputs.claims(spark, folder), "request_id").select(
        "request_id",
        verify_numeric(F.col("o_totalprice"), num.numeric_values("context")).alias("found"),
    )


@_query
def unmatched_against_all_lines(spark, folder):
    facts = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("value")
    )
    return unmatched_against_facts(_claim_numbers(spark, folder), facts)


@_query
def grounded_against_all_lines(spark, folder):
    facts = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_extendedprice").alias("value")
    )
    return grounded_against_facts(_claim_numbers(spark, folder), facts)


@_query
def document_numbers_not_in_pages(spark, folder):
    ids = extract_numerics(inputs.documents(spark, folder), offsets=False)
    facts = extract_numerics(inputs.pages(spark, folder), offsets=False).select("value")
    return unmatched_against_facts(ids, facts)


# Verdicts


def _verdicts(spark, folder, rules: list[str]):
    claims = inputs.claims(spark, folder).withColumn(
        "rules", F.array(*[F.lit(r) for r in rules]).cast("array<string>")
    )
    return verify_text(claims)


def _verdict_columns(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "request_id",
        "passed",
        F.size("violations").alias("n_violations"),
        F.size("unmatched").alias("n_unmatched"),
        F.aggregate("unmatched", F.lit(0.0), lambda a, v: a + v).alias("unmatched_sum"),
        F.array_join(
            F.filter("violations", lambda v: v.startswith("pii:")), ","
        ).alias("pii"),
    )


def _verdict_query(name: str, rules: list[str]) -> None:
    QUERIES[name] = lambda spark, folder: _verdict_columns(_verdicts(spark, folder, rules))


_verdict_query("verify_text", [])
_verdict_query("verify_text_pii_only", [" pii_block "])
_verdict_query("verify_text_numeric_only", ["numeric_verify", "Pii_Block"])
_verdict_query("verify_text_unknown_rule", ["unknown"])


@_query
def verdicts_through_files(spark, folder):
    """Claims stored as requests, read by the reader, verified, stored by the sink and read again."""
    requests, verdicts = (shared_folder(spark, n) for n in ("requests", "stored-verdicts"))
    inputs.claims(spark, folder).select(
        "request_id",
        "text",
        "context",
        F.lit("tenant").alias("tenant_id"),
        F.array().cast("array<string>").alias("rules"),
    ).write.parquet(requests)
    write_verdicts(verify_text(read_requests(spark, requests)), verdicts)
    stored = spark.read.parquet(verdicts)  # a folder's name says passed as text
    return _verdict_columns(stored.withColumn("passed", F.col("passed").cast("boolean")))


@_query
def violations_list(spark, folder):
    return _verdicts(spark, folder, []).select(
        "request_id",
        F.posexplode("violations").alias("ord", "violation"),
    ).select(
        "request_id",
        "ord",
        F.substring_index("violation", ":", 1).alias("kind"),
        F.substring_index("violation", ":", -1).try_cast("double").alias("number"),
    )


@_query
def verify_documents(spark, folder):
    docs = inputs.documents(spark, folder).select(
        F.col("id").alias("request_id"),
        "text",
        F.lit(None).cast("string").alias("context"),
        F.lit(None).cast("array<string>").alias("rules"),
    )
    return verify_text(docs).select(
        "request_id",
        "passed",
        F.size("violations").alias("n_violations"),
        F.size("unmatched").alias("n_unmatched"),
    )


@_query
def verdicts_by_label(spark, folder):
    """Pass rates of labelled documents: a report on top of the verdicts."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(
        F.col("doc_id").alias("request_id"), "quality", "toxic"
    )
    return (
        verify_documents(spark, folder)
        .join(labels, "request_id")
        .groupBy("quality", "toxic")
        .agg(
            F.count("*").alias("documents"),
            F.sum(F.col("passed").cast("int")).alias("passed"),
            F.sum("n_violations").alias("violations"),
        )
    )


# Token windows


def _token_list(cells):
    return F.array_join(F.transform(cells, lambda t: t["token_id"].cast("string")), ",")


@_query
def last_n_tokens_by_user(spark, folder):
    return last_n_tokens(inputs.tokens(spark, folder), 5, capacity=64).select(
        "session_id", "seq", _token_list("last_n").alias("last_n")
    )


@_query
def last_n_tokens_after_clear(spark, folder):
    segments = token_segments(inputs.tokens(spark, folder))
    return last_n_tokens(segments, 100, capacity=4, key=["session_id", "segment"]).select(
        "session_id", "segment", "seq", _token_list("last_n").alias("last_n")
    )


@_query
def retain_last_tokens(spark, folder):
    return retain_last(inputs.tokens(spark, folder), capacity=8).select(
        "session_id", "seq", "token_id", "position"
    )


@_query
def latest_tokens_by_user(spark, folder):
    return latest_tokens(inputs.tokens(spark, folder), 3, capacity=64).select(
        "session_id", _token_list("last_n").alias("last_n")
    )


@_query
def token_segments_by_user(spark, folder):
    return token_segments(inputs.tokens(spark, folder)).select("session_id", "seq", "segment")


@_query
def window_length_by_user(spark, folder):
    return window_length(inputs.tokens(spark, folder), capacity=3, is_reset="is_reset").select(
        "session_id", "seq", "window_len", "is_empty", "capacity"
    )


# Text in pieces


def _deltas(spark, folder):
    return inputs.as_deltas(inputs.documents(spark, folder))


@_query
def accumulated_text(spark, folder):
    return accumulate_text(_deltas(spark, folder)).select(
        "session_id",
        "seq",
        F.char_length("text").cast("bigint").alias("chars"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


@_query
def text_digests_of_documents(spark, folder):
    return text_digests(_deltas(spark, folder))


def _flat_verdicts(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id",
        "seq",
        "action",
        action_code(F.col("action")).alias("action_code"),
        "reason",
        F.array_join("matched_rules", ",").alias("matched_rules"),
    )


@_query
def verify_deltas_of_documents(spark, folder):
    return _flat_verdicts(verify_deltas(_deltas(spark, folder)))


def _run_stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over the files present now; its sink table is the result."""
    sink = shared_folder(spark, name)
    query = write_verdict_stream(df, sink, shared_folder(spark, f"{name}-state"), available_now=True)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(sink)


def _stream_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    # A glob, because a stream source takes folders and patterns, not single files.
    return read_token_batches(spark, f"{folder}/{name}[.]parquet", schema=schema)


# Groups that the sessions of a stream share.
_BUCKETS = 2048


@_query
def verify_stream_of_documents(spark, folder):
    docs = _stream_table(spark, folder, "documents", "doc_id bigint, text string").select(
        F.col("doc_id").alias("id"), "text"
    )
    verdicts = verify_stream(inputs.as_deltas(docs), buckets=_BUCKETS)
    return _flat_verdicts(_run_stream(spark, verdicts, "verdicts"))


@_query
def last_n_stream_of_events(spark, folder):
    events = _stream_table(
        spark, folder, "events", "event_id bigint, user_id bigint, event_type string"
    ).select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("token_id"),
        (F.col("event_id") * 10).alias("position"),
        (F.col("event_type") == "error").alias("is_reset"),
    )
    windows = last_n_stream(events, 100, capacity=4, is_reset="is_reset", buckets=_BUCKETS)
    out = _run_stream(spark, windows, "tokens")
    return out.select("session_id", "seq", _token_list("last_n").alias("last_n"), "window_len")
