"""Text verification as Spark DataFrame jobs.

Personal-data detection, number extraction, numeric grounding, rule verdicts,
token windows and verified text streams, all over tables of texts.
"""

from factsieve.functions.grounding import DEFAULT_TOLERANCE
from factsieve.operators.deltas import accumulate_text, text_digests, verify_deltas, verify_deltas_by_rescan
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
    DEFAULT_CAPACITY,
    last_n_tokens,
    latest_tokens,
    retain_last,
    token_segments,
    window_length,
)
from factsieve.operators.verdicts import verify_text
from factsieve.sources.io import (
    read_requests,
    read_token_batches,
    write_verdict_stream,
    write_verdicts,
)
from factsieve.streaming.tokens import last_n_stream
from factsieve.streaming.verdicts import verify_stream

__all__ = [
    "DEFAULT_CAPACITY",
    "DEFAULT_TOLERANCE",
    "accumulate_text",
    "answers_grounded",
    "detect_pii",
    "extract_numerics",
    "filter_pii",
    "grounded_against_facts",
    "grounded_numbers",
    "last_n_stream",
    "last_n_tokens",
    "latest_tokens",
    "read_requests",
    "read_token_batches",
    "retain_last",
    "token_segments",
    "unmatched_against_facts",
    "unmatched_numerics",
    "text_digests",
    "verify_deltas",
    "verify_deltas_by_rescan",
    "verify_stream",
    "verify_text",
    "window_length",
    "write_verdict_stream",
    "write_verdicts",
]
