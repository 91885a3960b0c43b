"""Schemas of the tables and streams the jobs read and write."""

REQUESTS = (
    "request_id bigint, text string, context string, tenant_id string, rules array<string>"
)
TEXT_VERDICTS = (
    "request_id bigint, passed boolean, violations array<string>, unmatched array<double>"
)
TOKEN_BATCHES = (
    "session_id string, seq bigint, token_ids array<bigint>, text_delta string, tenant_id string"
)
STREAM_VERDICTS = (
    "session_id string, seq bigint, action string, reason string, matched_rules array<string>"
)
TOKENS = "session_id string, seq bigint, token_id bigint, position bigint, is_reset boolean"
