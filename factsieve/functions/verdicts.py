"""Rule selection and verdict texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule names, actions and reasons as they appear in verdicts.
PII_RULE = "pii_block"
NUMERIC_RULE = "numeric_verify"
PASS, BLOCK, FLAG = "PASS", "BLOCK", "FLAG"
ACTION_CODES = {PASS: 0, BLOCK: 1, FLAG: 2}
REASON_OK = "ok"
REASON_PII = "pii detected in stream"
REASON_NO_TEXT = "token_ids without text_delta; decode upstream or send text_delta"
NO_TEXT_RULE = "missing_text_delta"


def rule_enabled(rules: Column, name: str) -> Column:
    """An absent or empty list enables every rule, else exactly the listed names.

    Names are trimmed of any Unicode blank and compared case-sensitively.
    """
    listed = F.coalesce(rules, F.array().cast("array<string>"))
    names = F.transform(listed, lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", ""))
    return (F.size(listed) == 0) | F.coalesce(F.array_contains(names, name), F.lit(False))


def stream_action(matched: Column, text_length: Column, has_token_ids: Column) -> Column:
    return (
        F.when(matched > 0, F.lit(BLOCK))
        .when((text_length == 0) & has_token_ids, F.lit(FLAG))
        .otherwise(F.lit(PASS))
    )


def stream_reason(action: Column) -> Column:
    return (
        F.when(action == BLOCK, F.lit(REASON_PII))
        .when(action == FLAG, F.lit(REASON_NO_TEXT))
        .otherwise(F.lit(REASON_OK))
    )


def action_code(action: Column) -> Column:
    chain = F
    for name, code in ACTION_CODES.items():
        chain = chain.when(action == name, F.lit(code))
    return chain
