"""Verdicts on finished answers."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.arrays import empty
from factsieve.functions.grounding import (
    DEFAULT_TOLERANCE,
    numeric_violations,
    unmatched_numbers,
)
from factsieve.functions.personal_data import contains_pii, pii_violations
from factsieve.functions.verdicts import NUMERIC_RULE, PII_RULE, rule_enabled


def verify_text(
    df: DataFrame,
    text: str = "text",
    context: str = "context",
    rules: str = "rules",
    id_cols: Sequence[str] = ("request_id",),
    tol: float = DEFAULT_TOLERANCE,
) -> DataFrame:
    """One verdict per row: ``passed``, ``violations`` and the ``unmatched`` numbers.

    Violations list personal data in type order, then unmatched numbers in text
    order. Everything is decided inside the row: one stage, no shuffle.
    """
    found = df.select(
        *id_cols,
        F.when(
            rule_enabled(F.col(rules), PII_RULE) & contains_pii(text), pii_violations(text)
        )
        .otherwise(empty("string"))
        .alias("_pii"),
        F.when(rule_enabled(F.col(rules), NUMERIC_RULE), unmatched_numbers(text, context, tol))
        .otherwise(empty("double"))
        .alias("unmatched"),
    )
    return found.select(
        *id_cols,
        ((F.size("_pii") == 0) & (F.size("unmatched") == 0)).alias("passed"),
        F.concat("_pii", numeric_violations(F.col("unmatched"))).alias("violations"),
        "unmatched",
    )
