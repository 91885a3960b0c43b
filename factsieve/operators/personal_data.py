"""Personal data: filter texts, or turn a text table into a span table."""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.personal_data import (
    PII_TYPES,
    contains_pii,
    has_type,
    mask_by_type,
    pii_spans_by_position,
)


def filter_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text holds personal data of any type."""
    return df.where(contains_pii(text_col))


def detect_pii(
    df: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = ("id",),
    types: Iterable[str] | None = None,
) -> DataFrame:
    """One row per match: ``ord``, type, byte and character offsets, raw text and mask.

    ``ord`` numbers the spans of one text in (start, end) order; types may overlap. The boolean
    test runs first, so clean texts never reach the span search.
    """
    if types is None:
        wanted = contains_pii(text_col)
    else:
        types = list(types)
        unknown = set(types) - set(PII_TYPES)
        if unknown:
            raise ValueError(f"unknown types: {sorted(unknown)}")
        wanted = reduce(lambda a, b: a | b, [has_type(text_col, t) for t in types], F.lit(False))
    spans = F.when(wanted, pii_spans_by_position(text_col, types))
    # Masks are made after the spans became rows, where expressions are compiled.
    found = df.select(*id_cols, F.posexplode(spans).alias("ord", "_span"))
    return found.select(*id_cols, "ord", "_span.*").withColumn(
        "masked", mask_by_type(F.col("raw"), F.col("pii_type"))
    )
