"""Number extraction: text table to number table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions.numbers import (
    lexeme_spans,
    normalize_digits,
    number_core,
    numeric_values,
    parse_core,
)


def extract_numerics(
    df: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = ("id",),
    offsets: bool = True,
) -> DataFrame:
    """One row per number: ``ord`` (place in the text), value, offsets and raw text.

    ``offsets=False`` gives ``ord`` and ``value`` only and reads each text once less.
    """
    if not offsets:
        return df.select(*id_cols, F.posexplode(numeric_values(text_col)).alias("ord", "value"))
    # Lexemes become rows first; from then on expressions are compiled. The bare number is
    # a column of its own, so that its many uses do not repeat the search for it.
    found = df.select(*id_cols, F.posexplode(lexeme_spans(text_col)).alias("ord", "_span"))
    found = found.select(*id_cols, "ord", "_span.*").withColumn("_core", number_core(F.col("raw")))
    value = parse_core(F.col("raw"), lambda core: normalize_digits(F.col("_core")))
    return found.select(*id_cols, "ord", value.alias("value"), "start", "end", "start_char", "end_char", "raw")
