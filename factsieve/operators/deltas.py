"""Verdicts on text that arrives in pieces, over a stored table of deltas."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.functions.patterns import UP_TO_LAST_CUT, java
from factsieve.functions.personal_data import PII_TYPES, count_type, matched_types
from factsieve.functions.verdicts import (
    FLAG,
    NO_TEXT_RULE,
    stream_action,
    stream_reason,
)
from factsieve.plans.skew import ROWS_PER_TASK, hot_groups, running_totals


# Digests are sums of code points times powers of a base, modulo a prime; products stay below 2^63.
DIGEST_BASE = 1_000_003
DIGEST_PRIME = 2**31 - 1
_LENGTH_BITS = 48


def _list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _has_token_ids():
    return F.coalesce(F.size("token_ids") > 0, F.lit(False))


def accumulate_text(
    df: DataFrame,
    key: str | Sequence[str] = "session_id",
    seq: str = "seq",
    delta: str = "text_delta",
) -> DataFrame:
    """Add ``text``: all text of the session up to and with each row.

    The result repeats a session's text once per row by definition;
    :func:`verify_deltas` gets its verdicts and :func:`text_digests` its lengths without it.
    """
    so_far = (
        Window.partitionBy(*_list(key))
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn("text", F.array_join(F.collect_list(delta).over(so_far), ""))


def _digest(text):
    """Digest of one piece, as if it began the text."""
    points = F.reverse(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.aggregate(
        points,
        F.lit(0).cast("bigint"),
        lambda h, c: (h * DIGEST_BASE + F.ascii(c)) % DIGEST_PRIME,
    )


def _base_to(power):
    """``DIGEST_BASE ** power`` modulo the prime, by the bits of ``power``."""
    squares = [pow(DIGEST_BASE, 1 << i, DIGEST_PRIME) for i in range(_LENGTH_BITS)]
    steps = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(s).alias("f")) for i, s in enumerate(squares)])
    return F.aggregate(
        F.filter(steps, lambda s: power.bitwiseAND(s["bit"]) != 0),
        F.lit(1).cast("bigint"),
        lambda product, s: product * s["f"] % DIGEST_PRIME,
    )


def text_digests(
    df: DataFrame,
    key: str | Sequence[str] = "session_id",
    seq: str = "seq",
    delta: str = "text_delta",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """``key, seq, chars, digest``: length and digest of the text so far, without the text.

    The digest of a text is the sum of its code points times ``DIGEST_BASE ** place``, modulo
    ``DIGEST_PRIME``, so it does not depend on how the text is cut. A delta adds its own
    length and its own digest moved to its place; both are running totals, and a session
    of any length is split over tasks. A null delta adds nothing. Equal digests do not prove
    equal texts; :func:`accumulate_text` gives the texts themselves. ``seq`` is unique in
    a session.
    """
    keys = _list(key)
    hot = hot_groups(df, keys, rows_per_task)
    text = F.coalesce(F.col(delta), F.lit(""))
    rows = df.select(*keys, seq, F.char_length(text).cast("bigint").alias("_chars"), _digest(text).alias("_own"))
    placed = running_totals(rows, keys, [seq], {"chars": F.col("_chars")}, rows_per_task, hot)
    moved = _base_to(F.col("chars") - F.col("_chars")) * F.col("_own") % DIGEST_PRIME
    summed = running_totals(placed, keys, [seq], {"digest": moved}, rows_per_task, hot)
    return summed.select(*keys, seq, "chars", (F.col("digest") % DIGEST_PRIME).alias("digest"))


def _verdict(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """From ``_matched`` (array), ``_seen`` (text length) and ``_ids`` to the verdict columns."""
    acted = df.withColumn("action", stream_action(F.size("_matched"), F.col("_seen"), F.col("_ids")))
    return acted.select(
        *keys,
        seq,
        "action",
        stream_reason(F.col("action")).alias("reason"),
        F.when(F.col("action") == FLAG, F.array(F.lit(NO_TEXT_RULE)))
        .otherwise(F.col("_matched"))
        .alias("matched_rules"),
    )


def verify_deltas_by_rescan(
    df: DataFrame, key: str | Sequence[str] = "session_id", seq: str = "seq"
) -> DataFrame:
    """One verdict per delta, scanning the whole text so far each time.

    Quadratic in the length of a session; kept as the plain definition of
    :func:`verify_deltas`.
    """
    keys = _list(key)
    return _verdict(
        accumulate_text(df, keys, seq).withColumns(
            {
                "_matched": matched_types("text"),
                "_seen": F.char_length("text"),
                "_ids": _has_token_ids(),
            }
        ),
        keys,
        seq,
    )


def verify_deltas(
    df: DataFrame,
    key: str | Sequence[str] = "session_id",
    seq: str = "seq",
    rows_per_task: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """One verdict per delta on the text so far, scanning each character about once.

    No match goes across a cut (see ``UP_TO_LAST_CUT``), so the text of a session
    falls into stretches between the last cuts of its deltas. Matches up to a cut
    are settled for good and are added up with a running total; only the open
    stretch behind the last cut is looked at again when it grows. One character
    on either side of a cut goes along, as word boundaries look at it.
    """
    keys = _list(key)
    hot = hot_groups(df, keys, rows_per_task)
    rows = df.select(
        *keys,
        seq,
        F.coalesce("text_delta", F.lit("")).alias("_delta"),
        _has_token_ids().alias("_ids"),
    ).withColumn("_cut", F.char_length(F.regexp_extract("_delta", java(UP_TO_LAST_CUT), 1)))
    rows = running_totals(
        rows,
        keys,
        [seq],
        {
            "_stretch": (F.col("_cut") > 0).cast("bigint"),
            "_seen": F.char_length("_delta").cast("bigint"),
        },
        rows_per_task,
        hot,
    )

    def piece(stretch, is_open, text):
        return F.struct(
            stretch.alias("_stretch"), F.lit(is_open).alias("_open"), text.alias("_piece")
        )

    # A delta with a cut closes one stretch and opens the next.
    delta, cut, stretch = F.col("_delta"), F.col("_cut"), F.col("_stretch")
    pieces = F.when(
        cut > 0,
        F.array(
            piece(stretch - 1, 0, F.substring(delta, F.lit(1), cut + 1)),
            piece(stretch, 1, F.substring(delta, cut, F.char_length(delta))),
        ),
    ).otherwise(F.array(piece(stretch, 1, delta)))
    in_stretch = (
        Window.partitionBy(*keys, "_stretch")
        .orderBy(seq, "_open")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = (
        rows.select(*keys, seq, "_ids", "_seen", F.inline(pieces))
        .withColumn("_text", F.array_join(F.collect_list("_piece").over(in_stretch), ""))
        .select(
            *keys,
            seq,
            "_ids",
            "_seen",
            "_open",
            *[count_type(F.col("_text"), t).alias(f"_n_{t}") for t in PII_TYPES],
        )
    )
    settled = running_totals(
        counted,
        keys,
        [seq, "_open"],
        {
            f"_settled_{t}": F.when(F.col("_open") == 0, F.col(f"_n_{t}")).otherwise(0)
            for t in PII_TYPES
        },
        rows_per_task,
        hot,
    ).where("_open = 1")
    matched = F.concat(
        *[
            F.array_repeat(F.lit(t), (F.col(f"_settled_{t}") + F.col(f"_n_{t}")).cast("int"))
            for t in PII_TYPES
        ]
    )
    return _verdict(settled.withColumn("_matched", matched), keys, seq)
