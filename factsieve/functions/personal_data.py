"""Personal data in a text column: tests, spans, masks and violation strings."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions import patterns
from factsieve.functions.arrays import built_once, empty
from factsieve.functions.emails import any_email, email_spans, emails
from factsieve.functions.patterns import java
from factsieve.functions.spans import find_all, find_spans

PII_TYPES = tuple(patterns.PII_PATTERNS)
PII_SPAN = (
    "struct<pii_type:string,start:int,end:int,start_char:int,end_char:int,raw:string>"
)


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _may_have(text: Column, pii_type: str) -> Column:
    """Cheap exact gate: an email needs ``@``, every other type a digit."""
    if pii_type == "email":
        return F.contains(text, F.lit("@"))
    return text.rlike(java(patterns.DIGIT))


def has_type(col: Column | str, pii_type: str) -> Column:
    text = _text(col)
    if pii_type == "email":
        return any_email(text)
    return _may_have(text, pii_type) & text.rlike(java(patterns.PII_PATTERNS[pii_type]))


def _found(text: Column, pii_type: str) -> Column:
    """The matches of one type, left to right."""
    return emails(text) if pii_type == "email" else find_all(text, patterns.PII_PATTERNS[pii_type])


def has_email(col: Column | str) -> Column:
    return has_type(col, "email")


def has_phone(col: Column | str) -> Column:
    return has_type(col, "phone")


def has_ssn(col: Column | str) -> Column:
    return has_type(col, "ssn")


def has_credit_card(col: Column | str) -> Column:
    return has_type(col, "credit_card")


@built_once
def contains_pii(col: Column | str) -> Column:
    """True if any type occurs. The three digit types share one pass over the text."""
    text = _text(col)
    digits = _may_have(text, "phone") & text.rlike(java(patterns.DIGIT_PII))
    return has_email(text) | digits


def digits_only(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def mask(raw: Column, pii_type: str) -> Column:
    """The redacted form of one match."""
    if pii_type == "email":
        at = F.instr(raw, F.lit("@"))
        domain = F.substring(raw, at + 1, F.char_length(raw))
        return F.when(at > 0, F.concat(F.substring(raw, 1, 1), F.lit("***@"), domain)).otherwise(
            F.lit("***")
        )
    digits = digits_only(raw)
    # Mask texts, with and without the last four digits.
    shown, hidden = {
        "phone": ("***-***-", "***"),
        "ssn": ("***-**-", "***-**-****"),
        "credit_card": ("**** **** **** ", "**** **** **** ****"),
    }[pii_type]
    return F.when(
        F.char_length(digits) >= 4, F.concat(F.lit(shown), F.right(digits, F.lit(4)))
    ).otherwise(F.lit(hidden))


def mask_by_type(raw: Column, pii_type: Column) -> Column:
    """As :func:`mask`, with the type taken from a column."""
    chain = F
    for t in PII_TYPES:
        chain = chain.when(pii_type == t, mask(raw, t))
    return chain


def _wanted(types: Iterable[str] | None) -> list[str]:
    return [t for t in PII_TYPES if types is None or t in set(types)]


def _each_type(
    text: Column,
    element: Callable[[Column, str], Column],
    ddl: str,
) -> Column:
    """Findings of every type, in type order; a type whose gate fails costs nothing."""

    def of_type(t: str) -> Column:
        found = F.transform(_found(text, t), lambda m: element(m, t))
        return F.when(_may_have(text, t), found).otherwise(empty(ddl))

    return F.concat(*[of_type(t) for t in PII_TYPES])


@built_once
def pii_spans(col: Column | str, types: Iterable[str] | None = None) -> Column:
    """Every match of every type with its offsets, in type order, nothing deduplicated."""
    text = _text(col)
    wanted = _wanted(types)
    if not wanted:
        return empty(PII_SPAN)

    def found(t: str) -> Column:
        spans = email_spans(text) if t == "email" else find_spans(text, patterns.PII_PATTERNS[t])
        located = F.transform(
            spans,
            lambda m: F.struct(
                F.lit(t).alias("pii_type"),
                *[m[c].alias(c) for c in ("start", "end", "start_char", "end_char", "raw")],
            ),
        )
        return F.when(_may_have(text, t), located).otherwise(empty(PII_SPAN))

    return F.concat(*[found(t) for t in wanted])


@built_once
def pii_spans_by_position(col: Column | str, types: Iterable[str] | None = None) -> Column:
    """As :func:`pii_spans`, sorted by (start, end); ties keep the type order."""
    keyed = F.transform(
        pii_spans(col, types),
        lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


@built_once
def matched_types(col: Column | str) -> Column:
    """The type name of each match, duplicates kept, in type order."""
    return _each_type(_text(col), lambda m, t: F.lit(t), "string")


@built_once
def pii_violations(col: Column | str) -> Column:
    """``pii:<type>:<masked>`` of each match, in type order."""
    return _each_type(
        _text(col),
        lambda raw, t: F.concat(F.lit(f"pii:{t}:"), mask(raw, t)),
        "string",
    )


def count_type(text: Column, pii_type: str) -> Column:
    """How many matches of one type the text holds."""
    return F.when(
        _may_have(text, pii_type), F.size(_found(text, pii_type))
    ).otherwise(F.lit(0))
