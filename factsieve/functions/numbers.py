"""Numbers in a text column: lexemes, values and spans."""

import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions import patterns
from factsieve.functions.arrays import built_once, empty, let
from factsieve.functions.patterns import java
from factsieve.functions.spans import SPAN, find_all, find_spans


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def normalize_digits(core: Column) -> Column:
    """Rewrite a bare number so that ``.`` is its only separator.

    With both separators the last one is the decimal mark. One kind only:
    groups of three are thousands (for dots only from two groups on), a single
    comma otherwise is the decimal mark.
    """
    no_commas = F.replace(core, F.lit(","), F.lit(""))
    no_dots = F.replace(core, F.lit("."), F.lit(""))
    has_comma, has_dot = F.contains(core, F.lit(",")), F.contains(core, F.lit("."))
    one_comma_decimal = F.replace(core, F.lit(","), F.lit("."))
    return (
        F.when(~has_comma & ~has_dot, core)
        .when(
            has_comma & has_dot,
            F.when(
                core.rlike(r",[^.]*$"), F.replace(no_dots, F.lit(","), F.lit("."))
            ).otherwise(no_commas),
        )
        .when(has_dot, F.when(core.rlike(r"^[^.]*(\.[^.]{3}){2,}$"), no_dots).otherwise(core))
        .when(core.rlike(r"^[^,]*(,[^,]{3})+$"), no_commas)
        .when(core.rlike(r"^[^,]*,[^,]*$"), one_comma_decimal)
        .otherwise(no_commas)
    )


def multiplier_factor(word: Column) -> Column:
    """The factor a multiplier word stands for, 1 for anything else."""
    lowered = F.lower(F.trim(word))
    chain = None
    for factor, beginnings in patterns.MULTIPLIER_FACTORS.items():
        test = lowered.startswith(beginnings[0])
        for b in beginnings[1:]:
            test = test | lowered.startswith(b)
        chain = F.when(test, factor) if chain is None else chain.when(test, factor)
    return chain.otherwise(1.0)


def parse_numeric(lexeme: Column) -> Column:
    """The value of one number lexeme, sign, percent and multiplier word included.

    A percent keeps its face value. NULL if the digits do not parse.
    """
    return parse_core(lexeme, lambda core: let(core, normalize_digits))


def number_core(lexeme: Column) -> Column:
    """Digits and separators of a lexeme."""
    return F.regexp_extract(lexeme, java(patterns.NUMBER_CORE), 0)


def parse_core(lexeme: Column, digits: Callable[[Column], Column]) -> Column:
    """As :func:`parse_numeric`; ``digits`` says how to normalise the bare number."""
    magnitude = digits(number_core(lexeme)).try_cast("double")
    signed = F.when(F.startswith(lexeme, F.lit("-")), -magnitude).otherwise(magnitude)
    word = F.regexp_extract(lexeme, r"\p{L}.*$", 0)
    return (
        F.when(lexeme.rlike(patterns.PLAIN_NUMBER), lexeme.try_cast("double"))
        .when(F.right(lexeme, F.lit(1)).between("0", "9"), signed)
        .otherwise(signed * multiplier_factor(word))
    )


def _parsable(text: Column, found: Column, lexeme: Callable[[Column], Column]) -> Column:
    """Without the lexemes that have a non-ASCII digit: those are no numbers."""
    return F.when(
        text.rlike(java(patterns.OTHER_DIGIT)),
        F.filter(found, lambda f: ~lexeme(f).rlike(java(patterns.OTHER_DIGIT))),
    ).otherwise(found)


@built_once
def numeric_lexemes(col: Column | str) -> Column:
    """All number lexemes of the text, in text order, as ``array<string>``."""
    text = _text(col)
    hits = _parsable(text, find_all(text, patterns.NUMBER_WITH_MULTIPLIER), lambda f: f)
    return F.when(text.rlike(java(patterns.DIGIT)), hits).otherwise(empty("string"))


@built_once
def lexeme_spans(col: Column | str) -> Column:
    """As :func:`numeric_lexemes`, with offsets."""
    text = _text(col)
    spans = _parsable(
        text, find_spans(text, patterns.NUMBER_WITH_MULTIPLIER), lambda f: f["raw"]
    )
    return F.when(text.rlike(java(patterns.DIGIT)), spans).otherwise(empty(SPAN))


# Between lexemes that are written into one string, and for a decimal comma on the way; neither is in a lexeme.
_BAR, _COMMA = "|", "_"


def _plain_numbers(joined: Column) -> Column:
    """The numbers of joined lexemes with ``.`` as their only separator, still joined.

    The same rules as :func:`normalize_digits`, for all lexemes of a text at once: a comma behind
    a dotted group is the decimal mark; dots before a further separator, or behind a dotted
    group, part thousands, and so does a comma before just three digits; any other comma is the
    decimal mark.
    """
    bare = F.regexp_replace(joined, r"[^0-9.,|\-]+\.?|[^0-9.,|\-]+", "")
    marked = F.regexp_replace(bare, r"(?<=\.[0-9]{3}),", _COMMA)
    no_dots = F.regexp_replace(marked, r"\.(?=[0-9]*[._])|(?<=\.[0-9]{3})\.", "")
    no_commas = F.regexp_replace(no_dots, r",(?=[0-9]{3}(?![0-9]))", "")
    return F.translate(no_commas, "," + _COMMA, "..")


def _factors(joined: Column) -> Column:
    """The factor of each of the joined lexemes, NULL without a multiplier word."""
    words = F.regexp_replace(F.lower(joined), r"[^|\p{L}]+", "")
    for factor, beginnings in patterns.MULTIPLIER_FACTORS.items():
        words = F.regexp_replace(words, rf"(?<![^|])(?:{'|'.join(beginnings)})[^|]*", f"{factor:.0f}")
    return F.split(words, r"\|", -1).try_cast("array<double>")


@built_once
def numeric_values(col: Column | str) -> Column:
    """All number values of the text, in text order, as ``array<double>``.

    The lexemes are joined, rewritten together and cast together; lambdas run for
    multiplier words alone.
    """

    def values(joined: Column) -> Column:
        plain = F.split(_plain_numbers(joined), r"\|", -1).try_cast("array<double>")
        multiplied = F.zip_with(plain, _factors(joined), lambda v, f: v * F.coalesce(f, F.lit(1.0)))
        return F.when(joined == "", empty("double")).when(joined.rlike(r"\p{L}"), multiplied).otherwise(plain)

    return let(F.array_join(numeric_lexemes(col), _BAR), values)


@built_once
def numeric_spans(col: Column | str) -> Column:
    """All numbers of the text with value, offsets and raw text, in text order."""
    return F.transform(
        lexeme_spans(col),
        lambda m: F.struct(
            parse_numeric(m["raw"]).alias("value"),
            *[m[f].alias(f) for f in ("start", "end", "start_char", "end_char", "raw")],
        ),
    )


def format_number_text(value: Column) -> Column:
    """Shortest round-trip digits; exponent form below 1e-4 and from 1e6 on.

    No two decimals of up to 15 digits share a (normal) double, so 15 digits are
    tried first with the trailing zeros cut, then 16, then 17. Subnormals have
    fewer digits to go by: there every precision is tried, the lowest first.
    """
    whole = F.when(
        (value == F.floor(value)) & (F.abs(value) < 1e6) & (value != 0.0),
        value.cast("bigint").cast("string"),
    )
    # Six decimals that read back as the number are all it has: fifteen digits tell doubles apart.
    short = F.when(
        F.abs(value).between(1e-4, 999999.0),
        let(
            F.rtrim(F.abs(value).cast("decimal(18,6)").cast("string"), F.lit("0")),
            lambda s: F.when(s.cast("double") == F.abs(value), F.concat(F.when(value < 0, "-").otherwise(""), s)),
        ),
    )
    special = (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("+Inf"))
        .when(value == float("-inf"), F.lit("-Inf"))
        .when(value == 0.0, F.when(value.cast("string") == "-0.0", F.lit("-0")).otherwise(F.lit("0")))
    )
    e15, e16, e17 = (F.format_string(f"%.{p}e", F.abs(value)) for p in (14, 15, 16))
    every_precision = F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda p: F.call_function(
            "format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("e")), F.abs(value)
        ),
    )
    subnormal = F.get(
        F.filter(every_precision, lambda s: s.try_cast("double") == F.abs(value)), F.lit(0)
    )
    scientific = (
        F.when(F.abs(value) < sys.float_info.min, subnormal)
        .when(e15.try_cast("double") == F.abs(value), e15)
        .when(e16.try_cast("double") == F.abs(value), e16)
        .otherwise(e17)
    )
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    laid_out = let(scientific, lambda s: F.concat(sign, _lay_out(s)))
    return F.coalesce(special, whole, short, laid_out)


def _lay_out(scientific: Column) -> Column:
    """``d.ddde+XX`` without trailing zeros, or as plain decimal text."""
    digits = F.rtrim(
        F.replace(F.substring_index(scientific, "e", 1), F.lit("."), F.lit("")), F.lit("0")
    )
    exponent = F.substring_index(scientific, "e", -1)
    power = exponent.cast("int")
    head, rest = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.char_length(digits))
    exponential = F.concat(
        head, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.lit("e"), exponent
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    before = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    after = F.substring(digits, power + 2, F.char_length(digits))
    plain = F.when(after != "", F.concat(before, F.lit("."), after)).otherwise(before)
    return (
        F.when((power < -4) | (power >= 6), exponential).when(power < 0, small).otherwise(plain)
    )
