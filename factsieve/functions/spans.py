"""Find-all with offsets, as a column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions.arrays import empty, let, running_sum
from factsieve.functions.patterns import java

SPAN = "struct<start:int,end:int,start_char:int,end_char:int,raw:string>"

_MARK = "\0"
_LOW = (1 << 32) - 1


def find_all(text: Column, pattern: str) -> Column:
    """All matches, left to right, not overlapping."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    """Gap, match, gap, match, ... gap, from one pass over a text without the mark."""
    return F.split(F.regexp_replace(text, F.lit(java(pattern)), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def lengths(s: Column) -> Column:
    """Bytes and characters in one number, so that one running sum adds up both."""
    return F.shiftleft(F.octet_length(s).cast("bigint"), 32) + F.char_length(s)


def locate(hits: Column, gaps: Column) -> Column:
    """Matches with byte offsets (``start``, ``end``) and character offsets.

    Match i ends after the first i gaps and matches.
    """
    steps = F.transform(hits, lambda hit, i: lengths(F.get(gaps, i)) + lengths(hit))
    return F.transform(F.arrays_zip(hits.alias("hit"), running_sum(steps).alias("to")), lambda f: span_at(f["hit"], f["to"]))


def find_spans(text: Column, pattern: str) -> Column:
    """All matches, left to right, not overlapping, with offsets.

    Spark compiles the pattern of ``split`` anew for each row, that of ``regexp_replace``
    once; so matches are put between marks to split at, which gives matches and gaps in
    one search, unless the text happens to hold the mark.
    """

    def in_turns(pieces: Column) -> Column:
        hits, gaps = F.filter(pieces, lambda _, i: i % 2 == 1), F.filter(pieces, lambda _, i: i % 2 == 0)
        return F.when(F.size(pieces) == 1, empty(SPAN)).otherwise(let(gaps, lambda g: let(hits, lambda h: locate(h, g))))

    def apart(hits: Column) -> Column:
        return let(F.split(text, java(pattern), -1), lambda g: locate(hits, g))

    return F.when(
        F.contains(text, F.lit(_MARK)),
        let(find_all(text, pattern), lambda h: F.when(F.size(h) == 0, empty(SPAN)).otherwise(apart(h))),
    ).otherwise(let(_pieces(text, pattern), in_turns))


def span_at(raw: Column, to: Column) -> Column:
    """The span of ``raw`` that ends at ``to``, a sum of :func:`lengths`."""
    end = F.shiftright(to, 32).cast("int")
    end_char = to.bitwiseAND(F.lit(_LOW)).cast("int")
    return F.struct(
        (end - F.octet_length(raw)).alias("start"),
        end.alias("end"),
        (end_char - F.char_length(raw)).alias("start_char"),
        end_char.alias("end_char"),
        raw.alias("raw"),
    )
