"""Numeric grounding of one row's answer in the same row's context."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions.arrays import built_once, empty, following_min, let, running_max
from factsieve.functions.numbers import format_number_text, numeric_values

# Fixed value: absolute tolerance, inclusive.
DEFAULT_TOLERANCE = 0.01
# Up to so many pairs comparing each beats sorting; the result is the same.
_FEW_PAIRS = 1024


def within(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= F.lit(float(tol))


def verify_numeric(value: Column, context: Column, tol: float = DEFAULT_TOLERANCE) -> Column:
    """True if ``value`` occurs in the array ``context`` within the tolerance; NULLs match nothing."""
    return F.coalesce(
        F.exists(context, lambda c: F.coalesce(within(c, value, tol), F.lit(False))), F.lit(False)
    )


def unmatched_values(answer: Column, context: Column, tol: float = DEFAULT_TOLERANCE) -> Column:
    """Values of the array ``answer`` with no partner in the array ``context``.

    Order and duplicates are kept. A NULL matches nothing on either side: it is unmatched
    in the answer and overlooked in the context, and a NULL context is an empty one.
    ``context`` is not evaluated when the answer holds no number, and once at most.
    """
    def against(a: Column, c: Column) -> Column:
        each = F.filter(a, lambda v: ~verify_numeric(v, c, tol))
        return F.when(F.size(a) * F.size(c) <= _FEW_PAIRS, each).otherwise(_unmatched_by_sorting(a, c, tol))

    return let(
        answer,
        lambda a: F.when(F.size(a) == 0, empty("double")).otherwise(
            let(F.coalesce(context, empty("double")), lambda c: against(a, c))
        ),
    )


def _unmatched_by_sorting(answer: Column, context: Column, tol: float) -> Column:
    """The nearest context values on both sides decide; found by one sort and two scans.

    NULLs sort first and are passed over by the scans.
    """
    tagged = F.concat(
        F.transform(context, lambda c: F.struct(c.alias("v"), F.lit(-1).alias("i"))),
        F.transform(answer, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
    )

    def lonely(line: Column) -> Column:
        of_context = F.transform(line, lambda p: F.when(p["i"] < 0, p["v"]))
        nearest = F.arrays_zip(
            line.alias("p"), running_max(of_context).alias("lo"), following_min(of_context).alias("hi")
        )
        far = F.filter(
            nearest,
            lambda n: (n["p"]["i"] >= 0)
            & ~F.coalesce(within(n["lo"], n["p"]["v"], tol), F.lit(False))
            & ~F.coalesce(within(n["hi"], n["p"]["v"], tol), F.lit(False)),
        )
        in_order = F.array_sort(
            F.transform(far, lambda n: F.struct(n["p"]["i"].alias("i"), n["p"]["v"].alias("v")))
        )
        return F.transform(in_order, lambda s: s["v"])

    return let(F.array_sort(tagged), lonely)


@built_once
def unmatched_numbers(text: Column | str, context: Column | str, tol: float = DEFAULT_TOLERANCE) -> Column:
    """Numbers of ``text`` that do not occur in ``context``, as ``array<double>``."""
    return unmatched_values(numeric_values(text), numeric_values(context), tol)


@built_once
def answer_grounded(text: Column | str, context: Column | str, tol: float = DEFAULT_TOLERANCE) -> Column:
    """True if every number of ``text`` occurs in ``context``; true without numbers."""

    return F.size(unmatched_numbers(text, context, tol)) == 0


def numeric_violations(unmatched: Column) -> Column:
    """``numeric_unmatched:<number>`` of each value."""
    return F.transform(
        unmatched, lambda v: F.concat(F.lit("numeric_unmatched:"), format_number_text(v))
    )
