"""Small array helpers shared by the column functions."""

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def built_once(f: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column built for given column names; building a large one takes a while."""
    kept: dict = {}

    @wraps(f)
    def build(*args, **kwargs) -> Column:
        if any(isinstance(a, Column) for a in (*args, *kwargs.values())):
            return f(*args, **kwargs)
        key = repr((id(SparkContext._gateway), args, sorted(kwargs.items())))
        if key not in kept:
            kept[key] = f(*args, **kwargs)
        return kept[key]

    return build


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain nested expression is copied into every place that uses it, lambdas
    included; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(ddl: str) -> Column:
    """An empty array of the given element type."""
    return F.array().cast(f"array<{ddl}>")


def _scan(values: Column, combine: Callable[[Column, Column], Column], sign: int) -> Column:
    """Inclusive scan by doubling distances: n log n steps, no growing array."""
    return let(
        values,
        lambda v: F.aggregate(
            F.filter(F.expr("transform(sequence(0, 30), i -> shiftleft(1, i))"), lambda d: d < F.size(v)),
            v,
            lambda acc, d: F.transform(
                acc, lambda x, i: combine(x, F.get(acc, i - d if sign > 0 else i + d))
            ),
        ),
    )


# Up to this size appending to a growing array beats the doubling scan.
_SHORT = 128


def running_sum(values: Column) -> Column:
    """Prefix sums of an array of bigint."""

    def appended(v: Column) -> Column:
        return F.aggregate(
            F.slice(v, F.lit(2), F.size(v)),
            F.slice(v, 1, 1),
            lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x),
        )

    return let(
        values,
        lambda v: F.when(F.size(v) <= _SHORT, appended(v)).otherwise(
            _scan(v, lambda x, y: x + F.coalesce(y, F.lit(0).cast("bigint")), 1)
        ),
    )


def running_max(values: Column) -> Column:
    """Largest value at or before each place; NULLs are passed over."""
    return _scan(values, F.greatest, 1)


def following_min(values: Column) -> Column:
    """Smallest value at or after each place; NULLs are passed over."""
    return _scan(values, F.least, -1)
