"""Column helpers over arrays that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last(arr: Column) -> Column:
    """The last element, null if there is none."""
    return F.get(arr, F.size(arr) - 1)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


def running_sum(arr: Column, chunk: int = 256) -> Column:
    """Inclusive prefix sums of an array of longs.

    Sums run within chunks first and are then shifted by the sums of the chunks before, as appending to an
    array copies it: the work stays near linear for arrays of many thousands.
    """
    none = F.array().cast("array<bigint>")

    def sums(a: Column) -> Column:
        return F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(last(acc), F.lit(0)) + x)))

    starts = F.when(F.size(arr) > 0, F.sequence(F.lit(1), F.size(arr), F.lit(chunk)))
    chunks = F.transform(starts, lambda s: sums(F.slice(arr, s, F.lit(chunk))))
    shifted = let(chunks, lambda cs: let(
        sums(F.transform(cs, last)),
        lambda before: F.flatten(F.transform(cs, lambda c, i: F.transform(
            c, lambda x: x + F.coalesce(F.get(before, i - 1), F.lit(0)))))))
    return F.coalesce(shifted, none)
