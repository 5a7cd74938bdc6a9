"""Array expressions that name a value once and fold it in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # a lambda: transform() counts parameters


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each of `values` the fold of all up to it, itself included.

    `step` must be associative: folds run within blocks of RUN, and over the blocks' folds, so that n values take about RUN * n steps.
    """
    fold = lambda x: F.aggregate(x, zero, step)

    def laid(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, F.lit(RUN)))
        return let(blocks, lambda parts: let(F.transform(parts, fold), lambda sums: F.flatten(F.transform(parts, lambda x, k: inside(x, fold(F.slice(sums, F.lit(1), k)))))))

    def inside(x: Column, before: Column) -> Column:
        return let(before, lambda base: F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i + 1), base, step)))

    return let(values, lambda all_: F.when(F.size(all_) > 0, laid(all_)).otherwise(all_))
