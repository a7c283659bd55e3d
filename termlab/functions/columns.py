"""Small column helpers.  Division never fails and never stores NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from termlab.schema import DAY


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is 0."""
    return F.try_divide(num, den)


#: Binary digits that values are compared on, about twelve decimal ones.
STEADY_BITS = 40


def steady(expr: str) -> str:
    """SQL for a DOUBLE rounded to :data:`STEADY_BITS` significant binary digits.

    Values that are equal but for rounding in the last bits become equal, so what is decided by comparing them
    does not hang on the order of additions.  Scaling by a power of two is exact; only ``floor`` rounds.
    Values beyond 1e-280 to 1e280 in size, and NaN, stay as they are.
    """
    grid = f"pow(2D, floor(log2(abs({expr}))) - {STEADY_BITS - 1})"
    return f"if(abs({expr}) > 1e-280D AND abs({expr}) < 1e280D, floor({expr} / {grid} + 0.5D) * {grid}, {expr})"


def log_ratio(num: Column, den: Column) -> Column:
    """``ln(num / den)``, NULL unless both are positive."""
    return F.when((num > 0) & (den > 0), F.ln(ratio(num, den)))


def dot(left: Sequence[str], right: Sequence[str]) -> Column:
    """Sum of the products of two lists of columns."""
    return F.expr(" + ".join(f"{a} * {b}" for a, b in zip(left, right, strict=True)))


def sharpe(mean: Column, std: Column, periods: int) -> Column:
    return ratio(mean, std) * F.sqrt(F.lit(float(periods)))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows where ``condition`` holds (NULL counts as no value)."""
    return F.avg(condition.cast("double"))


def by_day(keys: Sequence[str]) -> WindowSpec:
    """Day order within one curve; see :mod:`termlab.schema` for its size bound."""
    return Window.partitionBy(*keys).orderBy(DAY)


def whole(keys: Sequence[str]) -> WindowSpec:
    """All day rows of one curve."""
    return Window.partitionBy(*keys)


def running(keys: Sequence[str]) -> WindowSpec:
    return by_day(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def change(column: Column, keys: Sequence[str]) -> Column:
    """Difference to the previous day row."""
    return column - F.lag(column).over(by_day(keys))


def rolling_std(column: Column, keys: Sequence[str], first: int, last: int, minimum: int) -> Column:
    """Sample deviation over day rows ``first..last`` relative to the current one.

    NULL unless the frame holds at least ``minimum`` values.
    """
    frame = by_day(keys).rowsBetween(first, last)
    return F.when(F.count(column).over(frame) >= minimum, F.stddev_samp(column).over(frame))
