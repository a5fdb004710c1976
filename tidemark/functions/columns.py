"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where the denominator is zero or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num: Column | str, den: Column | str) -> Column:
    return ratio(num, den) * 100


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def ladder(steps: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """Label of the first condition that holds."""
    first, label = steps[0]
    out = reduce(lambda acc, s: acc.when(s[0], s[1]), steps[1:], F.when(first, label))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def means(cols: list[str], suffix: str = "") -> list[Column]:
    return [F.avg(c).alias(c + suffix) for c in cols]


def day_name(c: Column | str = "date") -> Column:
    return F.date_format(c, "EEEE")


def month_name(c: Column | str = "date") -> Column:
    return F.date_format(c, "MMMM")
