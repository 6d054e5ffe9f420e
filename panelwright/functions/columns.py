"""Column expressions. All are built-ins, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_or_null(c: Column | str) -> Column:
    """Natural log; NULL for zero and negative values."""
    return F.ln(c)


def round_ln(c: Column | str) -> Column:
    """Natural log rounded to a whole number, halves away from zero."""
    return F.round(ln_or_null(c))


def ratio(num: Column | str, den: Column | str) -> Column:
    """True division that gives NULL on a zero denominator instead of an error."""
    return F.try_divide(num, den)


def band_share(counts: Sequence[str], denominator: Column | str) -> Column:
    """Sum of the shares of several fine bands; NULL when any of them is NULL."""
    return reduce(add, [ratio(c, denominator) for c in counts])


def date_key(c: Column | str) -> Column:
    """Date or timestamp as a ``yyyy-MM-dd`` string."""
    return F.date_format(c, "yyyy-MM-dd")
