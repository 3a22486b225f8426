"""Column expressions shared by the operators.

All are built-in Catalyst expressions (whole-stage codegen, no Python at run
time).  Money and ratios are exact decimals rounded HALF_UP, the rounding of
the source reports; doubles appear only in the final projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c, precision: int = 22, scale: int = 2) -> Column:
    return col(c).cast(T.DecimalType(precision, scale))


def nonzero(c) -> Column:
    """NULL when the value is 0: every division goes through this."""
    return F.nullif(col(c), F.lit(0))


def ratio(num, den, digits: int, scale: int = 2) -> Column:
    """ROUND(num / NULLIF(den, 0), digits) on exact decimals.

    ``scale`` is the number of decimals the operands have; nothing is rounded
    before the division.  The quotient has 16 decimals or more."""
    return F.round(dec(num, 20 + scale, scale) / nonzero(dec(den, 20 + scale, scale)), digits)


def pct(num, den, digits: int = 2, scale: int = 2) -> Column:
    """ROUND(num * 100 / NULLIF(den, 0), digits), as ``ratio``."""
    return F.round(dec(num, 20 + scale, scale) * 100 / nonzero(dec(den, 20 + scale, scale)),
                   digits)


def mean(total, count, src_scale: int = 2, digits: int = 2) -> Column:
    """AVG of a decimal column with ``src_scale`` decimals, from sum and count.

    Like the source engine, the mean is first taken to ``src_scale + 4``
    decimals (the declared scale of AVG) and then rounded to ``digits``.
    """
    # decimal(28, s) / decimal(20, 0) keeps at least s + 10 decimals.
    m = dec(total, 28, src_scale) / nonzero(dec(count, 20, 0))
    return F.round(F.round(m, src_scale + 4), digits)


def avg_money(total, count, digits: int = 2) -> Column:
    """Mean of 2-decimal money from its sum and count (6 decimals, then ``digits``)."""
    return mean(total, count, 2, digits)


def as_double(c) -> Column:
    return col(c).cast("double")


def money_out(c, digits: int = 2) -> Column:
    return F.round(col(c), digits).cast("double")


def month_start(ts) -> Column:
    """First day of the month as a DATE."""
    return F.trunc(F.to_date(col(ts)), "month")


def month_text(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


# Weekday names for dayofweek() 1..7, 1 = Sunday.
WEEKDAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday",
                 "Friday", "Saturday"]


def weekday_name(ts) -> Column:
    return F.date_format(col(ts), "EEEE")


def elapsed_days(start, end, mode: str = "calendar") -> Column:
    """Days from ``start`` to ``end``.

    ``calendar``: difference of calendar dates (time of day ignored).
    ``elapsed``:  whole days in the interval, truncated toward zero.
    """
    if mode == "calendar":
        return F.datediff(col(end), col(start))
    if mode == "elapsed":
        secs = F.timestamp_diff("SECOND", col(start), col(end))
        return (secs / 86400).cast("long").cast("int")
    raise ValueError(f"unknown lateness mode {mode!r}")


def days_over(start, end, allowed, mode: str = "calendar") -> Column:
    """Signed days beyond the allowed duration (NULL if either side is NULL)."""
    return elapsed_days(start, end, mode) - col(allowed)


def floor_zero(c) -> Column:
    """GREATEST(0, x) with NULL propagation (Spark's greatest skips NULLs)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0), c))


def daily_rate(rate, duration) -> Column:
    """rental_rate / NULLIF(rental_duration, 0) at 6 decimals.

    6 is the scale the source engine gives a 2-decimal by integer division;
    the division itself runs at a wider scale before that single rounding.
    """
    return F.round(dec(rate, 4, 2) / nonzero(dec(duration, 20, 0)), 6)
