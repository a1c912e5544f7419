"""Finite-number guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def is_finite(value: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; false for NULL.

    NaN compares greater than everything, so one comparison settles it.
    """
    return F.coalesce(F.abs(value) < F.lit(INFINITY), F.lit(False))


def finite_only(value: Column) -> Column:
    """The number, or NULL when it is not finite."""
    return F.when(F.abs(value) < F.lit(INFINITY), value)


def checked(value: Column, label: str) -> Column:
    """Fail the job rather than report an infinite total. NULL stays NULL."""
    return F.when(
        value.isNotNull() & ~is_finite(value),
        F.raise_error(F.lit(f"{label} leaves the finite range")).cast("double"),
    ).otherwise(value)


def is_interval(start: Column, end: Column) -> Column:
    """Both ends finite and a positive length."""
    return is_finite(start) & is_finite(end) & F.coalesce(end > start, F.lit(False))
