"""Null-safe arithmetic. Missing values are NULL throughout, never NaN."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import as_column

# Floors used by the target transform and the error columns.
LOG_EPSILON = 1e-3
APE_EPSILON = 1e-8


def nan_to_null(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def safe_ratio(numerator: Column | str | None, denominator: Column | str | None) -> Column:
    """Quotient, or null where an operand is absent, null or a zero divisor."""
    if numerator is None or denominator is None:
        return F.lit(None).cast("double")
    return finite(F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double")))


def optional(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def floored(value: Column | str, minimum: float) -> Column:
    """``max(value, minimum)`` that keeps null (``greatest`` would drop it)."""
    value = as_column(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(minimum))))


def log_target(value: Column | str, epsilon: float = LOG_EPSILON) -> Column:
    return F.log(floored(value, 0.0) + F.lit(epsilon))


def inverse_log_target(value: Column | str, epsilon: float = LOG_EPSILON) -> Column:
    return floored(F.exp(as_column(value)) - F.lit(epsilon), 0.0)


def absolute_percentage_error(truth: Column | str, prediction: Column | str, epsilon: float = APE_EPSILON) -> Column:
    """Error relative to the truth, whose size is floored at ``epsilon``."""
    truth, prediction = as_column(truth), as_column(prediction)
    return F.abs(prediction - truth) / floored(F.abs(truth), epsilon)


def all_present(columns: list[str]) -> Column:
    """1 if every column is non-null, 0 otherwise and for an empty list."""
    if not columns:
        return F.lit(0)
    return reduce(and_, [F.col(c).isNotNull() for c in columns]).cast("int")


def positive_flag(value: Column | str) -> Column:
    """1 if above zero; 0 for zero, negative and null."""
    return F.coalesce(as_column(value) > 0, F.lit(False)).cast("int")
