"""Month parsing and calendar columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted month spellings, tried in this order, and the
# separator inside a row id such as "2024 Aug_sector 12".
MONTH_PATTERNS = ("yyyy-MMM", "yyyy MMM")
ID_SEPARATOR = "_sector "


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def month_start(day: Column | str) -> Column:
    return F.trunc(as_column(day), "MM")


def parse_month(text: Column | str) -> Column:
    """First day of the month named by ``text``; null if it names none."""
    text = as_column(text)
    attempts = [F.try_to_date(text, pattern) for pattern in MONTH_PATTERNS]
    return month_start(F.coalesce(*attempts, text.try_cast("date")))


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months from ``earlier`` to ``later``."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def month_index(month: Column | str, first_month: Column | str) -> Column:
    first = F.lit(first_month).cast("date") if isinstance(first_month, str) else first_month
    return months_between(as_column(month), first).cast("int")


def horizon_flag(month: Column | str, horizon_start: str) -> Column:
    """1 from ``horizon_start`` on, else 0."""
    return (as_column(month) >= F.lit(horizon_start).cast("date")).cast("int")


def age_in_months(month: Column | str, reference: Column) -> Column:
    """Months from ``month`` back from ``reference``, never negative."""
    age = months_between(reference, as_column(month)).cast("double")
    return F.when(age.isNotNull(), F.greatest(age, F.lit(0.0)))


def seasonality(month: Column | str) -> dict[str, Column]:
    """Month, quarter and the month's place on the yearly circle."""
    number = F.month(as_column(month))
    angle = F.lit(2 * math.pi) * number / F.lit(12)
    return {
        "month": number,
        "quarter": F.quarter(as_column(month)),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def holiday_flags(month: Column | str, flags: Mapping[str, Sequence[int]]) -> dict[str, Column]:
    number = F.month(as_column(month))
    return {name: number.isin(list(months)).cast("int") for name, months in flags.items()}


def id_month(row_id: Column | str) -> Column:
    part = F.split(as_column(row_id), ID_SEPARATOR).getItem(0)
    return F.try_to_date(part, MONTH_PATTERNS[1])


def id_sector(row_id: Column | str) -> Column:
    return F.split(as_column(row_id), ID_SEPARATOR).getItem(1).try_cast("bigint")


def row_id(month: Column | str, sector: Column | str) -> Column:
    """The id text of a (month, sector) row."""
    return F.concat(
        F.date_format(as_column(month), MONTH_PATTERNS[1]),
        F.lit(ID_SEPARATOR),
        as_column(sector).cast("string"),
    )
