"""Filling missing values, with flags for the cells that were empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ZERO_FILL_MARKERS, has_marker
from ..session import materialize
from .quantiles import exact_quantiles, unpivoted
from .series import filled

KEY = "sector_id"
MONTH = "panel_month"


def _wide(long: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str) -> DataFrame:
    """``(keys, metric, quantile)`` to one column per metric."""
    picks = [F.max(F.when(F.col("metric") == c, F.col("quantile"))).alias(c + suffix) for c in columns]
    return long.groupBy(*keys).agg(*picks)


def month_medians(df: DataFrame, columns: Sequence[str], suffix: str = "_month") -> DataFrame:
    """Exact median per month and column, one row per month."""
    long = unpivoted(df, [MONTH], columns)
    return _wide(exact_quantiles(long, [MONTH, "metric"], "value"), [MONTH], columns, suffix)


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column over all rows: one value per column to the driver."""
    long = unpivoted(df, [], columns)
    found = {r.metric: r.quantile for r in exact_quantiles(long, ["metric"], "value").collect()}
    return {c: found.get(c) for c in columns}


def impute_panel(df: DataFrame, columns: Sequence[str], method: str = "bfill") -> DataFrame:
    """Fill along the sector, then from the month's median, then from the column's.

    Adds ``imputed_<c>``, 1 where the cell was empty, for columns with gaps.
    The stored month medians join by their known size, a broadcast for any
    usual calendar; the column medians are scalars, and are only computed if a
    month has no value at all in some column.
    """
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    flagged = [c for c in columns if gaps[c]]
    if not flagged:
        return df
    along = {c: filled(c, [KEY], MONTH, method) for c in flagged}
    first = df.withColumns({f"imputed_{c}": F.col(c).isNull().cast("int") for c in flagged}).withColumns(along)
    first = materialize(first, "filled_along")
    medians = materialize(month_medians(first, flagged), "month_medians")
    second = first.join(medians, MONTH, "left").withColumns(
        {c: F.coalesce(c, f"{c}_month") for c in flagged}
    ).drop(*[f"{c}_month" for c in flagged])
    known = medians.agg(*[F.count(f"{c}_month").alias(c) for c in flagged]).first().asDict()
    months = first.select(MONTH).distinct().count()
    empty = [c for c in flagged if known[c] < months]
    if not empty:
        return second
    overall = column_medians(second, empty)
    return second.fillna({c: v for c, v in overall.items() if v is not None})


def impute_months(by_month: DataFrame, columns: Sequence[str]) -> DataFrame:
    """City columns on the month table: empty months take the column's median; ``imputed_<c>`` where there are any.

    On a dense panel every month has the same number of rows, so the median
    over months equals the median over panel rows.
    """
    gaps = by_month.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict() if columns else {}
    empty = [c for c in columns if gaps[c]]
    if not empty:
        return by_month
    overall = column_medians(by_month, empty)
    flagged = by_month.withColumns({f"imputed_{c}": F.col(c).isNull().cast("int") for c in empty})
    return flagged.fillna({c: v for c, v in overall.items() if v is not None})


def month_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first known value per month of columns that are constant within a month.

    ``max`` gives that value whatever order rows arrive in.
    """
    return df.groupBy(MONTH).agg(*[F.max(c).alias(c) for c in columns])


def fill_lags_with_zero(df: DataFrame) -> DataFrame:
    marked = [c for c in df.columns if has_marker(c, ZERO_FILL_MARKERS)]
    return df.fillna(0, subset=marked) if marked else df
