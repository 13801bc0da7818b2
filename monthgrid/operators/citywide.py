"""Series with one value per month for the whole city.

Everything here runs before the join onto the panel, on tables whose row count
is bounded by the calendar, so features are computed once per month instead of
once per sector and month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import as_column
from ..functions.text import slug

MONTH = "panel_month"
# Fixed value: prefix of search columns.
SEARCH_PREFIX = "search_"


def _latin(searches: DataFrame, spelling: DataFrame | None, month: str) -> DataFrame:
    """The searches with keyword and source in the letters of ``spelling(text, latin)``; texts that it lacks stay.

    Rows are summed up first: what is joined is a row for each month, keyword and source, so no keyword is hot.
    """
    if spelling is None:
        return searches
    rows = searches.groupBy(month, "keyword", "source").agg(F.sum("search_volume").alias("search_volume"))
    for c in ("keyword", "source"):
        words = spelling.groupBy(F.col("text").alias(c)).agg(F.min("latin").alias("_latin"))
        rows = rows.join(words, c, "left").withColumn(c, F.coalesce("_latin", c)).drop("_latin")
    return rows


def search_sums(searches: DataFrame, month: str = MONTH, spelling: DataFrame | None = None) -> DataFrame:
    """Volume per month and ``search_<keyword>_<source>``, in long form.

    ``spelling(text, latin)`` transliterates keywords and sources before their names are made; of several
    spellings of a text the least counts. Keywords that end up under one name are summed.
    """
    name = F.concat(F.lit(SEARCH_PREFIX), slug("keyword"), F.lit("_"), slug("source"))
    return (
        _latin(searches, spelling, month).groupBy(F.col(month).alias(MONTH), name.alias("column_name"))
        .agg(F.coalesce(F.sum("search_volume"), F.lit(0.0)).alias("volume"))
    )


def pivot_columns(sums: DataFrame, column: str = "column_name") -> list[str]:
    """The column names a pivot makes: one for each column of the table it results in."""
    return sorted(r[0] for r in sums.select(column).distinct().collect())


def search_wide(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    return sums.groupBy(MONTH).pivot("column_name", list(names)).agg(F.sum("volume"))


def total_group(column: Column | str, mode: str = "per_source") -> Column:
    """Name of the total a search column counts towards.

    ``per_source`` drops the last underscore token, so a source of several
    words keeps its own total; ``across_sources`` expects one-word sources.
    """
    if mode not in ("per_source", "across_sources"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.concat(F.regexp_replace(as_column(column), "_[^_]*$", ""), F.lit("_all"))


def search_totals(
    searches: DataFrame, mode: str = "per_source", month: str = MONTH, spelling: DataFrame | None = None
) -> DataFrame:
    """``*_all`` totals per month in long form; a month without rows gives 0 later. ``spelling`` as in ``search_sums``."""
    searches = _latin(searches, spelling, month)
    if mode == "across_sources":
        group = F.concat(F.lit(SEARCH_PREFIX), slug("keyword"), F.lit("_all"))
    else:
        group = total_group(F.concat(F.lit(SEARCH_PREFIX), slug("keyword"), F.lit("_"), slug("source")), mode)
    return (
        searches.groupBy(F.col(month).alias(MONTH), group.alias("column_name"))
        .agg(F.coalesce(F.sum("search_volume"), F.lit(0.0)).alias("volume"))
    )


def totals_wide(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    return search_wide(totals, names).fillna(0.0, subset=list(names))


def add_surge(
    df: DataFrame, column: str, keys: Sequence[str], order: str, output: str, months: int = 12,
    quantile: float = 0.75, minimum: int = 3,
) -> DataFrame:
    """1 where the value exceeds its rolling quantile over ``months`` rows."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(months - 1), 0)
    level = F.when(F.count(column).over(frame) >= minimum, F.percentile(column, quantile).over(frame))
    return df.withColumns(
        {f"{output}_level": level, output: F.coalesce(F.col(column) > level, F.lit(False)).cast("int")}
    )


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, which must settle ties.

    ``max_by`` combines map-side: a key with many copies sends one row per task.
    """
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def expand_years(
    yearly: DataFrame, year: str, last_year: int, extrapolated_from: int, prefix: str = "macro_"
) -> DataFrame:
    """Twelve months per year; a missing year repeats the year before it."""
    measures = [c for c in yearly.columns if c != year]
    next_year = F.lead(year).over(Window.partitionBy(F.lit(0)).orderBy(year))
    covered = F.sequence(F.col(year).cast("int"), F.coalesce(next_year - 1, F.lit(last_year)).cast("int"))
    return (
        yearly.where(F.col(year) <= last_year)
        .withColumn("_covered", covered)
        .select(F.explode("_covered").alias("_year"), *measures)
        .select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_month"), "_year", *measures)
        .select(
            F.make_date("_year", "_month", F.lit(1)).alias(MONTH),
            *[F.col(c).alias(prefix + c) for c in measures],
            (F.col("_year") >= extrapolated_from).cast("int").alias(f"{prefix}is_extrapolated"),
        )
    )
