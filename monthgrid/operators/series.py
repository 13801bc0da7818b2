"""Time-series columns within a sector, or within any other series key.

Every function takes the key columns of one series and its order column. All
windows share the key, so a chain of them plans to one exchange (none after
``dense_grid``) and one sort. On a gap-free grid each series has one row per
month, so partitions are of equal size whatever the raw data's skew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import positive_flag, safe_ratio
from .scans import smoothed

Keys = Sequence[str]


def series_window(keys: Keys, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def add_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], keys: Keys, order: str) -> DataFrame:
    """``<c>_lag<k>``: the value ``k`` rows earlier; existing columns are kept."""
    w = series_window(keys, order)
    new = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags if f"{c}_lag{k}" not in df.columns}
    return df.withColumns(new) if new else df


def add_changes(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int], pct_lags: Sequence[int] | None = None,
    shift: int = 0, keys: Keys = (), order: str = "",
) -> DataFrame:
    """``<c>_diff<k>`` and ``<c>_pctchg<k>`` for each lag column that exists.

    With ``shift`` the change is the one that ended that many rows earlier, so that a row's own value is no
    part of it; it is taken along ``keys`` and ``order`` and needs no lag columns.
    """
    new: dict[str, Column] = {}
    if shift:
        w = series_window(keys, order)
        for c in columns:
            now = F.lag(c, shift).over(w)
            for k in lags:
                new[f"{c}_diff{k}"] = now - F.lag(c, k + shift).over(w)
            for k in lags if pct_lags is None else pct_lags:
                new[f"{c}_pctchg{k}"] = safe_ratio(now - F.lag(c, k + shift).over(w), F.lag(c, k + shift).over(w))
        return df.withColumns(new) if new else df
    for c in columns:
        for k in lags:
            if f"{c}_lag{k}" in df.columns:
                new[f"{c}_diff{k}"] = F.col(c) - F.col(f"{c}_lag{k}")
        for k in lags if pct_lags is None else pct_lags:
            if f"{c}_lag{k}" in df.columns:
                lagged = F.col(f"{c}_lag{k}")
                new[f"{c}_pctchg{k}"] = safe_ratio(F.col(c) - lagged, lagged)
    return df.withColumns(new) if new else df


def add_rolling(
    df: DataFrame, columns: Sequence[str], windows: Sequence[int], keys: Keys, order: str, shift: int = 0
) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the last ``n`` rows.

    ``shift=0`` includes the current row; ``shift=1`` ends at the row before.
    """
    new: dict[str, Column] = {}
    for n in windows:
        frame = series_window(keys, order).rowsBetween(-(n - 1) - shift, -shift)
        for c in columns:
            new[f"{c}_roll{n}_mean"] = F.avg(c).over(frame)
            new[f"{c}_roll{n}_std"] = F.stddev_samp(c).over(frame)
            new[f"{c}_roll{n}_min"] = F.min(c).over(frame)
            new[f"{c}_roll{n}_max"] = F.max(c).over(frame)
    return df.withColumns(new)


def add_ewm(
    df: DataFrame, columns: Sequence[str], alphas: Sequence[float], keys: Keys, order: str, point: str = ".", shift: int = 0,
) -> DataFrame:
    """``<c>_ewm_alpha<a>``: recursive exponentially weighted mean.

    ``point`` replaces the decimal point in the names, for stages that cannot
    take a dotted column.

    Missing values carry the mean forward and decay its weight. A series may be
    of any length: it is scanned in fragments (see ``scans``). ``shift`` takes the
    mean as it stood that many rows earlier.
    """
    names = {(c, a): f"{c}_ewm_alpha{str(a).replace('.', point)}" for c in columns for a in alphas}
    out = smoothed(df, names, keys, order) if names else df
    if not shift:
        return out
    w = series_window(keys, order)
    return out.withColumns({n: F.lag(F.col(f"`{n}`"), shift).over(w) for n in names.values()})


def add_interpolation(df: DataFrame, columns: Sequence[str], keys: Keys, order: str, suffix: str = "_interp") -> DataFrame:
    """Straight line between known values; leading gaps stay, trailing repeat."""
    w = series_window(keys, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    placed = df.withColumn("_pos", F.row_number().over(w))
    for c in columns:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("v")))
        placed = placed.withColumns(
            {f"_{c}_a": F.last(point, ignorenulls=True).over(back), f"_{c}_b": F.first(point, ignorenulls=True).over(ahead)}
        )
    new = {}
    for c in columns:
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        slope = F.try_divide(b["v"] - a["v"], (b["p"] - a["p"]).cast("double"))
        new[c + suffix] = F.coalesce(F.col(c).cast("double"), slope * (F.col("_pos") - a["p"]) + a["v"], a["v"])
    return placed.withColumns(new).drop("_pos", *[f"_{c}_{s}" for c in columns for s in "ab"])


def add_yoy(df: DataFrame, columns: Sequence[str], keys: Keys, order: str, periods: int = 12) -> DataFrame:
    """``<c>_yoy`` from ``<c>_interp``: growth over ``periods`` rows."""
    w = series_window(keys, order)
    return df.withColumns(
        {f"{c}_yoy": safe_ratio(f"{c}_interp", F.lag(f"{c}_interp", periods).over(w)) - F.lit(1.0) for c in columns}
    )


def filled(column: str, keys: Keys, order: str, method: str = "bfill") -> Column:
    """``bfill``, ``ffill`` or ``ffill_bfill`` of one column."""
    w = series_window(keys, order)
    backward = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    forward = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    choices = {"bfill": backward, "ffill": forward, "ffill_bfill": F.coalesce(forward, backward)}
    if method not in choices:
        raise ValueError(f"unknown fill method {method!r}")
    return choices[method]


def add_event_flag(
    df: DataFrame, column: str, flag: str, lags: Sequence[int], keys: Keys, order: str
) -> DataFrame:
    """1 where ``column`` is above zero, and that flag's own lags."""
    return add_lags(df.withColumn(flag, positive_flag(column)), [flag], lags, keys, order)


def add_zero_rule(
    df: DataFrame, column: str, keys: Keys, order: str, months: int = 6, output: str = "had_zero",
    origin: str | None = None, gaps_are_zero: bool = True,
) -> DataFrame:
    """1 where any of the previous ``months`` values is zero; a gap counts as zero by argument.

    ``origin`` is the last observed month. Rows after it are empty by nature, so
    they all take the state at the origin: the last ``months`` rows up to it.
    """
    w = series_window(keys, order)
    size = F.abs(F.coalesce(F.col(column), F.lit(0.0)) if gaps_are_zero else F.col(column))
    before = F.coalesce(F.min(size).over(w.rowsBetween(-months, -1)) == 0, F.lit(False))
    if origin is None:
        return df.withColumn(output, before.cast("int"))
    last = F.lit(origin).cast(df.schema[order].dataType)
    here = F.coalesce(F.min(size).over(w.rowsBetween(-(months - 1), 0)) == 0, F.lit(False))
    placed = df.withColumn("_here", F.when(F.col(order) <= last, here))
    state = F.last("_here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    flag = F.when(F.col(order) > last, F.coalesce(state, F.lit(False))).otherwise(before)
    return placed.withColumn(output, flag.cast("int")).drop("_here")


def add_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{output: (numerator, denominator)}``; an absent column gives nulls."""
    known = set(df.columns)
    return df.withColumns(
        {
            name: safe_ratio(top if top in known else None, bottom if bottom in known else None)
            for name, (top, bottom) in ratios.items()
        }
    )
