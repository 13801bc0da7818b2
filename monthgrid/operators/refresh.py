"""A stored panel of series columns, kept up to date month by month.

The panel lies in parquet, one partition for each month. New or corrected cells change the rows of their
month and of later months, no others: ``refresh`` reads the months that trailing frames reach back to, starts
the smoothed columns from the state stored in the month before, and overwrites the partitions from the first
changed month on. Its work grows with the months that change, not with the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import series
from .scans import smoothed

KEY, MONTH = "sector_id", "panel_month"


@dataclass(frozen=True)
class Frames:
    """The series columns that are kept for each of ``columns``, as in ``series``."""

    columns: Sequence[str]
    lags: Sequence[int] = (1, 2, 3, 6, 12)
    change_lags: Sequence[int] = (1, 3, 12)
    rolling: Sequence[int] = (3, 6)
    alphas: Sequence[float] = (0.3, 0.5)
    shift: int = 0

    def __post_init__(self):
        if not self.columns:
            raise ValueError("no columns to keep")

    @property
    def reach(self) -> int:
        """How many months before a row its lags and rolling frames read."""
        return max([0, *self.lags, *(n - 1 + self.shift for n in self.rolling)])

    @property
    def smooth_names(self) -> dict[tuple[str, float], str]:
        return {(c, a): f"{c}_ewm_alpha{str(a).replace('.', '_')}" for c in self.columns for a in self.alphas}


def seen(column: str) -> str:
    """Name of the column with the month of the last value so far: the age of the smoothed state."""
    return f"{column}_seen"


def _windowed(df: DataFrame, frames: Frames) -> DataFrame:
    df = series.add_lags(df, frames.columns, frames.lags, [KEY], MONTH)
    df = series.add_changes(df, frames.columns, frames.change_lags)
    return series.add_rolling(df, frames.columns, frames.rolling, [KEY], MONTH, frames.shift)


def _last_seen(frames: Frames, known: Mapping[str, Column] | None = None) -> dict[str, Column]:
    so_far = series.series_window([KEY], MONTH).rowsBetween(Window.unboundedPreceding, 0)
    here = {c: F.when(F.col(c).isNotNull(), F.col(MONTH)) for c in frames.columns}
    here = {c: F.coalesce(v, known[c]) if known else v for c, v in here.items()}
    return {seen(c): F.last(v, ignorenulls=True).over(so_far) for c, v in here.items()}


def series_table(panel: DataFrame, frames: Frames) -> DataFrame:
    """All series columns of a gap-free panel: the full build that ``refresh`` agrees with."""
    rows = panel.select(KEY, MONTH, *frames.columns)
    rows = _windowed(rows, frames).withColumns(_last_seen(frames))
    # The windows have gathered each series.
    return smoothed(rows, frames.smooth_names, [KEY], MONTH, gathered=True) if frames.alphas else rows


def write_months(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the months in ``df`` and leave the others.

    Rows are gathered by month; adaptive execution splits a large month, so no month is confined to a task.
    """
    spread = df.hint("rebalance", MONTH)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    stored = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("date"))
    return stored if columns is None else stored.select(*columns)


def store(panel: DataFrame, path: str, frames: Frames) -> DataFrame:
    """Build the series columns of a gap-free panel and store them by month."""
    write_months(series_table(panel, frames), path)
    return read_months(panel.sparkSession, path)


def _month(text) -> Column:
    return F.lit(str(text)).cast("date")


def _before_reach(state: DataFrame, frames: Frames, first: Column) -> DataFrame:
    """Rows for smoothed states that are older than the months read: from the last value of a column on.

    A gap fades the state by the row, so the empty months since the last value are made anew.
    """
    oldest = F.array_min(F.array(*[F.col(seen(c)) for c in frames.columns]))
    months = F.explode(F.sequence(oldest, F.add_months(first, -1), F.expr("interval 1 month")))
    kept = [seen(c) for c in frames.columns] + list(frames.smooth_names.values())
    return state.where(oldest < first).select(KEY, months.alias(MONTH), *kept)


def _folded(rows: DataFrame, cells: Mapping[str, DataFrame], frames: Frames) -> DataFrame:
    """``rows`` with the cells of the given tables in place of the stored ones; one shuffle."""
    stacked, owner = rows.withColumn("_stored", F.lit(1)), {}
    for name, table in cells.items():
        measured = [c for c in table.columns if c in frames.columns]
        owner |= {c: name for c in measured}
        renamed = table.select(KEY, MONTH, *[F.col(c).alias(f"_new_{c}") for c in measured], F.lit(1).alias(f"_rows_{name}"))
        stacked = stacked.unionByName(renamed, allowMissingColumns=True)
    carried = [c for c in stacked.columns if c not in (KEY, MONTH) and not c.startswith("_rows_")]
    folded = stacked.repartition(KEY).groupBy(KEY, MONTH).agg(
        *[F.max(c).alias(c) for c in carried], *[F.sum(f"_rows_{name}").alias(f"_rows_{name}") for name in cells]
    )
    wrong = {f"repeated (sector, month) key in {name}": F.col(f"_rows_{name}") > 1 for name in cells}
    wrong["a sector that the stored panel does not have"] = F.col("_stored").isNull()
    checked = {}
    for c in frames.columns:
        value = F.when(F.col(f"_rows_{owner[c]}") > 0, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in owner else F.col(c)
        for message, found in wrong.items():
            value = F.when(found, F.raise_error(F.lit(message)).cast(rows.schema[c].dataType)).otherwise(value)
        checked[c] = value
    return folded.select(*[checked.get(c, F.col(c)).alias(c) for c in rows.columns])


def refresh(spark: SparkSession, path: str, cells: Mapping[str, DataFrame], frames: Frames, end: str | None = None) -> DataFrame:
    """Bring a stored panel up to date and return the rows that were written, from the first changed month on.

    ``cells`` are sparse (sector, month) tables with some of the frames' columns: a row replaces the stored
    values of its own table's columns, nulls included; all other cells stay. ``end`` is a new last month,
    to which every sector is continued with empty months. Cells before the first stored month, after the
    last, of an unknown sector (dense numbers need a rebuild) or with a repeated key are errors; without
    cells and new months nothing is written. Repeating a refresh changes nothing. The rows are stored under
    ``spark.checkpoint.dir`` before partitions are replaced, so that a stopped write can be completed from them.
    """
    stored = read_months(spark, path)
    bounds = stored.agg(F.min(MONTH).alias("low"), F.max(MONTH).alias("high")).first()
    months = [r for r in (t.agg(F.min(MONTH).alias("low"), F.max(MONTH).alias("high")).first() for t in cells.values()) if r.low]
    last = max(str(bounds.high), str(end or bounds.high))
    if any(str(r.low) < str(bounds.low) or str(r.high) > last for r in months):
        raise ValueError(f"cells outside of the panel's months {bounds.low} to {last}")
    grown = _month(last) > _month(bounds.high)
    starts = [_month(r.low) for r in months] + ([F.add_months(_month(bounds.high), 1)] if last > str(bounds.high) else [])
    if not starts:
        return stored.where(F.lit(False))
    origin = spark.range(1).select(F.array_min(F.array(*starts)).alias("m")).first().m
    origin, first = _month(origin), F.add_months(_month(origin), -frames.reach)

    states = [seen(c) for c in frames.columns] + list(frames.smooth_names.values())
    wanted = [KEY, MONTH, *frames.columns, *states]
    # States from the origin on are made anew.
    rows = stored.where(F.col(MONTH) >= first).select(
        KEY, MONTH, *frames.columns, *[F.when(F.col(MONTH) < origin, F.col(c)).alias(c) for c in states]
    )
    span = F.sequence(F.add_months(_month(bounds.high), 1), _month(last), F.expr("interval 1 month"))
    months_added = F.explode(F.when(grown, span))
    added = stored.where(F.col(MONTH) == _month(bounds.high)).select(KEY, months_added.alias(MONTH))
    older = _before_reach(stored.where(F.col(MONTH) == F.add_months(origin, -1)), frames, first)
    rows = rows.unionByName(added, allowMissingColumns=True).unionByName(older, allowMissingColumns=True).select(*wanted)
    rows = _folded(rows, cells, frames)

    whole = Window.partitionBy(KEY)
    inputs = {}
    for (c, a), name in frames.smooth_names.items():
        valued = F.max(F.when(F.col(MONTH) == F.add_months(origin, -1), F.col(seen(c)))).over(whole)
        inputs[f"_in_{name}"] = F.when(F.col(MONTH) >= origin, F.col(c)).when(F.col(MONTH) == valued, F.col(name))
    rows = rows.withColumns(inputs | _last_seen(frames, {c: F.col(seen(c)) for c in frames.columns}))
    outputs = {(f"_in_{name}", a): name for (_, a), name in frames.smooth_names.items()}
    made = _windowed(rows.drop(*outputs.values()), frames)
    made = smoothed(made, outputs, [KEY], MONTH, gathered=True) if frames.alphas else made
    made = made.where(F.col(MONTH) >= origin).select(*stored.columns)
    made = materialize(made, "refreshed")
    write_months(made, path)
    return made
