"""The gap-free sector x month grid and the tables merged onto it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import horizon_flag, month_index
from ..functions.names import DERIVED_MARKERS, has_marker
from ..functions.numeric import all_present

KEY = "sector_id"
MONTH = "panel_month"


#: Rows of the full grid that one task is to hold; sorts and aggregates of a task grow with them.
GRID_ROWS = 1 << 19


def month_span(start: str, end: str):
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))


def dealt_by_sector(rows: DataFrame, sectors: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` by sector, in as many partitions as the full grid of ``sectors`` needs at ``GRID_ROWS`` each.

    Adaptive execution sees only the sparse rows and would gather far too many sectors in a task. A grid
    that falls short of a partition for each core is left to it.
    """
    spark = sectors.sparkSession
    grid = sectors.agg((F.count(F.lit(1)) * F.size(month_span(start, end))).alias("n")).first().n
    parts = -(-grid // GRID_ROWS)
    if parts <= spark.sparkContext.defaultParallelism:
        return rows.repartition(KEY)
    # No fewer than other shuffles have, or a join would deal the full grid anew.
    return rows.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), KEY)


def skeleton(sectors: DataFrame, start: str, end: str, horizon_start: str) -> DataFrame:
    """Every sector in every month, with month index and horizon flag.

    Each sector row expands in place, so only the sector dimension is shuffled
    and the result stays partitioned by sector for the windows that follow.
    """
    return (
        sectors.repartition(KEY)
        .withColumn(MONTH, F.explode(month_span(start, end)))
        .withColumn("month_idx", month_index(MONTH, start))
        .withColumn("is_future_horizon", horizon_flag(MONTH, horizon_start))
    )


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = (KEY, MONTH)) -> DataFrame:
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def dense_grid(sectors: DataFrame, cells: Mapping[str, DataFrame], start: str, end: str) -> DataFrame:
    """Left join of several sparse (sector, month) tables onto the full grid.

    Equivalent to chaining left joins from the skeleton, with one shuffle in
    total: the sparse tables and one anchor row per sector (in the first
    month) are stacked, sent to the sector's partition and folded per month.
    Each row then covers the empty months up to the next one, which are
    generated in place. The dense rows never cross the network, and all later
    windows over the sector reuse the partitioning. A sector has at most one
    row per month and table, so no sector can outgrow the others. Sectors are
    counted first, since the partitions must suit the dense rows.

    A repeated (sector, month) key inside one table is an error.
    """
    attributes = [c for c in sectors.columns if c != KEY]
    in_range = F.col(MONTH).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    stacked = sectors.select(KEY, *attributes, F.lit(start).cast("date").alias(MONTH), F.lit(1).alias("_anchor"))
    values, counters = [], []
    for name, table in cells.items():
        values += [(c, name) for c in table.columns if c not in (KEY, MONTH)]
        counters.append(f"_rows_{name}")
        stacked = stacked.unionByName(
            table.where(in_range).withColumn(f"_rows_{name}", F.lit(1)), allowMissingColumns=True
        )
    folded = (
        dealt_by_sector(stacked, sectors, start, end)
        .groupBy(KEY, MONTH)
        .agg(
            *[F.max(c).alias(c) for c, _ in values],
            *[F.max(c).alias(c) for c in attributes],
            *[F.sum(c).alias(c) for c in counters],
            F.max("_anchor").alias("_anchor"),
        )
    )
    for name in cells:
        repeated = F.raise_error(F.lit(f"repeated (sector, month) key in {name}"))
        folded = folded.withColumn(
            f"_rows_{name}", F.when(F.col(f"_rows_{name}") > 1, repeated.cast("long")).otherwise(F.col(f"_rows_{name}"))
        )
    checked = {
        c: F.when(F.col(f"_rows_{name}") > 0, F.col(c)).alias(c) for c, name in values
    }
    by_month = Window.partitionBy(KEY).orderBy(MONTH)
    whole = Window.partitionBy(KEY).orderBy(MONTH).rowsBetween(Window.unboundedPreceding, 0)
    last_covered = F.coalesce(F.add_months(F.lead(MONTH).over(by_month), -1), F.lit(end).cast("date"))
    runs = folded.select(
        KEY,
        F.col(MONTH).alias("_first"),
        last_covered.alias("_last"),
        *[F.max(c).over(whole).alias(c) for c in attributes],
        F.max("_anchor").over(whole).alias("_known"),
        *checked.values(),
    ).where(F.col("_known") == 1)
    months = F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias(MONTH)
    return runs.select(KEY, *attributes, months, "_first", *[c for c, _ in values]).select(
        KEY,
        *attributes,
        MONTH,
        *[F.when(F.col(MONTH) == F.col("_first"), F.col(c)).alias(c) for c, _ in values],
    )


def add_presence_flags(df: DataFrame, flags: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{flag: columns}``: 1 where all listed columns are present."""
    return df.withColumns({flag: all_present(list(columns)) for flag, columns in flags.items()})


def add_missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``missing_<c>`` for each raw column that has no such flag yet."""
    raw = [c for c in columns if not has_marker(c, DERIVED_MARKERS)]
    new = {f"missing_{c}": F.col(c).isNull().cast("int") for c in raw if f"missing_{c}" not in df.columns}
    return df.withColumns(new) if new else df


def unique_by(table: DataFrame, key: str, name: str) -> DataFrame:
    """``table`` if each key has one row; reading a repeated key fails."""
    others = [c for c in table.columns if c != key]
    once = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_row"))
    repeated = F.raise_error(F.lit(f"repeated {key} in {name}"))
    # The check sits in the values that are used, so that no pruning of columns can drop it.
    row = F.when(F.col("_n") > 1, repeated.cast(once.schema["_row"].dataType)).otherwise(F.col("_row"))
    return once.select(key, row.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def merge_static(panel: DataFrame, statics: DataFrame, flag: str = "has_poi") -> DataFrame:
    """Left join of one row per sector; a repeated sector is an error.

    No hint: the sector dimension grows with the data, so its size decides.
    """
    columns = [c for c in statics.columns if c != KEY]
    return add_presence_flags(panel.join(unique_by(statics, KEY, "statics"), KEY, "left"), {flag: columns})


def merge_months(panel: DataFrame, by_month: DataFrame, flag: str) -> DataFrame:
    """Left join of one row per calendar month; a repeated month is an error.

    At run time the month table's size decides: a calendar of any usual length
    is broadcast and the panel is not shuffled.
    """
    columns = [c for c in by_month.columns if c != MONTH]
    return add_presence_flags(panel.join(unique_by(by_month, MONTH, "the month table"), MONTH, "left"), {flag: columns})


def panel_checks(panel: DataFrame, sectors: DataFrame, start: str, end: str) -> DataFrame:
    """One row: rows expected, rows found, and keys that occur more than once."""
    expected = sectors.agg((F.count(F.lit(1)) * F.size(month_span(start, end))).alias("n"))
    return (
        panel.groupBy(KEY, MONTH)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("panel_rows"),
            F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        )
        .select(expected.select("n").scalar().alias("expected_rows"), "panel_rows", "repeated_keys")
    )


def validate_panel(panel: DataFrame, sectors: DataFrame, start: str, end: str) -> None:
    row = panel_checks(panel, sectors, start, end).first()
    if row.panel_rows != row.expected_rows:
        raise ValueError(f"panel has {row.panel_rows} rows, expected {row.expected_rows}")
    if row.repeated_keys:
        raise ValueError(f"{row.repeated_keys} (sector, month) keys occur more than once")
