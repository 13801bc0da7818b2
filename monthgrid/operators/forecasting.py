"""From model outputs on the horizon to the submitted table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import id_month, id_sector, row_id

KEY = "sector_id"
MONTH = "panel_month"


def id_months(ids: DataFrame, column: str = "id") -> DataFrame:
    """Distinct months named by row ids, in order; bounded by the calendar."""
    return ids.select(id_month(column).alias(MONTH)).distinct().orderBy(MONTH)


def horizon_rows(panel: DataFrame, months: Sequence[str] | DataFrame) -> DataFrame:
    """Panel rows of the given months, a list or a table of months."""
    if isinstance(months, DataFrame):
        return panel.join(months.select(MONTH).distinct(), MONTH, "left_semi")
    return panel.where(F.col(MONTH).isin([F.lit(m).cast("date") for m in sorted(set(months))]))


def prediction_stats(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and mean per prediction column, in one pass."""
    entries = [
        F.struct(
            F.lit(c).alias("prediction"),
            F.min(c).alias("min_value"),
            F.max(c).alias("max_value"),
            F.avg(c).alias("mean_value"),
        )
        for c in columns
    ]
    return predictions.agg(F.array(*entries).alias("_s")).select(F.inline("_s"))


def zero_overridden(predictions: DataFrame, overrides: DataFrame, column: str = "pred_ensemble") -> DataFrame:
    """0 for the (month, sector) keys in ``overrides``; ``overridden`` marks them.

    The list grows with sectors and months, so its size decides the join.
    """
    listed = overrides.select(MONTH, KEY).distinct().withColumn("_hit", F.lit(1))
    return (
        predictions.join(listed, [MONTH, KEY], "left")
        .withColumn(column, F.when(F.col("_hit") == 1, F.lit(0.0)).otherwise(F.col(column)))
        .withColumn("overridden", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def submission_for_ids(
    ids: DataFrame, predictions: DataFrame, column: str = "pred_ensemble", output: str = "new_house_transaction_amount"
) -> DataFrame:
    """The forecast of each id, 0 if there is none; other id columns pass through."""
    keyed = ids.withColumns({MONTH: id_month("id"), KEY: id_sector("id")})
    values = predictions.select(MONTH, F.col(KEY).cast("bigint").alias(KEY), F.col(column).alias(output))
    return (
        keyed.join(values, [MONTH, KEY], "left")
        .withColumn(output, F.coalesce(F.col(output), F.lit(0.0)))
        .drop(MONTH, KEY)
    )


def submission_grid(
    predictions: DataFrame, months: Sequence[str], column: str = "pred_ensemble",
    output: str = "new_house_transaction_amount",
) -> DataFrame:
    """An id and forecast for every given month and every sector with a forecast.

    Sectors expand over the month list in place; only filled cells are joined.
    """
    days = F.array(*[F.lit(m).cast("date") for m in months])
    grid = predictions.select(KEY).distinct().withColumn(MONTH, F.explode(days))
    values = predictions.select(MONTH, KEY, F.col(column).alias(output))
    return grid.join(values, [MONTH, KEY], "left").select(
        row_id(MONTH, KEY).alias("id"), F.coalesce(F.col(output), F.lit(0.0)).alias(output)
    )
