"""Third job: saved models to the submitted table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blending, folds, forecasting, learners, series
from ..sources import artefacts, sinks

KEY, MONTH = "sector_id", "panel_month"


def forecast(
    panel: DataFrame,
    model_dir: str,
    months: Sequence[str] | DataFrame,
    overrides: DataFrame | None = None,
    minimum: float = 0.0,
    zero_column: str | None = None,
    zero_months: int = 6,
) -> DataFrame:
    """``pred_<model>`` columns and the clipped, overridden ``pred_ensemble``.

    With ``zero_column`` a sector that had a zero, or a gap, in that column in
    one of the last ``zero_months`` months before the horizon is forecast as 0.
    ``overridden`` marks these cells and those listed in ``overrides``; its sum is
    the number of updates.
    """
    spark = panel.sparkSession
    means, default = artefacts.read_encoding(spark, f"{model_dir}/encoding")
    models, weights = artefacts.read_weights(spark, f"{model_dir}/weights")
    features = artefacts.read_features(spark, f"{model_dir}/features")
    rows = folds.encode(forecasting.horizon_rows(panel, months), means, KEY, f"{KEY}_te", default)
    for name in features:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0.0))
    loaded = {m: PipelineModel.load(f"{model_dir}/{m}") for m in models}
    rule = learners.TargetRule(*artefacts.read_rule(spark, f"{model_dir}/target_rule"))
    scored = learners.score_horizon(rows, loaded, features, rule)
    kept = [c for c in (KEY, MONTH, "month_idx", "is_future_horizon") if c in scored.columns]
    out = scored.withColumn("pred_ensemble", blending.blended(models, weights, minimum)).select(
        *kept, *[f"pred_{m}" for m in models], "pred_ensemble"
    )
    listed = [overrides.select(MONTH, KEY)] if overrides is not None else []
    if zero_column is not None:
        listed.append(zero_overrides(panel, months, zero_column, zero_months))
    if not listed:
        return out.withColumn("overridden", F.lit(0))
    return forecasting.zero_overridden(out, reduce(DataFrame.unionByName, listed))


def zero_overrides(panel: DataFrame, months: Sequence[str] | DataFrame, column: str, last: int = 6) -> DataFrame:
    """(panel_month, sector_id) of the horizon cells that the zero rule sets to 0."""
    rows = forecasting.horizon_rows(panel, months)
    first = rows.agg(F.min(MONTH)).first()[0]
    if first is None:
        return rows.select(MONTH, KEY)
    origin = (first.replace(day=1) - dt.timedelta(days=1)).replace(day=1)
    ruled = series.add_zero_rule(panel.select(KEY, MONTH, column), column, [KEY], MONTH, last, origin=str(origin))
    return forecasting.horizon_rows(ruled, months).where("had_zero = 1").select(MONTH, KEY)


def submission(predictions: DataFrame, ids: DataFrame | None, months: Sequence[str] = ()) -> DataFrame:
    """One row per given id, in the order of the list, or for every month and sector if there is none."""
    if ids is not None:
        placed = ids.withColumn("_place", F.monotonically_increasing_id())
        return forecasting.submission_for_ids(placed, predictions).orderBy("_place").drop("_place")
    return forecasting.submission_grid(predictions, months)


def write_outputs(predictions: DataFrame, submitted: DataFrame, out_dir: str) -> None:
    """The scored table, and the submission as CSV with six decimals."""
    sinks.write_parquet(predictions, f"{out_dir}/predictions")
    sinks.write_csv(submitted, f"{out_dir}/submission", decimals=6)
