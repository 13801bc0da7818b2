"""Forecast errors and scores, grouped by any keys.

All measures of a group come from one aggregation with map-side combine, so a
group holding most rows costs no more than the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import absolute_percentage_error

# Fixed values of the competition score: a row is bad above this error, and a
# share of bad rows above the limit scores zero.
BAD_ERROR = 1.0
BAD_SHARE_LIMIT = 0.3


def score_error(truth: str = "y_true", prediction: str = "y_pred") -> Column:
    """Relative error of the score: the divisor is 1 where the truth is 0."""
    t, p = F.col(truth), F.col(prediction)
    return F.abs(p - t) / F.when(t == 0, F.lit(1.0)).otherwise(F.abs(t))


def scores(df: DataFrame, keys: Sequence[str] = (), error: Column | None = None) -> DataFrame:
    """``score, scaled_mape, bad_ratio, good_fraction`` per group.

    A null truth or prediction is an error: skipping it would score the rest.
    """
    e = score_error() if error is None else error
    measured = df.select(*keys, e.alias("_e"))
    return _score_columns(measured.groupBy(*keys).agg(*_score_sums(F.col("_e"))), keys)


def _score_sums(e: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_n"),
        F.count_if(e.isNull()).alias("_missing"),
        F.count_if(e > BAD_ERROR).alias("_bad"),
        F.sum(F.when(e <= BAD_ERROR, e)).alias("_good_sum"),
    ]


def _score_columns(sums: DataFrame, keep: Sequence[str]) -> DataFrame:
    n = F.col("_n").cast("double")
    good = F.col("_n") - F.col("_bad")
    bad_ratio = F.when(
        F.col("_missing") > 0, F.raise_error(F.lit("null truth or prediction in a scored group")).cast("double")
    ).otherwise(F.col("_bad") / n)
    zeroed = (F.col("bad_ratio") > BAD_SHARE_LIMIT) | (good == 0)
    scaled = F.when(~zeroed, (F.col("_good_sum") / good.cast("double")) / (good.cast("double") / n))
    return (
        sums.withColumn("bad_ratio", bad_ratio)
        .withColumn("scaled_mape", scaled)
        .withColumn("good_fraction", good.cast("double") / n)
        .withColumn("score", F.when(zeroed, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("scaled_mape"))))
        .select(*keep, "score", "scaled_mape", "bad_ratio", "good_fraction")
    )


def _error_columns(weighted: bool) -> list[Column]:
    diff = F.col("y_pred") - F.col("y_true")
    columns = [
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff)).alias("mae"),
        F.avg(absolute_percentage_error("y_true", "y_pred")).alias("mape"),
        F.count(F.lit(1)).cast("double").alias("n"),
    ]
    if weighted:
        w = F.col("weights")
        columns += [
            F.sqrt(F.try_divide(F.sum(w * diff * diff), F.sum(w))).alias("rmse_weighted"),
            F.try_divide(F.sum(w * F.abs(diff)), F.sum(w)).alias("mae_weighted"),
        ]
    return columns


def error_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*_error_columns(False)[:3])


def score_report(df: DataFrame, keys: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    """Scores and errors per group in a single aggregation."""
    e = score_error()
    extras = _error_columns(weighted)
    names = ["rmse", "mae", "mape", "n"] + (["rmse_weighted", "mae_weighted"] if weighted else [])
    sums = df.groupBy(*keys).agg(*_score_sums(e), *extras)
    return _score_columns(sums, [*keys, *names])


def summarize(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Report per group; null keys form a group. Weighted errors if there are weights."""
    missing = {"y_true", "y_pred", *keys} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return score_report(df, keys, weighted="weights" in df.columns)


def sector_summary(df: DataFrame) -> DataFrame:
    keys = ["sector_id"] + (["model"] if "model" in df.columns else [])
    return summarize(df, keys).orderBy("score", *keys)


def worst_sectors(df: DataFrame, count: int = 10) -> DataFrame:
    keys = ["sector_id"] + (["model"] if "model" in df.columns else [])
    return summarize(df, keys).orderBy("score", *keys).limit(count)


def error_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Rows per model and equal-width bin of ``ape``; empty bins count 0.

    The extremes are one row per model, as are the models themselves, which
    were each fitted by the caller: the broadcast cannot grow with the rows.
    """
    known = df.where(F.col("ape").isNotNull()).select("model", "ape")
    ranges = known.groupBy("model").agg(F.min("ape").alias("_lo"), F.max("ape").alias("_hi"))
    place = (F.col("ape") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))
    bucket = F.when(F.col("_lo") == F.col("_hi"), F.lit(bins // 2 + 1)).otherwise(
        F.least(F.floor(place).cast("int") + 1, F.lit(bins))
    )
    counts = (
        known.join(F.broadcast(ranges), "model")
        .groupBy("model", bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    every = ranges.select("model", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counts, ["model", "bin"], "left").select(
        "model", "bin", F.coalesce("row_count", F.lit(0)).alias("row_count")
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("panel_month").agg(F.avg("y_true").alias("actual_mean"), F.avg("y_pred").alias("predicted_mean"))
