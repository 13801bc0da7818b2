"""Folds, scores, blending, screening, statics and models."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthgrid.functions.calendar import seasonality
from monthgrid.functions.numeric import absolute_percentage_error
from monthgrid.operators import blending as bl
from monthgrid.operators import evaluation as ev
from monthgrid.operators import folds as fo
from monthgrid.operators import forecasting as fc
from monthgrid.operators import learners as le
from monthgrid.operators import screening as sr
from monthgrid.operators import series as se
from monthgrid.operators import statics as st
from monthgrid.session import materialize, scratch_path
from monthgrid.sources import artefacts as ar

from . import fixtures as fx
from .panel_queries import merged, rounded
from .registry import query

KEY, MONTH, MODELS = fx.KEY, fx.MONTH, fx.MODELS

# --- folds, weights, encoding ----------------------------------------------


@query(
    "time_folds",
    """
SELECT f.fold, 'train' AS role, c.sector_id, c.panel_month, f.train_end AS reference_month
FROM cells c JOIN folds f ON c.panel_month <= f.train_end
UNION ALL
SELECT f.fold, 'valid', c.sector_id, c.panel_month, f.valid_end
FROM cells c JOIN folds f ON c.panel_month BETWEEN f.valid_start AND f.valid_end
""",
    ("cells", "folds"),
)
def time_folds(spark: SparkSession, d: str) -> DataFrame:
    return fo.assigned(fx.cells(spark, d).select(KEY, MONTH), fx.FOLDS)


@query(
    "fold_stats",
    """
SELECT f.fold, 'train' AS role, COUNT(*) AS row_count, COUNT(DISTINCT panel_month) AS month_count, MIN(amount) AS min_target
FROM cells c JOIN folds f ON c.panel_month <= f.train_end GROUP BY f.fold HAVING COUNT(DISTINCT panel_month) >= 48
UNION ALL
SELECT f.fold, 'valid', COUNT(*), COUNT(DISTINCT panel_month), MIN(amount)
FROM cells c JOIN folds f ON c.panel_month BETWEEN f.valid_start AND f.valid_end
WHERE f.fold IN (SELECT g.fold FROM cells x JOIN folds g ON x.panel_month <= g.train_end
                 GROUP BY g.fold HAVING COUNT(DISTINCT x.panel_month) >= 48)
GROUP BY f.fold
""",
    ("cells", "folds"),
)
def fold_stats(spark: SparkSession, d: str) -> DataFrame:
    """Folds with fewer than 48 training months are skipped (the first of the five)."""
    cells = fx.cells(spark, d)
    usable = fo.usable_folds(cells, fx.FOLDS, "amount", 48)
    return fo.fold_stats(cells, usable, "amount")


def _age(reference: str) -> str:
    return f"greatest((year(DATE '{reference}') - year(panel_month)) * 12 + month(DATE '{reference}') - month(panel_month), 0)"


@query(
    "decay_weights",
    f"""
, w AS (SELECT sector_id, panel_month, pow(0.5, {_age(fx.TRAIN_END)} / 12.0) AS e,
          CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * (1 - {_age(fx.TRAIN_END)} / CAST(MAX({_age(fx.TRAIN_END)}) OVER () AS DOUBLE)) AS l
        FROM cells WHERE panel_month <= DATE '{fx.TRAIN_END}')
SELECT sector_id, panel_month, ROUND(e / AVG(e) OVER (), 6) AS exponential_weight,
       ROUND(greatest(l, 0.1) / AVG(greatest(l, 0.1)) OVER (), 6) AS linear_weight, CAST(1.0 AS DOUBLE) AS plain_weight
FROM w
""",
    ("cells",),
)
def decay_weights(spark: SparkSession, d: str) -> DataFrame:
    df = fo.training_rows(fx.cells(spark, d), fx.TRAIN_END, "amount").select(KEY, MONTH)
    df = fo.add_decay_weights(df, fo.Decay("exponential"), fx.TRAIN_END, output="exponential_weight")
    df = fo.add_decay_weights(df, fo.Decay("linear"), fx.TRAIN_END, output="linear_weight")
    df = fo.add_decay_weights(df, fo.Decay("none"), fx.TRAIN_END, output="plain_weight")
    return rounded(df, ["exponential_weight", "linear_weight"])


@query(
    "target_encode",
    """
, m AS (SELECT sector_id, AVG(amount) AS mean FROM cells WHERE panel_month <= DATE '1996-06-01' GROUP BY sector_id)
SELECT sector_id, panel_month, ROUND(COALESCE(mean, 0.0), 6) AS sector_te,
       ROUND(COALESCE(mean, (SELECT AVG(amount) FROM cells WHERE panel_month <= DATE '1996-06-01')), 6) AS sector_te_mean
FROM panel LEFT JOIN m USING (sector_id)
""",
    ("panel", "cells"),
)
def target_encode(spark: SparkSession, d: str) -> DataFrame:
    """Means saved and read back; sectors unseen in training get the default."""
    train = fo.training_rows(fx.cells(spark, d), "1996-06-01", "amount")
    path = scratch_path(spark, "encoding")
    ar.write_encoding(fo.category_means(train, KEY, "amount"), 0.0, path)
    means, default = ar.read_encoding(spark, path)
    rows = fx.panel(spark, d).select(KEY, MONTH)
    out = fo.encode(rows, means, KEY, "sector_te", default)
    out = fo.encode(out, means, KEY, "sector_te_mean", fo.encoding_default(train, "amount", "mean"))
    return rounded(out, ["sector_te", "sector_te_mean"])


@query(
    "fold_target_encode",
    """
SELECT f.fold, c.sector_id, c.panel_month, ROUND(COALESCE(m.mean, 0.0), 6) AS sector_te
FROM cells c JOIN folds f ON c.panel_month BETWEEN f.valid_start AND f.valid_end
LEFT JOIN (SELECT f.fold, sector_id, AVG(amount) AS mean FROM cells JOIN folds f ON panel_month <= f.train_end
           GROUP BY f.fold, sector_id) m ON m.fold = f.fold AND m.sector_id = c.sector_id
""",
    ("cells", "folds"),
)
def fold_target_encode(spark: SparkSession, d: str) -> DataFrame:
    """Means of each fold's training rows, applied to its validation rows."""
    cells = fx.cells(spark, d)
    means = fo.category_means(fo.assigned(cells, fx.FOLDS, "train"), KEY, "amount", by=["fold"])
    valid = fo.assigned(cells, fx.FOLDS, "valid").select("fold", KEY, MONTH)
    return rounded(fo.encode(valid, means, KEY, "sector_te", 0.0, by=["fold"]), ["sector_te"])


@query(
    "oof_target_encode",
    f"""
, t AS (SELECT sector_id, panel_month, round(amount * 100)::BIGINT AS cents, (year(panel_month) * 12 + month(panel_month)) % 5 AS part
        FROM cells WHERE panel_month <= DATE '{fx.TRAIN_END}' AND amount IS NOT NULL)
SELECT sector_id, panel_month,
       COALESCE((SUM(cents) OVER c - SUM(cents) OVER p)::DOUBLE / NULLIF(COUNT(cents) OVER c - COUNT(cents) OVER p, 0), 0.0) AS sector_te
FROM t WINDOW c AS (PARTITION BY sector_id), p AS (PARTITION BY sector_id, part)""",
    ("cells",),
)
def oof_target_encode(spark: SparkSession, d: str) -> DataFrame:
    """Each training row's sector mean without the months of its own part. Whole cents, so that both engines start alike."""
    rows = fo.training_rows(fx.cells(spark, d), fx.TRAIN_END, "amount").select(KEY, MONTH, fx.cents("amount").cast("double").alias("cents"))
    return fo.encode_out_of_fold(rows, KEY, "cents", "sector_te", 0.0).drop("cents")


@query(
    "target_rules",
    """
, t AS (SELECT sector_id, panel_month, amount - 150000 AS x FROM cells)
SELECT sector_id, panel_month, ROUND(ln(greatest(x, 0.0) + 0.001::DOUBLE), 9) AS log_label, ROUND(greatest(x, 0.0), 3) AS log_forecast,
       ROUND(ln(greatest(x, 0.0) + 1), 9) AS wide_label, x AS plain_label, x AS plain_forecast, greatest(x, 10.0) AS limited_forecast FROM t""",
    ("cells",),
)
def target_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the learners are fitted on and how forecasts are read back, by logarithm or plain, limited or not."""
    log, wide, plain, limited = le.TargetRule(), le.TargetRule(epsilon=1.0), le.TargetRule(log=False, minimum=None), le.TargetRule(log=False, minimum=10.0)
    rows = fx.cells(spark, d).select(KEY, MONTH, (F.col("amount") - 150000).alias("x"))
    rows = rows.select(KEY, MONTH, log.label("x").alias("log_label"), wide.label("x").alias("wide_label"), plain.label("x").alias("plain_label"))
    read = rows.withColumns({
        "log_forecast": log.forecast("log_label"), "plain_forecast": plain.forecast("plain_label"), "limited_forecast": limited.forecast("plain_label"),
    })
    return rounded(rounded(read, ["log_label", "wide_label"], 9), ["log_forecast"], 3)


# --- errors and scores -----------------------------------------------------


@query(
    "ape",
    "SELECT model, fold, sector_id, panel_month, ape FROM predictions",
    ("predictions",),
)
def ape(spark: SparkSession, d: str) -> DataFrame:
    df = fx.predictions(spark, d).withColumn("ape", absolute_percentage_error("y_true", "y_pred"))
    return df.select("model", "fold", KEY, MONTH, "ape")


_ERRORS = """ROUND(sqrt(AVG((y_pred - y_true) * (y_pred - y_true))), 4) AS rmse, ROUND(AVG(abs(y_pred - y_true)), 4) AS mae,
ROUND(AVG(ape), 6) AS mape"""


@query("error_metrics", f"SELECT model, {_ERRORS} FROM predictions GROUP BY model", ("predictions",))
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(ev.error_metrics(fx.predictions(spark, d), ["model"]), ["rmse", "mae"], 4), ["mape"])


def _score_sql(keys: str, source: str, extra: str = "", names: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}CASE WHEN bad > 0.3 OR bad = 1 THEN CAST(0 AS DOUBLE) ELSE greatest(0.0, ROUND(1 - good_mean / (1 - bad), 6)) END AS score,
       CASE WHEN bad <= 0.3 THEN ROUND(good_mean / (1 - bad), 6) END AS scaled_mape,
       ROUND(bad, 6) AS bad_ratio, ROUND(1 - bad, 6) AS good_fraction{names}
FROM (SELECT {lead}AVG(CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END) AS bad, AVG(e) FILTER (WHERE e <= 1) AS good_mean{extra}
      FROM (SELECT *, abs(y_pred - y_true) / CASE WHEN y_true = 0 THEN 1.0 ELSE abs(y_true) END AS e FROM {source}) {group})"""


_SCORES = ["score", "scaled_mape", "bad_ratio", "good_fraction"]


@query("competition_score", _score_sql("model, fold", "predictions"), ("predictions",))
def competition_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.scores(fx.predictions(spark, d), ["model", "fold"]), _SCORES)


@query(
    "score_report",
    _score_sql("model", "predictions", f", {_ERRORS}, CAST(COUNT(*) AS DOUBLE) AS n", ", rmse, mae, mape, n"),
    ("predictions",),
)
def score_report(spark: SparkSession, d: str) -> DataFrame:
    out = ev.score_report(fx.predictions(spark, d), ["model"])
    return rounded(rounded(out, [*_SCORES, "mape"]), ["rmse", "mae"], 4)


_WEIGHTED = """ROUND(sqrt(SUM(weights * (y_pred - y_true) * (y_pred - y_true)) / SUM(weights)), 4) AS rmse_weighted,
ROUND(SUM(weights * abs(y_pred - y_true)) / SUM(weights), 4) AS mae_weighted"""


@query("weighted_errors", f"SELECT fold, {_WEIGHTED} FROM predictions GROUP BY fold", ("predictions",))
def weighted_errors(spark: SparkSession, d: str) -> DataFrame:
    out = ev.summarize(fx.predictions(spark, d), ["fold"]).select("fold", "rmse_weighted", "mae_weighted")
    return rounded(out, ["rmse_weighted", "mae_weighted"], 4)


_ALL_EXTRA = f", {_ERRORS}, CAST(COUNT(*) AS DOUBLE) AS n, {_WEIGHTED}"
_ALL_NAMES = ", rmse, mae, mape, n, rmse_weighted, mae_weighted"


def _round_summary(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, [*_SCORES, "mape"]), ["rmse", "mae", "rmse_weighted", "mae_weighted"], 4)


@query(
    "summary_by_model_fold",
    _score_sql("model, fold", "labelled", _ALL_EXTRA, _ALL_NAMES).replace(
        "labelled", "(SELECT * REPLACE (CASE WHEN fold < 5 THEN fold END AS fold) FROM predictions)"
    ),
    ("predictions",),
)
def summary_by_model_fold(spark: SparkSession, d: str) -> DataFrame:
    """A group whose key is null is reported like any other."""
    df = fx.predictions(spark, d).withColumn("fold", F.when(F.col("fold") < 5, F.col("fold")))
    return _round_summary(ev.summarize(df, ["model", "fold"]))


@query("sector_summary", _score_sql("sector_id, model", "predictions", _ALL_EXTRA, _ALL_NAMES), ("predictions",))
def sector_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round_summary(ev.sector_summary(fx.predictions(spark, d)))


@query(
    "worst_sectors",
    "SELECT sector_id, model, score, bad_ratio FROM ("
    + _score_sql("sector_id, model", "predictions")
    + ") ORDER BY score, sector_id, model LIMIT 10",
    ("predictions",),
)
def worst_sectors(spark: SparkSession, d: str) -> DataFrame:
    out = ev.worst_sectors(fx.predictions(spark, d)).select(KEY, "model", "score", "bad_ratio")
    return rounded(out, ["score", "bad_ratio"])


@query(
    "ape_histogram",
    """
, r AS (SELECT model, MIN(ape) AS lo, MAX(ape) AS hi FROM predictions GROUP BY model),
b AS (SELECT p.model, least(CAST(floor((ape - lo) / (hi - lo) * 30) AS INTEGER) + 1, 30) AS bin
      FROM predictions p JOIN r ON p.model = r.model)
SELECT r.model, CAST(g.bin AS INTEGER) AS bin, COUNT(b.bin) AS row_count
FROM r CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS bin) g LEFT JOIN b ON b.model = r.model AND b.bin = g.bin
GROUP BY r.model, g.bin
""",
    ("predictions",),
)
def ape_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ev.error_histogram(materialize(fx.predictions(spark, d), "predictions"))


@query(
    "monthly_trend",
    """
SELECT panel_month, ROUND(AVG(y_true), 4) AS actual_mean, ROUND(AVG(y_pred), 4) AS predicted_mean
FROM predictions GROUP BY panel_month
""",
    ("predictions",),
)
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.monthly_trend(fx.predictions(spark, d)), ["actual_mean", "predicted_mean"], 4)


@query(
    "trial_history",
    """
, t AS (SELECT shrink, fold, abs(y_pred * (shrink / CAST(10 AS DOUBLE)) - y_true) / abs(y_true) AS e
        FROM predictions CROSS JOIN (SELECT unnest(generate_series(1, 10)) AS shrink) WHERE model = 'naive'),
s AS (SELECT shrink, fold, bad, CASE WHEN bad > 0.3 THEN 0.0 ELSE greatest(0.0, 1 - g / (1 - bad)) END AS score FROM (
        SELECT shrink, fold, AVG(CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END) AS bad, AVG(e) FILTER (WHERE e <= 1) AS g
        FROM t GROUP BY shrink, fold))
SELECT CAST(shrink AS INTEGER) AS trial, ROUND(AVG(score), 6) AS score, CAST(MAX(shrink / CAST(10 AS DOUBLE)) AS DOUBLE) AS param_shrink,
       """
    + ", ".join(
        f"ROUND(MAX(score) FILTER (WHERE fold = {f}), 6) AS fold{f}_score, "
        f"ROUND(MAX(bad) FILTER (WHERE fold = {f}), 6) AS fold{f}_bad_ratio"
        for f in range(1, 6)
    )
    + " FROM s GROUP BY shrink",
    ("predictions",),
)
def trial_history(spark: SparkSession, d: str) -> DataFrame:
    """Ten settings of a shrinkage parameter, scored on five folds."""
    naive = fx.predictions(spark, d).where(F.col("model") == "naive")
    tried = naive.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn(
        "y_pred", F.col("y_pred") * (F.col("trial") / F.lit(10.0))
    )
    long = ev.scores(tried, ["trial", "fold"]).withColumn("shrink", F.col("trial") / F.lit(10.0))
    out = ar.trial_history(long, ["shrink"], range(1, 6))
    return rounded(out, [c for c in out.columns if "score" in c or "bad" in c])


# --- blending and the submitted table --------------------------------------

_WIDE_KEYS = "sector_id, panel_month, fold, y_true"


@query(
    "merge_predictions",
    f"""
SELECT {_WIDE_KEYS}, pred_naive, pred_yearly
FROM wide_predictions WHERE fold <> 2
""",
    ("wide_predictions",),
)
def merge_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Rows where one of the models has no forecast drop out."""
    df = fx.predictions(spark, d).where(~((F.col("model") == "yearly") & (F.col("fold") == 2)))
    return bl.merge_predictions(df, ["naive", "yearly"])


@query(
    "fold_union",
    """
SELECT model, fold, sector_id, panel_month, y_true, y_pred, ape, ROUND(weights, 6) AS weights
FROM predictions
""",
    ("predictions",),
)
def fold_union(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the folds, stacked one by one as the learners return them."""
    df = fx.predictions(spark, d)
    columns = ["model", "fold", KEY, MONTH, "y_true", "y_pred", "ape", "weights"]
    parts = [df.where(F.col("fold") == f.fold).select(columns) for f in fx.FOLDS]
    return rounded(le.stacked(parts), ["weights"])


STEPS = 20


@query(
    "ensemble_search",
    f"""
, g AS (SELECT a.k AS k1, b.k AS k2, {STEPS} - a.k - b.k AS k3
        FROM (SELECT unnest(generate_series(0, {STEPS})) AS k) a, (SELECT unnest(generate_series(0, {STEPS})) AS k) b
        WHERE a.k + b.k <= {STEPS}),
e AS (SELECT k1, k2, k3, abs(k1 / {STEPS}.0::DOUBLE * pred_naive + k2 / {STEPS}.0::DOUBLE * pred_yearly
                           + k3 / {STEPS}.0::DOUBLE * pred_smooth - y_true) / CASE WHEN y_true = 0 THEN 1.0 ELSE abs(y_true) END AS e
      FROM wide_predictions CROSS JOIN g),
s AS (SELECT k1, k2, k3, AVG(CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END) AS bad, AVG(e) FILTER (WHERE e <= 1) AS m
      FROM e GROUP BY k1, k2, k3)
SELECT k1 / {STEPS}.0::DOUBLE AS weight_naive, k2 / {STEPS}.0::DOUBLE AS weight_yearly, k3 / {STEPS}.0::DOUBLE AS weight_smooth,
       ROUND(CASE WHEN bad > 0.3 THEN 0.0 ELSE greatest(0.0, 1 - m / (1 - bad)) END, 6) AS score, ROUND(bad, 6) AS bad_ratio
FROM s
""",
    ("wide_predictions",),
)
def ensemble_search(spark: SparkSession, d: str) -> DataFrame:
    """The score of every weight vector of step 0.05 over the three models."""
    wide = materialize(bl.merge_predictions(fx.predictions(spark, d), MODELS), "wide_predictions")
    return rounded(bl.candidate_scores(wide, MODELS, STEPS), ["score", "bad_ratio"])


@query("weight_search", "SELECT TRUE AS weights_sum_to_one, TRUE AS at_least_uniform, TRUE AS at_least_each_model, TRUE AS at_least_grid, TRUE AS no_better_line")
def weight_search(spark: SparkSession, d: str) -> DataFrame:
    """The searched weights against equal weights, every single model and the plain grid."""
    wide = materialize(bl.merge_predictions(fx.predictions(spark, d), MODELS), "wide_predictions")
    weights, score = bl.search_weights(wide, MODELS, STEPS, line_rounds=20)
    single = np.eye(len(MODELS), dtype="int64")
    alone = bl.best_candidate(bl.share_scores(wide, MODELS, single, 1), MODELS).first()["score"]
    coarse = bl.best_candidate(bl.candidate_scores(wide, MODELS, 4), MODELS).first()["score"]
    equal = bl.uniform_score(wide, MODELS).first()[0]
    lines = bl.line_optima(wide, MODELS, list(weights.values())).agg(F.max("score")).first()[0]
    row = (abs(sum(weights.values()) - 1) < 1e-9, score >= equal, score >= alone, score >= coarse, lines <= score + 1e-8)
    return spark.createDataFrame(
        [row], "weights_sum_to_one boolean, at_least_uniform boolean, at_least_each_model boolean, at_least_grid boolean, no_better_line boolean"
    )


START = [0.5, 0.3, 0.2]
_LINES = [(x, y) for x in range(3) for y in range(x + 1, 3)]
_LINE_ROWS = " UNION ALL ".join(
    f"SELECT '{MODELS[x]}' AS raised, '{MODELS[y]}' AS lowered, (pred_{MODELS[x]} - pred_{MODELS[y]}) / s AS g, r, "
    f"CAST(-{START[x]} AS DOUBLE) AS lo, CAST({START[y]} AS DOUBLE) AS hi FROM scaled"
    for x, y in _LINES
)
_LINE_SQL = f"""
, scaled AS (
  SELECT *, ({" + ".join(f"CAST({w} AS DOUBLE) * pred_{m}" for w, m in zip(START, MODELS))} - y_true) / s AS r
  FROM (SELECT *, CASE WHEN y_true = 0 THEN 1.0::DOUBLE ELSE abs(y_true) END AS s FROM wide_predictions)),
lines AS (SELECT *, abs(g) AS b, sign(g) * r AS a FROM ({_LINE_ROWS})),
alive AS (SELECT * FROM lines WHERE CASE WHEN g = 0 THEN abs(r) <= 1 ELSE (1 - a) / b >= lo AND (-1 - a) / b <= hi END),
changes AS (
  SELECT raised, lowered, hi, CASE WHEN g = 0 THEN lo ELSE greatest((-1 - a) / b, lo) END AS t, 1.0::DOUBLE AS n1,
         CASE WHEN g = 0 THEN abs(r) ELSE -a END AS a1, -b AS b1, 0.0::DOUBLE AS n2, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS b2 FROM alive
  UNION ALL SELECT raised, lowered, hi, greatest(-a / b, lo), 0, 2 * a, 2 * b, 0, 0, 0 FROM alive WHERE g <> 0
  UNION ALL SELECT raised, lowered, hi, (1 - a) / b, 0, 0, 0, 1, a, b FROM alive WHERE g <> 0
  UNION ALL SELECT raised, lowered, hi, unnest([lo, hi]), 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT raised, lowered, lo, hi FROM lines)),
summed AS (SELECT raised, lowered, t, sum(n1) AS n1, sum(a1) AS a1, sum(b1) AS b1, sum(n2) AS n2, sum(a2) AS a2, sum(b2) AS b2
           FROM changes WHERE t <= hi GROUP BY raised, lowered, t),
sides AS (
  SELECT raised, lowered, t, side, sum(n1) OVER u - CASE WHEN side < 0 THEN n1 ELSE 0 END - sum(n2) OVER u + CASE WHEN side > 0 THEN 0 ELSE n2 END AS good,
         sum(a1) OVER u - CASE WHEN side < 0 THEN a1 ELSE 0 END - sum(a2) OVER u + CASE WHEN side > 0 THEN 0 ELSE a2 END AS a,
         sum(b1) OVER u - CASE WHEN side < 0 THEN b1 ELSE 0 END - sum(b2) OVER u + CASE WHEN side > 0 THEN 0 ELSE b2 END AS b,
         min(t) OVER p AS lo, max(t) OVER p AS hi
  FROM summed CROSS JOIN (VALUES (-1), (0), (1)) v(side)
  WINDOW u AS (PARTITION BY raised, lowered, side ORDER BY t), p AS (PARTITION BY raised, lowered)),
running AS (SELECT * FROM sides WHERE side = 0 OR (side < 0 AND t > lo) OR (side > 0 AND t < hi)),
size AS (SELECT count(*) AS n FROM wide_predictions)
SELECT raised, lowered, ROUND(max(CASE WHEN (n - good) / n > 0.3 OR good = 0 THEN 0.0
                                       ELSE greatest(0.0, 1 - greatest(a + b * t, 0.0) / good / (good / n)) END), 6) AS score
FROM running, size GROUP BY raised, lowered"""


@query(
    "line_search",
    _LINE_SQL,
    ("wide_predictions",),
)
def line_search(spark: SparkSession, d: str) -> DataFrame:
    """The best score that a shift of weight between two of the three models can reach, from the weights of START."""
    wide = materialize(bl.merge_predictions(fx.predictions(spark, d), MODELS), "wide_predictions")
    names = F.array(*[F.lit(m) for m in MODELS])
    best = bl.line_optima(wide, MODELS, START)
    return rounded(best.select(F.get(names, "x").alias("raised"), F.get(names, "y").alias("lowered"), "score"), ["score"])


WEIGHTS = [0.41421356, 0.31415927, 0.27162717]


def _blend_sql(weights: list[float]) -> str:
    terms = " + ".join(f"CAST({w!r} AS DOUBLE) * pred_{m}" for w, m in zip(weights, MODELS))
    return f"greatest({terms}, 0.0)"


_ENSEMBLE = _blend_sql(WEIGHTS)


@query(
    "ensemble_blend",
    f"""
SELECT sector_id, panel_month, {_ENSEMBLE} AS pred_ensemble, {_blend_sql([1 / 3] * 3)} AS pred_uniform
FROM horizon_predictions
""",
    ("horizon_predictions",),
)
def ensemble_blend(spark: SparkSession, d: str) -> DataFrame:
    """Saved weights, and the equal ones that a wrong number of weights falls back to."""
    path = scratch_path(spark, "weights")
    ar.write_weights(spark, MODELS, WEIGHTS, path)
    models, weights = ar.read_weights(spark, path)
    return fx.horizon_predictions(spark, d).select(
        KEY,
        MONTH,
        bl.blended(models, weights).alias("pred_ensemble"),
        bl.blended(models, weights[:2]).alias("pred_uniform"),
    )


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    return fx.horizon_predictions(spark, d).select(KEY, MONTH, bl.blended(MODELS, WEIGHTS).alias("pred_ensemble"))


@query(
    "prediction_stats",
    " UNION ALL ".join(
        f"SELECT 'pred_{m}' AS prediction, ROUND(MIN(pred_{m}), 4) AS min_value, ROUND(MAX(pred_{m}), 4) AS max_value, "
        f"ROUND(AVG(pred_{m}), 4) AS mean_value FROM horizon_predictions"
        for m in MODELS
    ),
    ("horizon_predictions",),
)
def prediction_stats(spark: SparkSession, d: str) -> DataFrame:
    out = fc.prediction_stats(fx.horizon_predictions(spark, d), [f"pred_{m}" for m in MODELS])
    return rounded(out, ["min_value", "max_value", "mean_value"], 4)


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Sectors without an order in the month before, and three listed ones."""
    ruled = se.add_zero_rule(fx.panel(spark, d), "amount", [KEY], MONTH, months=1)
    ruled = ruled.where(F.col("had_zero") == 1).select(MONTH, KEY)
    listed = fx.sectors(spark, d).where(F.col(KEY) <= 3).select(F.lit(fx.END).cast("date").alias(MONTH), KEY)
    return ruled.unionByName(listed)


_OVERRIDES = """
SELECT panel_month, sector_id FROM (
  SELECT *, COALESCE(LAG(amount, 1) OVER (PARTITION BY sector_id ORDER BY panel_month), 0) AS before,
         row_number() OVER (PARTITION BY sector_id ORDER BY panel_month) AS pos FROM panel)
WHERE before = 0 AND pos > 1
UNION
SELECT DATE '2001-08-01', sector_id FROM cust WHERE sector_id <= 3"""


@query(
    "zero_override",
    f"""
SELECT h.sector_id, h.panel_month, CASE WHEN o.sector_id IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE {_ENSEMBLE} END AS pred_ensemble,
       CAST(o.sector_id IS NOT NULL AS INTEGER) AS overridden
FROM horizon_predictions h LEFT JOIN ({_OVERRIDES}) o ON o.sector_id = h.sector_id AND o.panel_month = h.panel_month
""",
    ("horizon_predictions", "panel", "cust"),
)
def zero_override(spark: SparkSession, d: str) -> DataFrame:
    return fc.zero_overridden(ensemble(spark, d), overrides(spark, d))


@query(
    "submission_lookup",
    f"""
SELECT t.id, COALESCE({_ENSEMBLE}, 0.0) AS new_house_transaction_amount
FROM test_ids t LEFT JOIN horizon_predictions h
  ON h.sector_id = CAST(split_part(t.id, '_sector ', 2) AS BIGINT)
 AND h.panel_month = CAST(strptime(split_part(t.id, '_sector ', 1), '%Y %b') AS DATE)
""",
    ("test_ids", "horizon_predictions"),
)
def submission_lookup(spark: SparkSession, d: str) -> DataFrame:
    return fc.submission_for_ids(fx.test_ids(spark, d), ensemble(spark, d))


@query(
    "submission_grid",
    f"""
SELECT strftime(m.panel_month, '%Y %b') || '_sector ' || c.sector_id AS id,
       COALESCE({_ENSEMBLE}, 0.0) AS new_house_transaction_amount
FROM cust c CROSS JOIN (SELECT panel_month FROM months WHERE panel_month >= DATE '{fx.HORIZON}'
                        UNION ALL SELECT DATE '2001-09-01') m
LEFT JOIN horizon_predictions h ON h.sector_id = c.sector_id AND h.panel_month = m.panel_month
""",
    ("cust", "months", "horizon_predictions"),
)
def submission_grid(spark: SparkSession, d: str) -> DataFrame:
    """Without an id list: every sector in every month, also in one nobody forecast."""
    return fc.submission_grid(ensemble(spark, d), [*fx.HORIZON_MONTHS, "2001-09-01"])


@query(
    "horizon_rows",
    """
SELECT sector_id, panel_month, amount FROM panel
WHERE panel_month IN (SELECT CAST(strptime(split_part(id, '_sector ', 1), '%Y %b') AS DATE) FROM test_ids)
""",
    ("panel", "test_ids"),
)
def horizon_rows(spark: SparkSession, d: str) -> DataFrame:
    months = fc.id_months(fx.test_ids(spark, d))
    return fc.horizon_rows(fx.panel(spark, d).drop("num"), months)


# --- screening -------------------------------------------------------------

_MEASURES = ["nh_amount", "nh_num", "po_amount", "po_num", "land_amount", "nhnbr_amount"]
_M = {"nh_amount": "nh.amount", "nh_num": "nh.num", "po_amount": "po.amount", "po_num": "po.num",
      "land_amount": "land.amount", "nhnbr_amount": "nhnbr.amount"}
_WIDE = (
    "SELECT c.sector_id, m.panel_month, "
    + ", ".join(f"{v} AS {k}" for k, v in _M.items())
    + ", nh.num + po.num AS total_num, CASE WHEN nh.num IS NOT NULL THEN CAST(7 AS DOUBLE) END AS constant,"
    + " CAST(NULL AS DOUBLE) AS nothing FROM cust c CROSS JOIN months m "
    + " ".join(f"LEFT JOIN {s} ON {s}.sector_id = c.sector_id AND {s}.panel_month = m.panel_month" for s in ("nh", "po", "land", "nhnbr"))
)
_WIDE_NEEDS = ("cust", "months", "nh", "po", "land", "nhnbr")
SCREENED = [*_MEASURES, "total_num", "constant", "nothing"]


def screened(spark: SparkSession, d: str) -> DataFrame:
    """Eight measures with gaps: one is a sum of two, one constant, one empty."""
    return merged(spark, d).select(
        KEY,
        MONTH,
        *_MEASURES,
        (F.col("nh_num") + F.col("po_num")).alias("total_num"),
        F.when(F.col("nh_num").isNotNull(), F.lit(7.0)).alias("constant"),
        F.lit(None).cast("double").alias("nothing"),
    )


def _per_column(measure: str, output: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {measure.format(c=c)} AS {output} FROM x" for c in SCREENED)
    return f", x AS ({_WIDE}) {rows}"


@query("null_ratio", _per_column("ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6)", "null_ratio"), _WIDE_NEEDS)
def null_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sr.null_ratios(screened(spark, d), SCREENED), ["null_ratio"])


@query(
    "low_variance",
    f", x AS ({_WIDE}) SELECT feature FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) AS v FROM x" for c in SCREENED)
    + ") WHERE v < 1e-6",
    _WIDE_NEEDS,
)
def low_variance(spark: SparkSession, d: str) -> DataFrame:
    """The constant column goes, the empty one has no variance and stays."""
    found = sr.low_variance_columns(screened(spark, d), SCREENED)
    return spark.createDataFrame([(c,) for c in found], "feature string")


PAIRED = [*_MEASURES, "total_num"]
_PAIRS = ", x AS (" + _WIDE + "), pairs AS (" + " UNION ALL ".join(
    f"SELECT {i} AS left_pos, {j} AS right_pos, '{PAIRED[i]}' AS \"left\", '{PAIRED[j]}' AS \"right\", "
    f"CASE WHEN isfinite(corr({PAIRED[i]}, {PAIRED[j]})) THEN corr({PAIRED[i]}, {PAIRED[j]}) END AS corr FROM x"
    for i in range(len(PAIRED)) for j in range(i + 1, len(PAIRED))
) + ")"


@query("corr_pairs", _PAIRS + ' SELECT * REPLACE (ROUND(corr, 6) AS corr) FROM pairs', _WIDE_NEEDS)
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sr.correlation_pairs(screened(spark, d), PAIRED), ["corr"])


@query(
    "corr_drop",
    _PAIRS + ' SELECT "left" AS dropped, arg_min("right", right_pos) AS kept FROM pairs WHERE abs(corr) > 0.5 GROUP BY "left"',
    _WIDE_NEEDS,
)
def corr_drop(spark: SparkSession, d: str) -> DataFrame:
    df = materialize(screened(spark, d), "screened")
    return sr.correlated_drops(sr.correlation_pairs(df, PAIRED), 0.5)


_IMPORTANCE = "SELECT p_brand || ' ' || p_type AS feature, SUM(CAST(round(p_retailprice * 100) AS BIGINT))::DOUBLE / 100 AS importance FROM part GROUP BY ALL"


@query(
    "select_features",
    f"""
WITH i AS ({_IMPORTANCE}),
r AS (SELECT *, row_number() OVER o AS rank, SUM(importance) OVER o / SUM(importance) OVER () AS share
      FROM i WINDOW o AS (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT COUNT(*) FILTER (WHERE share <= 0.5) AS half, COUNT(*) FILTER (WHERE share <= 0.05) AS few FROM r)
SELECT 'share' AS branch, feature FROM r, n WHERE CASE WHEN half >= 10 THEN share <= 0.5 ELSE rank <= 10 END
UNION SELECT 'share', 'sector_id' UNION SELECT 'share', 'amount'
UNION SELECT 'top', feature FROM r, n WHERE CASE WHEN few >= 20 THEN share <= 0.05 ELSE rank <= 20 END
UNION SELECT 'top', 'sector_id'
""",
)
def select_features(spark: SparkSession, d: str) -> DataFrame:
    """Both branches of the rule: the cumulative share decides, or the minimum number does."""
    importance = (
        fx.table(spark, d, "part")
        .groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("feature"))
        .agg(fx.money(F.sum(fx.cents("p_retailprice"))).alias("importance"))
    )
    share = sr.select_features(importance, 10, 0.5, ["sector_id", "amount"])
    top = sr.select_features(importance, 20, 0.05, ["sector_id"])
    return share.select(F.lit("share").alias("branch"), "feature").unionByName(
        top.select(F.lit("top").alias("branch"), "feature")
    )


# --- statics ---------------------------------------------------------------


@query(
    "standardize",
    "SELECT sector_id, "
    + ", ".join(f"ROUND(({c} - AVG({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in fx.STATIC_COLUMNS)
    + " FROM statics",
    ("statics",),
)
def standardize(spark: SparkSession, d: str) -> DataFrame:
    df = st.standardized(fx.statics(spark, d), fx.STATIC_COLUMNS).drop("given_cluster")
    return rounded(df, fx.STATIC_COLUMNS)


@query(
    "static_ratios",
    """
SELECT sector_id, poi_number_of_shops / NULLIF(poi_resident_population, 0) AS poi_shop_per_capita,
       poi_catering / NULLIF(poi_number_of_shops, 0) AS poi_catering_share
FROM statics
""",
    ("statics",),
)
def static_ratios(spark: SparkSession, d: str) -> DataFrame:
    ratios = {
        "poi_shop_per_capita": ("poi_number_of_shops", "poi_resident_population"),
        "poi_catering_share": ("poi_catering", "poi_number_of_shops"),
    }
    return se.add_ratios(fx.statics(spark, d), ratios).select(KEY, *ratios)


_IMPUTED = ["poi_resident_population", "poi_number_of_shops"]


@query(
    "cluster_impute",
    """
, x AS (SELECT sector_id, given_cluster, CASE WHEN given_cluster <> 0 THEN poi_resident_population END AS p,
               poi_number_of_shops AS s FROM statics)
SELECT sector_id, given_cluster, ROUND(COALESCE(p, median(p) OVER c, median(p) OVER ()), 4) AS poi_resident_population,
       ROUND(COALESCE(s, median(s) OVER c, median(s) OVER ()), 4) AS poi_number_of_shops,
       CAST(p IS NULL OR s IS NULL AS INTEGER) AS imputed_poi_flag
FROM x WINDOW c AS (PARTITION BY given_cluster)
""",
    ("statics",),
)
def cluster_impute(spark: SparkSession, d: str) -> DataFrame:
    """Medians of given clusters; one cluster has no value at all in a column."""
    population = F.when(F.col("given_cluster") != 0, F.col("poi_resident_population"))
    df = fx.statics(spark, d).select(KEY, "given_cluster", population.alias(_IMPUTED[0]), _IMPUTED[1])
    return rounded(st.cluster_imputed(materialize(df, "statics"), _IMPUTED, "given_cluster"), _IMPUTED, 4)


def _complete_statics(spark: SparkSession, d: str) -> DataFrame:
    df = materialize(fx.statics(spark, d), "statics")
    return materialize(st.cluster_imputed(df, fx.STATIC_COLUMNS, "given_cluster"), "statics_complete")


# Clusters in SQL: farthest points first, then rounds of assigning and averaging, one subquery each.
_X = [f"x{i}" for i in range(len(fx.STATIC_COLUMNS))]
_GAP = " + ".join(f"(z.{x} - c.{x}) * (z.{x} - c.{x})" for x in _X)


def _listed(form: str) -> str:
    return ", ".join(form.format(x=x, c=c) for x, c in zip(_X, fx.STATIC_COLUMNS))


def _scaled_sql(name: str, rows: str) -> str:
    """Columns of ``rows`` scaled by the moments of its seen rows."""
    return f"""{name}_moments AS (SELECT {_listed("avg({c}) FILTER (seen) AS m_{x}, COALESCE(NULLIF(stddev_pop({c}) FILTER (seen), 0), 1) AS d_{x}")} FROM {rows}),
{name} AS MATERIALIZED (SELECT sector_id, seen, {_listed("({c} - m_{x}) / d_{x} AS {x}")} FROM {rows}, {name}_moments),
"""


def _clusters_sql(seen: str, k: int = 4, rounds: int = st.ROUNDS) -> str:
    """``labels(sector_id, seen, k, gap)``, of centres fitted on the rows where ``seen`` holds."""
    first = " + ".join(f"{x} * {x}" for x in _X)
    text = f""", medians AS (SELECT {_listed("median({c}) AS {c}")} FROM statics WHERE {seen}),
whole AS (SELECT s.sector_id, {seen} AS seen, {_listed("COALESCE(s.{c}, m.{c}) AS {c}")} FROM statics s, medians m),
{_scaled_sql("z", "whole")}
c_1 AS MATERIALIZED (SELECT 0 AS k, {_listed("{x}")} FROM z WHERE seen ORDER BY {first} DESC, sector_id LIMIT 1),
"""
    for i in range(1, k):
        text += f"""c_{i + 1} AS MATERIALIZED (SELECT * FROM c_{i} UNION ALL (
  SELECT {i}, {_listed("z.{x}")} FROM z, c_{i} c WHERE seen GROUP BY z.sector_id, {_listed("z.{x}")} ORDER BY MIN({_GAP}) DESC, z.sector_id LIMIT 1)),
"""
    nearest = f"SELECT z.*, c.k, {_GAP} AS gap FROM z, {{centres}} c QUALIFY ROW_NUMBER() OVER (PARTITION BY sector_id ORDER BY gap, c.k) = 1"
    for i in range(k, k + rounds):
        text += f"""c_{i + 1} AS MATERIALIZED (SELECT c.k, {_listed("COALESCE(avg(l.{x}), any_value(c.{x})) AS {x}")}
  FROM c_{i} c LEFT JOIN ({nearest.format(centres=f"c_{i}")}) l ON l.k = c.k AND l.seen GROUP BY c.k),
"""
    return text + f"""centres AS MATERIALIZED (SELECT (ROW_NUMBER() OVER (ORDER BY {_listed("{x}")}) - 1)::INTEGER AS k, {_listed("{x}")} FROM c_{k + rounds}),
labels AS MATERIALIZED ({nearest.format(centres="centres")})"""


@query(
    "static_clusters",
    _clusters_sql("TRUE") + """
SELECT sector_id, k AS poi_cluster_id, ROUND(gap, 6) AS gap, ROUND(SUM(gap) OVER (), 3) AS cost FROM labels
""",
    ("statics",),
)
def static_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each sector's cluster on the filled, scaled columns, its squared distance, and their sum."""
    df = materialize(fx.statics(spark, d), "statics")
    out = st.with_clusters(df, st.fit_clusters(df, fx.STATIC_COLUMNS), distance="gap")
    cost = out.agg(F.round(F.sum("gap"), 3)).first()[0]
    return out.select(KEY, "poi_cluster_id", F.round("gap", 6).alias("gap"), F.lit(cost).cast("double").alias("cost"))


_STATIC_RATIOS = {
    "poi_shop_per_capita": ("poi_number_of_shops", "poi_resident_population"),
    "poi_catering_share": ("poi_catering", "poi_number_of_shops"),
}


@query(
    "static_model",
    _clusters_sql("given_cluster <> 0") + f""",
cluster_medians AS (SELECT l.k, {_listed("median(s.{c}) AS {c}")} FROM statics s JOIN labels l USING (sector_id) WHERE l.seen GROUP BY l.k),
complete AS (SELECT s.sector_id, l.seen, l.k, {_listed("COALESCE(s.{c}, g.{c}, m.{c}) AS {c}")},
  ({" OR ".join(f"s.{c} IS NULL" for c in fx.STATIC_COLUMNS)})::INTEGER AS imputed_poi_flag
  FROM statics s JOIN labels l USING (sector_id) LEFT JOIN cluster_medians g ON g.k = l.k CROSS JOIN medians m),
{_scaled_sql("v", "complete")}
done AS (SELECT * FROM complete JOIN v USING (sector_id))
SELECT sector_id, k AS poi_cluster_id, imputed_poi_flag, ROUND(poi_number_of_shops / NULLIF(poi_resident_population, 0), 6) AS poi_shop_per_capita,
       ROUND(poi_catering / NULLIF(poi_number_of_shops, 0), 6) AS poi_catering_share, ROUND({" + ".join(f"{x} * {x}" for x in _X)}, 5) AS squared_length
FROM done
""",
    ("statics",),
)
def static_model(spark: SparkSession, d: str) -> DataFrame:
    """The stored transform, fitted on the sectors of three groups, read back and applied to those of all four.

    All components are kept, so they are a rotation of the scaled columns and their squares add up to the same.
    """
    df = materialize(fx.statics(spark, d), "statics")
    path = scratch_path(spark, "static_model")
    model = st.fit_static_model(df.where("given_cluster <> 0"), fx.STATIC_COLUMNS, count=len(fx.STATIC_COLUMNS))
    ar.write_static_model(spark, model, path)
    out = st.apply_static_model(df, ar.read_static_model(spark, path), _STATIC_RATIOS)
    length = sum((F.pow(f"poi_pca_component_{i + 1}", F.lit(2)) for i in range(len(fx.STATIC_COLUMNS))), F.lit(0.0))
    out = rounded(out, _STATIC_RATIOS).withColumn("squared_length", F.round(length, 5))
    return out.select(KEY, "poi_cluster_id", "imputed_poi_flag", *_STATIC_RATIOS, "squared_length")


@query(
    "static_pca",
    "SELECT component::INTEGER AS component, TRUE AS share_is_measured, TRUE AS orthonormal, TRUE AS falling "
    f"FROM range(1, least(5, {len(fx.STATIC_COLUMNS)}) + 1) t(component)",
)
def static_pca(spark: SparkSession, d: str) -> DataFrame:
    """Per component: its share is the variance of its values over that of all columns, loadings are orthonormal, shares fall."""
    out, shares, loadings = st.components(_complete_statics(spark, d), fx.STATIC_COLUMNS, 5)
    gram = np.array(loadings) @ np.array(loadings).T
    off = np.abs(gram - np.eye(len(shares))).max(axis=1)
    rows = [(i + 1, shares[i], bool(off[i] < 1e-9)) for i in range(len(shares))]
    measured = out.agg(*[F.var_pop(f"poi_pca_component_{i + 1}").alias(str(i + 1)) for i in range(len(shares))])
    measured = measured.unpivot([], measured.columns, "component", "measured_variance")
    table = spark.createDataFrame(rows, "component int, variance_share double, orthonormal boolean")
    joined = table.join(measured.withColumn("component", F.col("component").cast("int")), "component")
    # Standardised columns have a variance of one each, so the total is their number.
    whole = float(len(fx.STATIC_COLUMNS))
    before = F.lag("variance_share").over(Window.orderBy("component"))
    return joined.select(
        "component", (F.abs(F.col("measured_variance") / whole - F.col("variance_share")) < 1e-6).alias("share_is_measured"), "orthonormal",
        F.coalesce(F.col("variance_share") <= before, F.lit(True)).alias("falling"),
    )


# --- models ----------------------------------------------------------------

FEATURES = ["month", "quarter", "amount_lag1", "amount_lag12", "amount_roll6_mean", "missing_lag1", "missing_lag12"]
# Sizes of the fitted ensembles; the jobs take theirs from their options.
BOOSTED = {"maxIter": 20, "maxDepth": 3}
FOREST = {"numTrees": 20, "maxDepth": 5}
_FOLD_ROWS = """
r AS (SELECT f.fold, c.sector_id, c.panel_month FROM cells c JOIN folds f ON c.panel_month BETWEEN f.valid_start AND f.valid_end),
k AS (SELECT fold, COUNT(*) AS n FROM r GROUP BY fold)"""


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows with features from earlier months only."""
    df = fx.past_features(spark, d).withColumns(
        {"missing_lag1": F.col("amount_lag1").isNull().cast("int"), "missing_lag12": F.col("amount_lag12").isNull().cast("int")}
    )
    return df.withColumns(seasonality(MONTH))


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_model_rows(spark, d), "model_rows")


def observed(spark: SparkSession, d: str) -> DataFrame:
    """The rows with a target, written alone: folds read them many times, and most of the grid is empty."""
    return materialize(fo.training_rows(_model_rows(spark, d), fx.END, "amount"), "observed")


def _importance(spark: SparkSession, d: str) -> DataFrame:
    return le.fold_importance(observed(spark, d), fx.FOLDS, FEATURES, "amount", BOOSTED)


@query("feature_importance", f"SELECT fold, {len(FEATURES)}::BIGINT AS features, TRUE AS shares_sum_to_one, TRUE AS none_negative FROM folds", ("folds",))
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Gain shares of boosted trees on every fold: all features, none negative, summing to one."""
    return _importance(spark, d).groupBy("fold").agg(
        F.count_distinct("feature").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("shares_sum_to_one"),
        (F.min("importance") >= 0).alias("none_negative"),
    )


@query("importance_mean", "SELECT rank::INTEGER AS rank, TRUE AS falling, rank = {0} AS is_whole FROM range(1, {0} + 1) t(rank)".format(len(FEATURES)))
def importance_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean shares in falling order; with the last rank all of the importance is covered."""
    ranked = sr.rank_features(sr.mean_importance(_importance(spark, d)))
    before = F.lag("importance").over(Window.orderBy("rank"))
    return ranked.select(
        "rank", F.coalesce(F.col("importance") <= before, F.lit(True)).alias("falling"),
        (F.lead("rank").over(Window.orderBy("rank")).isNull() & (F.abs(F.col("cumulative_share") - 1) < 1e-9)).alias("is_whole"),
    )


@query(
    "fold_scores",
    ", " + _FOLD_ROWS + """
SELECT model, fold, n AS row_count, TRUE AS score_in_range, TRUE AS weights_average_one
FROM k CROSS JOIN (VALUES ('boosted_scaled'), ('random_forest')) m(model)""",
    ("cells", "folds"),
)
def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two learners fitted and scored on every fold with in-fold encoding: each validation row once."""
    rows = observed(spark, d)
    parts = [
        le.fold_predictions(rows, fx.FOLDS, learner, [*FEATURES, "sector_id_te"], "amount", params)
        for learner, params in (("boosted_scaled", BOOSTED), ("random_forest", FOREST))
    ]
    found = materialize(le.stacked(parts), "fold_predictions")
    scored = ev.scores(found, ["model", "fold"])
    counted = found.groupBy("model", "fold").agg(
        F.count_distinct(KEY, MONTH).alias("row_count"), (F.abs(F.avg("weights") - 1) < 1e-9).alias("weights_average_one")
    )
    return counted.join(scored, ["model", "fold"]).select(
        "model", "fold", "row_count", F.col("score").between(0, 1).alias("score_in_range"), "weights_average_one"
    )


@query(
    "param_search",
    "SELECT trial::INTEGER AS trial, fold, TRUE AS score_in_range, TRUE AS best_is_highest FROM folds CROSS JOIN range(3) t(trial)",
    ("folds",),
)
def param_search(spark: SparkSession, d: str) -> DataFrame:
    """Three seeded random settings on every fold; the best trial has the highest mean score."""
    space = {"maxDepth": {"type": "int", "low": 2, "high": 4}, "stepSize": {"type": "loguniform", "low": 0.05, "high": 0.3},
             "maxIter": {"type": "categorical", "choices": [5, 10]}}
    rows = observed(spark, d)
    history = le.search(rows, fx.FOLDS, "boosted", FEATURES, "amount", le.sample_params(space, 3))
    best = le.best_trial(history).first()
    means = {r.trial: r.m for r in history.groupBy("trial").agg(F.avg("score").alias("m")).collect()}
    highest = abs(means[best.trial] - max(means.values())) < 1e-12
    return history.select("trial", "fold", F.col("score").between(0, 1).alias("score_in_range"), F.lit(highest).alias("best_is_highest"))


@query(
    "final_fit",
    f"SELECT COUNT(*) AS row_count, COUNT(*) AS equal_rows, TRUE AS none_negative FROM cells WHERE panel_month <= DATE '{fx.TRAIN_END}'",
    ("cells",),
)
def final_fit(spark: SparkSession, d: str) -> DataFrame:
    """Refit on all training rows, saved and loaded: both give the same forecasts."""
    rows = model_rows(spark, d)
    train = fo.training_rows(rows, fx.TRAIN_END, "amount")
    path = scratch_path(spark, "model")
    fitted = le.final_fit(train, "boosted_scaled", FEATURES, "amount", BOOSTED, fx.TRAIN_END, path=path)
    loaded = PipelineModel.load(path)
    both = le.predict(loaded, le.predict(fitted, train, FEATURES, "fitted"), FEATURES, "loaded")
    return both.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("fitted") == F.col("loaded")).alias("equal_rows"),
        (F.min("fitted") >= 0).alias("none_negative"),
    )


@query(
    "score_horizon",
    f"SELECT sector_id, panel_month, TRUE AS boosted_scored, TRUE AS forest_scored FROM panel WHERE panel_month >= DATE '{fx.HORIZON}'",
    ("panel",),
)
def score_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Saved models on the horizon rows, one column per model."""
    rows = model_rows(spark, d)
    train = fo.training_rows(rows, fx.TRAIN_END, "amount")
    models = {}
    for name, params in (("boosted", BOOSTED), ("random_forest", FOREST)):
        path = scratch_path(spark, name)
        le.final_fit(train, name, FEATURES, "amount", params, fx.TRAIN_END, path=path)
        models[name] = PipelineModel.load(path)
    horizon = fc.horizon_rows(rows, fx.HORIZON_MONTHS)
    scored = le.score_horizon(horizon, models, FEATURES)
    ok = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    return scored.select(KEY, MONTH, ok("pred_boosted").alias("boosted_scored"), ok("pred_random_forest").alias("forest_scored"))
