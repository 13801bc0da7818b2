"""Tree models on Spark ML: folds, search, refit, scoring.

Each fit is a distributed job over the fold's rows; a few independent fits run
at once from driver threads, as Spark's own cross-validation does.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import LOG_EPSILON, absolute_percentage_error, floored, inverse_log_target, log_target
from ..session import materialize, path_exists
from .evaluation import scores
from .folds import Decay, Fold, add_decay_weights, assigned, category_means, encode, encode_out_of_fold, encoding_default

LABEL, FEATURES, RAW = "_label", "_features", "_raw"

# The learners on offer: estimator class, and whether inputs are standardised.
LEARNERS = {
    "boosted": (GBTRegressor, False),
    "boosted_scaled": (GBTRegressor, True),
    "random_forest": (RandomForestRegressor, False),
}


@dataclass(frozen=True)
class TargetRule:
    """What the learners see of the target and how forecasts are read back.

    ``log`` fits on the logarithm of the target plus ``epsilon``; ``minimum`` is the least forecast, None for no limit.
    """

    log: bool = True
    epsilon: float = LOG_EPSILON
    minimum: float | None = 0.0

    def label(self, target: str) -> Column:
        return log_target(target, self.epsilon) if self.log else F.col(target).cast("double")

    def forecast(self, raw: str) -> Column:
        if not self.log:
            value = F.col(raw)
        elif self.minimum is None:
            value = F.exp(F.col(raw)) - F.lit(self.epsilon)
        else:
            value = inverse_log_target(raw, self.epsilon)
        return value if self.minimum is None else floored(value, self.minimum)


# How categories are encoded: validation rows by the means of all training rows, training rows by these too
# ("in_fold") or by those of the other parts of the training rows ("out_of_fold"), or not at all.
ENCODINGS = ("in_fold", "out_of_fold", "none")


#: Settings under which rows that fall into the same bins are all one to boosted trees: squared loss, no draw of rows,
#: no count of rows in a leaf.
MERGEABLE = {"maxIter", "maxDepth", "stepSize", "maxBins", "minInfoGain", "minWeightFractionPerNode", "featureSubsetStrategy"}
_LEAST_BINS, _ACCURACY = 8, 1000


def build_pipeline(learner: str, features: Sequence[str], params: Mapping[str, object], seed: int = 42) -> Pipeline:
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}")
    estimator, scale = LEARNERS[learner]
    # Empty numeric cells reach the trees as 0; the missing_* flags mark them.
    stages = [VectorAssembler(inputCols=list(features), outputCol=FEATURES if not scale else "_assembled")]
    if scale:
        stages.append(StandardScaler(inputCol="_assembled", outputCol=FEATURES, withMean=True, withStd=True))
    weighted = estimator(featuresCol=FEATURES, labelCol=LABEL, predictionCol=RAW, weightCol="weights", seed=seed)
    return Pipeline(stages=[*stages, weighted.setParams(**params)])


def _bin(place: int) -> str:
    return f"_bin_{place}"


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Edges of at most ``bins`` bins for each feature, by quantiles and in one pass; 0, which stands for empty, is a bin of its own."""
    shares = [i / (bins - 2) for i in range(1, bins - 2)]
    found = rows.agg(*[
        F.percentile_approx(F.when(F.col(f) != 0, F.col(f).cast("double")), shares, _ACCURACY).alias(str(i)) for i, f in enumerate(features)
    ]).first()
    zero = [0.0, math.ulp(0.0)]
    return [[-math.inf, *sorted({*zero, *(found[i] or [])}), math.inf] for i in range(len(features))]


def fit_boosted(rows: DataFrame, learner: str, features: Sequence[str], params: Mapping[str, object], seed: int) -> PipelineModel:
    """Boosted trees on the bins of the features, from one weighted row for each set of bins.

    Trees split between bins only, so rows of equal bins take the same way through all trees, and with squared
    loss their total weight and weighted mean say all about them: the trees are those of the single rows. There
    are never more merged rows than rows. The bins are stages of the model.
    """
    names = [_bin(i) for i in range(len(features))]
    edges = bin_edges(rows, features, int(params.get("maxBins", 32)))
    bins = Bucketizer(inputCols=list(features), outputCols=names, splitsArray=edges)
    binned = bins.transform(rows)
    *first, trees = build_pipeline(learner, names, params, seed).getStages()
    prepare = Pipeline(stages=first).fit(binned)  # a scaler sees every row
    weight = F.sum("weights")
    # Plain numbers: trees would take bins that are marked as nominal for categories without an order.
    numbers = [(F.col(n) + F.lit(0.0)).alias(n) for n in names]
    merged = binned.groupBy(*numbers).agg(weight.alias("weights"), (F.sum(F.col("weights") * F.col(LABEL)) / F.nullif(weight, F.lit(0.0))).alias(LABEL))
    merged = materialize(merged.where(F.col("weights") > 0), "merged_rows")
    return PipelineModel(stages=[bins, *prepare.stages, trees.fit(prepare.transform(merged))])


def fit_rows(rows: DataFrame, learner: str, features: Sequence[str], params: Mapping[str, object], seed: int) -> PipelineModel:
    """Fit on prepared rows with label and weights."""
    if LEARNERS[learner][0] is GBTRegressor and set(params) <= MERGEABLE and int(params.get("maxBins", 32)) >= _LEAST_BINS:
        return fit_boosted(rows, learner, features, params, seed)
    return build_pipeline(learner, features, params, seed).fit(rows)


def prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(features))


def fit(
    df: DataFrame, learner: str, features: Sequence[str], target: str, params: Mapping[str, object], seed: int = 42,
    rule: TargetRule = TargetRule(),
) -> PipelineModel:
    """Fit on the target, by default its log, with the rows' ``weights``; rows without a target are dropped."""
    rows = prepared(df.where(F.col(target).isNotNull()), features).withColumn(LABEL, rule.label(target))
    return fit_rows(rows, learner, features, params, seed)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], output: str, rule: TargetRule = TargetRule()) -> DataFrame:
    """``rule`` is the one that the model was fitted with."""
    scored = model.transform(prepared(df, features))
    return scored.withColumn(output, rule.forecast(RAW)).drop(RAW, FEATURES, "_assembled", *[_bin(i) for i in range(len(features))])


def fold_part(
    df: DataFrame, fold: Fold, role: str, decay: Decay, column: str, target: str, unknown: float | str = 0.0, encoding: str = "in_fold"
) -> DataFrame:
    """One fold's training or validation rows, encoded on its training rows, weighted.

    ``unknown`` is what a category without training rows is encoded as, a number
    or a statistic of the fold's training rows. ``encoding`` is one of ``ENCODINGS``.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    if encoding == "none":
        return add_decay_weights(assigned(df, [fold], role), decay, F.col("reference_month"), by=["fold"])
    train = assigned(df, [fold], "train")
    means = category_means(train, column, target)
    default = encoding_default(train, target, unknown)
    part = train if role == "train" else assigned(df, [fold], "valid")
    weighted = add_decay_weights(part, decay, F.col("reference_month"), by=["fold"])
    if role == "train" and encoding == "out_of_fold":
        return encode_out_of_fold(weighted, column, target, f"{column}_te", default)
    return encode(weighted, means, column, f"{column}_te", default)


def fold_tables(
    df: DataFrame, folds: Sequence[Fold], target: str, decay: Decay = Decay(), column: str = "sector_id", unknown: float | str = 0.0,
    encoding: str = "in_fold",
) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Encoded, weighted training and validation rows by fold, written once for any number of fits."""
    made = {}
    for fold in folds:
        parts = (fold_part(df, fold, role, decay, column, target, unknown, encoding) for role in ("train", "valid"))
        made[fold.fold] = tuple(materialize(p, f"fold_{fold.fold}") for p in parts)
    return made


def fold_predictions(
    df: DataFrame, folds: Sequence[Fold], learner: str, features: Sequence[str], target: str,
    params: Mapping[str, object], decay: Decay = Decay(), column: str = "sector_id", seed: int = 42,
    parallelism: int = 2, unknown: float | str = 0.0, tables: Mapping[int, tuple[DataFrame, DataFrame]] | None = None,
    rule: TargetRule = TargetRule(), encoding: str = "in_fold",
) -> DataFrame:
    """Validation predictions of all folds: one fitted model per fold, rows stacked.

    ``tables`` are those of ``fold_tables``, made here if not given.
    """
    made = fold_tables(df, folds, target, decay, column, unknown, encoding) if tables is None else tables

    def one(fold: Fold) -> DataFrame:
        train, valid = made[fold.fold]
        model = fit(train, learner, features, target, params, seed, rule)
        scored = predict(model, valid, features, "y_pred", rule)
        return scored.select(
            F.lit(learner).alias("model"),
            "fold",
            "sector_id",
            "panel_month",
            F.col(target).alias("y_true"),
            "y_pred",
            absolute_percentage_error(target, "y_pred").alias("ape"),
            "weights",
        )

    with ThreadPool(min(parallelism, len(folds))) as pool:
        return stacked(pool.map(one, folds))


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts, matched by column name."""
    return reduce(DataFrame.unionByName, parts)


def fold_importance(
    df: DataFrame, folds: Sequence[Fold], features: Sequence[str], target: str, params: Mapping[str, object],
    seed: int = 42, parallelism: int = 2,
) -> DataFrame:
    """``(fold, feature, importance)`` of boosted trees on the raw target."""

    def one(fold: Fold) -> list[tuple[int, str, float]]:
        rows = assigned(df.where(F.col(target).isNotNull()), [fold], "train")
        rows = prepared(rows, features).withColumns({LABEL: F.col(target), "weights": F.lit(1.0)})
        model = fit_rows(rows, "boosted", features, params, seed).stages[-1]
        return [(fold.fold, f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]

    with ThreadPool(min(parallelism, len(folds))) as pool:
        found = [row for rows in pool.map(one, folds) for row in rows]
    return df.sparkSession.createDataFrame(found, "fold int, feature string, importance double")


def sample_params(space: Mapping[str, Mapping[str, object]], trials: int, seed: int = 42) -> list[dict[str, object]]:
    """A reproducible random table of parameter settings, one per trial.

    Kinds: ``int`` and ``uniform`` (low, high), ``loguniform`` (low, high),
    ``categorical`` (choices).
    """
    rng = random.Random(seed)

    def draw(spec: Mapping[str, object]) -> object:
        kind = spec["type"]
        if kind == "int":
            return rng.randint(int(spec["low"]), int(spec["high"]))
        if kind == "uniform":
            return rng.uniform(float(spec["low"]), float(spec["high"]))
        if kind == "loguniform":
            return math.exp(rng.uniform(math.log(float(spec["low"])), math.log(float(spec["high"]))))
        if kind == "categorical":
            return rng.choice(list(spec["choices"]))
        raise ValueError(f"unknown parameter type {kind!r}")

    return [{name: draw(spec) for name, spec in space.items()} for _ in range(trials)]


def _named(params: Mapping[str, object]) -> dict[str, str]:
    return {name: str(value) for name, value in params.items()}


TRIAL = "trial int, fold int, score double, bad_ratio double, params map<string,string>"
LOGGED = "learner string, data_version string, setting string, fold int, score double, bad_ratio double"


def setting_key(params: Mapping[str, object], seed: int) -> str:
    """The same for equal settings, whatever the order of their names."""
    return json.dumps({"seed": seed, **params}, sort_keys=True, default=str)


def logged_scores(spark: SparkSession, log: str | None, learner: str, data_version: str) -> dict[tuple[str, int], tuple[float, float]]:
    """Scores by setting and fold that earlier runs on the same data left in the log; one row for each fit."""
    if log is None or not path_exists(spark, log):
        return {}
    rows = spark.read.schema(LOGGED).parquet(log).where((F.col("learner") == learner) & (F.col("data_version") == data_version))
    return {(r.setting, r.fold): (r.score, r.bad_ratio) for r in rows.collect()}


def halving_rounds(trials: int, folds: int, keep: float | None) -> list[tuple[int, int]]:
    """``(trials, folds)`` still in the race round by round: the share ``keep`` of the trials goes on to about as many more folds.

    Without ``keep`` there is one round over all folds.
    """
    if keep is None or folds == 1 or trials == 1:
        return [(trials, folds)]
    rounds, left, seen = [], trials, 1
    while seen < folds:
        rounds.append((left, seen))
        left, seen = max(1, math.ceil(left * keep)), min(folds, max(seen + 1, round(seen / keep)))
    return [*rounds, (left, folds)]


def search(
    df: DataFrame, folds: Sequence[Fold], learner: str, features: Sequence[str], target: str,
    settings: Sequence[Mapping[str, object]], decay: Decay = Decay(), seed: int = 42, unknown: float | str = 0.0,
    tables: Mapping[int, tuple[DataFrame, DataFrame]] | None = None, rule: TargetRule = TargetRule(), encoding: str = "in_fold",
    log: str | None = None, data_version: str = "", keep: float | None = None, parallelism: int = 2,
) -> DataFrame:
    """``(trial, fold, score, bad_ratio, params)`` for every setting on every fold that it was tried on.

    With ``keep`` the folds are run in turn, the latest first, and only that share of the trials, by mean
    score so far and the earlier of equals, goes on; the others keep the rows of the folds they had.
    ``log`` is an append-only table of scores by learner, setting, fold and ``data_version``: what it
    holds is not fitted again, each fit is appended as it ends, so a search that was stopped goes on.
    Fits of several settings and folds run side by side.
    """
    spark = df.sparkSession
    known, made = logged_scores(spark, log, learner, data_version), dict(tables or {})
    latest_first, appending = sorted(folds, key=lambda f: f.fold, reverse=True), Lock()

    def table_of(fold: Fold) -> tuple[DataFrame, DataFrame]:
        if fold.fold not in made:
            made.update(fold_tables(df, [fold], target, decay, unknown=unknown, encoding=encoding))
        return made[fold.fold]

    def one(job: tuple[int, Fold]) -> None:
        params, fold = settings[job[0]], job[1]
        predictions = fold_predictions(df, [fold], learner, features, target, params, decay, seed=seed, tables=made, rule=rule)
        # Scored at once: only a row is kept of a fit, not its model.
        row = scores(predictions, ["fold"]).first()
        known[setting_key(params, seed), fold.fold] = (row.score, row.bad_ratio)
        if log is not None:
            line = (learner, data_version, setting_key(params, seed), fold.fold, row.score, row.bad_ratio)
            with appending:  # two writers at once would clear away each other's drafts
                spark.createDataFrame([line], LOGGED).coalesce(1).write.mode("append").parquet(log)

    racing, found = list(range(len(settings))), {}
    for left, seen in halving_rounds(len(settings), len(folds), keep):
        if found:
            means = {t: sum(found[t, f.fold][0] for f in latest_first if (t, f.fold) in found) / sum((t, f.fold) in found for f in latest_first) for t in racing}
            racing = sorted(sorted(racing), key=lambda t: -means[t])[:left]
        jobs = {}
        for fold in latest_first[:seen]:
            for trial in sorted(racing):
                key = setting_key(settings[trial], seed), fold.fold
                if key not in known:
                    jobs.setdefault(key, (trial, fold))
        for fold in latest_first[:seen]:
            if any(f == fold for _, f in jobs.values()):
                table_of(fold)
        if jobs:
            with ThreadPool(min(parallelism, len(jobs))) as pool:
                pool.map(one, jobs.values(), chunksize=1)
        found |= {(t, f.fold): known[setting_key(settings[t], seed), f.fold] for t in racing for f in latest_first[:seen]}
    rows = [(t, fold, *score, _named(settings[t])) for (t, fold), score in sorted(found.items())]
    return spark.createDataFrame(rows, TRIAL)


def best_trial(history: DataFrame) -> DataFrame:
    """The trial with the highest mean score among those that ran on the most folds; the earliest of equals."""
    means = history.groupBy("trial").agg(F.avg("score").alias("score"), F.count("*").alias("_folds"))
    means = means.withColumn("_most", F.max("_folds").over(Window.partitionBy(F.lit(0)))).where("_folds = _most")  # a row for each trial
    return means.agg(
        F.max_by("trial", F.struct("score", -F.col("trial"))).alias("trial"), F.max("score").alias("score")
    )


def final_fit(
    df: DataFrame, learner: str, features: Sequence[str], target: str, params: Mapping[str, object], train_end: str,
    decay: Decay = Decay(), path: str | None = None, seed: int = 42, rule: TargetRule = TargetRule(),
) -> PipelineModel:
    """Fit on all training rows and save; the scaler is part of the saved model."""
    model = fit(add_decay_weights(df, decay, train_end), learner, features, target, params, seed, rule)
    if path:
        model.write().overwrite().save(path)
    return model


def score_horizon(df: DataFrame, models: Mapping[str, PipelineModel], features: Sequence[str], rule: TargetRule = TargetRule()) -> DataFrame:
    """``pred_<model>`` for every saved model on the horizon rows."""
    for name, model in models.items():
        df = predict(model, df, features, f"pred_{name}", rule)
    return df
