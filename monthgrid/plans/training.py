"""Second job: the selected panel to saved models, encoding and blend weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blending, evaluation, folds, learners
from ..session import materialize
from ..sources import artefacts, sinks

KEY, MONTH = "sector_id", "panel_month"


@dataclass(frozen=True)
class TrainingResult:
    history: DataFrame
    predictions: DataFrame
    summary: DataFrame
    candidates: DataFrame
    weights: dict[str, float]
    score: float
    uniform_score: float


def train(
    panel: DataFrame,
    listed_features: Sequence[str],
    target: str,
    train_end: str,
    bounds: Sequence[tuple[str, str, str]],
    settings: Mapping[str, Sequence[Mapping[str, object]]],
    out_dir: str,
    minimum_months: int = 18,
    decay: folds.Decay = folds.Decay(),
    unknown: float | str = 0.0,
    steps: int = 20,
    seed: int = 42,
    weight_bounds: tuple[float, float] = (0.0, 1.0),
    rule: learners.TargetRule = learners.TargetRule(),
    encoding: str = "in_fold",
    trial_log: str | None = None,
    data_version: str = "",
    keep: float | None = None,
) -> TrainingResult:
    """Search each learner's settings on the folds, refit the best, weigh the blend.

    ``rule`` says whether the target is fitted as a logarithm and how forecasts are limited; it is stored
    with the models. ``encoding`` is ``in_fold``, ``out_of_fold`` or ``none``. ``trial_log``, ``data_version``
    and ``keep`` make the search resumable and prune it (see ``learners.search``).

    ``settings`` maps a learner to the parameter settings to try. Models, the
    encoding, the features and the weights go to ``out_dir``, as do the trials, the
    validation predictions of the best trials, alone and blended, and the scores.
    """
    spark = panel.sparkSession
    rows = materialize(folds.training_rows(panel, train_end, target), "training_rows")
    usable = folds.usable_folds(rows, folds.numbered_folds(bounds), target, minimum_months)
    encoded = f"{KEY}_te"
    if encoding not in learners.ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    features = artefacts.model_features(listed_features, target, encoded if encoding != "none" else None)
    means = folds.category_means(rows, KEY, target)
    default = folds.encoding_default(rows, target, unknown)
    artefacts.write_encoding(means, default, f"{out_dir}/encoding")
    artefacts.write_rule(spark, rule.log, rule.epsilon, rule.minimum, f"{out_dir}/target_rule")
    if encoding == "out_of_fold":
        full = folds.encode_out_of_fold(rows, KEY, target, encoded, default)
    else:
        full = folds.encode(rows, artefacts.read_encoding(spark, f"{out_dir}/encoding")[0], KEY, encoded, default)
    features = artefacts.numeric_features(full, features)
    histories, predictions = [], []
    made = learners.fold_tables(rows, usable, target, decay, unknown=unknown, encoding=encoding)
    for learner, tried in settings.items():
        history = learners.search(
            rows, usable, learner, features, target, tried, decay, seed, unknown, made, rule, encoding, trial_log, data_version, keep
        )
        history = materialize(history, "trials")
        best = tried[learners.best_trial(history).first().trial]
        found = learners.fold_predictions(rows, usable, learner, features, target, best, decay, seed=seed, tables=made, rule=rule)
        predictions.append(materialize(found, "fold_predictions"))
        learners.final_fit(full, learner, features, target, best, train_end, decay, f"{out_dir}/{learner}", seed, rule)
        histories.append(history.select(F.lit(learner).alias("model"), "*"))
    stacked, history = predictions[0], histories[0]
    for more, trials in zip(predictions[1:], histories[1:]):
        stacked, history = stacked.unionByName(more), history.unionByName(trials)
    models = list(settings)
    wide = materialize(blending.merge_predictions(stacked, models), "wide_predictions")
    if wide.isEmpty():
        raise ValueError("no row has a prediction of every model")
    candidates = materialize(blending.candidate_scores(wide, models, steps, weight_bounds), "candidates")
    weights, score = blending.search_weights(wide, models, steps, bounds=weight_bounds, line_rounds=20)
    artefacts.write_weights(spark, models, list(weights.values()), f"{out_dir}/weights")
    artefacts.write_features(spark, features, f"{out_dir}/features")
    equal = blending.uniform_score(wide, models).first()[0]
    blends = {"pred_ensemble": blending.blended(models, list(weights.values())), "pred_uniform": blending.blended(models, [])}
    sinks.write_parquet(history, f"{out_dir}/trials")
    sinks.write_parquet(stacked, f"{out_dir}/validation")
    sinks.write_parquet(wide.withColumns(blends), f"{out_dir}/validation_blended")
    sinks.write_parquet(spark.createDataFrame([(score, equal)], "score double, uniform_score double"), f"{out_dir}/blend_score")
    return TrainingResult(
        history,
        stacked,
        evaluation.summarize(stacked, ["model", "fold"]),
        candidates,
        weights,
        score,
        equal,
    )
