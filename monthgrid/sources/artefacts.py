"""Small tables that one job leaves for the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.statics import ClusterModel, ComponentModel, StaticModel


def write_sector_index(index: DataFrame, path: str) -> None:
    """``(sector_label, sector_id)`` in order of the id."""
    index.select("sector_label", "sector_id").orderBy("sector_id").write.mode("overwrite").parquet(path)


def read_sector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sector_label string, sector_id bigint").parquet(path)


def write_encoding(means: DataFrame, default: float, path: str) -> None:
    """Category means; the default travels with every row's file as a column."""
    means.withColumn("default_value", F.lit(float(default))).write.mode("overwrite").parquet(path)


def read_encoding(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    table = spark.read.parquet(path)
    return table.drop("default_value"), float(table.select("default_value").first()[0])


def write_weights(spark: SparkSession, models: Sequence[str], weights: Sequence[float], path: str) -> None:
    rows = [(i, m, float(w)) for i, (m, w) in enumerate(zip(models, weights, strict=True))]
    spark.createDataFrame(rows, "position int, model string, weight double").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def read_weights(spark: SparkSession, path: str) -> tuple[list[str], list[float]]:
    """Models and weights in their stored order; one row per model."""
    rows = spark.read.parquet(path).orderBy("position").collect()
    return [r.model for r in rows], [r.weight for r in rows]


RULE = "log boolean, epsilon double, minimum double"


def write_rule(spark: SparkSession, log: bool, epsilon: float, minimum: float | None, path: str) -> None:
    """How the learners' target was made, which their forecasts have to undo."""
    spark.createDataFrame([(log, float(epsilon), minimum)], RULE).coalesce(1).write.mode("overwrite").parquet(path)


def read_rule(spark: SparkSession, path: str) -> tuple[bool, float, float | None]:
    return tuple(spark.read.schema(RULE).parquet(path).first())


def write_components(spark: SparkSession, columns: Sequence[str], shares: Sequence[float], loadings: Sequence[Sequence[float]], path: str) -> None:
    """``(component, variance_share, column, loading)``; bounded by the columns' number."""
    rows = [(i + 1, shares[i], c, v) for i, row in enumerate(loadings) for c, v in zip(columns, row)]
    table = spark.createDataFrame(rows, "component int, variance_share double, column string, loading double")
    table.coalesce(1).write.mode("overwrite").parquet(path)


#: A number of a stored static model: by part, cluster or component (``row``) and column, in order.
STATIC_MODEL = "part string, row int, position int, column string, value double"


def write_static_model(spark: SparkSession, model: StaticModel, path: str) -> None:
    """One row for each number of the model; bounded by the columns' number times that of clusters and components."""
    clusters, parts = model.clusters, model.components
    lists = {"median": clusters.medians, "mean": clusters.means, "deviation": clusters.deviations,
             "filled_mean": parts.means, "filled_deviation": parts.deviations}
    grids = {"centre": clusters.centres, "cluster_median": model.cluster_medians, "loading": parts.loadings}
    grids |= {name: [values] for name, values in lists.items()}
    rows = [
        (part, i, j, column, value)
        for part, grid in grids.items() for i, values in enumerate(grid)
        for j, (column, value) in enumerate(zip(clusters.columns, values, strict=True))
    ]
    rows += [("share", i, 0, None, value) for i, value in enumerate(parts.shares)]
    spark.createDataFrame(rows, STATIC_MODEL).coalesce(1).write.mode("overwrite").parquet(path)


def read_static_model(spark: SparkSession, path: str) -> StaticModel:
    """The model as it was written, number for number."""
    found: dict[str, list[list]] = {}
    columns = []
    for r in spark.read.schema(STATIC_MODEL).parquet(path).orderBy("part", "row", "position").collect():
        grid = found.setdefault(r.part, [])
        if r.row == len(grid):
            grid.append([])
        grid[r.row].append(r.value)
        if r.part == "median":
            columns.append(r.column)
    single = {part: grid[0] for part, grid in found.items() if grid}
    shares = [values[0] for values in found["share"]]
    clusters = ClusterModel(columns, single["median"], single["mean"], single["deviation"], found["centre"])
    parts = ComponentModel(columns, single["filled_mean"], single["filled_deviation"], shares, found["loading"])
    return StaticModel(clusters, found["cluster_median"], parts)


def write_features(spark: SparkSession, features: Sequence[str], path: str) -> None:
    """One feature name per line, in order."""
    spark.createDataFrame([(f,) for f in features], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> list[str]:
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def model_features(listed: Sequence[str], target: str, encoded: str | None = None) -> list[str]:
    """The listed features without the target, first occurrences, then the encoded column."""
    wanted = [name for name in listed if name != target] + ([encoded] if encoded else [])
    return list(dict.fromkeys(wanted))


def numeric_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that exist in ``df`` with a numeric type; none is an error."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    kept = [f for f in features if f in numeric]
    if not kept:
        raise ValueError("no numeric feature left")
    return kept


def project_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Keys and features in order; features the table lacks are 0."""
    return df.select(
        *keys, *[F.col(f"`{f}`") if f in df.columns else F.lit(0.0).alias(f) for f in features if f not in keys]
    )


def trial_history(fold_scores: DataFrame, params: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """One row per trial: mean score, parameters, and score and bad share per fold."""
    per_fold = []
    for f in folds:
        here = F.col("fold") == f
        per_fold.append(F.max(F.when(here, F.col("score"))).alias(f"fold{f}_score"))
        per_fold.append(F.max(F.when(here, F.col("bad_ratio"))).alias(f"fold{f}_bad_ratio"))
    return fold_scores.groupBy("trial").agg(
        F.avg("score").alias("score"), *[F.max(p).alias(f"param_{p}") for p in params], *per_fold
    )
