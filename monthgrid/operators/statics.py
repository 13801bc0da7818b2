"""Static sector attributes: scaling, clusters, imputation, components.

All of these work on one row per sector. On a dense panel
each sector repeats the same number of times, so means, population deviations
and explained-variance shares are the same as over all panel rows.

What is fitted is kept in small models (columns x clusters numbers) that apply to any table by
plain column expressions, to sectors not seen in the fit too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .impute import column_medians
from .quantiles import exact_quantiles, unpivoted
from .series import add_ratios

ROUNDS = 20


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[list[float | None], list[float]]:
    """Mean and population deviation of each column, nulls ignored; a constant's deviation counts as 1."""
    wanted = [m for c in columns for m in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_dev"))]
    row = df.agg(*wanted).first()
    return [row[f"{c}_mean"] for c in columns], [row[f"{c}_dev"] or 1.0 for c in columns]


def _scaled(columns: Sequence[str], means: Sequence[float | None], deviations: Sequence[float], fills: Sequence[float | None] | None = None) -> list[Column]:
    cells = [F.coalesce(c, F.lit(v).cast("double")) for c, v in zip(columns, fills)] if fills else [F.col(c) for c in columns]
    return [(c - F.lit(m).cast("double")) / F.lit(d) for c, m, d in zip(cells, means, deviations)]


def standardized(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Zero mean, unit population deviation, nulls ignored; constants are only centred."""
    return df.withColumns(dict(zip([c + suffix for c in columns], _scaled(columns, *moments(df, columns)))))


# --- clusters --------------------------------------------------------------


@dataclass(frozen=True)
class ClusterModel:
    """Centres in scaled units, with the medians and moments that lead there."""

    columns: list[str]
    medians: list[float | None]
    means: list[float | None]
    deviations: list[float]
    centres: list[list[float]]

    def point(self) -> list[Column]:
        """A row's scaled columns; a column that had no value at all in the fit counts as 0."""
        return [F.coalesce(c, F.lit(0.0)) for c in _scaled(self.columns, self.means, self.deviations, self.medians)]


def _square(point: Sequence[Column], centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for x, v in zip(point, centre):
        total = total + (x - F.lit(v)) * (x - F.lit(v))
    return total


def _squares(point: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    return F.array(*[_square(point, centre) for centre in centres])


def _nearest(point: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """Position of the nearest centre, the first of several."""
    squares = _squares(point, centres)
    return (F.array_position(squares, F.array_min(squares)) - 1).cast("int")


def fit_clusters(df: DataFrame, columns: Sequence[str], k: int = 4, rounds: int = ROUNDS, key: str = "sector_id") -> ClusterModel:
    """K-means on the median-filled, standardised columns, the same for the same rows in any order.

    The first centre is the row farthest from the mean, each further one the row farthest from the
    centres so far, ties to the smaller key; at most ``rounds`` rounds of assigning and averaging
    follow, and a centre without rows stays. A round is one grouped aggregate of ``k`` rows. Centres
    are ordered by their coordinates. Fewer than ``k`` distinct rows give as many centres; an
    empty table gives one at the mean.
    """
    by_name = column_medians(df, columns)
    medians = [by_name[c] for c in columns]
    filled = df.select(*[F.coalesce(c, F.lit(v).cast("double")).alias(c) for c, v in zip(columns, medians)])
    model = ClusterModel(list(columns), medians, *moments(filled, columns), [])
    names = [f"x{i}" for i in range(len(columns))]
    rows = materialize(df.select(key, *[x.alias(n) for x, n in zip(model.point(), names)]), "static_points")
    point = [F.col(n) for n in names]
    centres: list[list[float]] = []
    while len(centres) < k:
        gap = F.array_min(_squares(point, centres or [[0.0] * len(names)]))
        top = rows.agg(F.max(F.struct(gap.alias("gap"), (-F.col(key)).alias("back"), *names)).alias("top")).first().top
        if top is None or (centres and top.gap == 0):
            break
        centres.append([top[n] for n in names])
    centres = centres or [[0.0] * len(names)]
    for _ in range(rounds):
        found = rows.groupBy(_nearest(point, centres).alias("label")).agg(*[F.avg(n).alias(n) for n in names]).collect()
        means = {r.label: [r[n] for n in names] for r in found}
        moved = [means.get(i, centre) for i, centre in enumerate(centres)]
        shift = max((abs(a - b) for new, old in zip(moved, centres) for a, b in zip(new, old)), default=0.0)
        centres = moved
        if shift < 1e-12:
            break
    return ClusterModel(model.columns, medians, model.means, model.deviations, sorted(centres))


def with_clusters(df: DataFrame, model: ClusterModel, output: str = "poi_cluster_id", distance: str | None = None) -> DataFrame:
    """The nearest stored centre of each row, and its squared distance if a name is given; no shuffle."""
    point = model.point()
    new = {output: _nearest(point, model.centres)}
    if distance:
        new[distance] = F.array_min(_squares(point, model.centres))
    return df.withColumns(new)


def add_clusters(df: DataFrame, columns: Sequence[str], k: int = 4, output: str = "poi_cluster_id") -> DataFrame:
    """Clusters fitted on ``df`` itself."""
    return with_clusters(df, fit_clusters(df, columns, k), output)


# --- imputation ------------------------------------------------------------


def _cluster_medians(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    long = exact_quantiles(unpivoted(df, [cluster], columns), [cluster, "metric"], "value")
    return long.groupBy(cluster).agg(*[F.max(F.when(F.col("metric") == c, F.col("quantile"))).alias(f"_{c}") for c in columns])


def _replaced(df: DataFrame, columns: Sequence[str], fills: Sequence[Column]) -> DataFrame:
    """Empty cells take their fill; ``imputed_poi_flag`` is 1 where any did."""
    new = {c: F.coalesce(c, fill) for c, fill in zip(columns, fills)}
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c).isNull() & new[c].isNotNull())
    return df.withColumns({"imputed_poi_flag": changed.cast("int"), **new})


def cluster_imputed(df: DataFrame, columns: Sequence[str], cluster: str = "poi_cluster_id") -> DataFrame:
    """Empty cells take their cluster's median, else the column's; flag any change."""
    overall = column_medians(df, columns)
    medians = materialize(_cluster_medians(df, columns, cluster), "cluster_medians")
    fills = [F.coalesce(f"_{c}", F.lit(overall[c]).cast("double")) for c in columns]
    return _replaced(df.join(medians, cluster, "left"), columns, fills).drop(*[f"_{c}" for c in columns])


# --- components ------------------------------------------------------------


@dataclass(frozen=True)
class ComponentModel:
    """Loadings on standardised columns, largest share first; each one's largest loading is positive."""

    columns: list[str]
    means: list[float | None]
    deviations: list[float]
    shares: list[float]
    loadings: list[list[float]]


def fit_components(df: DataFrame, columns: Sequence[str], count: int = 5) -> ComponentModel:
    """Principal components of the standardised columns."""
    count = min(count, len(columns))
    means, deviations = moments(df, columns)
    names = [f"x{i}" for i in range(len(columns))]
    scaled = df.select(*[x.alias(n) for x, n in zip(_scaled(columns, means, deviations), names)])
    vectors = VectorAssembler(inputCols=names, outputCol="_vector", handleInvalid="error").transform(scaled)
    model = PCA(k=count, inputCol="_vector", outputCol="_pca").fit(vectors)
    loadings = [[float(v) for v in row] for row in model.pc.toArray().T]
    loadings = [row if max(row, key=abs) > 0 else [-v for v in row] for row in loadings]
    return ComponentModel(list(columns), means, deviations, [float(v) for v in model.explainedVariance.toArray()], loadings)


def with_components(df: DataFrame, model: ComponentModel, prefix: str = "poi_pca_component_") -> DataFrame:
    """Components in place of their columns; a row with an empty column has none."""
    point = _scaled(model.columns, model.means, model.deviations)
    new = {}
    for i, row in enumerate(model.loadings):
        total = F.lit(0.0)
        for x, v in zip(point, row):
            total = total + x * F.lit(v)
        new[f"{prefix}{i + 1}"] = total
    return df.withColumns(new).drop(*model.columns)


def components(
    df: DataFrame, columns: Sequence[str], count: int = 5, prefix: str = "poi_pca_component_"
) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Components fitted on ``df`` itself, with the explained-variance shares and the loadings."""
    model = fit_components(df, columns, count)
    return with_components(df, model, prefix), model.shares, model.loadings


# --- the whole transform ---------------------------------------------------


@dataclass(frozen=True)
class StaticModel:
    """Clusters, each cluster's medians (NULL where it has no value) and components."""

    clusters: ClusterModel
    cluster_medians: list[list[float | None]]
    components: ComponentModel


def _filled(df: DataFrame, clusters: ClusterModel, medians: Sequence[Sequence[float | None]], cluster: str) -> DataFrame:
    """Labels each row and fills it from its cluster's medians, else from the column's."""
    fills = []
    for j, overall in enumerate(clusters.medians):
        known = F.array(*[F.lit(row[j]).cast("double") for row in medians])
        fills.append(F.coalesce(F.get(known, F.col(cluster)), F.lit(overall).cast("double")))
    return _replaced(with_clusters(df, clusters, cluster), clusters.columns, fills)


def fit_static_model(df: DataFrame, columns: Sequence[str], k: int = 4, count: int = 5, cluster: str = "poi_cluster_id") -> StaticModel:
    """Everything that ``apply_static_model`` needs, learned from one row per sector."""
    clusters = fit_clusters(df, columns, k)
    found = _cluster_medians(materialize(with_clusters(df, clusters, cluster), "static_clusters"), columns, cluster)
    known = {r[cluster]: [r[f"_{c}"] for c in columns] for r in found.collect()}
    medians = [known.get(i, [None] * len(columns)) for i in range(len(clusters.centres))]
    return StaticModel(clusters, medians, fit_components(_filled(df, clusters, medians, cluster), columns, count))


def apply_static_model(
    df: DataFrame, model: StaticModel, ratios: Mapping[str, tuple[str, str]] | None = None, cluster: str = "poi_cluster_id"
) -> DataFrame:
    """Cluster, imputed columns' flag, ratios of the imputed columns, and components in place of the columns.

    One projection: sectors may be new, rows may repeat, an empty table stays empty. A row
    without any value takes the medians, so it lands at the cluster nearest to them.
    """
    filled = _filled(df, model.clusters, model.cluster_medians, cluster)
    return with_components(add_ratios(filled, ratios or {}), model.components)
