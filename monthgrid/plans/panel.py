"""First job: input tables to the selected panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import holiday_flags, horizon_flag, month_index, parse_month, seasonality
from ..functions.names import UNIMPUTED_MARKERS, has_marker
from ..operators import citywide, folds, grid, impute, learners, screening, sectors, series, statics
from ..session import materialize
from ..sources import artefacts, sinks
from ..sources.tables import CITY_PREFIXES, SECTOR_PREFIXES, SOURCE_TABLES, keyed

KEY, MONTH = "sector_id", "panel_month"
# Columns that are always kept.
MANDATORY = ("sector_id", "sector_label", "panel_month", "month_idx", "is_future_horizon")


@dataclass(frozen=True)
class PanelOptions:
    """Settings of the panel job; the defaults fit the ten housing-market tables."""

    target: str = "nh_amount_new_house_transactions"
    train_end: str = "2024-07-01"
    horizon_start: str = "2024-08-01"
    horizon_months: int = 12
    lags: Sequence[int] = (1, 2, 3, 6, 12)
    change_lags: Sequence[int] = (1, 3, 12)
    rolling: Sequence[int] = (3, 6)
    alphas: Sequence[float] = (0.3, 0.5)
    # 1: changes, rolling and smoothed columns end at the month before, so that none holds the row's own value.
    shift: int = 0
    holidays: Mapping[str, Sequence[int]] = field(
        default_factory=lambda: {
            "is_spring_festival": [1, 2],
            "is_may_day": [5],
            "is_golden_week": [10],
            "is_double11": [11],
        }
    )
    last_year: int = 2024
    extrapolated_from: int = 2023
    surge_columns: Sequence[str] = ()
    ratios: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "nh_po_amt_ratio": ("nh_amount_new_house_transactions", "po_amount_pre_owned_house_transactions"),
            "nh_inventory_turnover": ("nh_num_new_house_available_for_sale", "nh_num_new_house_transactions"),
            "nh_neighbor_amt_ratio": (
                "nh_amount_new_house_transactions",
                "nhnbr_amount_new_house_transactions_nearby_sectors",
            ),
            "nh_land_lead_ratio_lag3": ("land_transaction_amount_lag3", "nh_amount_new_house_transactions"),
        }
    )
    static_ratios: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "poi_shop_per_capita": ("poi_number_of_shops", "poi_resident_population"),
            "poi_catering_share": ("poi_catering", "poi_number_of_shops"),
        }
    )
    event_column: str = "land_transaction_amount"
    static_missing_limit: float = 0.5
    static_clusters: int = 4
    static_components: int = 5
    fill_method: str = "bfill"
    zero_fill_lags: bool = False
    low_variance: float = 1e-6
    correlation_limit: float = 0.9
    top_n: int = 100
    cumulative_importance: float = 0.95
    importance_folds: Sequence[tuple[str, str, str]] = (
        ("2022-06-01", "2022-07-01", "2022-12-01"),
        ("2022-12-01", "2023-01-01", "2023-06-01"),
        ("2023-06-01", "2023-07-01", "2023-12-01"),
        ("2023-12-01", "2024-01-01", "2024-06-01"),
    )
    importance_params: Mapping[str, object] = field(default_factory=lambda: {"maxIter": 300, "stepSize": 0.05})
    seed: int = 42


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def index_sectors(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Dense ids for every sector in any table, stored once for all joins."""
    ids = F.concat(F.lit("sector "), F.split("id", "_sector ")[1])
    tables = [t for name, t in sources.items() if "sector" in t.columns]
    tables.append(sources["test"].select(ids.alias("sector")))
    return materialize(sectors.sector_index(sectors.sector_union(tables)), "sector_index")


def calendar_bounds(sources: Mapping[str, DataFrame], options: PanelOptions) -> tuple[str, str]:
    """First month of the main table, and the last month of the horizon."""
    end = F.add_months(F.lit(options.train_end).cast("date"), options.horizon_months)
    row = sources["new_house"].agg(F.min(parse_month("month")).alias("start"), F.max(end).alias("end")).first()
    return str(row.start), str(row.end)


def city_table(sources: Mapping[str, DataFrame], start: str, end: str, options: PanelOptions) -> DataFrame:
    """All city-wide columns and their features: one row per month of the grid.

    A table ``spelling(text, latin)`` among the sources transliterates search keywords.
    """
    spark, spelling = sources["test"].sparkSession, sources.get("spelling")
    spine = spark.range(1).select(F.explode(grid.month_span(start, end)).alias(MONTH))
    searched = sources["city_search"].withColumn(MONTH, parse_month("month"))
    sums = materialize(citywide.search_sums(searched, spelling=spelling), "search_sums")
    totals = materialize(citywide.search_totals(searched, spelling=spelling), "search_totals")
    search = citywide.search_wide(sums, citywide.pivot_columns(sums)).join(
        citywide.totals_wide(totals, citywide.pivot_columns(totals)), MONTH, "left"
    )
    year = "city_indicator_data_year"
    latest = citywide.latest_rows(sources["city_indexes"], [year], [c for c in sources["city_indexes"].columns if c != year])
    macro = citywide.expand_years(latest, year, options.last_year, options.extrapolated_from)
    macro = materialize(macro, "macro")
    measures = [c for c in macro.columns if c not in (MONTH, "macro_is_extrapolated")]
    macro = series.add_yoy(series.add_interpolation(macro, measures, [], MONTH), measures, [], MONTH)
    columns = {"has_search": [c for c in search.columns if c != MONTH], "has_macro": [c for c in macro.columns if c != MONTH]}
    city = grid.add_presence_flags(spine.join(search, MONTH, "left").join(macro, MONTH, "left"), columns)
    city = materialize(city, "city")
    for c in options.surge_columns:
        city = citywide.add_surge(city, c, [], MONTH, f"{c}_surge").drop(f"{c}_surge_level")
    measured = columns["has_search"] + columns["has_macro"]
    raw = grid.add_missing_flags(city, measured)
    lagged = series.add_lags(raw, measured, options.lags, [], MONTH)
    changed = series.add_changes(lagged, measured, options.change_lags, shift=options.shift, order=MONTH)
    return materialize(changed, "city_features")


def static_table(poi: DataFrame, index: DataFrame, options: PanelOptions, out_dir: str | None = None) -> DataFrame:
    """One row per sector of the index: flags, clusters, ratios and components."""
    renamed = grid.prefixed(poi, "poi_", keep=["sector"]).withColumnRenamed("sector", "sector_label")
    columns = [c for c in renamed.columns if c != "sector_label"]
    table = grid.add_presence_flags(index.select(KEY, "sector_label").join(renamed, "sector_label", "left"), {"has_poi": columns})
    table = materialize(table.drop("sector_label"), "statics")
    sparse = screening.sparse_columns(table, columns, options.static_missing_limit)
    kept = [c for c in columns if c not in sparse]
    if not kept:
        return grid.add_missing_flags(table, columns).drop(*sparse)
    flagged = grid.add_missing_flags(table, columns).drop(*sparse)
    model = statics.fit_static_model(flagged, kept, options.static_clusters, options.static_components)
    if out_dir:
        spark = poi.sparkSession
        artefacts.write_components(spark, kept, model.components.shares, model.components.loadings, f"{out_dir}/static_components")
        artefacts.write_static_model(spark, model, f"{out_dir}/static_model")
    out = statics.apply_static_model(flagged, model, options.static_ratios)
    return materialize(out, "static_features")


def sector_features(panel: DataFrame, metrics: Sequence[str], options: PanelOptions) -> DataFrame:
    """All series columns of the sector metrics: one partitioning, one sort."""
    df = series.add_ewm(panel, metrics, options.alphas, [KEY], MONTH, point="_", shift=options.shift)
    df = series.add_lags(df, metrics, options.lags, [KEY], MONTH)
    df = series.add_changes(df, metrics, options.change_lags, shift=options.shift, keys=[KEY], order=MONTH)
    df = series.add_rolling(df, metrics, options.rolling, [KEY], MONTH, options.shift)
    df = series.add_ratios(df, options.ratios)
    if options.event_column in df.columns:
        df = series.add_event_flag(df, options.event_column, "land_transacted_flag", [1, 3], [KEY], MONTH)
    return df


def merged_panel(sources: Mapping[str, DataFrame], index: DataFrame, start: str, end: str, options: PanelOptions) -> DataFrame:
    """The sector tables on the grid, with presence and missing flags; stored and checked."""
    cells, flags = {}, {}
    for t in SOURCE_TABLES:
        if t.kind == "sector_month":
            cells[t.name] = grid.prefixed(keyed(sources[t.name], index), t.prefix)
            flags[t.flag] = [c for c in cells[t.name].columns if c not in (KEY, MONTH)]
    panel = grid.add_presence_flags(grid.dense_grid(index, cells, start, end), flags)
    panel = panel.withColumns(
        {"month_idx": month_index(MONTH, start), "is_future_horizon": horizon_flag(MONTH, options.horizon_start)}
    )
    measured = [c for c in numeric_columns(panel, MANDATORY) if c.startswith(SECTOR_PREFIXES)]
    panel = materialize(grid.add_missing_flags(panel, measured), "panel_raw")
    grid.validate_panel(panel, index, start, end)
    return panel


def engineered_panel(sources: Mapping[str, DataFrame], options: PanelOptions, out_dir: str | None = None) -> DataFrame:
    """Merge, derive all features and impute; stored."""
    index = index_sectors(sources)
    if out_dir:
        artefacts.write_sector_index(index, f"{out_dir}/sector_index")
    start, end = calendar_bounds(sources, options)
    panel = merged_panel(sources, index, start, end, options)
    metrics = [c for c in numeric_columns(panel, MANDATORY) if c.startswith(SECTOR_PREFIXES)]
    df = sector_features(panel, metrics, options)
    df = df.withColumns(seasonality(MONTH) | holiday_flags(MONTH, options.holidays))
    city = city_table(sources, start, end, options)
    fill_city = [c for c in numeric_columns(city) if c.startswith(CITY_PREFIXES) and not has_marker(c, UNIMPUTED_MARKERS)]
    city = materialize(impute.impute_months(city, fill_city), "city_imputed")
    fixed = grid.unique_by(static_table(sources["poi"], index, options, out_dir), KEY, "statics")
    df = df.join(grid.unique_by(city, MONTH, "the city table"), MONTH, "left").join(fixed, KEY, "left")
    df = materialize(df, "panel_features")
    grid.validate_panel(df, index, start, end)
    columns = [c for c in numeric_columns(df, [*MANDATORY, options.target]) if not has_marker(c, UNIMPUTED_MARKERS) and not c.startswith(CITY_PREFIXES)]
    df = impute.impute_panel(df, columns, options.fill_method)
    if options.zero_fill_lags:
        df = impute.fill_lags_with_zero(df)
    return materialize(df, "panel_imputed")


def selected_features(panel: DataFrame, options: PanelOptions, out_dir: str | None = None) -> list[str]:
    """Names that survive the variance, correlation and importance stages, sorted."""
    train = panel.where(F.col(MONTH) <= F.lit(options.train_end).cast("date"))
    features = numeric_columns(train, [*MANDATORY, options.target])
    flat = set(screening.low_variance_columns(train, features, options.low_variance))
    features = [c for c in features if c not in flat]
    pairs = screening.correlation_pairs(train, features)
    drops = materialize(screening.correlated_drops(pairs, options.correlation_limit), "correlation_drops")
    dropped = {r.dropped for r in drops.collect()}
    features = [c for c in features if c not in dropped]
    per_fold = learners.fold_importance(
        train, folds.numbered_folds(options.importance_folds), features, options.target, options.importance_params, options.seed
    )
    if out_dir:
        sinks.write_parquet(drops, f"{out_dir}/correlation_drops")
        sinks.write_parquet(per_fold, f"{out_dir}/importance")
    always = [*MANDATORY, options.target]
    chosen = screening.select_features(screening.mean_importance(per_fold), options.top_n, options.cumulative_importance, always)
    return [r.feature for r in chosen.collect()]


def build_panel(
    spark: SparkSession, sources: Mapping[str, DataFrame], options: PanelOptions = PanelOptions(), out_dir: str | None = None
) -> tuple[DataFrame, list[str]]:
    """The panel with its selected columns, and their names.

    With ``out_dir`` the panel is written there by year, beside the feature list, the sector index,
    the dropped correlations, the importances of each fold and the components of the static columns.
    """
    panel = engineered_panel(sources, options, out_dir)
    names = selected_features(panel, options, out_dir)
    if out_dir:
        sinks.write_panel(panel.select(names), f"{out_dir}/panel")
        artefacts.write_features(spark, names, f"{out_dir}/features")
    return panel.select(names), names
