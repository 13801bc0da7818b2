"""The three jobs end to end, on CSV inputs derived from the given tables."""

import os

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx
from monthgrid.operators import forecasting as fc
from monthgrid.plans.forecast import forecast, submission, write_outputs
from monthgrid.plans.panel import PanelOptions, build_panel
from monthgrid.plans.training import train
from monthgrid.sources import artefacts, sinks, tables

SF = "/root/testdata/sf0.001"
TARGET = "nh_amount"
BOUNDS = [("1999-06-01", "1999-07-01", "1999-12-01"), ("1999-12-01", "2000-01-01", "2000-06-01")]


def _text_keys(df):
    return df.select(
        F.date_format(fx.MONTH, "yyyy-MMM").alias("month"),
        F.concat(F.lit("sector "), F.col(fx.KEY).cast("string")).alias("sector"),
        *[c for c in df.columns if c not in (fx.KEY, fx.MONTH)],
    )


@pytest.fixture(scope="module")
def base_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("inputs"))
    cells = fx.source_cells(spark, SF)
    stripped = {n: t.select(*t.columns[:2], *[F.col(c).alias(c.split("_", 1)[1]) for c in t.columns[2:]]) for n, t in cells.items()}
    names = {"nh": "new_house", "nhnbr": "new_house_nearby", "po": "pre_owned", "ponbr": "pre_owned_nearby", "land": "land", "landnbr": "land_nearby"}
    made = {names[n]: _text_keys(t) for n, t in stripped.items()}
    poi = fx.statics(spark, SF).drop("given_cluster")
    made["poi"] = poi.select(
        F.concat(F.lit("sector "), F.col(fx.KEY).cast("string")).alias("sector"),
        *[F.col(c).alias(c.removeprefix("poi_")) for c in poi.columns if c != fx.KEY],
    )
    made["city_indexes"] = fx.city_indexes(spark, SF).where("revision = 5").select(
        F.col("data_year").alias("city_indicator_data_year"), "total_price", "order_count"
    )
    monthly = fx.cells(spark, SF).groupBy(fx.MONTH).agg(F.sum("num").alias("search_volume"))
    made["city_search"] = monthly.select(
        F.date_format(fx.MONTH, "yyyy-MMM").alias("month"), F.lit("Buy home").alias("keyword"), F.lit("pc").alias("source"), "search_volume"
    )
    made["test"] = fx.test_ids(spark, SF)
    paths = {t.name: t.path for t in tables.SOURCE_TABLES}
    for name, df in made.items():
        sinks.write_csv(df, os.path.join(base, paths[name]))
    return base


def test_missing_source_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_sources(spark, str(tmp_path))


def test_build_train_forecast(spark, base_dir, tmp_path):
    sources = tables.read_sources(spark, base_dir)
    assert set(sources) == {t.name for t in tables.SOURCE_TABLES}
    options = PanelOptions(
        target=TARGET,
        train_end="2000-08-01",
        horizon_start=fx.HORIZON,
        lags=(1, 3, 12),
        change_lags=(1,),
        rolling=(3,),
        alphas=(0.3,),
        last_year=2001,
        extrapolated_from=2001,
        surge_columns=("search_buy_home_pc",),
        ratios={"nh_po_amt_ratio": ("nh_amount", "po_amount")},
        event_column="land_amount",
        importance_folds=BOUNDS,
        importance_params={"maxIter": 3, "maxDepth": 3},
        top_n=12,
        shift=1,
    )
    built = str(tmp_path / "built")
    panel, names = build_panel(spark, sources, options, built)
    assert tables.read_panel(spark, f"{built}/panel").count() == panel.count()
    assert artefacts.read_features(spark, f"{built}/features") == names
    assert artefacts.read_sector_index(spark, f"{built}/sector_index").count() == 300
    assert spark.read.parquet(f"{built}/correlation_drops").columns == ["dropped", "kept"]
    assert spark.read.parquet(f"{built}/importance").select("fold").distinct().count() == len(BOUNDS)
    loadings = spark.read.parquet(f"{built}/static_components")
    assert abs(loadings.groupBy("component").agg(F.sum(F.col("loading") ** 2).alias("n")).agg(F.max(F.abs(F.col("n") - 1))).first()[0]) < 1e-9
    assert names == sorted(names)
    assert {"sector_id", "sector_label", "panel_month", "month_idx", "is_future_horizon", TARGET} <= set(names)
    assert len(names) >= 12
    # 150 known sectors and 150 that only the ids name, in 80 months
    assert panel.count() == 300 * 80
    assert panel.select("sector_id", "panel_month").distinct().count() == 300 * 80

    usable = [n for n in names if n not in ("nh_num",)]
    settings = {
        "boosted": [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 3, "maxDepth": 3}],
        "random_forest": [{"numTrees": 5, "maxDepth": 4}],
    }
    out_dir = str(tmp_path / "models")
    result = train(panel, usable, TARGET, options.train_end, BOUNDS, settings, out_dir, steps=4)
    assert abs(sum(result.weights.values()) - 1) < 1e-9
    assert result.history.count() == 3 * 2
    best_single = max(
        r.score for r in result.candidates.collect() if max(r.weight_boosted, r.weight_random_forest) == 1.0
    )
    assert result.score >= best_single
    assert result.summary.count() == 4
    assert result.score >= result.uniform_score
    assert spark.read.parquet(f"{out_dir}/trials").count() == 3 * 2
    assert spark.read.parquet(f"{out_dir}/validation").count() == result.predictions.count()
    assert spark.read.parquet(f"{out_dir}/validation_blended").where("pred_ensemble is null or pred_uniform is null").isEmpty()
    assert spark.read.parquet(f"{out_dir}/blend_score").first().score == result.score

    ids = sources["test"]
    months = fc.id_months(ids)
    predicted = forecast(panel, out_dir, months)
    assert predicted.count() == 300 * 12
    assert predicted.where("pred_ensemble < 0 or pred_ensemble is null").isEmpty()
    assert predicted.agg(F.sum("overridden")).first()[0] == 0
    ruled = forecast(panel, out_dir, months, zero_column=TARGET)
    zeroed = ruled.where("overridden = 1")
    last = [f"2000-{m:02d}-01" for m in range(3, 9)]
    alive = panel.where(F.col("panel_month").isin([F.lit(m).cast("date") for m in last]) & (F.col(TARGET) != 0)).groupBy("sector_id").count()
    assert zeroed.where("pred_ensemble <> 0").isEmpty()
    assert zeroed.count() == 12 * (300 - alive.where("count = 6").count())
    write_outputs(ruled, submission(ruled, ids), str(tmp_path / "out"))
    lines = spark.read.option("header", True).csv(str(tmp_path / "out/submission")).collect()
    assert len(lines) == ids.count() and all(len(r[1].split(".")[1]) == 6 for r in lines)
    table = submission(predicted, ids)
    assert [r.id for r in table.collect()] == [r.id for r in ids.collect()]
    assert submission(predicted, None, fx.HORIZON_MONTHS).count() == 300 * 12
