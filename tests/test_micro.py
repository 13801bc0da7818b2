"""Small cases with answers worked out by hand, and brute-force comparisons."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthgrid.functions import calendar as ca
from monthgrid.functions import numeric as nu
from monthgrid.functions import text as tx
from monthgrid.operators import blending as bl
from monthgrid.operators import citywide as ci
from monthgrid.operators import evaluation as ev
from monthgrid.operators import folds as fo
from monthgrid.operators import forecasting as fc
from monthgrid.operators import grid as gr
from monthgrid.operators import impute as im
from monthgrid.operators import learners as le
from monthgrid.operators import quantiles as qu
from monthgrid.operators import screening as sr
from monthgrid.operators import sectors as sc
from monthgrid.operators import series as se
from monthgrid.operators import statics as st
from monthgrid.sources import artefacts as ar
from monthgrid.sources import sinks, tables


def line(spark, values, column="x"):
    """One series of months with the given values."""
    rows = [(1, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k int, pos int, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("pos").collect()]


def close(got, want, tol=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None), (got, want)
        assert g is None or abs(g - w) <= tol, (got, want)


def test_fills(spark):
    df = line(spark, [None, 5.0, None, 7.0, None])
    fills = df.withColumns({m: se.filled("x", ["k"], "pos", m) for m in ("bfill", "ffill", "ffill_bfill")})
    close(column(fills, "bfill"), [5, 5, 7, 7, None])
    close(column(fills, "ffill"), [None, 5, 5, 7, 7])
    close(column(fills, "ffill_bfill"), [5, 5, 5, 7, 7])
    with pytest.raises(ValueError):
        se.filled("x", ["k"], "pos", "linear")


def test_interpolation(spark):
    df = se.add_interpolation(line(spark, [None, 1.0, None, None, 4.0, None]), ["x"], ["k"], "pos")
    close(column(df, "x_interp"), [None, 1, 2, 3, 4, 4])


def test_ewm_known_values(spark):
    df = se.add_ewm(line(spark, [1.0, None, 3.0, None, None, 2.0]), ["x"], [0.3], ["k"], "pos")
    got = [r["x_ewm_alpha0.3"] for r in df.orderBy("pos").collect()]
    close(got, [1, 1, 1.759494, 1.759494, 1.759494, 1.871705])


def test_ewm_against_pandas(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, None if rng.random() < 0.3 else float(rng.normal())) for k in range(20) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, pos int, x double")
    native = {(r.k, r.pos): r["x_ewm_alpha0.5"] for r in se.add_ewm(df, ["x"], [0.5], ["k"], "pos").collect()}
    pdf = pd.DataFrame(rows, columns=["k", "pos", "x"])
    want = pdf.groupby("k").x.transform(lambda s: s.ewm(alpha=0.5, adjust=False).mean())
    ignoring = pdf.groupby("k").x.transform(lambda s: s.ewm(alpha=0.5, adjust=False, ignore_na=True).mean())
    differs = 0
    for (k, i, _), w, other in zip(rows, want, ignoring):
        n = native[k, i]
        assert (n is None) == math.isnan(w)
        assert math.isnan(w) or abs(n - w) < 1e-12
        differs += not math.isnan(w) and abs(w - other) > 1e-9
    assert differs > 100  # a recursion that skipped gaps would not have passed


def test_rolling_and_surge(spark):
    df = se.add_rolling(line(spark, [1.0, None, 3.0, 10.0]), ["x"], [3], ["k"], "pos")
    close(column(df, "x_roll3_std"), [None, None, 1.414214, 4.949747])
    close(column(df, "x_roll3_mean"), [1, 1, 2, 6.5])
    shifted = se.add_rolling(line(spark, [1.0, None, 3.0, 10.0]), ["x"], [3], ["k"], "pos", shift=1)
    close(column(shifted, "x_roll3_mean"), [None, 1, 1, 2])
    surge = ci.add_surge(line(spark, [1.0, None, 3.0, 10.0]), "x", ["k"], "pos", "s", months=3, minimum=1)
    close(column(surge, "s_level"), [1, 1, 2.5, 8.25])
    assert column(surge, "s") == [0, 0, 1, 1]


def test_changes_and_safe_ratio(spark):
    df = se.add_changes(se.add_lags(line(spark, [0.0, 2.0, 3.0, None]), ["x"], [1], ["k"], "pos"), ["x"], [1, 3])
    close(column(df, "x_diff1"), [None, 2, 1, None])
    close(column(df, "x_pctchg1"), [None, None, 0.5, None])
    assert "x_diff3" not in df.columns  # no such lag
    ratio = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    close([r.r for r in ratio.select(nu.safe_ratio("a", "b").alias("r")).collect()], [None, None, 1.5])
    absent = se.add_ratios(ratio, {"r": ("a", "zzz")})
    close([r.r for r in absent.collect()], [None] * 3)


def test_zero_rule(spark):
    df = se.add_zero_rule(line(spark, [1.0, 0.0, 2.0, 3.0, 4.0, 5.0, None, 1.0]), "x", ["k"], "pos", months=3)
    assert column(df, "had_zero") == [0, 0, 1, 1, 1, 0, 0, 1]


def test_zero_rule_beyond_the_last_observed_row(spark):
    full = line(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, None])
    after = se.add_zero_rule(full, "x", ["k"], "pos", months=6, origin=6)
    assert column(after, "had_zero")[7:] == [0, 0, 0]
    gap = line(spark, [1.0, 1.0, None, 3.0, 4.0, None, None, None])
    assert column(se.add_zero_rule(gap, "x", ["k"], "pos", months=4, origin=4), "had_zero")[5:] == [1, 1, 1]
    assert column(se.add_zero_rule(gap, "x", ["k"], "pos", months=4, origin=4, gaps_are_zero=False), "had_zero")[5:] == [0, 0, 0]


def test_event_flag(spark):
    df = se.add_event_flag(line(spark, [None, 0.0, -1.0, 2.0, 3.0]), "x", "f", [1], ["k"], "pos")
    assert column(df, "f") == [0, 0, 0, 1, 1]
    assert column(df, "f_lag1") == [None, 0, 0, 0, 1]


def test_month_parse_and_ids(spark):
    df = spark.createDataFrame([("2019-Jan",), ("2024 Aug",), ("2020-03-17",), ("x",), (None,)], "m string")
    got = [r[0] for r in df.select(ca.parse_month("m")).collect()]
    assert got == [dt.date(2019, 1, 1), dt.date(2024, 8, 1), dt.date(2020, 3, 1), None, None]
    ids = spark.createDataFrame([("2024 Aug_sector 12",)], "id string")
    row = ids.select(ca.id_month("id").alias("m"), ca.id_sector("id").alias("s")).select("*", ca.row_id("m", "s").alias("id")).first()
    assert (row.m, row.s, row.id) == (dt.date(2024, 8, 1), 12, "2024 Aug_sector 12")


def test_slug(spark):
    words = [("Buy House!",), ("  a--b_c ",), ("***",), ("Übung 3",)]
    got = [r[0] for r in spark.createDataFrame(words, "w string").select(tx.slug("w")).collect()]
    assert got == ["buy_house", "a_b_c", "keyword", "übung_3"]
    spelling = spark.createDataFrame([("房价", "fang jia"), ("房价", "fang jia")], "text string, latin string")
    df = spark.createDataFrame([("房价",), ("loan",)], "w string")
    assert sorted(r.s for r in tx.add_slug(df, "w", "s", spelling).collect()) == ["fang_jia", "loan"]


def test_target_transforms_keep_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (10.0,)], "x double")
    rows = df.select(
        nu.log_target("x").alias("l"), nu.inverse_log_target(nu.log_target("x")).alias("r"), nu.floored("x", 0).alias("c")
    ).collect()
    close([r.l for r in rows], [None, math.log(1e-3), math.log(10.001)])
    close([r.r for r in rows], [None, 0, 10])
    close([r.c for r in rows], [None, 0, 10])


def test_dense_numbers_across_buckets(spark):
    labels = [f"sector {n}" for n in (3, 10, 2, 999_999, 1_000_000, 5_000_001, 12, *range(20, 10**12, 10**12 // 300))]
    df = sc.sector_index(spark.createDataFrame([(v,) for v in labels], "sector_label string"))
    got = {r.sector_label: r.sector_id for r in df.collect()}
    assert got == {v: i for i, v in enumerate(sorted(labels, key=lambda v: int(v.split()[1])), 1)}


def _cells(spark, rows, name):
    return spark.createDataFrame(rows, f"sector_id bigint, panel_month date, {name} double")


def test_dense_grid_equals_left_joins(spark):
    sectors = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sector_id bigint, sector_label string")
    d = dt.date
    a = _cells(spark, [(1, d(2020, 1, 1), 1.0), (1, d(2020, 3, 1), 3.0), (2, d(2020, 4, 1), None), (9, d(2020, 2, 1), 9.0)], "a")
    b = _cells(spark, [(1, d(2020, 3, 1), 30.0), (2, d(2020, 2, 1), 20.0), (1, d(2019, 12, 1), 7.0), (1, d(2020, 6, 1), 7.0)], "b")
    got = gr.dense_grid(sectors, {"a": a, "b": b}, "2020-01-01", "2020-05-01")
    frame = gr.skeleton(sectors, "2020-01-01", "2020-05-01", "2020-04-01")
    want = frame.join(a, ["sector_id", "panel_month"], "left").join(b, ["sector_id", "panel_month"], "left")
    columns = ["sector_id", "sector_label", "panel_month", "a", "b"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() == 15
    gr.validate_panel(got, sectors, "2020-01-01", "2020-05-01")
    with pytest.raises(ValueError):
        gr.validate_panel(got.union(got.limit(1)), sectors, "2020-01-01", "2020-05-01")
    with pytest.raises(Exception, match="repeated"):
        gr.dense_grid(sectors, {"a": a.union(a)}, "2020-01-01", "2020-05-01").collect()


def test_a_task_holds_a_bounded_part_of_the_grid(spark, monkeypatch):
    monkeypatch.setattr(gr, "GRID_ROWS", 1200, raising=False)
    sectors = spark.range(500).withColumnRenamed("id", "sector_id")
    cells = sectors.where("sector_id % 3 = 0").select("sector_id", F.lit("2020-03-01").cast("date").alias("panel_month"), F.lit(1.0).alias("a"))
    got = gr.dense_grid(sectors, {"a": cells}, "2020-01-01", "2029-12-01")
    tasks = [r[0] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert sum(tasks) == 60_000 and max(tasks) < 4 * 1200
    joined = gr.merge_static(got, sectors.withColumn("poi", F.lit(1)))
    assert joined.agg(F.count("*"), F.sum("has_poi"), F.sum("a")).first()[:] == (60_000, 60_000, 167.0)


def test_dense_grid_plan_has_one_exchange_for_the_series_chain(spark):
    sectors = spark.createDataFrame([(1,)], "sector_id bigint")
    df = gr.dense_grid(sectors, {"a": _cells(spark, [], "a")}, "2020-01-01", "2020-05-01")
    df = se.add_rolling(se.add_lags(df, ["a"], [1, 12], ["sector_id"], "panel_month"), ["a"], [3], ["sector_id"], "panel_month")
    plan = df.withColumn("f", se.filled("a", ["sector_id"], "panel_month"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("slices,small", [(16, 10), (4096, 1_000_000)])
def test_exact_quantiles(spark, slices, small):
    rng = np.random.default_rng(3)
    groups = {
        0: rng.normal(size=301),
        1: np.where(rng.random(200) < 0.4, 5.0, rng.normal(size=200)),  # one value repeats
        2: np.full(50, 3.0),
        3: np.exp(rng.normal(size=150) * 20),  # most values in one slice
        4: np.concatenate([rng.normal(size=100), 1e9 + rng.normal(size=100)]),  # the middle falls in a gap
        5: np.array([2.0]),
        6: np.array([-1.7e308, 1.7e308, 1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(7, None), (0, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.5, 0.75):
        got = {r.g: r.quantile for r in qu.exact_quantiles(df, ["g"], "v", q, slices=slices, few_rows=small).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            want = float(np.quantile(values, q))
            assert abs(got[g] - want) <= 1e-9 * max(1.0, abs(want)), (g, q)
    whole = qu.exact_quantiles(df.where("g < 6"), [], "v", slices=slices, few_rows=small).first()[0]
    want = float(np.median(np.concatenate([groups[g] for g in range(6)])))
    assert abs(whole - want) <= 1e-9 * max(1.0, abs(want))


def test_rough_quantiles(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id") * 1.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([(9, None)], "g long, v double"))
    exact = {r.g: r.quantile for r in qu.exact_quantiles(df, ["g"], "v", 0.3).collect()}
    rough = {r.g: r.quantile for r in qu.rough_quantiles(df, ["g"], "v", 0.3, accuracy=500).collect()}
    assert exact.keys() == rough.keys() == {0, 1}
    assert all(abs(exact[g] - rough[g]) <= 100_000 / 500 * 1.2 for g in exact)
    assert abs(qu.rough_quantiles(df, [], "v").first()[0] - 50_000) < 40


def test_shifted_columns_do_not_hold_the_own_value(spark):
    rows = [("a", i, v) for i, v in enumerate([2.0, 4.0, None, 8.0, 6.0])]
    df = spark.createDataFrame(rows, "k string, m int, `v.x` double").withColumnRenamed("v.x", "v")
    out = se.add_changes(se.add_ewm(df, ["v"], [0.5], ["k"], "m", shift=1), ["v"], [1], shift=1, keys=["k"], order="m")
    got = out.orderBy("m").collect()
    assert [r.v_diff1 for r in got] == [None, None, 2.0, None, None]
    assert [r.v_pctchg1 for r in got] == [None, None, 1.0, None, None]
    assert [r["v_ewm_alpha0.5"] for r in got][:4] == [None, 2.0, 3.0, 3.0] and abs(got[4]["v_ewm_alpha0.5"] - 19 / 3) < 1e-12


def test_search_spelling(spark):
    day = F.to_date(F.lit("2020-01-01")).alias("panel_month")
    rows = [("房价", "pc", 1.0), ("Fang Jia", "pc", 2.0), ("房价", "移动", 4.0), ("loan", None, None), (None, "pc", 3.0)]
    df = spark.createDataFrame(rows, "keyword string, source string, search_volume double").select(day, "*")
    spelling = spark.createDataFrame([("房价", "fang jia"), ("房价", "zz"), ("移动", "yi dong")], "text string, latin string")
    got = {r.column_name: r.volume for r in ci.search_sums(df, spelling=spelling).collect()}
    assert got == {"search_fang_jia_pc": 3.0, "search_fang_jia_yi_dong": 4.0, None: 3.0}
    totals = {r.column_name: r.volume for r in ci.search_totals(df, spelling=spelling).collect()}
    assert totals == {"search_fang_jia_all": 3.0, "search_fang_jia_yi_all": 4.0, None: 3.0}
    empty = spelling.where("false")
    assert {r.column_name for r in ci.search_sums(df, spelling=empty).collect()} == {r.column_name for r in ci.search_sums(df).collect()}


def test_exact_quantiles_with_infinite_ends(spark):
    inf = float("inf")
    groups = {0: [-inf, 1.0, 2.0, 3.0, inf], 1: [inf, inf, 1.0], 2: [-inf, -inf], 3: [float(i) for i in range(50)] + [inf] * 3, 4: [-inf, 5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    for few in (2, 4_096):
        got = {r.g: r.quantile for r in qu.exact_quantiles(df, ["g"], "v", slices=4, few_rows=few).collect()}
        assert got == {0: 2.0, 1: inf, 2: -inf, 3: 26.0, 4: -inf}


def test_impute_panel_three_stages(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), None), (1, d(2020, 2, 1), 5.0), (1, d(2020, 3, 1), None), (1, d(2020, 4, 1), None)]
    rows += [(2, d(2020, 1, 1), 2.0), (2, d(2020, 2, 1), 4.0), (2, d(2020, 3, 1), 9.0), (2, d(2020, 4, 1), None)]
    df = spark.createDataFrame(rows, "sector_id bigint, panel_month date, x double")
    out = im.impute_panel(df, ["x"]).orderBy("sector_id", "panel_month").collect()
    # backward fill, then the month's median (9), then the column's over 5,5,9,2,4,9 (5)
    close([r.x for r in out], [5, 5, 9, 5, 2, 4, 9, 5])
    assert [r.imputed_x for r in out] == [1, 0, 1, 1, 0, 0, 0, 1]
    full = df.fillna(1.0)
    assert im.impute_panel(full, ["x"]).columns == full.columns  # nothing empty, no flag


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0.5), (10.0, 10.0), (10.0, 5.0), (10.0, 40.0)], "y_true double, y_pred double")
    row = ev.scores(df).first()
    close([row.bad_ratio, row.good_fraction, row.scaled_mape, row.score], [0.25, 0.75, 4 / 9, 5 / 9])
    assert ev.scores(df.union(df.where("y_pred = 40"))).first().score == 0.0  # 2 of 5 are bad
    ten = spark.createDataFrame([(1.0, 1.0)] * 7 + [(1.0, 9.0)] * 3, "y_true double, y_pred double")
    close([ev.scores(ten).first().score], [1.0])  # a bad share of exactly 0.3 still counts
    every = spark.createDataFrame([(1.0, 9.0)], "y_true double, y_pred double")
    assert ev.scores(every).first().score == 0.0 and ev.scores(every).first().scaled_mape is None
    with pytest.raises(Exception, match="null truth"):
        ev.scores(df.union(spark.createDataFrame([(None, 1.0)], df.schema))).collect()
    with pytest.raises(ValueError):
        ev.summarize(df, ["model"])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("m", 2.0), ("m", 2.0), ("m", None)], "model string, ape double")
    got = {r.bin: r.row_count for r in ev.error_histogram(df).collect()}
    assert len(got) == 30 and got[16] == 2 and sum(got.values()) == 2


def test_decay_weights(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2020, 1, 1),), (d(2019, 1, 1),), (d(2018, 1, 1),)], "panel_month date")
    got = fo.add_decay_weights(df, fo.Decay(), "2020-01-01").orderBy(F.desc("panel_month")).collect()
    close([r.weights for r in got], [1.714286, 0.857143, 0.428571])
    linear = fo.add_decay_weights(df, fo.Decay("linear", linear_min_ratio=0.5), "2020-01-01")
    close([r.weights for r in linear.orderBy(F.desc("panel_month")).collect()], [4 / 3, 1.0, 2 / 3])
    for bad in ({"strategy": "x"}, {"half_life_months": 0}, {"linear_min_ratio": 0}, {"linear_min_ratio": 1.5}):
        with pytest.raises(ValueError):
            fo.Decay(**bad)


def test_folds_need_months_and_validation(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2020, m, 1), float(m)) for m in range(1, 9)], "panel_month date, y double")
    folds = fo.numbered_folds([("2020-02-01", "2020-03-01", "2020-04-01"), ("2020-06-01", "2020-07-01", "2020-08-01"),
                               ("2020-08-01", "2020-09-01", "2020-10-01")])
    assert [f.fold for f in fo.usable_folds(df, folds, "y", 3)] == [2]
    with pytest.raises(ValueError):
        fo.usable_folds(df, folds, "y", 100)
    train = fo.assigned(df, folds, "train").groupBy("fold").agg(F.max("panel_month").alias("m")).collect()
    valid = fo.assigned(df, folds, "valid").groupBy("fold").agg(F.min("panel_month").alias("m")).collect()
    first = {r.fold: r.m for r in valid}
    assert all(r.m < first[r.fold] for r in train if r.fold in first)


def test_encoding_defaults(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "c string, y double")
    means = fo.category_means(df, "c", "y")
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = {r.c: r.e for r in fo.encode(rows, means, "c", "e", fo.encoding_default(df, "y", "mean")).collect()}
    assert got == {"a": 2.0, "z": 4.0, None: 4.0}
    assert fo.encoding_default(df, "y", "zero") == 0.0 and fo.encoding_default(df, "y", 7) == 7.0


def test_correlations(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 6))
    data[:, 1] = data[:, 0] * 2 + rng.normal(size=400) * 0.01
    data[:, 5] = 4.0
    data[rng.random(data.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(data, columns=list("abcdef"))
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in data]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(5)
    want = pdf.corr()
    pairs = sr.correlation_pairs(df, list(pdf.columns))
    got = {(r.left, r.right): r.corr for r in pairs.collect()}
    assert len(got) == 15
    for (a, b), r in got.items():
        assert (r is None) == math.isnan(want.loc[a, b]), (a, b)
        assert r is None or abs(r - want.loc[a, b]) < 1e-10
    drops = {r.dropped: r.kept for r in sr.correlated_drops(pairs, 0.9).collect()}
    assert drops == {"a": "b"}
    assert sr.low_variance_columns(df, list(pdf.columns)) == ["f"]
    small = spark.createDataFrame([(1, 2), (2, None), (3, 5), (4, 6), (None, 1)], "a int, b int")
    close([sr.correlation_pairs(small, ["a", "b"]).first().corr], [0.995871])


@pytest.mark.parametrize("width", [2, 40, 150])
def test_correlation_does_not_depend_on_the_width(spark, width):
    # On the rows that both have, the first two columns lie far from the mean of the first.
    rows = [(1e8 + i, float(i * i)) for i in range(50)] + [(0.0, None)] * 50
    rng = np.random.default_rng(1)
    others = rng.normal(size=(100, width - 2))
    df = spark.createDataFrame([(*r, *map(float, o)) for r, o in zip(rows, others)], ", ".join(f"c{i} double" for i in range(width))).repartition(3)
    pairs = sr.correlation_pairs(df, df.columns)
    want = np.corrcoef(np.arange(50.0), np.arange(50.0) ** 2)[0, 1]
    assert abs(pairs.where("left_pos = 0 and right_pos = 1").first().corr - want) < 1e-9
    assert pairs.count() == width * (width - 1) // 2


def test_correlation_of_600_columns_with_200_constant_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 600)) * rng.choice([1e-1, 1, 1e6], 600) + rng.choice([0, 1e7], 600)
    data[:, 100:300] = rng.choice([0.0, 1.0, 0.1], 200)
    data[rng.random(data.shape) < 0.1] = np.nan
    data[:, 7] = np.where(np.isnan(data[:, 8]), rng.normal(size=300), 3.3)  # constant on the rows that both have
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(600)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)
    monkeypatch.setattr(sr, "BATCH_CELLS", 600 * 70)
    got = np.full((600, 600), np.nan)
    pairs = sr.correlation_pairs(df, list(pdf.columns)).toPandas()
    assert len(pairs) == 600 * 599 // 2
    got[pairs.left_pos, pairs.right_pos] = pairs["corr"]
    upper = np.triu_indices(600, 1)
    small = np.triu_indices(90, 1)
    own = pdf.iloc[:, :90].corr().to_numpy()[small]
    flat = [k for k, (i, j) in enumerate(zip(*small)) if (i, j) != (7, 8)]
    np.testing.assert_allclose(got[:90, :90][small][flat], own[flat], atol=1e-6)
    assert np.isnan(got[7, 8])
    assert np.isnan(got[:, 100:300][:100]).all() and not np.isnan(got[:100, 300:]).any() and not np.isnan(got[upper]).all()


def test_tiles_cover_every_pair_once_and_constants_cost_nothing():
    for width in (0, 1, 64, 65, 600, 4000):
        for held in (1, 4, 256):
            pairs = [p for g in sr.tile_groups(width, pairs=held) for p in g]
            tiles = -(-width // 64)
            assert sorted(pairs) == [(i, j) for i in range(tiles) for j in range(i, tiles)]
            assert all(len(g) <= held for g in sr.tile_groups(width, pairs=held))
    rng, took = np.random.default_rng(3), []
    data = rng.normal(size=(4096, 64))
    for constant in (0, 40):
        data[:, :constant] = 0.1
        start = time.process_time()
        for _ in range(5):
            sr._tile_moments(sr._Tile(data), sr._Tile(data))
        took.append(time.process_time() - start)
    assert took[1] < 3 * took[0] + 0.1


def test_blend_and_search(spark):
    wide = spark.createDataFrame([(10.0, 8.0, 14.0), (20.0, 18.0, 24.0), (30.0, None, 1.0)], "y_true double, pred_a double, pred_b double")
    blends = [r[0] for r in wide.select(bl.blended(["a", "b"], [0.75, 0.25])).collect()]
    close(blends, [9.5, 19.5, None])
    close([r[0] for r in wide.select(bl.blended(["a", "b"], [1.0])).collect()], [11, 21, None])
    known = wide.dropna()
    table = bl.candidate_scores(known, ["a", "b"], 30)
    assert table.count() == bl.candidate_count(2, 30) == 31
    best = bl.best_candidate(table, ["a", "b"]).first()
    assert abs(best.weight_a - 20 / 30) < 1e-9 and abs(best.score - 1.0) < 1e-9
    assert best.score >= bl.uniform_score(known, ["a", "b"]).first()[0]
    assert bl.candidate_scores(known, ["a", "b"], 10, bounds=(0.2, 0.8)).count() == 7
    coarse, coarse_score = bl.search_weights(known, ["a", "b"], 10, refinements=0)
    fine, fine_score = bl.search_weights(known, ["a", "b"], 10, refinements=3)
    assert coarse == {"a": 0.7, "b": 0.3} and fine_score > coarse_score and abs(fine["a"] - 2 / 3) < 0.001
    assert bl.candidate_scores(known.withColumn("pred_c", F.lit(1.0)), ["a", "b", "c"], 4).count() == 15
    assert bl.candidate_scores(known.withColumn("pred_c", F.lit(1.0)), ["a", "b", "c"], 60).count() == bl.candidate_count(3, 60)
    many = known.withColumns({f"pred_{m}": F.lit(float(i)) for i, m in enumerate("cdefg")})
    weights, score = bl.search_weights(many, list("abcdefg"))
    assert abs(sum(weights.values()) - 1) < 1e-9 and score >= bl.uniform_score(many, list("abcdefg")).first()[0]
    # Equal weights are exact here and off every grid.
    thirds = spark.createDataFrame([(1.0, 3.0, 0.0, 0.0), (2.0, 0.0, 6.0, 0.0), (5.0, 0.0, 0.0, 15.0)], "y_true double, pred_a double, pred_b double, pred_c double")
    assert bl.search_weights(thirds, ["a", "b", "c"], 10, refinements=0)[0] == {m: 1 / 3 for m in "abc"}
    bounded, _ = bl.search_weights(many, list("abcdefg"), bounds=(0.05, 0.4))
    assert all(0.05 - 1e-9 <= w <= 0.4 + 1e-9 for w in bounded.values())
    with pytest.raises(Exception, match="cannot be scored"):
        bl.candidate_scores(wide, ["a", "b"], 4).collect()
    keyed = spark.createDataFrame([(1, "x", 1, 1.0, "a", 2.0), (1, "x", 1, 1.0, "a", 3.0)], "sector_id int, panel_month string, fold int, y_true double, model string, y_pred double")
    with pytest.raises(Exception, match="several predictions"):
        bl.merge_predictions(keyed, ["a"]).collect()


def test_override_and_submission(spark):
    d = dt.date
    preds = spark.createDataFrame([(1, d(2024, 8, 1), 5.0), (2, d(2024, 8, 1), 6.0)], "sector_id bigint, panel_month date, pred_ensemble double")
    listed = spark.createDataFrame([(d(2024, 8, 1), 2), (d(2024, 8, 1), 2), (d(2024, 9, 1), 1)], "panel_month date, sector_id bigint")
    out = {r.sector_id: (r.pred_ensemble, r.overridden) for r in fc.zero_overridden(preds, listed).collect()}
    assert out == {1: (5.0, 0), 2: (0.0, 1)}
    ids = spark.createDataFrame([("2024 Aug_sector 1", 0), ("2024 Sep_sector 1", 1)], "id string, place int")
    got = [r.new_house_transaction_amount for r in fc.submission_for_ids(ids, preds).orderBy("place").collect()]
    assert got == [5.0, 0.0]
    assert [str(r[0]) for r in fc.id_months(ids).collect()] == ["2024-08-01", "2024-09-01"]


def test_years_carry_forward(spark):
    yearly = spark.createDataFrame([(2019, 1.0), (2021, 3.0)], "y int, v double")
    out = ci.expand_years(yearly, "y", 2022, 2022).orderBy("panel_month").collect()
    assert len(out) == 48
    assert [out[i].macro_v for i in (0, 12, 24, 36)] == [1.0, 1.0, 3.0, 3.0]
    assert [out[i].macro_is_extrapolated for i in (35, 36)] == [0, 1]


def test_search_total_modes(spark):
    d = dt.date(2020, 1, 1)
    rows = [(d, "buy", "pc", 1.0), (d, "buy", "yi dong", 2.0), (d, "buy", "pc", None)]
    df = spark.createDataFrame(rows, "panel_month date, keyword string, source string, search_volume double")
    per = {r.column_name: r.volume for r in ci.search_totals(df).collect()}
    assert per == {"search_buy_all": 1.0, "search_buy_yi_all": 2.0}
    across = {r.column_name: r.volume for r in ci.search_totals(df, "across_sources").collect()}
    assert across == {"search_buy_all": 3.0}


def test_standardize_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (None, 4.0)], "a double, b double")
    rows = st.standardized(df, ["a", "b"]).collect()
    close([r.a for r in rows], [-1, 1, None])
    close([r.b for r in rows], [0, 0, 0])


def test_feature_lists_and_projection(spark):
    assert ar.model_features(["b", "y", "a", "b"], "y", "s_te") == ["b", "a", "s_te"]
    df = spark.createDataFrame([(1, 2.0, "t")], ["k", "a.b", "t"])
    out = ar.project_features(df, ["k"], ["a.b", "gone"]).first()
    assert (out[1], out[2]) == (2.0, 0.0)
    with pytest.raises(ValueError):
        ar.numeric_features(df, ["t"])


def test_artefacts_round_trip(spark, tmp_path):
    base = str(tmp_path)
    ar.write_weights(spark, ["z", "a"], [0.7, 0.3], f"{base}/w")
    assert ar.read_weights(spark, f"{base}/w") == (["z", "a"], [0.7, 0.3])
    ar.write_features(spark, ["b", "a"], f"{base}/f")
    assert ar.read_features(spark, f"{base}/f") == ["b", "a"]


def test_panel_is_partitioned_by_year(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 5, 1), 1.0), (1, dt.date(2021, 5, 1), 2.0)], "sector_id bigint, panel_month date, x double")
    sinks.write_panel(df, str(tmp_path / "p"))
    back = tables.read_panel(spark, str(tmp_path / "p")).where("panel_year = 2021")
    assert [r.x for r in back.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(panel_year" in back._jdf.queryExecution().executedPlan().toString()


def test_csv_header_must_match(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("2020-Jan", 1.0)], "month string, v double").coalesce(1).write.option("header", True).csv(path)
    with pytest.raises(Exception):
        tables.read_csv(spark, path, tables.schema_for(["month", "other"])).collect()
    assert tables.read_csv(spark, path).dtypes == [("month", "string"), ("v", "double")]


@pytest.mark.parametrize("cell", ['"1,234.5"', "12%", "n/a"])
def test_csv_cells_that_do_not_read_fail(spark, tmp_path, cell):
    (tmp_path / "t.csv").write_text(f"month,v\n2020-Jan,1.5\n2020-Feb,\n2020-Mar,{cell}\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "t.csv")).collect()
    lenient = tables.read_csv(spark, str(tmp_path / "t.csv"), mode="PERMISSIVE")
    assert [r.v for r in lenient.collect()] == [1.5, None, None]


def test_repeated_keys_of_attributes_fail(spark):
    panel = _cells(spark, [(1, dt.date(2020, 1, 1), 1.0)], "x")
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], "sector_id bigint, poi_a double")
    with pytest.raises(Exception, match="repeated sector_id"):
        gr.merge_static(panel, twice).collect()
    months = spark.createDataFrame([(dt.date(2020, 1, 1), 2.0)] * 2, "panel_month date, m double")
    with pytest.raises(Exception, match="repeated panel_month"):
        gr.merge_months(panel, months, "has_m").collect()
    assert gr.merge_static(panel, twice.limit(1)).count() == 1


def test_column_roles(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 1)], ["sector_id", "nh_a", "nh_a_lag1", "poi_x", "search_k", "has_poi", "y"])
    assert list(tables.column_roles(df, "y").values()) == ["key", "sector_metric", "derived", "static", "city_metric", "flag", "target"]


def test_sampled_settings_repeat():
    space = {"a": {"type": "int", "low": 1, "high": 9}, "b": {"type": "loguniform", "low": 0.01, "high": 1.0},
             "c": {"type": "categorical", "choices": ["x", "y"]}, "d": {"type": "uniform", "low": 0, "high": 1}}
    first = le.sample_params(space, 5, seed=3)
    assert first == le.sample_params(space, 5, seed=3) != le.sample_params(space, 5, seed=4)
    assert all(1 <= p["a"] <= 9 and 0.01 <= p["b"] <= 1.0 and 0 <= p["d"] <= 1 for p in first)
    with pytest.raises(ValueError):
        le.sample_params({"a": {"type": "zzz"}}, 1)


def test_selection_ranks(spark):
    table = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), ("d", 1.0)], "feature string, importance double")
    assert [r.feature for r in sr.select_features(table, 1, 0.8, ["y"]).collect()] == ["a", "b", "y"]
    assert [r.feature for r in sr.select_features(table, 3, 0.5, ["a"]).collect()] == ["a", "b", "c"]


def _static_rows(spark):
    rng = np.random.default_rng(5)
    middles = np.array([[0.0, 0.0, 0.0], [8.0, 0.0, 3.0], [0.0, 9.0, -3.0], [9.0, 9.0, 0.0]])
    cells = middles[np.arange(60) % 4] + rng.normal(0, 0.4, (60, 3))
    rows = [(i, *[None if (i * 7 + j) % 11 == 0 else float(v) for j, v in enumerate(row)], i) for i, row in enumerate(cells)]
    return spark.createDataFrame(rows, "sector_id bigint, a double, b double, c double, x0 int")


def test_clusters_are_the_same_in_any_order(spark):
    df = _static_rows(spark)
    model = st.fit_clusters(df, ["a", "b", "c"])
    again = st.fit_clusters(df.repartition(7).orderBy(F.desc("sector_id")), ["a", "b", "c"])
    assert np.allclose(model.centres, again.centres, atol=1e-12) and model.centres == sorted(model.centres)
    complete = st.with_clusters(df.na.drop(), model, "label").collect()
    # The four planted groups are found: a group has one label and each label one group.
    assert len({(r.sector_id % 4, r.label) for r in complete}) == 4
    assert {r.x0 == r.sector_id for r in complete} == {True}


def test_clusters_of_few_equal_and_no_rows(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(9)] + [(9, 4.0, 2.0)], "sector_id bigint, a double, b double")
    model = st.fit_clusters(same, ["a", "b"])
    assert len(model.centres) == 2
    assert [r.poi_cluster_id for r in st.with_clusters(same, model).orderBy("sector_id").collect()] == [0] * 9 + [1]
    empty = st.fit_clusters(same.limit(0), ["a", "b"])
    assert empty.centres == [[0.0, 0.0]] and st.with_clusters(same, empty).where("poi_cluster_id = 0").count() == 10


def test_static_model_is_stored_and_applied(spark, tmp_path):
    df, columns = _static_rows(spark), ["a", "b", "c"]
    model = st.fit_static_model(df, columns, count=2)
    ar.write_static_model(spark, model, str(tmp_path / "model"))
    stored = ar.read_static_model(spark, str(tmp_path / "model"))
    assert stored == model
    ratios = {"a_by_b": ("a", "b")}
    steps = st.cluster_imputed(st.add_clusters(df, columns), columns)
    want, _, _ = st.components(se.add_ratios(steps, ratios), columns, 2)
    got = st.apply_static_model(df, stored, ratios)
    assert set(got.columns) == set(want.columns)
    order = ["sector_id", "poi_cluster_id", "imputed_poi_flag", "x0", "a_by_b", "poi_pca_component_1", "poi_pca_component_2"]
    pairs = zip(got.select(order).orderBy("sector_id").collect(), want.select(order).orderBy("sector_id").collect(), strict=True)
    assert all(np.allclose(g, w, atol=1e-9) for g, w in pairs)
    # A sector not seen before and without any value gets all columns; one row alone gets what it got among others.
    lone = spark.createDataFrame([(99, None, None, None, 0)], df.schema)
    row = st.apply_static_model(lone, stored).first()
    assert row.imputed_poi_flag == 1 and row.poi_pca_component_1 is not None
    one = st.apply_static_model(df.where("sector_id = 11"), stored).first()
    assert one == st.apply_static_model(df, stored).where("sector_id = 11").first()
    assert st.apply_static_model(df.limit(0), stored).count() == 0
