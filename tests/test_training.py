"""Encoding out of fold, target rules, exact lines between blends, and the search that prunes and resumes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import blending as bl
from monthgrid.operators import folds as fo
from monthgrid.operators import learners as le
from monthgrid.session import scratch_path


def test_no_row_sees_its_own_target(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{rng.integers(0, 6)}" if i % 9 else None, int(i % 4), float(2.0**i) if i % 7 else None) for i in range(40)] + [("alone", 0, 3.0), ("one part", 1, 4.0), ("one part", 1, 5.0)]
    df = spark.createDataFrame(rows, "c string, p int, y double")
    got = fo.encode_out_of_fold(df, "c", "y", "e", -1.0, part=F.col("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        others = [y for c, p, y in rows if c == r.c and p != r.p and y is not None] if r.c is not None else []
        assert r.e == (sum(others) / len(others) if others else -1.0)
    # With distinct powers of two a mean shows which targets went into it.
    shifted = fo.encode_out_of_fold(df.withColumn("y", F.when(F.col("p") == 2, F.col("y") * 1000).otherwise(F.col("y"))), "c", "y", "e", -1.0, part=F.col("p"))
    same = lambda d: sorted((str(r.c), r.e) for r in d if r.p == 2)
    assert same(got) == same(shifted.collect())


def test_fold_rows_are_encoded_as_asked(spark):
    months = [f"2020-{m:02d}-01" for m in range(1, 11)]
    rows = [(s, m, float(10 * s + i)) for s in (1, 2) for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "sector_id int, panel_month string, y double").withColumn("panel_month", F.col("panel_month").cast("date"))
    fold = fo.Fold(1, "2020-08-01", "2020-09-01", "2020-10-01")
    part = lambda role, how: le.fold_part(df, fold, role, fo.Decay(), "sector_id", "y", encoding=how)
    whole = {1: 13.5, 2: 23.5}
    assert all(r.sector_id_te == whole[r.sector_id] for r in part("train", "in_fold").collect() + part("valid", "out_of_fold").collect())
    for r in part("train", "out_of_fold").collect():
        own = [10.0 * r.sector_id + i for i in range(8) if (2020 * 12 + i + 1) % 5 != (2020 * 12 + r.panel_month.month) % 5]
        assert abs(r.sector_id_te - sum(own) / len(own)) < 1e-12
    assert "sector_id_te" not in part("train", "none").columns and part("valid", "none").count() == 4
    with pytest.raises(ValueError):
        part("train", "leaky")


def direct(wide, weights):
    y, p = wide[:, 0], wide[:, 1:]
    error = np.abs(p @ np.array(weights) - y) / np.where(y == 0, 1, np.abs(y))
    good = error <= 1
    bad = 1 - good.mean()
    return 0.0 if bad > 0.3 else max(0.0, 1 - error[good].mean() / (1 - bad))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_line_optima_are_the_true_ones(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.choice([0.0, 5.0, 40.0, -3.0], 60) + rng.choice([0.0, 1.0], 60) * rng.normal(size=60)
    p = y[:, None] * rng.uniform(0.3, 2.2, (60, 3)) + rng.normal(size=(60, 3))
    p[:5, 1] = p[:5, 0]  # lines that change nothing for a row
    wide = np.column_stack([y, p])
    df = spark.createDataFrame(wide.tolist(), "y_true double, pred_a double, pred_b double, pred_c double").repartition(5)
    start, bounds = [0.5, 0.2, 0.3], (0.05, 0.9) if seed else (0.0, 1.0)
    for line in bl.line_optima(df, list("abc"), start, bounds).collect():
        x, z = line.x, line.y
        low, high = max(bounds[0] - start[x], start[z] - bounds[1]), min(bounds[1] - start[x], start[z] - bounds[0])
        scale, r, g = np.where(y == 0, 1, np.abs(y)), p @ np.array(start) - y, p[:, x] - p[:, z]
        with np.errstate(divide="ignore", invalid="ignore"):
            marks = np.concatenate([(-scale - r) / g, -r / g, (scale - r) / g, [low, high], np.linspace(low, high, 400)])
        marks = marks[np.isfinite(marks) & (marks >= low) & (marks <= high)]

        def at(t, x=x, z=z):
            w = list(start)
            w[x] += t
            w[z] -= t
            return direct(wide, w)

        best = max(at(min(max(t + d, low), high)) for t in marks for d in (0.0, 1e-10, -1e-10))
        assert abs(line.score - best) < 1e-8 and low <= line.shift <= high and abs(at(line.shift) - best) < 1e-8
    if seed:
        return
    weights, score = bl.search_weights(df, list("abc"), 4, refinements=0, line_rounds=30)
    plain, plain_score = bl.search_weights(df, list("abc"), 4, refinements=0)
    assert score >= plain_score and abs(score - direct(wide, list(weights.values()))) < 1e-9
    assert bl.line_optima(df, list("abc"), list(weights.values())).agg(F.max("score")).first()[0] <= score + 1e-8
    with pytest.raises(Exception, match="cannot be scored"):
        bl.line_optima(df.withColumn("pred_a", F.lit(None).cast("double")), list("abc"), start).collect()


def test_rounds_of_the_race():
    assert le.halving_rounds(40, 5, 0.5) == [(40, 1), (20, 2), (10, 4), (5, 5)]
    assert le.halving_rounds(40, 5, None) == [(40, 5)] and le.halving_rounds(7, 1, 0.5) == [(7, 1)]


class Stopped(Exception):
    pass


def test_search_prunes_and_resumes(spark, monkeypatch):
    """Scores come from a table instead of fits, so that every step of the race can be checked."""
    value = lambda setting, fold: round(0.5 + 0.01 * setting - 0.001 * fold * (setting % 3), 6)
    fits = []

    def predictions(df, folds, learner, features, target, params, *args, **kwargs):
        if len(fits) == stop_after:
            raise Stopped
        fits.append((params["a"], folds[0].fold))
        return spark.createDataFrame([(folds[0].fold, 1.0, 2.0 - value(params["a"], folds[0].fold))], "fold int, y_true double, y_pred double")

    monkeypatch.setattr(le, "fold_predictions", predictions)
    monkeypatch.setattr(le, "fold_tables", lambda df, folds, *a, **k: {f.fold: None for f in folds})
    folds, settings = fo.numbered_folds([("2020-01-01",) * 3] * 5), [{"a": i} for i in range(8)]
    log, rows = scratch_path(spark, "trial_log"), spark.range(1)
    run = lambda version="v1", keep=0.5: le.search(
        rows, folds, "boosted", [], "y", settings, log=log, data_version=version, keep=keep, parallelism=1
    ).collect()
    stop_after = 5
    with pytest.raises(Stopped):
        run()
    assert len(fits) == 5 and spark.read.parquet(log).count() == 5
    stop_after = -1
    found = run()
    # 8 settings on one fold, 4 on two, 2 on four, 1 on all: what was logged is not fitted again.
    assert len(fits) == len(set(fits)) == 8 + 4 + 2 * 2 + 1 == len(found)
    seen = {t: sorted(r.fold for r in found if r.trial == t) for t in range(8)}
    assert sorted(map(len, seen.values())) == [1, 1, 1, 1, 2, 2, 4, 5] and all(f[-1] == 5 for f in seen.values())
    assert all(abs(r.score - value(r.trial, r.fold)) < 1e-9 and r.params == {"a": str(r.trial)} for r in found)
    best = le.best_trial(spark.createDataFrame(found)).first()
    assert len(seen[best.trial]) == 5
    # The best mean by SQL over the stored scores.
    spark.read.parquet(log).createOrReplaceTempView("logged")
    want = spark.sql("SELECT setting, avg(score) AS m FROM logged GROUP BY setting HAVING count(*) = 5").collect()
    assert len(want) == 1 and abs(want[0].m - best.score) < 1e-12 and want[0].setting == le.setting_key(settings[best.trial], 42)
    assert run() == found and len(fits) == 17
    # Other data, or a search of all folds, fits what is missing only.
    everything = run(keep=None)
    assert len(everything) == 40 and len(fits) == 40
    run(version="v2")
    assert len(fits) == 57
    spark.catalog.dropTempView("logged")


def test_search_takes_real_fits_from_its_log(spark):
    rng = np.random.default_rng(5)
    months = [f"{y}-{m:02d}-01" for y in (2019, 2020) for m in range(1, 13)]
    rows = [(s, m, float(rng.uniform(0, 1)), float(s * 10 + rng.uniform(0, 1))) for s, (m) in itertools.product(range(6), months)]
    df = spark.createDataFrame(rows, "sector_id int, panel_month string, x double, y double").withColumn("panel_month", F.col("panel_month").cast("date"))
    folds = fo.numbered_folds([("2020-04-01", "2020-05-01", "2020-06-01"), ("2020-06-01", "2020-07-01", "2020-08-01")])
    settings, log = [{"numTrees": 2, "maxDepth": 2}, {"numTrees": 3, "maxDepth": 3}], scratch_path(spark, "trial_log")
    for encoding, rule in (("in_fold", le.TargetRule()), ("out_of_fold", le.TargetRule(log=False, minimum=None)), ("none", le.TargetRule(epsilon=1.0))):
        features = ["x"] + (["sector_id_te"] if encoding != "none" else [])
        run = lambda path=None: sorted(map(str, le.search(  # noqa: E731, B023
            df, folds, "random_forest", features, "y", settings, rule=rule, encoding=encoding, log=path, data_version=encoding).collect()))  # noqa: B023
        first = run(log)
        assert len(first) == 4 and run(log) == first


def test_boosted_trees_of_merged_rows_are_those_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(a), float(b), float(a * 3 - b + rng.uniform()), float(w)) for a, b, w in zip(rng.integers(0, 6, 2000), rng.integers(-2, 3, 2000), rng.uniform(0.1, 2, 2000), strict=True)]
    df = spark.createDataFrame(rows, "a int, b double, y double, weights double")
    written = []
    real = le.materialize
    monkeypatch.setattr(le, "materialize", lambda d, name="cut": written.append(real(d, name)) or written[-1])
    params, rule = {"maxIter": 4, "maxDepth": 3}, le.TargetRule(log=False, minimum=None)
    for learner in ("boosted", "boosted_scaled"):
        model = le.fit(df, learner, ["a", "b"], "y", params, rule=rule)
        assert written[-1].count() <= 30  # a row for each pair of values
        plain = le.build_pipeline(learner, ["a", "b"], params).fit(df.withColumn(le.LABEL, F.col("y")))
        both = le.predict(plain, le.predict(model, df, ["a", "b"], "merged", rule), ["a", "b"], "single", rule)
        assert both.columns == [*df.columns, "merged", "single"]
        assert both.agg(F.max(F.abs(F.col("merged") - F.col("single")))).first()[0] < 1e-9
