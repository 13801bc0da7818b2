"""Refreshing a stored panel against building it anew."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import refresh as re
from monthgrid.operators.grid import dense_grid

KEY, MONTH = "sector_id", "panel_month"
FRAMES = re.Frames(["a", "b"], lags=[1, 2], change_lags=[1], rolling=[2, 3], alphas=[0.3, 0.9], shift=1)
MONTHS = [str(m.date()) for m in pd.date_range("2019-01-01", periods=24, freq="MS")]


def cells(spark, rows, column):
    return spark.createDataFrame(rows, f"{KEY} int, m string, {column} double").withColumn(MONTH, F.col("m").cast("date")).drop("m")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    # Sector 3 is silent for longer than any frame reaches, sector 4 has no value, sector 5 starts late.
    draws = {(s, m, c): rng.uniform(1, 9) for s in (1, 2, 3, 5) for m in MONTHS for c in "ab" if rng.random() < 0.7}
    return {k: v for k, v in draws.items() if not (k[0] == 3 and MONTHS[4] <= k[1] < MONTHS[18]) and not (k[0] == 5 and k[1] < MONTHS[17])}


def built(spark, values, end):
    rows = {c: [(s, m, v) for (s, m, k), v in values.items() if k == c] for c in "ab"}
    sectors = spark.createDataFrame([(s,) for s in range(1, 6)], f"{KEY} int")
    return dense_grid(sectors, {c: cells(spark, rows[c], c) for c in "ab"}, MONTHS[0], end)


def ordered(df, columns):
    return df.select(*columns).toPandas().sort_values([KEY, MONTH], ignore_index=True)


def stored_until(spark, tmp_path, data, end):
    path = str(tmp_path / uuid.uuid4().hex)
    re.store(built(spark, {k: v for k, v in data.items() if k[1] <= end}, end), path, FRAMES)
    return path


def same_as_rebuilt(spark, path, values, end):
    want = re.series_table(built(spark, values, end), FRAMES)
    got = ordered(re.read_months(spark, path), want.columns)
    pd.testing.assert_frame_equal(got, ordered(want, want.columns), rtol=1e-12, check_dtype=False)


def test_months_are_added_one_by_one(spark, tmp_path, data):
    path = stored_until(spark, tmp_path, data, MONTHS[15])
    for n in (16, 17, 19):
        new = {c: cells(spark, [(s, m, v) for (s, m, k), v in data.items() if k == c and MONTHS[max(16, n - 1)] <= m <= MONTHS[n]], c) for c in "ab"}
        made = re.refresh(spark, path, new, FRAMES, end=MONTHS[n])
        assert made.agg(F.min(MONTH)).first()[0].isoformat() >= MONTHS[n - 1]
        same_as_rebuilt(spark, path, {k: v for k, v in data.items() if k[1] <= MONTHS[n]}, MONTHS[n])


def test_corrections_replace_their_own_columns_only(spark, tmp_path, data):
    path = stored_until(spark, tmp_path, data, MONTHS[-1])
    fixed = [(1, MONTHS[10], 100.0), (2, MONTHS[12], None), (4, MONTHS[11], 7.0), (3, MONTHS[14], 2.0)]
    values = dict(data) | {(s, m, "a"): v for s, m, v in fixed}
    before = spark.read.parquet(path).where(F.col(MONTH) < MONTHS[10]).select(F.input_file_name()).distinct().toPandas()
    for _ in range(2):
        re.refresh(spark, path, {"fixed": cells(spark, fixed, "a")}, FRAMES)
        same_as_rebuilt(spark, path, values, MONTHS[-1])
    after = spark.read.parquet(path).where(F.col(MONTH) < MONTHS[10]).select(F.input_file_name()).distinct().toPandas()
    assert sorted(before.iloc[:, 0]) == sorted(after.iloc[:, 0])


def test_history_is_read_as_far_as_frames_reach(spark, tmp_path, data):
    path = stored_until(spark, tmp_path, data, MONTHS[-1])
    assert FRAMES.reach == 3
    read = re.read_months(spark, path).where(F.col(MONTH) >= F.lit(MONTHS[20]).cast("date"))
    assert "PartitionFilters: [isnotnull(panel_month" in read._jdf.queryExecution().executedPlan().toString()


def test_nothing_new_and_errors(spark, tmp_path, data):
    path = stored_until(spark, tmp_path, data, MONTHS[6])
    empty = cells(spark, [], "a")
    assert re.refresh(spark, path, {"none": empty}, FRAMES).count() == 0
    assert re.refresh(spark, path, {}, FRAMES, end=MONTHS[0]).count() == 0
    for late in ([(1, MONTHS[9], 1.0)], [(1, "2018-12-01", 1.0)]):
        with pytest.raises(ValueError, match="outside"):
            re.refresh(spark, path, {"x": cells(spark, late, "a")}, FRAMES)
    for wrong, message in (([(1, MONTHS[5], 1.0), (1, MONTHS[5], 2.0)], "repeated"), ([(77, MONTHS[5], 1.0)], "does not have")):
        with pytest.raises(Exception, match=message):
            re.refresh(spark, path, {"x": cells(spark, wrong, "a")}, FRAMES)
    same_as_rebuilt(spark, path, {k: v for k, v in data.items() if k[1] <= MONTHS[6]}, MONTHS[6])


def test_gathered_series_are_smoothed_in_one_pass(spark, data, monkeypatch):
    from monthgrid.operators import scans
    from monthgrid.operators import series as se

    panel = built(spark, data, MONTHS[-1])
    names = list(FRAMES.smooth_names.values())
    want = ordered(se.add_ewm(panel, FRAMES.columns, FRAMES.alphas, [KEY], MONTH, point="_"), [KEY, MONTH, *names])

    def dealt_again(df):
        raise AssertionError("series are stored once more")

    monkeypatch.setattr(scans, "checkpointed", dealt_again)
    got = re.series_table(panel, FRAMES)
    pd.testing.assert_frame_equal(ordered(got, [KEY, MONTH, *names]), want, rtol=1e-12)
