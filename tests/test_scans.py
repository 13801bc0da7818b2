"""Scans of series in fragments against pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import scans
from monthgrid.operators import series as se


def test_fragments_compose_to_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        values = [None if rng.random() < 0.4 else rng.uniform(-5, 5) for _ in range(rng.randint(0, 30))]
        alpha, cuts = rng.choice([0.1, 0.5, 0.9]), sorted(rng.randint(0, 30) for _ in range(3))
        state, pieces = scans.START, [values[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        for piece in pieces:
            fragment = scans.Fragment()
            fragment.add(piece[:2], alpha)
            fragment.add(piece[2:], alpha)
            state = fragment.apply(state, alpha)
        _, want = scans.smooth(values, alpha, scans.START)
        assert (state[0] is None) == (want[0] is None)
        assert want[0] is None or (abs(state[0] - want[0]) < 1e-12 and abs(state[1] - want[1]) < 1e-12)


@pytest.mark.parametrize("parts", ["1", "9"])
def test_series_of_all_lengths(spark, parts):
    rng = random.Random(int(parts))
    rows = [(k, g, i, None if rng.random() < 0.3 else rng.uniform(0, 9), f"t{i}") for k, n in ((1, 700), (2, 1), (3, 0), (None, 40), (4, 3), (5, 90)) for g in "ab" for i in range(n)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that series are cut
    try:
        df = spark.createDataFrame(rows, "k int, g string, pos int, `x.y` double, tag string").withColumn("day", F.date_add(F.lit("2020-01-01"), F.col("pos")))
        out = se.add_ewm(df, ["x.y"], [0.3, 0.9], ["k", "g"], "pos")
        plan = out._jdf.queryExecution().toString()
        got = out.toPandas().sort_values(["k", "g", "pos"], ignore_index=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "collect_list" not in plan and list(got.columns) == ["k", "g", "pos", "x.y", "tag", "day", "x.y_ewm_alpha0.3", "x.y_ewm_alpha0.9"]
    pdf = pd.DataFrame(rows, columns=["k", "g", "pos", "x", "tag"]).sort_values(["k", "g", "pos"], ignore_index=True)
    assert got.tag.tolist() == pdf.tag.tolist()
    for a in (0.3, 0.9):
        want = pdf.groupby(["k", "g"], dropna=False).x.transform(lambda s, a=a: s.ewm(alpha=a, adjust=False).mean())
        pd.testing.assert_series_equal(got[f"x.y_ewm_alpha{a}"], want, check_names=False, rtol=1e-12)
    assert se.add_ewm(df.where("false"), ["x.y"], [0.3], ["k", "g"], "pos").count() == 0


def test_one_series_of_a_million_rows(spark):
    value = F.when(F.col("id") % 7 != 0, (F.xxhash64("id") % 1000).cast("double"))
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), value.alias("x")).repartition(6)
    out = se.add_ewm(df, ["x"], [0.05], ["k"], "pos")
    tasks = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(tasks) < 600_000
    got = out.orderBy("pos").toPandas()
    want = got.x.ewm(alpha=0.05, adjust=False).mean()
    pd.testing.assert_series_equal(got["x_ewm_alpha0.05"], want, check_names=False, rtol=1e-9)
