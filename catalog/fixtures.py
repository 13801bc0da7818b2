"""The library's input tables, derived from the given ones.

A customer plays the role of a sector and its orders are its monthly
transactions, so the panel has one series per customer and grows with the data.
The same derivations are stated as common table expressions for the oracle.
Money is summed in whole cents, so both engines start from identical numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthgrid.functions.calendar import month_start, row_id
from monthgrid.functions.numeric import absolute_percentage_error
from monthgrid.operators import folds as fo
from monthgrid.operators import series as se
from monthgrid.operators.grid import dense_grid
from monthgrid.session import materialize

from .registry import cte

START, END = "1995-01-01", "2001-08-01"
HORIZON = "2000-09-01"
TRAIN_END = "2000-08-01"
HORIZON_MONTHS = [f"2000-{m:02d}-01" for m in range(9, 13)] + [f"2001-{m:02d}-01" for m in range(1, 9)]
KEY, MONTH = "sector_id", "panel_month"
MODELS = ["naive", "yearly", "smooth"]
FOLD_BOUNDS = [
    ("1998-06-01", "1998-07-01", "1998-12-01"),
    ("1998-12-01", "1999-01-01", "1999-06-01"),
    ("1999-06-01", "1999-07-01", "1999-12-01"),
    ("1999-12-01", "2000-01-01", "2000-06-01"),
    ("2000-06-01", "2000-07-01", "2000-12-01"),
]
FOLDS = fo.numbered_folds(FOLD_BOUNDS)
URGENT = ("1-URGENT", "2-HIGH")
# Factors on the three forecasts, with enough digits that no result falls on a rounding tie.
SHRINK = {"naive": 0.91371318, "yearly": 0.50231307, "smooth": 0.80125714}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column | str) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) * 100).cast("bigint")


def money(whole_cents: Column) -> Column:
    return whole_cents.cast("double") / F.lit(100.0)


def exact_mean(value: Column, window) -> Column:
    """Mean by way of whole cents: the same bits in every order of rows."""
    return F.try_divide(money(F.sum(cents(value)).over(window)), F.count(value).over(window))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select((F.col("c_custkey") + 1).alias(KEY))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") + 1).alias(KEY),
        month_start("o_orderdate").alias(MONTH),
        cents("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )


def _cells(orders: DataFrame) -> DataFrame:
    """Amount and number per sector and month; a busy customer combines map-side."""
    return orders.groupBy(KEY, MONTH).agg(
        money(F.sum("price")).alias("amount"), F.count(F.lit(1)).cast("double").alias("num")
    )


def _nearby(own: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Amount of the other customers of the same nation in the same month.

    There are 25 nations, so the nation-by-month totals are bounded by the
    calendar and may be broadcast.
    """
    nations = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias(KEY), "c_nationkey")
    placed = own.select(KEY, MONTH, cents("amount").alias("own")).join(nations, KEY)
    totals = placed.groupBy("c_nationkey", MONTH).agg(F.sum("own").alias("total"), F.count("own").alias("n"))
    rest = F.when(F.col("n") > 1, money(F.col("total") - F.col("own")))
    return placed.join(F.broadcast(totals), ["c_nationkey", MONTH]).select(KEY, MONTH, rest.alias("amount"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_orders(spark, d))


def new_house(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_orders(spark, d).where(F.col("priority").isin(*URGENT)))


def pre_owned(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_orders(spark, d).where(~F.col("priority").isin(*URGENT)))


def land(spark: SparkSession, d: str) -> DataFrame:
    """Returned line items per customer and month, summed per order before the join."""
    lines = (
        table(spark, d, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(cents("l_extendedprice")).alias("returned"))
    )
    joined = lines.join(_orders(spark, d).select("o_orderkey", KEY, MONTH), "o_orderkey")
    return joined.groupBy(KEY, MONTH).agg(money(F.sum("returned")).alias("amount"))


def source_cells(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The six sector-by-month tables, prefixed as they are merged."""
    tables = {"nh": new_house(spark, d), "po": pre_owned(spark, d), "land": land(spark, d)}
    tables = {name: materialize(t, name) for name, t in tables.items()}
    nearby = {f"{name}nbr": _nearby(tables[name], spark, d) for name in tables}
    return {
        name: t.select(KEY, MONTH, *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c not in (KEY, MONTH)])
        for name, t in (tables | nearby).items()
    }


def panel(spark: SparkSession, d: str) -> DataFrame:
    """``sector_id, panel_month, amount, num``: dense, null where nothing was ordered."""
    return dense_grid(sectors(spark, d), {"cells": cells(spark, d)}, START, END)


def statics(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer, with gaps: low balances, and customers without orders."""
    per_customer = _orders(spark, d).groupBy(KEY).agg(
        F.count(F.lit(1)).cast("double").alias("poi_number_of_shops"),
        F.count_if(F.col("priority").isin(*URGENT)).cast("double").alias("poi_catering"),
        (money(F.sum("price")) / F.count(F.lit(1))).alias("poi_mean_price"),
        money(F.max("price")).alias("poi_max_price"),
    )
    balance = F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal"))
    base = table(spark, d, "customer").select(
        (F.col("c_custkey") + 1).alias(KEY),
        balance.alias("poi_resident_population"),
        (F.col("c_nationkey") % 4).alias("given_cluster"),
    )
    return base.join(per_customer, KEY, "left")


STATIC_COLUMNS = ["poi_resident_population", "poi_number_of_shops", "poi_catering", "poi_mean_price", "poi_max_price"]


def searches(spark: SparkSession, d: str) -> DataFrame:
    """Events per day, type and kind of user; a day stands for a month."""
    source = F.when(F.col("user_id") % 2 == 0, F.lit("pc")).otherwise(F.lit("yi dong"))
    return (
        table(spark, d, "events")
        .groupBy(F.to_date("ts").alias(MONTH), F.col("event_type").alias("keyword"), source.alias("source"))
        .agg(F.count(F.lit(1)).cast("double").alias("search_volume"))
    )


def city_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Revised yearly totals: years 1997 and 1999 absent, the 1998 total empty."""
    year = F.year(MONTH)
    return (
        _orders(spark, d)
        .groupBy(year.alias("data_year"), F.substring("priority", 1, 1).cast("int").alias("revision"))
        .agg(money(F.sum("price")).alias("total_price"), F.count(F.lit(1)).cast("double").alias("order_count"))
        .where(~F.col("data_year").isin(1997, 1999))
        .withColumn("total_price", F.when(F.col("data_year") != 1998, F.col("total_price")))
    )


def test_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all customers over the horizon, and of one unknown sector per customer."""
    months = F.explode(F.array(*[F.lit(m).cast("date") for m in HORIZON_MONTHS])).alias(MONTH)
    known = sectors(spark, d).select(KEY, months)
    unknown = sectors(spark, d).select((F.col(KEY) + 1_000_000_000).alias(KEY), F.lit(HORIZON).cast("date").alias(MONTH))
    return known.unionByName(unknown).select(row_id(MONTH, KEY).alias("id"))


def _modelled(df: DataFrame) -> DataFrame:
    """Three simple forecasts from past values and the sector's training mean."""
    mean = F.col("train_mean")
    return df.withColumns(
        {
            "pred_naive": F.coalesce(F.col("amount_lag1"), mean, F.lit(0.0)) * SHRINK["naive"],
            "pred_yearly": F.coalesce(F.col("amount_lag12"), mean, F.lit(0.0)) * SHRINK["yearly"],
            "pred_smooth": F.coalesce(F.col("amount_roll6_mean"), mean, F.lit(0.0)) * SHRINK["smooth"],
        }
    )


def past_features(spark: SparkSession, d: str) -> DataFrame:
    df = se.add_lags(panel(spark, d), ["amount"], [1, 12], [KEY], MONTH)
    frame = se.series_window([KEY], MONTH).rowsBetween(-6, -1)
    return df.withColumn("amount_roll6_mean", exact_mean(F.col("amount"), frame))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Validation predictions of three models over five folds, in long form.

    The training mean per fold is a window sum over the sector's own rows, so
    it needs no shuffle beyond the panel's.
    """
    df = past_features(spark, d)
    whole = se.series_window([KEY], MONTH).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for f in FOLDS:
        past = F.when(F.col(MONTH) <= F.lit(f.train_end).cast("date"), F.col("amount"))
        df = df.withColumn(f"_mean{f.fold}", exact_mean(past, whole))
    means = F.array(*[F.col(f"_mean{f.fold}") for f in FOLDS])
    valid = fo.assigned(df.where(F.col("amount").isNotNull()), FOLDS, "valid")
    valid = _modelled(valid.withColumn("train_mean", F.get(means, F.col("fold") - 1)))
    kept = ["fold", "reference_month", KEY, MONTH, "amount", *[f"pred_{m}" for m in MODELS]]
    valid = materialize(valid.select(kept), "valid")
    weighted = fo.add_decay_weights(valid, fo.Decay(), F.col("reference_month"), by=["fold"])
    long = weighted.select(
        "fold", KEY, MONTH, F.col("amount").alias("y_true"), "weights", *[F.col(f"pred_{m}").alias(m) for m in MODELS]
    ).unpivot(["fold", KEY, MONTH, "y_true", "weights"], MODELS, "model", "y_pred")
    return long.withColumn("ape", absolute_percentage_error("y_true", "y_pred"))


def horizon_predictions(spark: SparkSession, d: str) -> DataFrame:
    """``pred_<model>`` for every sector over the last twelve months."""
    whole = se.series_window([KEY], MONTH).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    past = F.when(F.col(MONTH) <= F.lit(TRAIN_END).cast("date"), F.col("amount"))
    df = past_features(spark, d).withColumn("train_mean", exact_mean(past, whole))
    df = df.where(F.col(MONTH) >= F.lit(HORIZON).cast("date"))
    return _modelled(df).select(KEY, MONTH, *[f"pred_{m}" for m in MODELS])


# --- the same tables for the oracle ---------------------------------------

cte("cust", "SELECT c_custkey + 1 AS sector_id, c_nationkey, c_acctbal FROM customer")
cte(
    "ord",
    """
SELECT o_orderkey, o_custkey + 1 AS sector_id,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS panel_month,
       CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_orderpriority AS priority
FROM orders""",
)
cte(
    "months",
    f"""
SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH)) AS DATE) AS panel_month""",
)
_CELLS = """
SELECT sector_id, panel_month, CAST(SUM(price) AS DOUBLE) / 100 AS amount, CAST(COUNT(*) AS DOUBLE) AS num
FROM ord {where} GROUP BY sector_id, panel_month"""
cte("cells", _CELLS.format(where=""), ("ord",))
cte("nh", _CELLS.format(where="WHERE priority IN ('1-URGENT', '2-HIGH')"), ("ord",))
cte("po", _CELLS.format(where="WHERE priority NOT IN ('1-URGENT', '2-HIGH')"), ("ord",))
cte(
    "land",
    """
SELECT sector_id, panel_month, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount
FROM lineitem JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
GROUP BY sector_id, panel_month""",
    ("ord",),
)
for _name in ("nh", "po", "land"):
    cte(
        f"{_name}nbr",
        f"""
SELECT sector_id, panel_month,
       CASE WHEN COUNT(*) OVER g > 1 THEN CAST(SUM(CAST(round(amount * 100) AS BIGINT)) OVER g
            - CAST(round(amount * 100) AS BIGINT) AS DOUBLE) / 100 END AS amount
FROM {_name} JOIN cust USING (sector_id) WINDOW g AS (PARTITION BY c_nationkey, panel_month)""",
        (_name, "cust"),
    )
cte(
    "panel",
    """
SELECT c.sector_id, m.panel_month, x.amount, x.num
FROM cust c CROSS JOIN months m
LEFT JOIN cells x ON x.sector_id = c.sector_id AND x.panel_month = m.panel_month""",
    ("cust", "months", "cells"),
)
cte(
    "statics",
    """
SELECT c.sector_id, CASE WHEN c_acctbal >= 1000 THEN c_acctbal END AS poi_resident_population,
       c_nationkey % 4 AS given_cluster, poi_number_of_shops, poi_catering, poi_mean_price, poi_max_price
FROM cust c LEFT JOIN (
  SELECT sector_id, CAST(COUNT(*) AS DOUBLE) AS poi_number_of_shops,
         CAST(COUNT(*) FILTER (WHERE priority IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS poi_catering,
         CAST(SUM(price) AS DOUBLE) / 100 / COUNT(*) AS poi_mean_price, CAST(MAX(price) AS DOUBLE) / 100 AS poi_max_price
  FROM ord GROUP BY sector_id) o USING (sector_id)""",
    ("cust", "ord"),
)
cte(
    "searches",
    """
SELECT CAST(ts AS DATE) AS panel_month, event_type AS keyword,
       CASE WHEN user_id % 2 = 0 THEN 'pc' ELSE 'yi dong' END AS source, CAST(COUNT(*) AS DOUBLE) AS search_volume
FROM events GROUP BY 1, 2, 3""",
)
cte(
    "city_indexes",
    """
SELECT CAST(year(panel_month) AS INTEGER) AS data_year, CAST(substr(priority, 1, 1) AS INTEGER) AS revision,
       CASE WHEN year(panel_month) <> 1998 THEN CAST(SUM(price) AS DOUBLE) / 100 END AS total_price,
       CAST(COUNT(*) AS DOUBLE) AS order_count
FROM ord WHERE year(panel_month) NOT IN (1997, 1999) GROUP BY year(panel_month), substr(priority, 1, 1)""",
    ("ord",),
)
cte(
    "test_ids",
    f"""
SELECT strftime(panel_month, '%Y %b') || '_sector ' || sector_id AS id
FROM cust CROSS JOIN months WHERE panel_month >= DATE '{HORIZON}'
UNION ALL
SELECT strftime(DATE '{HORIZON}', '%Y %b') || '_sector ' || (sector_id + 1000000000) FROM cust""",
    ("cust", "months"),
)
cte(
    "folds",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({f.fold}, DATE '{f.train_end}', DATE '{f.valid_start}', DATE '{f.valid_end}')" for f in FOLDS)
    + ") f(fold, train_end, valid_start, valid_end)",
)
cte(
    "past",
    """
SELECT *, LAG(amount, 1) OVER w AS lag1, LAG(amount, 12) OVER w AS lag12,
       CAST(SUM(CAST(round(amount * 100) AS BIGINT)) OVER s AS DOUBLE) / 100 / NULLIF(COUNT(amount) OVER s, 0) AS roll6
FROM panel WINDOW w AS (PARTITION BY sector_id ORDER BY panel_month),
  s AS (PARTITION BY sector_id ORDER BY panel_month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    ("panel",),
)
_MODEL_SQL = """
COALESCE(lag1, train_mean, 0.0) * CAST({naive} AS DOUBLE) AS pred_naive,
COALESCE(lag12, train_mean, 0.0) * CAST({yearly} AS DOUBLE) AS pred_yearly,
COALESCE(roll6, train_mean, 0.0) * CAST({smooth} AS DOUBLE) AS pred_smooth""".format(**SHRINK)
cte(
    "wide_predictions",
    f"""
SELECT v.fold, p.sector_id, p.panel_month, p.amount AS y_true, {_MODEL_SQL},
       pow(0.5, ((year(valid_end) - year(p.panel_month)) * 12 + month(valid_end) - month(p.panel_month)) / 12.0)
         / AVG(pow(0.5, ((year(valid_end) - year(p.panel_month)) * 12 + month(valid_end) - month(p.panel_month)) / 12.0))
           OVER (PARTITION BY v.fold) AS weights
FROM past p JOIN folds v ON p.panel_month BETWEEN v.valid_start AND v.valid_end
LEFT JOIN (SELECT f.fold, q.sector_id, CAST(SUM(CAST(round(q.amount * 100) AS BIGINT)) AS DOUBLE) / 100 / COUNT(*) AS train_mean FROM cells q JOIN folds f ON q.panel_month <= f.train_end
           GROUP BY f.fold, q.sector_id) m ON m.fold = v.fold AND m.sector_id = p.sector_id
WHERE p.amount IS NOT NULL""",
    ("past", "folds", "cells"),
)
cte(
    "predictions",
    """
SELECT *, abs(y_pred - y_true) / greatest(abs(y_true), CAST(1e-8 AS DOUBLE)) AS ape FROM (
  SELECT 'naive' AS model, fold, sector_id, panel_month, y_true, pred_naive AS y_pred, weights FROM wide_predictions
  UNION ALL
  SELECT 'yearly', fold, sector_id, panel_month, y_true, pred_yearly, weights FROM wide_predictions
  UNION ALL
  SELECT 'smooth', fold, sector_id, panel_month, y_true, pred_smooth, weights FROM wide_predictions)""",
    ("wide_predictions",),
)
cte(
    "horizon_predictions",
    f"""
SELECT p.sector_id, p.panel_month, {_MODEL_SQL}
FROM past p LEFT JOIN (SELECT sector_id, CAST(SUM(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 / COUNT(*) AS train_mean FROM cells
  WHERE panel_month <= DATE '{TRAIN_END}' GROUP BY sector_id) m USING (sector_id)
WHERE p.panel_month >= DATE '{HORIZON}'""",
    ("past", "cells"),
)
