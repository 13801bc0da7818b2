"""Time-series features and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.operators import grid as gr
from monthgrid.operators import impute as im
from monthgrid.operators import quantiles as qu
from monthgrid.operators import series as se
from monthgrid.session import materialize

from . import fixtures as fx
from .panel_queries import interpolation_sql, merged, rounded
from .registry import query

KEY, MONTH = fx.KEY, fx.MONTH
LAGS, CHANGES = [1, 2, 3, 6, 12], [1, 3, 12]
W = "WINDOW w AS (PARTITION BY sector_id ORDER BY panel_month)"


def _lag_sql(lags: list[int]) -> str:
    return ", ".join(f"LAG(amount, {k}) OVER w AS amount_lag{k}" for k in lags)


@query("sector_lags", f"SELECT sector_id, panel_month, amount, {_lag_sql(LAGS)} FROM panel {W}", ("panel",))
def sector_lags(spark: SparkSession, d: str) -> DataFrame:
    return se.add_lags(fx.panel(spark, d).drop("num"), ["amount"], LAGS, [KEY], MONTH)


def _change_sql(k: int) -> str:
    lag = f"LAG(amount, {k}) OVER w"
    return f"amount - {lag} AS amount_diff{k}, (amount - {lag}) / NULLIF({lag}, 0) AS amount_pctchg{k}"


@query(
    "diff_pct",
    f"SELECT sector_id, panel_month, {', '.join(_change_sql(k) for k in CHANGES)} FROM panel {W}",
    ("panel",),
)
def diff_pct(spark: SparkSession, d: str) -> DataFrame:
    df = se.add_lags(fx.panel(spark, d), ["amount"], CHANGES, [KEY], MONTH)
    out = se.add_changes(df, ["amount"], CHANGES)
    return out.select(KEY, MONTH, *[f"amount_{what}{k}" for k in CHANGES for what in ("diff", "pctchg")])


def _rolling_sql(n: int) -> str:
    frame = f"(PARTITION BY sector_id ORDER BY panel_month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""ROUND(AVG(amount) OVER {frame}, 6) AS amount_roll{n}_mean,
    ROUND(stddev_samp(amount) OVER {frame}, 4) AS amount_roll{n}_std,
    MIN(amount) OVER {frame} AS amount_roll{n}_min, MAX(amount) OVER {frame} AS amount_roll{n}_max"""


@query("rolling_stats", f"SELECT sector_id, panel_month, {_rolling_sql(3)}, {_rolling_sql(6)} FROM panel", ("panel",))
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    out = se.add_rolling(fx.panel(spark, d).drop("num"), ["amount"], [3, 6], [KEY], MONTH).drop("amount")
    return rounded(rounded(out, ["amount_roll3_mean", "amount_roll6_mean"]), ["amount_roll3_std", "amount_roll6_std"], 4)


def _ewm_step(a: float, m: str, w: str) -> str:
    """Next mean and weight of the recursion, given the row ``r`` and the state ``m, w``."""
    x, alpha, keep = "r.amount", f"CAST({a!r} AS DOUBLE)", f"{w} * CAST({1.0 - a!r} AS DOUBLE)"
    return f"""CASE WHEN {x} IS NULL OR {x} = {m} THEN {m} WHEN {m} IS NULL THEN {x}
      ELSE ({keep} * {m} + {alpha} * {x}) / ({keep} + {alpha}) END,
      CASE WHEN {x} IS NOT NULL THEN CAST(1 AS DOUBLE) WHEN {m} IS NULL THEN {w} ELSE {keep} END"""


EWM_CTES = f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY sector_id ORDER BY panel_month) AS pos FROM panel),
folded AS (
  SELECT sector_id, panel_month, pos, amount AS m1, CAST(1 AS DOUBLE) AS w1, amount AS m2, CAST(1 AS DOUBLE) AS w2
  FROM numbered WHERE pos = 1
  UNION ALL
  SELECT r.sector_id, r.panel_month, r.pos, {_ewm_step(0.3, "e.m1", "e.w1")}, {_ewm_step(0.5, "e.m2", "e.w2")}
  FROM folded e JOIN numbered r ON r.sector_id = e.sector_id AND r.pos = e.pos + 1)
"""
_EWM_SQL = EWM_CTES + 'SELECT sector_id, panel_month, m1 AS "amount_ewm_alpha0.3", m2 AS "amount_ewm_alpha0.5" FROM folded'


@query("ewm", _EWM_SQL, ("panel",))
def ewm(spark: SparkSession, d: str) -> DataFrame:
    out = se.add_ewm(fx.panel(spark, d).drop("num"), ["amount"], [0.3, 0.5], [KEY], MONTH)
    return out.drop("amount")


def _ended_before(k: int) -> str:
    now, then = "LAG(p.amount, 1) OVER w", f"LAG(p.amount, {k + 1}) OVER w"
    return f"{now} - {then} AS amount_diff{k}, ROUND(({now} - {then}) / NULLIF({then}, 0), 6) AS amount_pctchg{k}"


@query(
    "shifted_series",
    f"""{EWM_CTES}
SELECT p.sector_id, p.panel_month, {', '.join(_ended_before(k) for k in CHANGES)},
       ROUND(LAG(e.m1, 1) OVER w, 4) AS "amount_ewm_alpha0_3", ROUND(LAG(e.m2, 1) OVER w, 4) AS "amount_ewm_alpha0_5"
FROM panel p JOIN (SELECT sector_id AS sid, panel_month AS pm, m1, m2 FROM folded) e ON e.sid = p.sector_id AND e.pm = p.panel_month
WINDOW w AS (PARTITION BY p.sector_id ORDER BY p.panel_month)""",
    ("panel",),
)
def shifted_series(spark: SparkSession, d: str) -> DataFrame:
    """Changes and smoothed columns that end a month earlier and so hold nothing of the row's own value."""
    df = se.add_ewm(fx.panel(spark, d).drop("num"), ["amount"], [0.3, 0.5], [KEY], MONTH, point="_", shift=1)
    df = se.add_changes(df, ["amount"], CHANGES, shift=1, keys=[KEY], order=MONTH).drop("amount")
    df = rounded(df, [f"amount_pctchg{k}" for k in CHANGES])
    return rounded(df, ["amount_ewm_alpha0_3", "amount_ewm_alpha0_5"], 4)


@query(
    "interpolate",
    "SELECT sector_id, panel_month, amount, amount_interp FROM ("
    + interpolation_sql("(SELECT sector_id, panel_month, amount FROM panel)", "sector_id", ["amount"])
    + ")",
    ("panel",),
)
def interpolate(spark: SparkSession, d: str) -> DataFrame:
    return se.add_interpolation(fx.panel(spark, d).drop("num"), ["amount"], [KEY], MONTH)


@query(
    "city_lags",
    f"""
SELECT panel_month, volume, {', '.join(f'LAG(volume, {k}) OVER w AS volume_lag{k}' for k in (1, 3))},
       volume - LAG(volume, 1) OVER w AS volume_diff1,
       (volume - LAG(volume, 1) OVER w) / NULLIF(LAG(volume, 1) OVER w, 0) AS volume_pctchg1
FROM (SELECT panel_month, SUM(search_volume) AS volume FROM searches GROUP BY panel_month)
WINDOW w AS (ORDER BY panel_month)
""",
    ("searches",),
)
def city_lags(spark: SparkSession, d: str) -> DataFrame:
    """Lags and changes on the month table, before any join to sectors."""
    monthly = fx.searches(spark, d).groupBy(MONTH).agg(F.sum("search_volume").alias("volume"))
    return se.add_changes(se.add_lags(monthly, ["volume"], [1, 3], [], MONTH), ["volume"], [1])


@query(
    "event_flag",
    f"""
SELECT *, LAG(land_transacted_flag, 1) OVER w AS land_transacted_flag_lag1,
       LAG(land_transacted_flag, 3) OVER w AS land_transacted_flag_lag3
FROM (SELECT c.sector_id, m.panel_month, l.amount AS land_amount,
             COALESCE(CAST(l.amount > 0 AS INTEGER), 0) AS land_transacted_flag
      FROM cust c CROSS JOIN months m
      LEFT JOIN land l ON l.sector_id = c.sector_id AND l.panel_month = m.panel_month) {W}
""",
    ("cust", "months", "land"),
)
def event_flag(spark: SparkSession, d: str) -> DataFrame:
    land = fx.land(spark, d).withColumnRenamed("amount", "land_amount")
    df = gr.dense_grid(fx.sectors(spark, d), {"land": land}, fx.START, fx.END)
    return se.add_event_flag(df, "land_amount", "land_transacted_flag", [1, 3], [KEY], MONTH)


@query(
    "supply_demand",
    f"""
SELECT sector_id, panel_month, nh / NULLIF(po, 0) AS nh_po_amt_ratio, num / NULLIF(nh_num, 0) AS nh_inventory_turnover,
       nh / NULLIF(nbr, 0) AS nh_neighbor_amt_ratio,
       LAG(land, 3) OVER w / NULLIF(nh, 0) AS nh_land_lead_ratio_lag3
FROM (SELECT c.sector_id, m.panel_month, h.amount AS nh, p.amount AS po, h.num AS nh_num, p.num AS num,
             b.amount AS nbr, l.amount AS land
      FROM cust c CROSS JOIN months m
      LEFT JOIN nh h ON h.sector_id = c.sector_id AND h.panel_month = m.panel_month
      LEFT JOIN po p ON p.sector_id = c.sector_id AND p.panel_month = m.panel_month
      LEFT JOIN nhnbr b ON b.sector_id = c.sector_id AND b.panel_month = m.panel_month
      LEFT JOIN land l ON l.sector_id = c.sector_id AND l.panel_month = m.panel_month) {W}
""",
    ("cust", "months", "nh", "po", "nhnbr", "land"),
)
def supply_demand(spark: SparkSession, d: str) -> DataFrame:
    """The four ratios; the last one needs the land amount three months back."""
    df = se.add_lags(merged(spark, d), ["land_amount"], [3], [KEY], MONTH)
    ratios = {
        "nh_po_amt_ratio": ("nh_amount", "po_amount"),
        "nh_inventory_turnover": ("po_num", "nh_num"),
        "nh_neighbor_amt_ratio": ("nh_amount", "nhnbr_amount"),
        "nh_land_lead_ratio_lag3": ("land_amount_lag3", "nh_amount"),
    }
    return se.add_ratios(df, ratios).select(KEY, MONTH, *ratios)


@query(
    "zero_rule",
    """
SELECT sector_id, panel_month, COALESCE(CAST(MIN(abs(COALESCE(amount, 0.0))) OVER (
         PARTITION BY sector_id ORDER BY panel_month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 0 AS INTEGER), 0) AS had_zero
FROM panel
""",
    ("panel",),
)
def zero_rule(spark: SparkSession, d: str) -> DataFrame:
    return se.add_zero_rule(fx.panel(spark, d), "amount", [KEY], MONTH).select(KEY, MONTH, "had_zero")


@query(
    "zero_rule_horizon",
    f"""
, o AS (SELECT sector_id, CAST(COUNT(*) FILTER (WHERE COALESCE(amount, 0.0) = 0) > 0 AS INTEGER) AS had_zero FROM panel
       WHERE panel_month > DATE '{fx.TRAIN_END}' - INTERVAL 6 MONTH AND panel_month <= DATE '{fx.TRAIN_END}' GROUP BY sector_id)
SELECT sector_id, panel_month, had_zero FROM panel JOIN o USING (sector_id) WHERE panel_month >= DATE '{fx.HORIZON}'
""",
    ("panel",),
)
def zero_rule_horizon(spark: SparkSession, d: str) -> DataFrame:
    """On a panel whose horizon is empty, all its months take the state at the last observed month."""
    observed = F.when(F.col(MONTH) <= F.lit(fx.TRAIN_END).cast("date"), F.col("amount"))
    df = fx.panel(spark, d).withColumn("amount", observed)
    ruled = se.add_zero_rule(df, "amount", [KEY], MONTH, origin=fx.TRAIN_END)
    return ruled.where(F.col(MONTH) >= F.lit(fx.HORIZON).cast("date")).select(KEY, MONTH, "had_zero")


# --- imputation ------------------------------------------------------------

_BFILL = "first_value(amount IGNORE NULLS) OVER (PARTITION BY sector_id ORDER BY panel_month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_FFILL = "last_value(amount IGNORE NULLS) OVER (PARTITION BY sector_id ORDER BY panel_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("fill_backward", f"SELECT sector_id, panel_month, amount, {_BFILL} AS amount_filled FROM panel", ("panel",))
def fill_backward(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).drop("num").withColumn("amount_filled", se.filled("amount", [KEY], MONTH, "bfill"))


@query(
    "fill_forward",
    f"SELECT sector_id, panel_month, amount, {_FFILL} AS amount_filled, COALESCE({_FFILL}, {_BFILL}) AS amount_both FROM panel",
    ("panel",),
)
def fill_forward(spark: SparkSession, d: str) -> DataFrame:
    return (
        fx.panel(spark, d)
        .drop("num")
        .withColumns(
            {
                "amount_filled": se.filled("amount", [KEY], MONTH, "ffill"),
                "amount_both": se.filled("amount", [KEY], MONTH, "ffill_bfill"),
            }
        )
    )


@query(
    "group_median",
    """
SELECT panel_month, ROUND(median(amount), 4) AS month_median, (SELECT ROUND(median(amount), 4) FROM cells) AS overall_median
FROM cells GROUP BY panel_month
""",
    ("cells",),
)
def group_median(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.cells(spark, d)
    overall = qu.exact_quantiles(cells, [], "amount", 0.5, "q")
    months = qu.exact_quantiles(cells, [MONTH], "amount", 0.5, "month_median")
    out = months.withColumn("overall_median", overall.select("q").scalar())
    return rounded(out, ["month_median", "overall_median"], 4)


@query(
    "rough_median",
    "SELECT panel_month, quantile_disc(amount, 0.5) AS month_median FROM cells GROUP BY panel_month",
    ("cells",),
)
def rough_median(spark: SparkSession, d: str) -> DataFrame:
    """The one-pass form; groups of fewer rows than its accuracy have their lower median."""
    return qu.rough_quantiles(fx.cells(spark, d), [MONTH], "amount", 0.5, "month_median")


@query(
    "month_first",
    """
SELECT panel_month, MAX(total) AS total FROM (
  SELECT panel_month, CASE WHEN num = 1 THEN
           CAST(SUM(CAST(round(amount * 100) AS BIGINT)) OVER (PARTITION BY panel_month) AS DOUBLE) / 100 END AS total FROM cells)
GROUP BY panel_month
""",
    ("cells",),
)
def month_first(spark: SparkSession, d: str) -> DataFrame:
    """A month's value, known on some of its rows only, for the whole month."""
    totals = fx.cells(spark, d).groupBy(MONTH).agg(
        fx.money(F.sum(fx.cents("amount"))).alias("total")
    )
    rows = fx.cells(spark, d).join(F.broadcast(totals), MONTH)
    return im.month_values(rows.withColumn("total", F.when(F.col("num") == 1, F.col("total"))), ["total"])


@query(
    "impute_panel",
    f"""
, s1 AS (SELECT sector_id, panel_month, CAST(amount IS NULL AS INTEGER) AS imputed_amount, {_BFILL} AS amount
         FROM (SELECT sector_id, panel_month, CASE WHEN panel_month < DATE '2001-06-01' THEN amount END AS amount FROM panel)),
s2 AS (SELECT sector_id, s1.panel_month, imputed_amount, COALESCE(amount, med) AS amount
       FROM s1 LEFT JOIN (SELECT panel_month, median(amount) AS med FROM s1 GROUP BY panel_month) m USING (panel_month))
SELECT sector_id, panel_month, imputed_amount,
       ROUND(COALESCE(amount, (SELECT median(amount) FROM s2)), 4) AS amount
FROM s2
""",
    ("panel",),
)
def impute_panel(spark: SparkSession, d: str) -> DataFrame:
    """Backward fill, month median, column median: the last months hold nothing."""
    known = F.when(F.col(MONTH) < F.lit("2001-06-01").cast("date"), F.col("amount"))
    df = materialize(fx.panel(spark, d).select(KEY, MONTH, known.alias("amount")), "impute_input")
    return rounded(im.impute_panel(df, ["amount"]), ["amount"], 4)


@query(
    "impute_city",
    """
SELECT panel_month, CAST(volume IS NULL AS INTEGER) AS imputed_volume, COALESCE(volume, median(volume) OVER ()) AS volume
FROM (SELECT panel_month, CASE WHEN dayofweek(panel_month) <> 0 THEN SUM(search_volume) END AS volume
      FROM searches GROUP BY panel_month)
""",
    ("searches",),
)
def impute_city(spark: SparkSession, d: str) -> DataFrame:
    """Sundays hold no value and take the median."""
    volume = F.when(F.dayofweek(MONTH) != 1, F.col("volume"))
    monthly = fx.searches(spark, d).groupBy(MONTH).agg(F.sum("search_volume").alias("volume"))
    return im.impute_months(monthly.withColumn("volume", volume), ["volume"])


@query(
    "lag_zero_fill",
    f"""
SELECT sector_id, panel_month, amount, COALESCE(LAG(amount, 1) OVER w, 0.0) AS amount_lag1,
       COALESCE(amount - LAG(amount, 1) OVER w, 0.0) AS amount_diff1,
       COALESCE((amount - LAG(amount, 1) OVER w) / NULLIF(LAG(amount, 1) OVER w, 0), 0.0) AS amount_pctchg1
FROM panel {W}
""",
    ("panel",),
)
def lag_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    df = se.add_lags(fx.panel(spark, d).drop("num"), ["amount"], [1], [KEY], MONTH)
    return im.fill_lags_with_zero(se.add_changes(df, ["amount"], [1]))
