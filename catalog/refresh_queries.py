"""A stored panel that is brought up to date, against the SQL of the full build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.operators import refresh as re
from monthgrid.session import materialize, scratch_path

from . import fixtures as fx
from .panel_queries import rounded
from .registry import query
from .series_queries import EWM_CTES

KEY, MONTH = fx.KEY, fx.MONTH
FRAMES = re.Frames(["amount", "num"], lags=[1, 3, 12], change_lags=[1, 12], rolling=[3, 6], alphas=[0.3, 0.5])
# The panel is stored with two months missing, then gets the first of them, the second, and the months of the horizon.
FIRST_END, NEXT_MONTH = "2000-06-01", "2000-07-01"
COMPARED = ["amount_lag12", "amount_pctchg12", "amount_roll6_std", "num_lag1", "num_roll3_mean", "num_diff1"]

_FRAME = "PARTITION BY sector_id ORDER BY panel_month"
_SQL = f"""{EWM_CTES}
SELECT p.sector_id, p.panel_month, p.amount, p.num,
  LAG(p.amount, 12) OVER w AS amount_lag12,
  ROUND((p.amount - LAG(p.amount, 12) OVER w) / NULLIF(LAG(p.amount, 12) OVER w, 0), 6) AS amount_pctchg12,
  ROUND(stddev_samp(p.amount) OVER ({_FRAME} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS amount_roll6_std,
  LAG(p.num, 1) OVER w AS num_lag1,
  ROUND(AVG(p.num) OVER ({_FRAME} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS num_roll3_mean,
  p.num - LAG(p.num, 1) OVER w AS num_diff1,
  ROUND(e.m1, 4) AS amount_ewm_alpha0_3, ROUND(e.m2, 4) AS amount_ewm_alpha0_5,
  MAX(CASE WHEN p.amount IS NOT NULL THEN p.panel_month END) OVER ({_FRAME} ROWS UNBOUNDED PRECEDING) AS amount_seen
FROM panel p JOIN (SELECT sector_id AS sid, panel_month AS pm, m1, m2 FROM folded) e ON e.sid = p.sector_id AND e.pm = p.panel_month
WINDOW w AS ({_FRAME})"""


def refreshed(spark: SparkSession, d: str) -> str:
    """Path of a panel that was stored early and refreshed twice."""
    path = scratch_path(spark, "panel_by_month")
    cells = materialize(fx.cells(spark, d), "cells")
    early = cells.where(F.col(MONTH) <= F.lit(FIRST_END).cast("date"))
    re.store(fx.dense_grid(fx.sectors(spark, d), {"cells": early}, fx.START, FIRST_END), path, FRAMES)
    amounts = cells.select(KEY, MONTH, "amount")
    new = F.col(MONTH) == F.lit(NEXT_MONTH).cast("date")
    # One table for each column: the second month corrects numbers that the first refresh has not brought.
    re.refresh(spark, path, {"amounts": amounts.where(new)}, FRAMES, end=NEXT_MONTH)
    late = F.col(MONTH) > F.lit(NEXT_MONTH).cast("date")
    numbers = cells.select(KEY, MONTH, "num").where(new | late)
    re.refresh(spark, path, {"amounts": amounts.where(late), "numbers": numbers}, FRAMES, end=fx.END)
    return path


@query("panel_refresh", _SQL, ("panel",))
def panel_refresh(spark: SparkSession, d: str) -> DataFrame:
    """All months of the refreshed panel, read back."""
    smooth = ["amount_ewm_alpha0_3", "amount_ewm_alpha0_5"]
    out = re.read_months(spark, refreshed(spark, d), [KEY, MONTH, "amount", "num", *COMPARED, *smooth, "amount_seen"])
    out = rounded(out, ["amount_pctchg12", "num_roll3_mean"])
    return rounded(out, ["amount_roll6_std", *smooth], 4)
