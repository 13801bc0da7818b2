"""Writers for panels, reports and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_panel(df: DataFrame, path: str, month: str = "panel_month") -> None:
    """Parquet partitioned by year, so a month filter skips other years' files.

    Rows are gathered by year, and adaptive execution splits a large year into
    pieces of the advisory size: no year is confined to one task, and each
    task writes few files.
    """
    spread = df.withColumn("panel_year", F.year(month)).hint("rebalance", "panel_year")
    spread.write.mode("overwrite").partitionBy("panel_year").parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def fixed_decimals(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles and floats as text with a fixed number of decimals."""
    pattern = f"%.{decimals}f"
    fractional = (T.DoubleType, T.FloatType)
    return df.select(
        [
            F.when(F.col(f.name).isNotNull(), F.format_string(pattern, F.col(f.name))).alias(f.name)
            if isinstance(f.dataType, fractional)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """Headed CSV; ``decimals`` fixes how numbers print. Existing rows are replaced."""
    table = df if decimals is None else fixed_decimals(df, decimals)
    table.write.mode("overwrite").option("header", True).csv(path)
