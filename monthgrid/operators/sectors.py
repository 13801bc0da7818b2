"""The sector dimension: which sectors exist and their dense numbers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def sector_union(tables: Iterable[DataFrame], label: str = "sector") -> DataFrame:
    """Distinct labels over all tables.

    Each table is made distinct before the union, so a label holding a large
    share of one table crosses the network once per map task only.
    """
    parts = [t.select(F.col(label).alias("sector_label")).distinct() for t in tables]
    return reduce(DataFrame.unionByName, parts).where(F.col("sector_label").isNotNull()).distinct()


def label_number(label: str = "sector_label"):
    return F.regexp_extract(label, r"(\d+)", 1).cast("bigint")


def dense_numbers(df: DataFrame, number: str, output: str, tiebreak: str | None = None) -> DataFrame:
    """1, 2, 3, ... in order of ``number``.

    A plain ``row_number`` over the whole table would pull every row into one
    task. Here rows are range-partitioned by row counts, whatever the numbers
    look like, and numbered inside their partition; only the sizes, one row per
    partition, are ordered as a whole. The partitions are written first, so that
    sizes and numbers speak of the same ones.
    """
    order = [number] + ([tiebreak] if tiebreak else [])
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_part")
        .withColumn(output, F.col("_row") + F.col("_offset"))
        .drop("_part", "_row", "_offset")
    )


def sector_index(labels: DataFrame) -> DataFrame:
    """``(sector_label, sector_id)`` with dense ids in order of the label's number."""
    numbered = labels.withColumn("_number", label_number())
    return dense_numbers(numbered, "_number", "sector_id", tiebreak="sector_label").select("sector_label", "sector_id")
