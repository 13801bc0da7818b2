"""Exact quantiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group in one
buffer. Here a group's value range is cut into equal slices that are counted
with map-side combine; only the slice that holds the wanted rank is kept, and
cut again while it is large. What is ordered in the end is small, whatever the
size of the group and however often one value repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SLICES = 4_096
# A range is cut further while it holds more rows than this and more than one value.
# Every group takes this way; the number only says when there is nothing left to gain.
FEW_ROWS = 4_096
INFINITE = float("inf")
# Key of the single group when no keys are given.
WHOLE = "_all"


def _ranked(df: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """``_upto``: rows of the group up to and including this counted entry."""
    running = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_upto", F.col("_below") + F.sum("_n").over(running))


def _bracketed(rows: DataFrame, ranges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows inside their group's range, with the range's columns.

    Without keys there is one range, whose few numbers go into the filter as
    literals. With keys the stored ranges join by their known size.
    """
    if list(group) == [WHOLE]:
        found = ranges.first()
        bounds = {c: found[c] if found else None for c in ("_rank", "_lo", "_hi", "_below")}
        joined = rows.withColumns(
            {c: F.lit(v).cast("long" if c == "_below" else "double") for c, v in bounds.items()}
        )
    else:
        joined = rows.join(ranges.drop("_n"), list(group))
    return joined.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(rows: DataFrame, ranges: DataFrame, group: Sequence[str], slices: int) -> DataFrame:
    """Ranges of the open groups, cut to the slice with the wanted rank."""
    half = F.lit(0.5)  # halved, so that the width of the range cannot overflow
    position = (F.col("_v") * half - F.col("_lo") * half) / (F.col("_hi") * half - F.col("_lo") * half)
    counted = _bracketed(rows, ranges, group).groupBy(*group, F.floor(position * slices).alias("_slice")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.first("_rank").alias("_rank"),
        F.first("_below").alias("_below"),
    )
    ranked = _ranked(counted, group, F.col("_slice"))
    low = F.col("_upto") > F.floor("_rank")
    high = F.col("_upto") > F.ceil("_rank")
    entry = F.struct("_slice", "_min", "_max", "_n", (F.col("_upto") - F.col("_n")).alias("_below"))
    picked = ranked.groupBy(*group).agg(
        F.first("_rank").alias("_rank"), F.min(F.when(low, entry)).alias("_a"), F.min(F.when(high, entry)).alias("_b")
    )
    same = F.col("_a._slice") == F.col("_b._slice")
    # Neighbours in different slices are the last value of one and the first of the next.
    return picked.select(
        *group,
        "_rank",
        F.when(same, F.col("_a._min")).otherwise(F.col("_a._max")).alias("_lo"),
        F.when(same, F.col("_a._max")).otherwise(F.col("_b._min")).alias("_hi"),
        F.when(same, F.col("_a._below")).alias("_below"),
        F.when(same, F.col("_a._n")).otherwise(F.lit(0)).alias("_n"),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantile: float = 0.5, output: str = "quantile",
    slices: int = SLICES, few_rows: int = FEW_ROWS,
) -> DataFrame:
    """``quantile`` of ``value`` per group, linear between neighbours, nulls ignored; ``rough_quantiles`` is the one-pass form.

    Groups without a value are absent from the result. Infinite values stand at
    their ends of the order; only finite ones are cut into slices. ``df`` is read
    at least twice, so it should be a stored table or cheap to compute.
    """
    group = list(keys) or [WHOLE]
    rows = df.select(
        *[F.col(k) for k in keys], *([] if keys else [F.lit(0).alias(WHOLE)]), F.col(value).cast("double").alias("_v")
    ).where(F.col("_v").isNotNull())
    inside = F.when(F.abs("_v") < INFINITE, F.col("_v"))
    ranges = (
        rows.groupBy(*group)
        .agg(
            F.count("_v").alias("_all_rows"),
            F.count(inside).alias("_n"),
            F.min(inside).alias("_lo"),
            F.max(inside).alias("_hi"),
            F.count(F.when(F.col("_v") == -INFINITE, 1)).alias("_below"),
        )
        .withColumn("_rank", F.lit(quantile) * (F.col("_all_rows") - 1))
    )
    ranges = materialize(ranges, "ranges")
    # Ranks that fall on infinite values are known from the counts.
    first, last = F.floor("_rank"), F.ceil("_rank")

    def end(place: Column) -> Column:
        return F.when(place < F.col("_below"), F.lit(-INFINITE)).when(place >= F.col("_below") + F.col("_n"), F.lit(INFINITE))

    ends = ranges.select(*group, end(first).alias("_low_end"), end(last).alias("_high_end"), (F.col("_rank") - first).alias("_share"))
    rows = rows.where(inside.isNotNull())
    ranges = ranges.where("_n > 0").select(*group, "_rank", "_lo", "_hi", "_below", "_n")
    large = (F.col("_n") > few_rows) & (F.col("_lo") < F.col("_hi"))
    settled = [ranges.where(~large)]
    opened = ranges.where(large)
    while not opened.isEmpty():
        # The two ends of a finite range fall into different slices, so every pass shrinks it.
        cut = materialize(_narrowed(rows, opened, group, slices), "ranges")
        settled.append(cut.where(~large))
        opened = cut.where(large)
    ranges = settled[0]
    for part in settled[1:]:
        ranges = ranges.unionByName(part)
    counted = (
        _bracketed(rows, ranges, group)
        .groupBy(*group, "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_rank").alias("_rank"), F.first("_below").alias("_below"))
    )
    # Without a count of what lies below, the range ends are the two neighbours.
    ranked = _ranked(counted, group, F.col("_v"))
    lower = F.min(F.when(F.col("_below").isNull() | (F.col("_upto") > F.floor("_rank")), F.col("_v")))
    upper = F.coalesce(F.min(F.when(F.col("_upto") > F.ceil("_rank"), F.col("_v"))), F.max("_v"))
    a, b = F.coalesce("_low_end", "_a"), F.coalesce("_high_end", "_b")
    share = F.col("_share")
    endless = (F.abs(a) == INFINITE) | (F.abs(b) == INFINITE)
    value_at = F.when((share == 0) | (a == b), a).when(endless, a * (1 - share) + b * share).otherwise(a + (b - a) * share)
    found = ranked.groupBy(*group).agg(lower.alias("_a"), upper.alias("_b"))
    return ends.join(found, group, "left").select(*keys, value_at.alias(output))


def rough_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantile: float = 0.5, output: str = "quantile", accuracy: int = 10_000
) -> DataFrame:
    """As ``exact_quantiles``, but a value of the group whose rank is off by at most 1/``accuracy`` of its rows.

    One pass with mergeable sketches of bounded size; nothing is stored. Groups without a value are absent.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    return rows.groupBy(*keys).agg(F.percentile_approx("_v", quantile, accuracy).alias(output)).where(F.col(output).isNotNull())


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys, metric, value)``; empty cells are kept."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "metric", "value"
    )
