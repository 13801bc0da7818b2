"""Column statistics and feature selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite

# Columns of a tile of the correlation table, tile pairs (of about 200 kB) that a task holds, and cells that are multiplied at once.
COLUMN_BLOCK = 64
TILE_PAIRS = 256
BATCH_CELLS = 1 << 20
# Squared deviations this small next to the squares they are the difference of are not trusted.
CANCELLED = 1e-6


def per_column(df: DataFrame, columns: Sequence[str], output: str, measure) -> DataFrame:
    """``(feature, output)``: one aggregate per column, all in one pass."""
    row = df.agg(*[measure(F.col(c)).cast("double").alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", output)


def null_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, "null_ratio", lambda c: F.avg(c.isNull().cast("double")))


def sparse_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> list[str]:
    """Columns whose null ratio exceeds ``threshold``."""
    ratios = {r.feature: r.null_ratio for r in null_ratios(df, columns).collect()}
    return [c for c in columns if ratios[c] is not None and ratios[c] > threshold]


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, "variance", F.var_samp)


def low_variance_columns(df: DataFrame, columns: Sequence[str], threshold: float = 1e-6) -> list[str]:
    """Columns with a sample variance below ``threshold``; all-null columns stay."""
    found = {r.feature: r.variance for r in variances(df, columns).collect()}
    return [c for c in columns if found[c] is not None and found[c] < threshold]


class _Tile:
    """A block of columns of some rows: values around a shift per column, and which are there.

    A column that is constant in the block is shifted by exactly its value, so all its sums are exactly 0.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.seen = ~np.isnan(values)
        self.there = self.seen.astype("float64")
        self.count = np.maximum(self.there.sum(0), 1)
        filled = np.where(self.seen, values, 0.0)
        low = np.where(self.seen, values, np.inf).min(0, initial=np.inf)
        high = np.where(self.seen, values, -np.inf).max(0, initial=-np.inf)
        self.shift = np.where(low >= high, np.where(np.isfinite(low), low, 0.0), filled.sum(0) / self.count)
        self.values = values
        self.x = np.where(self.seen, values - self.shift, 0.0)
        self.squares = self.x**2


def _own_moments(a: _Tile, i: np.ndarray, b: _Tile, j: int) -> np.ndarray:
    """(5, columns): both means, both squared deviations and the co-deviation of columns ``i`` with column ``j``, around their own means."""
    rows = b.seen[:, j]
    both = a.seen[rows][:, i]
    n = np.maximum(both.sum(0), 1)
    out = []
    for values in (a.values[rows][:, i], np.broadcast_to(b.values[rows, j, None], both.shape)):
        low, high = np.where(both, values, np.inf).min(0, initial=np.inf), np.where(both, values, -np.inf).max(0, initial=-np.inf)
        # A mean of equal values may miss them by a rounding error.
        mean = np.where(low >= high, np.where(np.isfinite(low), low, 0.0), np.where(both, values, 0.0).sum(0) / n)
        out.append((mean, np.where(both, values - mean, 0.0)))
    (ma, da), (mb, db) = out
    return np.stack([ma, mb, (da**2).sum(0), (db**2).sum(0), (da * db).sum(0)])


def _tile_moments(a: _Tile, b: _Tile) -> np.ndarray:
    """Rows shared by each pair of a column of ``a`` and one of ``b``: count, both means, both squared deviations, co-deviation.

    Masked matrix products of shifted values are exact enough for most pairs. Where they cancel, because
    the shared rows lie far from the column's shift next to their own spread, the pairs of a column are
    computed around their own means, together. Constant columns have nothing to cancel.
    """
    n = a.there.T @ b.there
    count = np.maximum(n, 1)
    sx, sxx = a.x.T @ b.there, a.squares.T @ b.there
    sy, syy = a.there.T @ b.x, a.there.T @ b.squares
    mx, my = sx / count, sy / count
    square, other, cross = sxx - sx * mx, syy - sy * my, a.x.T @ b.x - sx * my
    out = np.stack([n, mx + a.shift[:, None], my + b.shift, square, other, cross])
    doubtful = (n > 0) & (((square <= CANCELLED * sxx) & (sxx > 0)) | ((other <= CANCELLED * syy) & (syy > 0)))
    for j in np.flatnonzero(doubtful.any(0)).tolist():
        i = np.flatnonzero(doubtful[:, j])
        out[1:, i, j] = _own_moments(a, i, b, j)
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of the rows of both, pair by pair."""
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return np.stack([
        n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight,
        a[5] + b[5] + dx * dy * weight,
    ])


def tile_groups(width: int, tile: int = COLUMN_BLOCK, pairs: int = TILE_PAIRS) -> list[list[tuple[int, int]]]:
    """Pairs of column tiles that one pass over the rows computes: squares of tiles, so that few columns are read for many pairs."""
    tiles = -(-width // tile)
    side = max(1, int(pairs**0.5))
    groups = []
    for i in range(0, tiles, side):
        for j in range(i, tiles, side):
            own = [(a, b) for a in range(i, min(i + side, tiles)) for b in range(j, min(j + side, tiles)) if a <= b]
            groups.append(own)
    return groups


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(left_pos, right_pos, left, right, corr)`` for every pair in column order.

    Rows where either column is null are left out of that pair; the result is
    null if either column is constant over the shared rows. Columns form tiles. A
    task owns a bounded group of tile pairs and a range of rows, reads the columns of
    these tiles only, merges the centred moments of its batches and sends one packed
    row for each tile pair; the tasks' rows of a pair are merged as they stream in.
    """
    width = len(columns)
    edges = [(at, min(at + COLUMN_BLOCK, width)) for at in range(0, width, COLUMN_BLOCK)]

    def moments_of(group: list[tuple[int, int]], tiles: list[int]):
        place, sizes = {t: k for k, t in enumerate(tiles)}, np.cumsum([0, *[edges[t][1] - edges[t][0] for t in tiles]])

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int], np.ndarray] = {}
            step = max(BATCH_CELLS // int(sizes[-1]), 64)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    rows = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, step).columns]
                    made = [_Tile(np.stack(rows[a:b], 1).astype("float64")) for a, b in zip(sizes[:-1], sizes[1:])]
                    for pair in group:
                        part = _tile_moments(made[place[pair[0]]], made[place[pair[1]]])
                        totals[pair] = part if pair not in totals else _merged(totals[pair], part)
            for (i, j), total in totals.items():
                columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "other", "packed"])

        return moments

    def correlations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            for i, j, packed in batch.itertuples(index=False):
                (a, b), (c, d) = edges[i], edges[j]
                part = np.frombuffer(packed).reshape(6, b - a, d - c)
                if at is not None and at != (i, j):
                    yield finished(at, total)
                    total = None
                at, total = (i, j), part if total is None else _merged(total, part)
        if at is not None:
            yield finished(at, total)

    def finished(at: tuple[int, int], total: np.ndarray) -> pd.DataFrame:
        left, right = np.meshgrid(np.arange(*edges[at[0]]), np.arange(*edges[at[1]]), indexing="ij")
        own = left < right
        spread = np.sqrt(total[3][own]) * np.sqrt(total[4][own])
        corr = np.divide(total[5][own], spread, out=np.full(own.sum(), np.nan), where=spread > 0)
        return pd.DataFrame({"left_pos": left[own].astype("int32"), "right_pos": right[own].astype("int32"), "corr": corr})

    parts = []
    for group in tile_groups(width):
        tiles = sorted({t for pair in group for t in pair})
        read = [columns[c] for t in tiles for c in range(*edges[t])]
        doubles = df.select([F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(read)])
        parts.append(doubles.mapInArrow(moments_of(group, tiles), "block int, other int, packed binary"))
    if not parts:
        return df.sparkSession.createDataFrame([], "left_pos int, right_pos int, left string, right string, corr double")
    dealt = reduce(DataFrame.unionByName, parts).repartition(max(len(edges), 1), "block", "other").sortWithinPartitions("block", "other")
    found = dealt.mapInPandas(correlations, "left_pos int, right_pos int, corr double")
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(
        "left_pos", "right_pos", F.get(names, F.col("left_pos")).alias("left"), F.get(names, F.col("right_pos")).alias("right"),
        finite(F.col("corr")).alias("corr"),
    )


def correlated_drops(pairs: DataFrame, threshold: float) -> DataFrame:
    """``(kept, dropped)``: a column goes if a later one correlates above ``threshold``.

    Whether the later column is dropped itself does not matter, so the rule
    needs no sequential pass. ``kept`` is the first such later column.
    """
    strong = pairs.where(F.abs("corr") > threshold)
    return strong.groupBy(F.col("left").alias("dropped")).agg(F.min_by("right", "right_pos").alias("kept"))


def mean_importance(per_fold: DataFrame) -> DataFrame:
    """Mean of ``importance`` per feature over folds."""
    return per_fold.groupBy("feature").agg(F.avg("importance").alias("importance"))


def rank_features(importance: DataFrame) -> DataFrame:
    """Rank and cumulative share, most important first.

    One row per feature: bounded by the width of the schema, so one ordered
    window over the whole table is safe.
    """
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    whole = Window.partitionBy(F.lit(0))
    running = F.sum("importance").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return importance.select(
        "feature",
        "importance",
        F.row_number().over(ranked).alias("rank"),
        (running / F.sum("importance").over(whole)).alias("cumulative_share"),
    )


def select_features(
    importance: DataFrame, top_n: int, cumulative: float, always: Sequence[str]
) -> DataFrame:
    """Features within the cumulative share, at least ``top_n``, plus ``always``; by name."""
    ranked = rank_features(importance)
    within = F.col("cumulative_share") <= cumulative
    enough = F.sum(within.cast("int")).over(Window.partitionBy(F.lit(0))) >= top_n
    chosen = ranked.withColumn("_enough", enough).where(
        F.when(F.col("_enough"), within).otherwise(F.col("rank") <= top_n)
    )
    extra = importance.sparkSession.createDataFrame([(c,) for c in always], "feature string")
    return chosen.select("feature").union(extra).distinct().orderBy("feature")
