"""Combining the forecasts of several models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import floored
from ..session import materialize
from .evaluation import BAD_ERROR, BAD_SHARE_LIMIT, scores

ROW_KEYS = ["sector_id", "panel_month", "fold", "y_true"]
# Candidates and rows that are blended at once.
CANDIDATE_BLOCK, BATCH_ROWS = 1_024, 2_048
# How far beside a change of a line its neighbourhood is tried.
BESIDE = 1e-10
Bounds = tuple[float, float] | Sequence[tuple[float, float]]


def merge_predictions(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per forecast row with ``pred_<model>`` columns.

    Same as inner joins of the per-model tables on the row keys, in one
    shuffle: rows that lack a model are dropped. Two predictions of one model
    for one row are an error.
    """

    def only(m: str) -> Column:
        own = F.col("model") == m
        twice = F.raise_error(F.lit(f"several predictions of {m} for one row")).cast("double")
        return F.when(F.count(F.when(own, 1)) > 1, twice).otherwise(F.max(F.when(own, F.col("y_pred"))))

    picks = [only(m).alias(f"pred_{m}") for m in models]
    wide = predictions.where(F.col("model").isin(list(models))).groupBy(*ROW_KEYS).agg(*picks)
    return wide.dropna(subset=[f"pred_{m}" for m in models])


def blended(models: Sequence[str], weights: Sequence[float], minimum: float | None = 0.0) -> Column:
    """Weighted sum of the model columns; null if any is null.

    Weights of another length than the models fall back to equal weights.
    """
    if len(weights) != len(models) or not weights:
        weights = [1.0 / len(models)] * len(models)
    total = reduce(add, [F.lit(float(w)) * F.col(f"pred_{m}") for w, m in zip(weights, models)])
    return total if minimum is None else floored(total, minimum)


def candidate_count(models: int, steps: int) -> int:
    """Weight vectors of step ``1 / steps`` that sum to 1."""
    return math.comb(steps + models - 1, models - 1)


def _box(models: int, steps: int, bounds: Bounds) -> list[tuple[int, int]]:
    """Smallest and largest number of steps of each weight."""
    each = list(bounds) if isinstance(bounds[0], (tuple, list)) else [bounds] * models
    return [(max(math.ceil(low * steps - 1e-9), 0), min(math.floor(high * steps + 1e-9), steps)) for low, high in each]


def _grid(total: int, box: Sequence[tuple[int, int]], by: int = 1) -> np.ndarray:
    """All whole shares inside the box that sum to ``total``, in steps of ``by`` from each lower bound but for the last."""
    rows = np.zeros((1, 0), np.int64)
    for low, high in box[:-1]:
        own = np.arange(low, high + 1, by)
        rows = np.concatenate([np.repeat(rows, len(own), 0), np.tile(own, len(rows))[:, None]], 1)
        rows = rows[rows.sum(1) <= total]
    rows = np.concatenate([rows, total - rows.sum(1, keepdims=True)], 1)
    return rows[(rows[:, -1] >= box[-1][0]) & (rows[:, -1] <= box[-1][1])]


def share_scores(wide: DataFrame, models: Sequence[str], shares: np.ndarray, steps: int) -> DataFrame:
    """Score of each row of ``shares``, weights in ``1 / steps``.

    A task blends its rows with a block of candidates at a time and sends one
    packed row of sums for each block, so what is shuffled depends on tasks and
    candidates, not on rows. A null truth or prediction is an error.
    """
    blocks = range(0, len(shares), CANDIDATE_BLOCK)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, len(shares)))
        for batch in batches:
            table = batch.to_numpy(dtype="float64")
            if np.isnan(table).any():
                raise ValueError("a row without truth or prediction cannot be scored")
            for at in range(0, len(table), BATCH_ROWS):
                truth, preds = table[at : at + BATCH_ROWS, 0], table[at : at + BATCH_ROWS, 1:]
                for b in blocks:
                    own = slice(b, b + CANDIDATE_BLOCK)
                    # Summed in the order of the models, so that errors of exactly 1 stay exact.
                    blend = reduce(add, [preds[:, i, None] * (shares[own, i] / float(steps)) for i in range(len(models))])
                    error = np.abs(blend - truth[:, None]) / np.where(truth == 0, 1.0, np.abs(truth))[:, None]
                    good = error <= BAD_ERROR
                    total[:, own] += [good.shape[0] - good.sum(0), np.where(good, error, 0.0).sum(0), np.full(good.shape[1], good.shape[0])]
        yield pd.DataFrame([(i, total[:, b : b + CANDIDATE_BLOCK].tobytes()) for i, b in enumerate(blocks)], columns=["block", "packed"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in batch.itertuples(index=False):
                held[i] = held.get(i, 0) + np.frombuffer(packed).reshape(3, -1)
        for i, (bad, error, n) in held.items():
            ratio = bad / np.maximum(n, 1)
            mean = error / np.maximum(n - bad, 1)
            score = np.where(ratio > BAD_SHARE_LIMIT, 0.0, np.maximum(0.0, 1 - mean / np.where(ratio < 1, 1 - ratio, 1.0)))
            out = pd.DataFrame(shares[blocks[i] : blocks[i] + CANDIDATE_BLOCK] / float(steps), columns=[f"weight_{m}" for m in models])
            yield out.assign(score=score, bad_ratio=ratio)[n > 0]

    rows = wide.select(*[F.col(c).cast("double").alias(c) for c in ["y_true", *[f"pred_{m}" for m in models]]])
    parts = rows.mapInPandas(sums, "block int, packed binary").repartition("block")
    schema = ", ".join(f"weight_{m} double" for m in models) + ", score double, bad_ratio double"
    return parts.mapInPandas(finish, schema)


def candidate_scores(wide: DataFrame, models: Sequence[str], steps: int = 20, bounds: Bounds = (0.0, 1.0)) -> DataFrame:
    """Score of every weight vector on a grid of step ``1 / steps`` that sums to 1.

    ``bounds`` limits all weights, or each weight in turn.
    """
    shares = _grid(steps, _box(len(models), steps, bounds))
    if not len(shares):
        raise ValueError("bounds leave no weight on the grid")
    return share_scores(wide, models, shares, steps)


def _line_events(wide: DataFrame, models: Sequence[str], weights: Sequence[float], bounds: tuple[float, float]) -> DataFrame:
    """(x, y, first, last, t) and what changes there on the lines that shift weight ``t`` from model ``y`` to model ``x``.

    The error of a row is ``|r + t * g|``. It counts while that is at most 1, from a first to a last shift,
    and its slope turns where the blend meets the truth. ``n_in, a_in, b_in`` are the changes of the
    number of counted rows and of the sum of their errors, ``a + b * t``, from ``t`` on; ``n_out, ...`` those
    beyond ``t``, since a row with an error of exactly 1 still counts.
    """
    names, (low, high) = [f"pred_{m}" for m in models], bounds
    scale = F.when(F.col("y_true") == 0, F.lit(1.0)).otherwise(F.abs("y_true"))
    r = (blended(models, weights, None) - F.col("y_true")) / scale
    rows = wide.select(r.alias("r"), *[(F.col(n) / scale).alias(n) for n in names])
    lines = [
        F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"), (F.col(names[x]) - F.col(names[y])).alias("g"),
            F.lit(float(max(low - weights[x], weights[y] - high))).alias("first"), F.lit(float(min(high - weights[x], weights[y] - low))).alias("last"),
        )
        for x in range(len(models)) for y in range(x + 1, len(models))
    ]
    at = rows.select("r", F.explode(F.array(*lines)).alias("l")).select("r", "l.*")
    g, size = F.col("g"), F.abs("g")
    begin, end, turn = (F.try_divide(x, size) for x in (F.lit(-1.0) - F.signum(g) * F.col("r"), F.lit(1.0) - F.signum(g) * F.col("r"), -F.signum(g) * F.col("r")))
    flat = g == 0
    zero, signed = F.lit(0.0), F.signum(g) * F.col("r")

    def event(t: Column, n: float, a: Column, b: Column, out: bool) -> Column:
        none = [zero, zero, zero]
        own = [F.lit(float(n)), a, b]
        return F.struct(t.alias("t"), *[v.alias(c) for c, v in zip(["n_in", "a_in", "b_in", "n_out", "a_out", "b_out"], none + own if out else own + none)])

    first = F.col("first")
    moving = F.array(
        event(F.greatest(begin, first), 1, -signed, -size, False), event(F.greatest(turn, first), 0, 2 * signed, 2 * size, False),
        event(end, -1, -signed, -size, True),
    )
    still = F.array(event(first, 1, F.abs("r"), zero, False))
    nothing = F.slice(still, 1, 0)
    events = F.when(flat, F.when(F.abs("r") <= BAD_ERROR, still).otherwise(nothing)).when((end >= first) & (begin <= F.col("last")), moving).otherwise(nothing)
    # The ends of a line are looked at whether anything changes there or not.
    ends = F.array(event(first, 0, zero, zero, False), event(F.col("last"), 0, zero, zero, False))
    found = at.select("x", "y", "first", "last", F.explode(F.concat(events, ends)).alias("e")).select("x", "y", "first", "last", "e.*")
    sums = [F.sum(c).alias(c) for c in ("n_in", "a_in", "b_in", "n_out", "a_out", "b_out")]
    return found.where(F.col("t") <= F.col("last")).groupBy("x", "y", "first", "last", "t").agg(*sums)


def line_optima(wide: DataFrame, models: Sequence[str], weights: Sequence[float], bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``(x, y, shift, score, bad_ratio)``: for every two models the best shift of weight from the second to the first.

    Between neighbouring changes the number of counted rows is the same and their error is linear, so the
    best score of a line lies at a change, at an end, or right beside a change, where a row does not count
    yet or any more; ``shift`` is then moved to that side by ``BESIDE``. Changes are range-partitioned, their
    running sums are made inside the ranges and carried on from range to range. Null cells are an error.
    """
    rows = wide.select(F.col("y_true").cast("double").alias("y_true"), *[F.col(f"pred_{m}").cast("double").alias(f"pred_{m}") for m in models])
    checked = F.when(F.col("y_true").isNull() | reduce(or_, [F.col(f"pred_{m}").isNull() for m in models]), F.raise_error(F.lit("a row without truth or prediction cannot be scored")).cast("double")).otherwise(F.col("y_true"))
    rows = rows.withColumn("y_true", checked)
    n = rows.count()
    changes = ["n_in", "a_in", "b_in", "n_out", "a_out", "b_out"]
    dealt = _line_events(rows, models, weights, bounds).repartitionByRange("x", "y", "t").withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "line_changes")
    earlier = Window.partitionBy("x", "y").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("x", "y", "_part").agg(*[F.sum(c).alias(c) for c in changes])  # at most ranges plus lines
    carried = totals.select("x", "y", "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"_{c}") for c in changes])
    inside = Window.partitionBy("_part", "x", "y").orderBy("t")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    # At a change the rows that begin to count are in and those that end to count are in still; left of it the first are
    # not yet, right of it the others no more.
    run = {}
    for c in changes:
        run[c], run[f"{c}_before"] = F.col(f"_{c}") + F.sum(c).over(upto), F.col(f"_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0.0))
    at = dealt.join(carried, ["x", "y", "_part"]).select("x", "y", "t", "first", "last", *[v.alias(c) for c, v in run.items()])
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), (F.col(f"n_in{i}") + F.col(f"n_out{o}")).alias("n"), (F.col(f"a_in{i}") + F.col(f"a_out{o}")).alias("a"),
                 (F.col(f"b_in{i}") + F.col(f"b_out{o}")).alias("b"))
        for side, i, o in ((0, "", "_before"), (1, "", ""), (-1, "_before", "_before"))
    ])
    at = at.select("x", "y", "t", "first", "last", F.explode(sides).alias("s"))
    at = at.where((F.col("s.side") == 0) | ((F.col("t") > F.col("first")) & (F.col("s.side") < 0)) | ((F.col("t") < F.col("last")) & (F.col("s.side") > 0)))
    good, error = F.round(F.col("s.n")), F.greatest(F.col("s.a") + F.col("s.b") * F.col("t"), F.lit(0.0))
    bad = (F.lit(float(n)) - good) / F.lit(float(max(n, 1)))
    score = F.when((bad > BAD_SHARE_LIMIT) | (good == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - error / good / (1 - bad)))
    shift = F.col("t") + F.col("s.side") * F.lit(BESIDE)
    best = F.max(F.struct(score.alias("score"), (-F.abs("t")).alias("near"), shift.alias("shift"), bad.alias("bad_ratio"))).alias("b")
    return at.groupBy("x", "y").agg(best).select("x", "y", "b.shift", "b.score", "b.bad_ratio")


def _climb(wide: DataFrame, models: Sequence[str], weights: list[float], score: float, bounds: tuple[float, float], rounds: int) -> tuple[list[float], float]:
    """Moves along the best of all lines until none is better, each move held against the plain score."""
    for _ in range(rounds):
        moved = False
        for line in sorted(line_optima(wide, models, weights, bounds).collect(), key=lambda r: -r["score"]):
            if line["score"] <= score + 1e-12:
                break
            # A row that counts at exactly this shift may miss it by a rounding error; so may one beside it.
            for nudge in (0.0, 1e-12, -1e-12):
                tried = list(weights)
                tried[line["x"]] += line["shift"] + nudge
                tried[line["y"]] -= line["shift"] + nudge
                if min(tried) < bounds[0] - 1e-9 or max(tried) > bounds[1] + 1e-9:
                    continue
                found = scores(wide.withColumn("y_pred", blended(models, tried, None))).first()["score"]
                if found > score + 1e-12:
                    weights, score, moved = tried, found, True
                    break
            if moved:
                break
        if not moved:
            break
    return weights, score


def search_weights(
    wide: DataFrame, models: Sequence[str], steps: int = 20, refinements: int = 1, finer: int = 4,
    bounds: tuple[float, float] = (0.0, 1.0), line_rounds: int = 0,
) -> tuple[dict[str, float], float]:
    """The best weights found from a coarse grid by ever finer shifts, or equal weights if those score higher.

    A round shifts weight between any two models, so its size grows with the
    square of the number of models. Shifts are halved down to ``1 / steps`` when
    none helps, and ``refinements`` times ``finer`` after that. The score never falls.
    With ``line_rounds`` the weights then move along exact lines (see ``line_optima``) until
    no shift between two models scores higher, or so many moves were made.
    """
    count = len(models)

    def best_of(shares: np.ndarray, total: int) -> tuple[float, list[int]]:
        row = best_candidate(share_scores(wide, models, shares, total), models).first()
        if row is None or row["score"] is None:
            raise ValueError("no row to score")
        return row["score"], [round(row[f"weight_{m}"] * total) for m in models]

    coarse = max(steps // 4, 1)
    start = _grid(steps, _box(count, steps, bounds), coarse)
    if not len(start):
        start = _grid(steps, _box(count, steps, bounds))[:1]
    if not len(start):
        raise ValueError("bounds leave no weight on the grid")
    score, best = best_of(start, steps)
    total, shift = steps, coarse
    for level in range(refinements + 1):
        box = _box(count, total, bounds)
        while shift:
            moved = np.array([best] + [
                [b + shift * ((i == x) - (i == y)) for i, b in enumerate(best)] for x in range(count) for y in range(count) if x != y
            ])
            inside = np.all([(moved[:, i] >= low) & (moved[:, i] <= high) for i, (low, high) in enumerate(box)], axis=0)
            found, place = best_of(moved[inside], total) if inside.any() else (score, best)
            if found > score:
                score, best = found, place
            else:
                shift //= 2
        if level < refinements:
            total, best, shift = total * finer, [b * finer for b in best], finer // 2
    equal = uniform_score(wide, models).first()[0]
    weights = [b / total for b in best]
    if equal > score and bounds[0] <= 1 / count <= bounds[1]:
        weights, score = [1 / count] * count, equal
    if line_rounds and count > 1:
        weights, score = _climb(wide, models, weights, score, bounds, line_rounds)
    return dict(zip(models, weights)), score


def uniform_score(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    return scores(wide.withColumn("y_pred", blended(models, [], None))).select(F.col("score").alias("uniform_score"))


def best_candidate(candidates: DataFrame, models: Sequence[str]) -> DataFrame:
    """The highest score; ties go to the larger weights of the earlier models."""
    weights = [f"weight_{m}" for m in models]
    best = F.max(F.struct("score", *weights))
    return candidates.agg(best.alias("_b")).select(*[F.col(f"_b.{c}").alias(c) for c in [*weights, "score"]])
