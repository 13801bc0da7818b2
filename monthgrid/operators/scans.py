"""Recursions along series that may be longer than a task should hold.

Rows are dealt by ranges of (series, order), so a long series is cut into consecutive fragments, one
for each task it touches, and a series of any length is spread over the cluster. A first pass sums up
what each task's last fragment does to the state it starts from, as one affine map; the maps, one row
for each task, are composed in order, which gives every task the state its first series starts from;
a second pass runs the recursion in place. No rows of a series are gathered: a task holds one batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import checkpointed

#: Mean (None before the first value) and weight of a recursion after some rows.
State = tuple[float | None, float]
START: State = (None, 1.0)


@dataclass
class Fragment:
    """What consecutive rows of one series do to the state before them, for one column and factor.

    Up to the first value only the weight fades. From there on the mean is an affine map of the mean
    after that value: ``end + slope * (mean - first)``, where ``end`` is the result from ``first`` itself.
    """

    rows: int = 0
    before: int = 0
    first: float | None = None
    end: float = 0.0
    slope: float = 1.0
    weight: float = 1.0

    def add(self, values: list[float | None], alpha: float) -> None:
        keep, mean, slope, weight = 1.0 - alpha, self.end, self.slope, self.weight
        for x in values:
            if self.first is None:
                if x is None:
                    self.before += 1
                else:
                    self.first = mean = x
            elif x is None:
                weight *= keep
            else:
                kept = weight * keep
                mean, slope, weight = (kept * mean + alpha * x) / (kept + alpha), slope * (kept / (kept + alpha)), 1.0
        self.rows += len(values)
        self.end, self.slope, self.weight = mean, slope, weight

    def apply(self, state: State, alpha: float) -> State:
        mean, weight = state
        keep = 1.0 - alpha
        if self.first is None:
            return state if mean is None else (mean, weight * keep**self.rows)
        if mean is None:
            return self.end, self.weight
        kept = weight * keep ** (self.before + 1)
        after = (kept * mean + alpha * self.first) / (kept + alpha)
        return self.end + self.slope * (after - self.first), self.weight


def smooth(values: list[float | None], alpha: float, state: State) -> tuple[list[float | None], State]:
    """The recursive mean after each value, and the state in the end. A gap lowers the weight of what came before."""
    (mean, weight), keep, out = state, 1.0 - alpha, []
    for x in values:
        if x is None:
            if mean is not None:
                weight *= keep
        else:
            if mean is None:
                mean = x
            elif x != mean:
                kept = weight * keep
                mean = (kept * mean + alpha * x) / (kept + alpha)
            weight = 1.0
        out.append(mean)
    return out, (mean, weight)


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple[int, int]]:
    """First and one past the last row of each series in the batch."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _key(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _summarise(keys: Sequence[str], wanted: Sequence[tuple[str, float]]):
    """One row for each task: its first and last series, whether they are one, and the fragments of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_row = last_row = None
        last, whole, fragments = None, True, []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = _runs(batch, keys)
            start, stop = runs[-1]
            key = _key(batch, keys, start)
            own = batch.select(list(keys))
            first_row = own.slice(0, 1) if first_row is None else first_row
            whole = whole and len(runs) == 1 and (last is None or last == key)
            if last != key or len(runs) > 1:
                fragments = [Fragment() for _ in wanted]
            last, last_row = key, own.slice(start, 1)
            for fragment, (column, alpha) in zip(fragments, wanted, strict=True):
                fragment.add(batch.column(column).slice(start, stop - start).to_pylist(), alpha)
        if last_row is not None:
            packed = [[f.rows, f.before, f.first, f.end, f.slope, f.weight] for f in fragments]
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([whole]), *first_row.columns, *last_row.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed], pa.list_(pa.list_(pa.float64())))], names)

    names = ["part", "whole", *[f"first_{i}" for i in range(len(keys))], *[f"last_{i}" for i in range(len(keys))], "fragments"]
    return run


def _carried(found: Sequence, keys: int, wanted: Sequence[tuple[str, float]]) -> dict[int, list[State]]:
    """The states that the first series of each task starts from, where it goes on from the task before."""
    states: dict[int, list[State]] = {}
    before, ends = None, []
    for row in sorted(found, key=lambda r: r["part"]):
        first, last = (tuple(row[f"{x}_{i}"] for i in range(keys)) for x in ("first", "last"))
        goes_on = before == first
        if goes_on:
            states[row["part"]] = ends
        start = ends if goes_on and row["whole"] else [START] * len(wanted)
        fragments = [Fragment(int(f[0]), int(f[1]), *f[2:]) for f in row["fragments"]]
        ends = [f.apply(s, alpha) for f, s, (_, alpha) in zip(fragments, start, wanted, strict=True)]
        before = last
    return states


def _smooth_runs(x: np.ndarray, valid: np.ndarray, starts: np.ndarray, alpha: float, state: State) -> tuple[np.ndarray, np.ndarray, State]:
    """``smooth`` for consecutive series at once: means, which of them are known, and the state at the end of the last.

    ``starts`` are the first rows of the series; the first series goes on from ``state``. The values of one rank
    in all series are taken together; a batch of few long series goes value by value.
    """
    n, (mean0, weight0) = len(x), state
    placed = np.flatnonzero(valid)
    run = np.searchsorted(starts, placed, side="right") - 1
    first = np.searchsorted(placed, starts)  # of each series, its first among the values
    rank = np.arange(len(placed)) - first[run]
    steps = int(rank.max()) + 1 if len(placed) else 0
    if steps * 8 > max(len(placed), 64):
        values, out, bounds = [v if k else None for v, k in zip(x.tolist(), valid.tolist(), strict=True)], [], [*starts.tolist(), n]
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            done, end = smooth(values[start:stop], alpha, state if start == 0 else START)
            out += done
        known = np.array([m is not None for m in out], bool)
        return np.array([m if k else 0.0 for m, k in zip(out, known.tolist(), strict=True)], np.float64), known, end
    fades = np.cumprod(np.concatenate([[1.0], np.full(n, 1.0 - alpha)]))
    before = np.concatenate([[-1], placed[:-1]])
    kept, own = fades[np.where(rank > 0, placed - before, 0)], x[placed]
    means, order = own.copy(), np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank, minlength=steps)) if steps else []
    if mean0 is not None and len(placed) and run[0] == 0 and own[0] != mean0:
        fade = weight0 * fades[placed[0] + 1]
        means[0] = (fade * mean0 + alpha * own[0]) / (fade + alpha)
    elif mean0 is not None and len(placed) and run[0] == 0:
        means[0] = mean0
    for start, stop in zip(ends[:-1], ends[1:], strict=True):
        at = order[start:stop]
        last = means[at - 1]
        means[at] = np.where(own[at] != last, (kept[at] * last + alpha * own[at]) / (kept[at] + alpha), last)
    latest = np.cumsum(valid) - 1  # the last value so far, of any series
    series = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), n]))
    known = latest >= first[series]
    out = np.where(known, means[np.maximum(latest, 0)] if len(placed) else 0.0, 0.0)
    if mean0 is not None:
        carried = (series == 0) & ~known
        out[carried], known = mean0, known | carried
    if first[-1] < len(placed):
        end = float(means[-1]), float(fades[n - 1 - placed[-1]])
    elif len(starts) == 1:
        end = state if mean0 is None else (mean0, float(weight0 * fades[n]))
    else:
        end = START
    return out, known, end


def _apply(keys: Sequence[str], wanted: Sequence[tuple[str, float]], carried: Mapping[int, list[State]], names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = carried.get(TaskContext.get().partitionId())
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.array([start for start, _ in _runs(batch, keys)])
            goes_on = last == _key(batch, keys, 0) if last is not None else states is not None
            before, out = states if goes_on else [START] * len(wanted), []
            for (column, alpha), state in zip(wanted, before, strict=True):
                values = batch.column(column)
                valid = values.is_valid().to_numpy(zero_copy_only=False)
                means, known, end = _smooth_runs(values.fill_null(0.0).to_numpy(zero_copy_only=False), valid, starts, alpha, state)
                out.append((pa.array(means, pa.float64(), mask=~known), end))
            states, last = [s for _, s in out], _key(batch, keys, batch.num_rows - 1)
            others = [batch.column(c) for c in names[: len(names) - len(out)]]
            yield pa.RecordBatch.from_arrays([*others, *[m for m, _ in out]], list(names))

    return run


def smoothed(
    df: DataFrame, outputs: Mapping[tuple[str, float], str], keys: Sequence[str], order: str, gathered: bool = False
) -> DataFrame:
    """``df`` with a recursive mean for each (column, factor) of ``outputs``, under the name given there.

    ``keys`` and ``order`` tell rows apart. Values are taken as doubles; missing is NULL. ``gathered`` says that
    the rows come from a window over ``keys``, so that each series is in one task already: then one pass does.
    """
    wanted = list(outputs)
    # Columns go to the tasks by place, whatever characters their names have.
    place = {c: f"_{i}" for i, c in enumerate(df.columns)}
    inputs = {c: f"_x{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in wanted))}
    sources, own = [(inputs[c], alpha) for c, alpha in wanted], [place[k] for k in keys]
    rows = df.toDF(*place.values())
    rows = rows.withColumns({name: F.col(place[c]).cast("double") for c, name in inputs.items()})
    if gathered:
        ranged, carried = rows.sortWithinPartitions(*own, place[order]), {}
    else:
        # Both passes must see the same tasks, so their partitions are stored as they are.
        ranged = checkpointed(rows.repartitionByRange(*own, place[order]).sortWithinPartitions(*own, place[order]))
        ends = [StructField(f"{x}_{i}", ranged.schema[k].dataType) for x in ("first", "last") for i, k in enumerate(own)]
        summary = StructType([StructField("part", _type("int")), StructField("whole", _type("boolean")), *ends, StructField("fragments", _type("array<array<double>>"))])
        found = ranged.mapInArrow(_summarise(own, sources), summary).collect()  # a row for each task
        carried = _carried(found, len(keys), sources)
    out = StructType([*ranged.schema[: len(place)], *[StructField(f"_y{i}", DoubleType()) for i in range(len(outputs))]])
    return ranged.mapInArrow(_apply(own, sources, carried, out.names), out).toDF(*df.columns, *outputs.values())


def _type(text: str):
    return StructType.fromDDL(f"x {text}")["x"].dataType
