"""Fill-in-middle transformation with a boundary set.

The byte offsets at which the texts of a slice may be cut, the starts of their units, are held as one
set in containers of 65,536 offsets. A container is a sorted array, a bitmap or a list of runs,
whichever is smallest, and the set keeps the cumulative cardinalities of its containers. The cut after
``k`` units of a text is the member of rank ``first + k``: a search over the cumulative cardinalities
finds its container, a select inside gives the offset. Both cuts of all documents of a slice are
selected together, and prefix, middle and suffix are cut out of the bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import text_or_empty

SENTINELS = ("<P>", "<S>", "<M>")
SPAN = 1 << 16
_BITMAP_BYTES = SPAN // 8
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1).astype(np.int64)
#: Place of the k-th set bit of each byte.
_NTH = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable")


class ArrayContainer:
    def __init__(self, mask: np.ndarray) -> None:
        self.values = np.flatnonzero(mask).astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.values[k].astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Members below each place."""
        return np.searchsorted(self.values, at)


class RunContainer:
    def __init__(self, starts: np.ndarray, stops: np.ndarray) -> None:
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, side="right") - 1
        return self.starts[run].astype(np.int64) + k - self.before[run]

    def rank(self, at: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, at, side="right") - 1
        inside = np.minimum(at - self.starts[run].astype(np.int64), self.before[run + 1] - self.before[run])
        return np.where(run >= 0, self.before[run] + inside, 0)


class BitmapContainer:
    def __init__(self, mask: np.ndarray) -> None:
        self.bits = np.packbits(mask, bitorder="little")

    def _before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(_ONES[self.bits])])

    def select(self, k: np.ndarray) -> np.ndarray:
        before = self._before()
        byte = np.searchsorted(before, k, side="right") - 1
        return byte * 8 + _NTH[self.bits[byte], k - before[byte]]

    def rank(self, at: np.ndarray) -> np.ndarray:
        byte = np.minimum(at >> 3, len(self.bits) - 1)
        below = _BITS[self.bits[byte]].astype(np.int64) * (np.arange(8) < (at - byte * 8)[:, None])
        return self._before()[byte] + below.sum(1)


def container(mask: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container for the set places of ``mask``."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    n = int((stops - starts).sum())
    sizes = {"run": 6 * len(starts) + 4, "array": 2 * n, "bitmap": _BITMAP_BYTES}
    best = min(sizes, key=sizes.get)
    return RunContainer(starts, stops) if best == "run" else ArrayContainer(mask) if best == "array" else BitmapContainer(mask)


class BoundarySet:
    """Byte offsets where ``is_start(first, last)``, a mask of that range, is true, below ``size``."""

    def __init__(self, is_start, size: int) -> None:
        self.containers, counts = [], []
        for at in range(0, size, SPAN):
            mask = is_start(at, min(at + SPAN, size))
            self.containers.append(container(mask))
            counts.append(int(np.count_nonzero(mask)))
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def _each(self, which: np.ndarray, values: np.ndarray, local) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        order = np.argsort(which, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []:
            c = int(which[own[0]])
            out[own] = local(c, values[own])
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets of the members with these ranks, from 0."""
        which = np.searchsorted(self.before, ranks, side="right") - 1
        return self._each(which, ranks, lambda c, k: c * SPAN + self.containers[c].select(k - self.before[c]))

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """Members below these offsets."""
        which = np.minimum(offsets // SPAN, len(self.containers) - 1)
        if not self.containers:
            return np.zeros(len(offsets), np.int64)
        return self._each(which, offsets, lambda c, at: self.before[c] + self.containers[c].rank(at - c * SPAN))


def _starts(data: np.ndarray, rows: np.ndarray, unit: str):
    """A function that gives the mask of unit starts of a range of bytes; ``rows`` are the offsets where texts begin."""

    def is_start(first: int, last: int) -> np.ndarray:
        own = data[first:last]
        if unit == "char":
            mask = (own & 0xC0) != 0x80
        else:
            before = data[first - 1 : last - 1] if first else np.concatenate([np.full(1, 0x0A, np.uint8), own[:-1]])
            mask = before == 0x0A if unit == "line" else _BLANK[before] & ~_BLANK[own]
        begun = rows[np.searchsorted(rows, first) : np.searchsorted(rows, last)]
        mask[begun - first] = True
        return mask

    return is_start


def _check(sentinels: Sequence[str], unit: str) -> None:
    if unit not in ("char", "word", "line"):
        raise ValueError(f"unknown unit {unit!r}")
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a.endswith(b[:i]) for i in range(1, len(b))):
                raise ValueError("sentinels must not be empty, hold one another or overlap")


def _digit_groups(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of each id; a NULL id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", percent: int = 90, spm_percent: int = 20,
    sentinels: Sequence[str] = SENTINELS, seed: int = 1,
) -> DataFrame:
    """id, n_units, form (plain, psm or spm), prefix_units, middle_units and output, one row per input row.

    Units are code points, words with the blanks after them, or lines with their ends. The id alone
    decides on form and cuts, so rows that share an id, repeated rows among them, are cut alike if their
    texts are. A text that is empty, NULL or holds a sentinel stays plain, as do all but ``percent`` of the
    others; plain rows have NULL for the two counts. Only the two named columns are read, so that no
    other name can clash; an empty table gives an empty result. Memory is bounded by a slice of texts.
    """
    _check(sentinels, unit)
    prefix_mark, suffix_mark, middle_mark = (s.encode() for s in sentinels)
    names = ["h1", "h2", "h3", "h4"]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text")).select(
        "id", "text", *[c.alias(n) for c, n in zip(_digit_groups("id", seed), names, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                data, offsets = wh.text_buffer(part.column("text"))
                ends, begins = offsets[1:], offsets[:-1]
                units = BoundarySet(_starts(data, begins[begins < ends], unit), len(data))
                first, after = units.rank(begins), units.rank(ends)
                n = after - first
                h = [part.column(c).to_numpy() for c in names]
                cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
                # The cut after the last unit is the end of the text.
                where = [np.where(c < n, units.select(np.minimum(first + c, max(len(units) - 1, 0))), ends) if len(units) else ends for c in cuts]
                forms, outputs = [], []
                for begin, low, high, end, dice, order in zip(begins.tolist(), *(w.tolist() for w in where), ends.tolist(), h[2].tolist(), h[3].tolist(), strict=True):
                    text = data[begin:end].tobytes()
                    if not text or dice % 100 >= percent or prefix_mark in text or suffix_mark in text or middle_mark in text:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = text[: low - begin], text[low - begin : high - begin], text[high - begin :]
                    spm = order % 100 < spm_percent
                    forms.append("spm" if spm else "psm")
                    pieces = (suffix_mark, suffix, prefix_mark, prefix) if spm else (prefix_mark, prefix, suffix_mark, suffix)
                    outputs.append(b"".join((*pieces, middle_mark, middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n), pa.array(forms, pa.string()), pa.array(cuts[0], mask=plain),
                        pa.array(cuts[1] - cuts[0], mask=plain), pa.array(outputs, pa.string()),
                    ],
                    schema.names,
                )

    schema = StructType([
        StructField("id", rows.schema["id"].dataType), StructField("n_units", LongType()), StructField("form", StringType()),
        StructField("prefix_units", LongType()), StructField("middle_units", LongType()), StructField("output", StringType()),
    ])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form", sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that a transformed one was made from; NULL for NULL."""
    pieces = F.split(F.col(output), "|".join(re.escape(s) for s in sentinels), -1)
    piece = [F.get(pieces, F.lit(i)) for i in range(4)]
    return (
        F.when(F.col(form) == "psm", F.concat(piece[1], piece[3], piece[2]))
        .when(F.col(form) == "spm", F.concat(piece[2], piece[3], piece[1]))
        .otherwise(F.col(output))
    )
