"""Line dedup by winnowing.

Every window of ``WINDOW`` consecutive lines selects its smallest line hash, the rightmost of equals,
so two documents that share a run of that many lines select the same line of it. A line of
``LONG_WORDS`` words or more is selected in any case. Each selected line is one row: its hash as the
fingerprint, its position, and the hashes of the lines up to a window away on both sides.

Rows whose fingerprint occurs once are left behind. Positions that share a fingerprint are extended to
both sides: each window of lines around a position, and a long line by itself, is held against its
first occurrence by (id, place), which an aggregate finds. All that occurs again is deleted;
neighbouring windows join up to whole runs. Occurrences are never paired with each other, so a run that
very many documents share costs a row for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import materialize, text_or_empty

WINDOW = 2
#: A line with so many words goes by itself, whatever stands beside it.
LONG_WORDS = 20
_BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the indexes of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_BLANKS)]


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(c) for c in _BLANKS]] = True


def _line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and word counts of lines without the blanks around them."""
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer("\n".join(x.strip(_BLANKS) for x in lines).encode(), np.uint8)
    blank, ends = _IS_BLANK[data], np.array([0, len(data)])
    joined = wh.Words(np.where(blank & (data != 0x0A), 0x01, data).astype(np.uint8), ends, lower=False)
    # Blanks inside a line are hashed as a byte of their own kind, then told apart by a second sum.
    kinds = wh.Words(np.where(data == 0x0A, 0x0A, np.where(blank, data + 0x80, 0x02)).astype(np.uint8), ends, lower=False)
    begun = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    words = np.bincount(np.searchsorted(np.flatnonzero(data == 0x0A), begun), minlength=len(lines))
    return wh.mix(joined.hashes * wh.U64(3) + kinds.hashes), words


def _second_hash(line: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(line.strip(_BLANKS).encode())).view(np.int64))


def selected(hashes: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """True for the lines that a window inside their text selects; ``counts`` are the lines of each text."""
    out = np.zeros(len(hashes), bool)
    per_row = np.maximum(counts - window + 1, 0)
    if per_row.sum():
        starts = np.cumsum(counts) - counts
        first = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row) + np.repeat(starts, per_row)
        lines = hashes[first[:, None] + np.arange(window)]
        out[first + window - 1 - np.argmin(lines[:, ::-1], axis=1)] = True
    return out


def _select(window: int, long_words: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                kept = []
                for t in part.column("text").to_pylist():
                    lines, full = split_lines(t)
                    kept.append([lines[i] for i in full])
                counts = np.array([len(k) for k in kept])
                flat = [x for k in kept for x in k]
                hashes, words = _line_hashes(flat)
                long = words >= long_words
                at = np.flatnonzero(selected(hashes, counts, window) | long)
                row = np.repeat(np.arange(len(counts)), counts)
                around = at[:, None] + np.arange(1 - window, window)
                inside = (around >= 0) & (around < len(hashes))
                around = np.where(inside, around, 0)
                inside &= row[around] == row[at][:, None] if len(at) else inside
                near = pa.array(hashes[around].view(np.int64).ravel() if len(at) else [], pa.int64(), mask=~inside.ravel() if len(at) else None)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * (2 * window - 1))
                second = [_second_hash(flat[i]) if is_long else None for i, is_long in zip(at.tolist(), long[at].tolist(), strict=True)]
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[at].view(np.int64)), pa.array(second, pa.int64()), pa.ListArray.from_arrays(offsets, near),
                        part.column("id").take(pa.array(row[at])), part.column("row_key").take(pa.array(row[at])), pa.array(place[at].astype(np.int64)),
                    ],
                    ["fingerprint", "second", "near", "id", "row_key", "at"],
                )

    return select


def repeated_lines(rows: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``rows``: id (bigint, not NULL), row_key, text. Numbers of the lines that repeat earlier ones, by row, not distinct."""
    schema = "fingerprint bigint, second bigint, near array<bigint>, id bigint, row_key bigint, at bigint"
    places = materialize(rows.mapInArrow(_select(window, long_words), schema), "line_places")
    # Written, so that the join reads two plain shuffles and can split the rows of a very common line.
    twice = materialize(places.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "line_fingerprints")
    # What is extended on either side: the windows around the position, first line ``offset`` lines before it, and a long line alone.
    parts = [
        F.struct(F.lit(o).alias("offset"), F.lit(window).alias("size"), F.slice("near", window - o, window).alias("lines")) for o in range(window)
    ]
    parts.append(F.struct(F.lit(0).alias("offset"), F.lit(1).alias("size"), F.array("second").alias("lines")))
    around = places.join(twice.hint("merge"), "fingerprint", "left_semi").select("fingerprint", "id", "row_key", "at", F.explode(F.array(*parts)).alias("p"))
    around = around.where(~F.exists("p.lines", lambda x: x.isNull())).select(
        "fingerprint", "id", "row_key", "at", F.col("p.offset").alias("offset"), F.col("p.size").alias("size"), F.xxhash64("p.lines").alias("lines")
    )
    around = materialize(around, "line_windows")
    match = ["fingerprint", "offset", "size", "lines"]
    first = around.groupBy(*match).agg(F.min(F.struct("id", "row_key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = around.join(materialize(first, "line_firsts").hint("merge"), match).where(F.struct("id", "row_key", "at") > F.col("first"))
    start = F.col("at") - F.col("offset")
    return later.select("id", "row_key", F.explode(F.sequence(start, start + F.col("size") - 1)).alias("line"))


def _delete(schema: StructType, text_col: str):
    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), text_col)
            whole = pa.RecordBatch.from_arrays([batch.column("row"), texts, batch.column("gone")], ["row", "text", "gone"])
            for part in wh.slices(whole, "text"):
                n_lines, n_removed, kept = [], [], []
                for text, numbers in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    lines, full = split_lines(text or "")
                    gone = {full[i] for i in numbers or ()}
                    n_lines.append(len(full))
                    n_removed.append(len(gone))
                    kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema.names
                )

    return delete


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS,
) -> DataFrame:
    """``row`` (a struct of all columns of the input row), n_lines, n_removed and kept_text, one row per input row.

    Lines end at line feeds and are compared without the blanks around them; blank lines count as no
    line and stay. A line goes if ``window`` consecutive lines over it also occur earlier, in a row
    with a smaller id or further up in the same row, or if it has ``long_words`` words or more and occurs
    earlier itself; all lines are judged on the input. A NULL text stays NULL, a text without repeats stays
    as it is. Rows with a NULL id stand outside the order. Rows that share an id are ordered by their text's
    hash, and rows repeated as a whole are one and the same, so neither loses lines to the other. Columns
    of any name are carried inside ``row``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"))
    text = text_or_empty(f"row.`{text_col}`")
    rows = rows.withColumn("row_key", F.xxhash64(text))
    read = rows.where("id IS NOT NULL").select("id", "row_key", text.alias("text"))
    gone = repeated_lines(read, window, long_words).groupBy("id", "row_key").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone, "line_repeats")
    schema = StructType([
        StructField("row", rows.schema["row"].dataType), StructField("n_lines", LongType()), StructField("n_removed", LongType()),
        StructField("kept_text", StringType()),
    ])
    # One plan at every size: the documents are dealt by their keys, once, whether there are few repeats or many.
    marked = rows.join(gone.hint("merge"), ["id", "row_key"], "left").select("row", "gone")
    return marked.mapInArrow(_delete(schema, text_col), schema)
