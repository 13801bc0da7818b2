"""Language identification with hyperdimensional profiles.

Each letter, and the gap between words, has a random vector of +1 and -1. A trigram binds the
vectors of its letters, rotated by their place, by multiplication; a text bundles its trigrams by
addition. The profile of a language is the bundle of all its learning texts, and a text belongs to
the language whose profile has the largest cosine with it. The cosine of a text of ``n`` letters grows
like sqrt(n / (n + a)), as its noise fades. ``a``, and how far labelled texts fall behind that, are
learned too. A text is in none of the languages if its cosine is no more than that of unrelated texts
can be, and far below that of labelled texts of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from monthgrid.llm import wordhash as wh

DIMENSIONS = 1024
UNKNOWN = "und"
#: Cosines of unrelated texts spread around 0 by the root of the dimensions; so many times that is taken for chance.
CHANCE = 3.0
#: A score of this share of the low quantile of labelled texts, next to what their length lets expect, is never rejected.
LEVEL_SHARE, LEVEL_QUANTILE = 0.4, 0.01
_ACCURACY = 10_000
#: Trigrams whose vectors are held at once.
_BLOCK = 4096
_CODES = 0x110000


@cache
def _letter_table() -> np.ndarray:
    """Lower-case letter of each code point; 0 for what is not a letter."""
    table = np.zeros(_CODES, np.uint32)
    for code in range(_CODES):
        ch = chr(code)
        if ch.isalpha():
            low = ch.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _compact(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each value among them."""
    if size > 1 << 24:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[values] = True
    used = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    return used, place[values]


class Encoder:
    """Trigram counts of texts and their bundles."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letters = _letter_table()
        self.vectors: dict[int, np.ndarray] = {}

    def _vector(self, letter: int) -> np.ndarray:
        if letter not in self.vectors:
            bits = np.random.default_rng([97, letter]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.vectors[letter] = (2 * bits - 1).astype(np.int8)
        return self.vectors[letter]

    def trigrams(self, texts: list[str], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups, trigram numbers and counts, one entry for each trigram of a group, and the letters of each number.

        A group is a text unless ``groups`` says otherwise. Every letter makes a trigram with the
        letters, or gaps between words, on its two sides.
        """
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = self.letters[codes]
        used, small = _compact(low, _CODES)
        middle = np.flatnonzero(low)
        k = len(used)
        number = (small[middle - 1].astype(np.int64) * k + small[middle]) * k + small[middle + 1] if len(middle) else middle
        grams, place = _compact(number, k**3)
        ends = np.cumsum([len(t) + 1 for t in texts])
        group = np.searchsorted(ends, middle, side="left")
        n = len(texts)
        if groups is not None:
            group, n = groups[group], int(groups.max()) + 1
        cell = group * len(grams) + place
        if n * len(grams) <= 1 << 23:
            sums = np.bincount(cell, minlength=1)
            cells = np.flatnonzero(sums)
            counts = sums[cells]
        else:
            cells, counts = np.unique(cell, return_counts=True)
        letters = np.stack([used[grams // (k * k)], used[grams // k % k], used[grams % k]], 1)
        width = max(len(grams), 1)
        return cells // width, cells % width, counts, letters

    def bind(self, letters: np.ndarray) -> np.ndarray:
        """Vectors of trigrams: the first letter rotated by two, the second by one."""
        out = np.ones((len(letters), self.dimensions), np.int8)
        for place in range(3):
            used, inverse = np.unique(letters[:, place], return_inverse=True)
            rotated = np.stack([np.roll(self._vector(int(x)), 2 - place) for x in used])
            out *= rotated[inverse]
        return out

    def bundle(self, rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, letters: np.ndarray, n: int) -> np.ndarray:
        """(n, dimensions) sums of the trigram vectors, as float64 for whole numbers of any size."""
        out = np.zeros((n, self.dimensions))
        for at in range(0, len(letters), _BLOCK):
            own = (grams >= at) & (grams < at + _BLOCK)
            block = np.zeros((n, min(_BLOCK, len(letters) - at)), np.float32)
            block[rows[own], grams[own] - at] = counts[own]
            out += block @ self.bind(letters[at : at + _BLOCK]).astype(np.float32)
        return out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and trigram of a task, letters packed into one number each."""
    encoder, totals = Encoder(1), {}
    for batch in batches:
        for part in wh.slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            owner = np.array([names.index(x) for x in langs])
            groups, grams, counts, letters = encoder.trigrams(part.column("text").to_pylist(), owner)
            sums = np.zeros((len(names), len(letters)), np.int64)
            sums[groups, grams] = counts
            keys = [tuple(x) for x in letters.tolist()]
            for name, line in zip(names, sums, strict=True):
                own = totals.setdefault(name, {})
                for g in np.flatnonzero(line).tolist():
                    own[keys[g]] = own.get(keys[g], 0) + int(line[g])
                if len(own) > 200_000:
                    yield _count_rows(name, own)
                    totals[name] = {}
    for name, own in totals.items():
        yield _count_rows(name, own)


def _count_rows(name: str, own: dict) -> pa.RecordBatch:
    keys = np.array(list(own), np.int64).reshape(-1, 3)
    columns = [pa.array([name] * len(own)), *[pa.array(keys[:, i]) for i in range(3)], pa.array(list(own.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "c", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit profiles of each language, from all rows with text and language.

    Trigrams are counted in the tasks and summed per language in Spark; bundles of blocks of trigrams
    are added up per language, so the driver gets one vector for each language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_count_trigrams, "lang string, a bigint, b bigint, c bigint, n bigint")
    summed = counted.groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            letters = np.stack([batch.column(x).to_numpy() for x in "abc"], 1)
            names = np.array(batch.column("lang").to_pylist(), object)
            counts = batch.column("n").to_numpy().astype(np.float64)
            for at in range(0, len(letters), _BLOCK):
                vectors = encoder.bind(letters[at : at + _BLOCK]).astype(np.float64)
                for name in set(names[at : at + _BLOCK]):
                    own = names[at : at + _BLOCK] == name
                    sums[name] = sums.get(name, 0) + counts[at : at + _BLOCK][own] @ vectors[own]
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(np.arange(dimensions)), pa.array(vector)], ["lang", "d", "x"]
            )

    parts = summed.mapInArrow(bundle, "lang string, d bigint, x double").groupBy("lang", "d").agg(F.sum("x").alias("x"))
    profiles: dict[str, np.ndarray] = {}
    for row in parts.collect():  # languages x dimensions
        profiles.setdefault(row["lang"], np.zeros(dimensions))[row["d"]] = row["x"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(profiles.items()) if np.any(v)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with lang_pred, score, the largest cosine (0 if negative), and n_letters, one row per input row.

    A NULL or empty text, or one without a letter, or any text if nothing was learned, is ``und`` with
    score 0. Ties go to the language first in order. Ids may be NULL or repeated; other columns are not
    read.
    """
    names = list(profiles)
    matrix = np.stack([profiles[n] for n in names], 1) if names else np.zeros((DIMENSIONS, 0))
    rows = docs.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(matrix.shape[0])
        for batch in batches:
            for part in wh.slices(batch, "_text"):
                for at in range(0, part.num_rows, 512):
                    piece = part.slice(at, 512)
                    found = encoder.trigrams(piece.column("_text").to_pylist())
                    bundles = encoder.bundle(*found, piece.num_rows)
                    size = np.linalg.norm(bundles, axis=1)
                    cosines = (bundles @ matrix) / np.where(size > 0, size, 1)[:, None]
                    known = np.zeros(piece.num_rows, bool)
                    known[found[0]] = bool(names)
                    best = cosines.argmax(1) if names else np.zeros(piece.num_rows, int)
                    score = np.clip(cosines[np.arange(len(best)), best], 0, 1) if names else np.zeros(piece.num_rows)
                    labels = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    letters = np.bincount(found[0], weights=found[2], minlength=piece.num_rows).astype(np.int64)
                    columns = [*[piece.column(c) for c in id_cols], pa.array(labels, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(letters)]
                    yield pa.RecordBatch.from_arrays(columns, [*id_cols, "lang_pred", "score", "n_letters"])

    new = [("lang_pred", StringType()), ("score", DoubleType()), ("n_letters", LongType())]
    out = [*[rows.schema[c] for c in id_cols], *[StructField(n, t) for n, t in new]]
    return rows.mapInArrow(run, StructType(out))


def _expected(fade: float) -> Column:
    letters = F.greatest(F.col("n_letters"), F.lit(1)).cast("double")
    return F.sqrt(letters / (letters + F.lit(fade)))


def levels(labelled: DataFrame) -> tuple[float, float]:
    """From identified rows with a label: the letters at which half of a score's square is noise, and the least score
    as a share of what the length lets expect. Two sketches; without rows nothing is expected and 0 is enough.
    """
    scored = labelled.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    noise = F.col("n_letters") * (1 / F.col("score") ** 2 - 1)
    fade = max(0.0, scored.agg(F.percentile_approx(noise, 0.5, _ACCURACY)).first()[0] or 0.0)
    low = scored.agg(F.percentile_approx(F.col("score") / _expected(fade), LEVEL_QUANTILE, _ACCURACY)).first()[0] or 0.0
    return fade, LEVEL_SHARE * low


def accepted(fade: float, least: float, dimensions: int = DIMENSIONS) -> Column:
    """True for an identified row whose text is in one of the languages."""
    level = F.least(F.lit(least) * _expected(fade), F.lit(CHANCE / dimensions**0.5))
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= level)
