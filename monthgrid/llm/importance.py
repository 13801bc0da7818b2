"""Target-distribution importance resampling.

Runs of words are hashed into buckets. The buckets' counts over all documents and over all target
texts give each bucket a gain, the logarithm of how much more frequent it is in the target; a
document's weight is the mean gain of its features, and weight plus Gumbel noise is its score. Drawing
the highest scores is sampling without replacement in proportion to the exponentials of the weights.

The cutoff is found without sorting all scores: a quantile sketch brackets it, the exact counts of
the rows above and inside say whether the bracket holds it (it is widened until it does), and only
the rows inside are sorted. Rows of equal score are told apart by id, so no tie is left to chance.

Hashes, counts and weights are made with arrays over whole slices of texts. Only the bucket counts, as
many numbers as there are buckets, reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import materialize, shuffle_width, text_or_empty

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
#: Half the width of the first bracket, as a share of the rows, and how much it widens.
BRACKET, WIDER = 0.002, 8
SKETCH_ACCURACY = 10_000
#: Words longer than this are hashed one by one.
_LONG = 255
_SPACE = 0x20


def _word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the bytes with A-Z in lower case."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[65:91] = inside[128:] = True
    return inside, lower


_INSIDE, _LOWER = _word_bytes()


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """Effect of one byte on the 32-bit checksum, from its reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """(length, byte place, byte): a checksum's share in the checksum of its text with ``length`` more bytes."""
    tables = np.zeros((_LONG + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _LONG + 1):
        tables[n] = _crc_table()[tables[n - 1] & 0xFF] ^ (tables[n - 1] >> 8)
    return tables


class Features:
    """Words of consecutive texts, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case, and checksums of runs of one and two."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = wh.text_buffer(texts)
        word = _INSIDE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        filled = offsets[1:] > offsets[:-1]
        begun, ended = offsets[:-1][filled], offsets[1:][filled] - 1
        first[begun], last[ended] = word[begun], word[ended]
        self.data = _LOWER[data]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.words = np.diff(self.offsets)
        self.row = np.repeat(np.arange(len(self.words)), self.words)

    def _singles(self) -> np.ndarray:
        sizes = self.ends - self.starts
        order = np.argsort(-sizes, kind="stable")
        places, left = self.starts[order], sizes[order]
        long = int(np.searchsorted(-left, -_LONG, side="left"))
        table, state = _crc_table(), np.full(len(order), 0xFFFFFFFF, np.uint32)
        for j in range(int(left[long]) if long < len(left) else 0):
            stop = int(np.searchsorted(-left, -j, side="left"))
            own = state[long:stop]
            state[long:stop] = table[(own ^ self.data[places[long:stop] + j]) & 0xFF] ^ (own >> 8)
        out = np.empty(len(order), np.uint32)
        out[order] = ~state
        for i in order[:long].tolist():
            out[i] = zlib.crc32(self.data[self.starts[i] : self.ends[i]])
        return out

    def _pairs(self, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and checksums of neighbouring words joined by a space."""
        first = np.flatnonzero(self.row[1:] == self.row[:-1]) if len(self.row) else np.zeros(0, np.int64)
        state = ~singles[first]
        spaced = ~(_crc_table()[(state ^ np.uint32(_SPACE)) & 0xFF] ^ (state >> 8))
        size = (self.ends - self.starts)[first + 1]
        tables, short = _shift_tables(), np.minimum(size, _LONG)
        out = singles[first + 1].copy()
        for place in range(4):
            out ^= tables[short, place, (spaced >> np.uint32(8 * place)) & 0xFF]
        for i in np.flatnonzero(size > _LONG).tolist():
            at = first[i] + 1
            out[i] = zlib.crc32(self.data[self.starts[at] : self.ends[at]], int(spaced[i]))
        return self.row[first], out

    def checksums(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and checksum of every feature."""
        singles = self._singles()
        rows, pairs = self._pairs(singles)
        return np.concatenate([self.row, rows]), np.concatenate([singles, pairs])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, for the buckets that occur in any text. A task sends one row for each bucket it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in wh.slices(batch, "text"):
                total += np.bincount(Features(part.column("text")).checksums()[1] % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = texts.select(text_or_empty(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, raw_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths, with one more feature assumed in each bucket on both sides."""
    counts = []
    for texts, col in ((raw, raw_col), (target, target_col)):
        own = [0] * buckets
        for r in bucket_counts(texts, col, buckets).collect():  # at most one row for each bucket
            own[r["bucket"]] = r["n"]
        counts.append(own)
    s, t = counts
    whole, aim = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * whole / ((a + 1) * aim))) for a, b in zip(s, t, strict=True)], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise in thousandths that an id alone decides; a NULL id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """id, n_words, n_features, weight and score, one row per input row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text"):
                found = Features(part.column("text"))
                row, checksum = found.checksums()
                n = np.bincount(row, minlength=part.num_rows)
                # Gains are whole numbers, so their sums in doubles are exact.
                total = np.bincount(row, weights=gain[checksum % len(gain)], minlength=part.num_rows).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.words.astype(np.int64)), pa.array(n), pa.array(weight)], schema.names)

    schema = StructType([StructField("id", rows.schema["id"].dataType), *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + gumbel("id", seed))


def numbered(df: DataFrame, order: list[str], output: str) -> DataFrame:
    """1, 2, 3, ... in ``order``: rows are dealt by ranges and numbered inside theirs after the sizes of the ranges before."""
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # one row for each range
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(output, F.col("_before") + place + 1).drop("_part", "_before", "_at")


def bracket(rows: DataFrame, n: int, k: int, width: float = BRACKET) -> tuple[int | None, int | None, int]:
    """Scores, lowest and highest, between which the row of rank ``k`` (by falling score, of ``n``) lies, and the rows above.

    None stands for no bound. The sketch only proposes; the counts decide.
    """
    while True:
        low, high = 1 - k / n - width, 1 - k / n + width
        asked = [x for x in (low, high) if 0 < x < 1]
        found = rows.agg(F.percentile_approx("score", asked, SKETCH_ACCURACY)).first()[0] if asked else []
        bounds = dict(zip(asked, found, strict=True))
        least, most = bounds.get(low), bounds.get(high)
        above = F.lit(False) if most is None else F.col("score") > most
        inside = ~above & (F.lit(True) if least is None else F.col("score") >= least)
        over, within = rows.agg(F.count_if(above), F.count_if(inside)).first()
        if over < k <= over + within:
            return least, most, over
        width *= WIDER


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... by falling score for the ``percent`` drawn of the rows with enough words, else NULL.

    Ties go to the smaller id; rows that share id and score stand in any, but fixed, order.
    """
    order = ["_down", "_no_id", "_known", "_copy"]
    scored = scored.withColumns({
        "_down": -F.col("score"), "_no_id": F.col("id").isNull(), "_known": F.coalesce("id", F.lit(0)), "_copy": F.monotonically_increasing_id(),
    })
    scored = materialize(scored, "scored")
    able = F.col("n_words") >= min_words
    rows = scored.where(able)
    n = rows.count()
    k = n * percent // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("bigint")).drop(*order)
    least, most, over = bracket(rows, n, k)
    inside = rows if most is None else rows.where(F.col("score") <= most)
    inside = inside if least is None else inside.where(F.col("score") >= least)
    last = numbered(inside.select(*order), order, "rank").where(F.col("rank") == k - over).first()
    key, cut = F.struct(*order), F.struct(*[F.lit(last[c]).cast(scored.schema[c].dataType).alias(c) for c in order])
    drawn = able & (key <= cut)
    ranked = numbered(scored.where(drawn), order, "rank")
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop(*order)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
    min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = 7,
) -> DataFrame:
    """id, n_words, n_features, weight, score and rank, one row per input row.

    NULL and empty texts have no features, weight 0, and are not drawn for having too few words. Rows
    without id share the noise of the empty string and come after others of their score. Rows that share
    an id share its noise; repeated rows are drawn one by one. An empty target gives nearly equal gains,
    an empty table an empty result. Other columns are not read.
    """
    gain = gains(docs, target, text_col, target_col, buckets)
    return draw(score(docs, gain, id_col, text_col, seed), percent, min_words).withColumnRenamed("id", id_col)
