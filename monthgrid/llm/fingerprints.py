"""Document fingerprints: MinHash signatures of word shingles.

Universal permutations of the shingle hashes are minimised with numpy. The 128 minima, in hex, are
the fingerprint, and the share of equal minima estimates the Jaccard similarity of two texts. To
find similar documents, bands of the signatures are joined in Spark and the pairs verified on the
full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import materialize, shuffle_width, text_or_empty

HASHES = 128
SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
SIMILAR_PERCENT = 75
#: Least share of equal minima of a pair that is verified: the threshold less six standard errors.
LIKELY = 0.52
BLOCK_MEMBERS = 512
#: Parts of the id order per shuffle partition, so that hashing them to partitions stays even.
PARTS = 4

_FINGERPRINT = "fingerprint binary"


def signatures(texts: pa.Array, minhash: wh.MinHash) -> np.ndarray:
    """(rows, HASHES) minima. Texts without words share one signature, unlike any other."""
    return minhash.minima(wh.Words(*wh.text_buffer(texts), lower=True).shingles(SHINGLE_WORDS))


def permutations() -> wh.MinHash:
    return wh.MinHash(HASHES, seed=23)


def _bytes(minima: np.ndarray) -> pa.Array:
    return pa.array([row.astype(">u4").tobytes() for row in minima], pa.binary())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row_key and ``fingerprint`` (the minima as big-endian 32-bit numbers), one row per input row.

    Equal texts have equal fingerprints; NULL counts as empty; NULL ids are carried. Other columns
    are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("row_key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = permutations()
        for batch in batches:
            for part in wh.slices(batch, "text"):
                prints = _bytes(signatures(part.column("text"), minhash))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row_key"), prints], ["id", "row_key", "fingerprint"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, row_key bigint, {_FINGERPRINT}").withColumnRenamed("id", id_col)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band and pair of blocks. Likely pairs, each only in the first band that it shares."""
    names = ["id_u", "key_u", "id_v", "key_v"]

    def likely(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        band, _, lo, hi = key
        ids, keys = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        blocks = np.array([r[2] for r in rows])
        minima = np.array([np.frombuffer(r[3], ">u4") for r in rows])
        out = []
        for i in range(len(rows) - 1):
            equal = minima[i + 1 :] == minima[i]
            keep = equal.mean(1) >= LIKELY
            keep &= equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            if lo != hi:
                keep &= blocks[i + 1 :] != blocks[i]
            out.append(np.stack([np.full(keep.sum(), i), i + 1 + np.flatnonzero(keep)]))
        a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], keys[a], ids[b], keys[b])], names)

    at, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("band", "bucket", "lo", "hi", "id", "row_key", "block", "fingerprint")]
        for band, bucket, lo, hi, *row in zip(*columns, strict=True):
            if (band, bucket, lo, hi) != at:
                if held:
                    yield likely(at, held)
                at, held = (band, bucket, lo, hi), []
            held.append(row)
    if held:
        yield likely(at, held)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (u, v, jaccard) between ids, u > v: all pairs of different texts that share a band, verified.

    A text stands for its smallest id, to which each other id with that text has a link of 1. Buckets of
    the join are cut into blocks and every pair of blocks is compared in a task's memory, so work grows
    with the square of a bucket, but only likely pairs leave a task. A link at the threshold is missed by
    the estimate only beyond six standard errors, by all bands with a probability of about 1 in 200,000.
    Rows with NULL ids or without words are left out; rows that repeat an id are linked if any of their
    texts is.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text")).where("id IS NOT NULL")
    texts = materialize(rows.groupBy("text").agg(F.min("id").alias("id"), F.collect_set("id").alias("ids")), "distinct_texts")
    texts = texts.withColumn("row_key", F.xxhash64("text"))
    prints = materialize(fingerprint(texts, "id", "text"), "fingerprints").where(F.col("fingerprint") != F.lit(b"\xff" * 4 * HASHES))
    size = 4 * ROWS
    bands = F.array(*[F.substring("fingerprint", b * size + 1, size) for b in range(BANDS)])
    entries = prints.select("id", "row_key", "fingerprint", F.posexplode(bands).alias("band", "bucket"))
    sizes = entries.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("band", "bucket", F.ceil(F.col("n") / BLOCK_MEMBERS).alias("blocks"))
    members = entries.join(sizes, ["band", "bucket"]).withColumn("block", F.expr("pmod(xxhash64(id, row_key, 5), blocks)"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    members = members.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = members.select("band", F.xxhash64("bucket").alias("bucket"), "lo", "hi", "id", "row_key", "block", "fingerprint")
    dealt = dealt.repartition(width, "band", "bucket", "lo", "hi").sortWithinPartitions("band", "bucket", "lo", "hi")
    pairs = dealt.mapInArrow(_pairs, "id_u bigint, key_u bigint, id_v bigint, key_v bigint")
    sides = [texts.select(F.col("id").alias(f"id_{x}"), F.col("row_key").alias(f"key_{x}"), F.col("text").alias(f"text_{x}")) for x in "uv"]
    pairs = pairs.where("id_u <> id_v").join(sides[0], ["id_u", "key_u"]).join(sides[1], ["id_v", "key_v"])
    pairs = pairs.select(F.greatest("id_u", "id_v").alias("u"), F.least("id_u", "id_v").alias("v"), "text_u", "text_v")
    worded = texts.join(prints.select("id", "row_key"), ["id", "row_key"], "left_semi")
    copies = worded.select(F.explode("ids").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("jaccard")).where("u <> v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wh.slices(batch, "text_u"):
                a, b = (wh.Words(*wh.text_buffer(part.column(c)), lower=True).shingles(SHINGLE_WORDS) for c in ("text_u", "text_v"))
                shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], float)
                union = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)]) - shared
                keep = 100 * shared >= SIMILAR_PERCENT * union
                yield pa.RecordBatch.from_arrays(
                    [part.column("u").filter(keep), part.column("v").filter(keep), pa.array((shared / union)[keep])], ["u", "v", "jaccard"]
                )

    found = pairs.mapInArrow(verify, "u bigint, v bigint, jaccard double").unionByName(copies)
    return found.groupBy("u", "v").agg(F.max("jaccard").alias("jaccard"))


def _count_below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are <= value, by binary search; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, step: F.when(F.get(held, low + step - 1) <= value, low + step).otherwise(low),
    )


def with_successors(rows: DataFrame) -> DataFrame:
    """``rows``: id (bigint), row_key, text. Adds ``part`` and ``guest`` and deals the rows by part, in id order.

    The id order is cut at quantiles into parts. The first row of each part also visits the part
    before it as a guest, and the very first row the last part, so each part knows the successor of
    its last row. NULL ids come first; rows that share an id are ordered by their text's hash.
    """
    width = shuffle_width(rows.sparkSession)
    n = width * PARTS
    facts = rows.agg(
        F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("cuts"), F.min("id").alias("least"),
        F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"),
    ).first()
    cuts = sorted(set(facts["cuts"] or []))
    first = F.lit(None if facts["nulls"] else facts["least"]).cast("bigint")
    home = rows.withColumn("part", _count_below(cuts, F.col("id")))
    starts = F.col("id").isin(cuts) if cuts else F.lit(False)
    stays = F.array(
        F.struct("part", F.lit(0).alias("guest")),
        F.when(starts, F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("guest"))),
        F.when(F.col("id").eqNullSafe(first), F.struct(F.lit(len(cuts)).alias("part"), F.lit(1).alias("guest"))),
    )
    dealt = home.withColumn("stay", F.explode(F.array_compact(stays))).select("stay.part", "stay.guest", "id", "row_key", "text")
    return dealt.repartition(width, "part").sortWithinPartitions("part", "guest", "id", "row_key")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``with_successors``; the row before waits for its successor."""
    minhash = permutations()
    waiting = None  # part, id, text, minima
    done = False  # the part has met its guest
    for batch in batches:
        for piece in wh.slices(batch, "text"):
            minima = signatures(piece.column("text"), minhash)
            columns = [piece.column(c).to_pylist() for c in ("part", "guest", "id", "text")]
            pairs = []
            for i, (part, guest, doc, text) in enumerate(zip(*columns, strict=True)):
                if waiting is not None and waiting[0] == part and not done:
                    pairs.append((waiting, text, minima[i]))
                if waiting is None or waiting[0] != part:
                    done = False
                done = done or bool(guest)
                waiting = (part, doc, text, minima[i])
            if not pairs:
                continue
            edited = []
            for (_, _, text, _), after, _ in pairs:
                quarter = len(text) // 4
                edited.append(text[: len(text) - quarter] + after[:quarter])
            changed = signatures(pa.array(edited, pa.string()), minhash)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0][1] for p in pairs], pa.int64()), pa.array([len(p[0][2]) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    _bytes(np.array([p[0][3] for p in pairs])), _bytes(changed),
                    pa.array([float(np.mean(p[0][3] == c)) for p, c in zip(pairs, changed, strict=True)]),
                    pa.array([float(np.mean(p[0][3] == p[2])) for p in pairs]),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they are.

    The edited text has its last quarter replaced by the start of the next document's. One row per
    input row. NULL texts count as empty; two texts without words are alike (1), one without is unlike
    any other (0). In a table of one row that row is its own successor. Other columns are not read;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text")).withColumn("row_key", F.xxhash64("text"))
    schema = (
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double"
    )
    return with_successors(rows).mapInArrow(_compare, schema).withColumnRenamed("id", id_col)
