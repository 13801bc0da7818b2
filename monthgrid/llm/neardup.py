"""Near duplicates by b-bit MinHash.

Documents with equal shingle sets form a class, and classes are compared:

1. One pass over the texts makes 256 minima per set. Each band of five full minima becomes a bucket;
   of the minima themselves only the low two bits are kept, packed into eight longs.
2. In each bucket all members are paired with its smallest member only. Pairs whose similarity, as
   estimated from the equal low bits and corrected for chance collisions, is within six standard
   errors of the threshold are confirmed on the full shingle sets. Components of the confirmed
   links usually hold whole groups of copies by now.
3. Members of buckets that still span several components chain up, by likely pairs, to families. A
   family is compared across its components in blocks of bounded size, each pair of blocks in a
   task of its own; what comes out are links that join components, never all pairs of a group.

At the threshold a link is missed by all bands with a probability of one in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import materialize, shuffle_width, text_or_empty
from monthgrid.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, ROWS, HASHES, BITS = 51, 5, 256, 2
#: Classes of a family that one task holds against as many others.
BLOCK_MEMBERS = 512
_LOW = 0x5555555555555555


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low ``BITS`` of the mixed minima, 32 to an int64."""
    place = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
    low = wh.mix(minima.astype(np.uint64) | place) & np.uint64(3)
    shift = (np.arange(HASHES, dtype=np.uint64) % np.uint64(32)) * np.uint64(2)
    return (low << shift).reshape(len(minima), -1, 32).sum(2, dtype=np.uint64).view(np.int64)


def _bands(minima: np.ndarray) -> np.ndarray:
    out = np.zeros((len(minima), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(minima), band + 1, np.uint64)
        for r in range(ROWS):
            h = wh.mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, band * ROWS + r].astype(np.uint64))
        out[:, band] = h
    return out.view(np.int64)


def _fixed_lists(rows: list[np.ndarray | None], width: int) -> pa.Array:
    present = [r for r in rows if r is not None]
    values = pa.array(np.concatenate(present) if present else np.zeros(0, np.int64), pa.int64())
    ends = np.cumsum([0 if r is None else width for r in rows])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
    keep = pa.array([r is not None for r in rows])
    return pa.compute.if_else(keep, lists, pa.scalar(None, lists.type)) if rows else lists


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = wh.MinHash(HASHES)
    for batch in batches:
        known: set[bytes] = set()
        for part in wh.slices(batch, "text"):
            sets = wh.Words(*wh.text_buffer(part.column("text")), lower=True).shingles(SHINGLE_WORDS)
            keys = [
                np.array([wh.mix(s).sum(dtype=np.uint64), wh.mix(s ^ wh.U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()
                for s in sets
            ]
            # A class is sketched once per batch, however many copies the batch holds.
            fresh = [i for i, k in enumerate(keys) if len(sets[i]) and not (k in known or known.add(k))]
            minima = minhash.minima([sets[i] for i in fresh])
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            for i, b, s in zip(fresh, _bands(minima), _pack(minima), strict=True):
                bands[i], bits[i] = b, s
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("row_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 _fixed_lists(bands, BANDS), _fixed_lists(bits, HASHES * BITS // 64)],
                ["id", "row_key", "n_shingles", "key", "bands", "bits"],
            )


def _most_unequal() -> int:
    """Unequal low bits up to which the estimate (E - 1/4) / (3/4), E the share of equal ones, is within six standard errors."""
    limit = PERCENT / 100
    equal = 0.25 + 0.75 * limit
    error = (equal * (1 - equal) / HASHES) ** 0.5 / 0.75
    return int(HASHES * (1 - (0.25 + 0.75 * (limit - 6 * error))))


def _likely(a: str, b: str) -> Column:
    unequal = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    return unequal <= _most_unequal()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold. Rows come sorted by v, whose set is made once per run."""
    for batch in batches:
        for part in wh.slices(batch, "text_u"):
            us, vs = part.column("u").to_numpy(), part.column("v").to_numpy()
            sets = wh.Words(*wh.text_buffer(part.column("text_u")), lower=True).shingles(SHINGLE_WORDS)
            keep, last, other = [], None, None
            for i, v in enumerate(vs):
                if v != last:
                    last, other = v, wh.Words(*wh.text_buffer(part.column("text_v").slice(i, 1)), lower=True).shingles(SHINGLE_WORDS)[0]
                both = len(np.intersect1d(sets[i], other, assume_unique=True))
                if 100 * both >= PERCENT * (len(sets[i]) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(us[keep], pa.int64()), pa.array(vs[keep], pa.int64())], ["u", "v"])


def _texts(classes: DataFrame, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """cid and one text of each class in ``wanted``, written once."""
    needed = classes.join(wanted, "cid").select("cid", F.col("rep.id").alias("rid"), F.col("rep.row_key").alias("rkey"))
    found = rows.join(needed, rows["id"].eqNullSafe(needed["rid"]) & (rows["row_key"] == needed["rkey"]))
    return materialize(found.select("cid", "text"), "texts")


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (u, v of classes) that the full sets of one text of each class confirm."""
    wanted = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).distinct()
    held = _texts(classes, wanted, rows)
    full = pairs.join(held.select(F.col("cid").alias("u"), F.col("text").alias("text_u")), "u").join(
        held.select(F.col("cid").alias("v"), F.col("text").alias("text_v")), "v"
    )
    return materialize(full.select("u", "v", "text_u", "text_v").mapInArrow(_confirm, "u bigint, v bigint").distinct(), "links")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        at = 0
        for i, value in enumerate(values):
            if value != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, value
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _bit_matrix(col: pa.ChunkedArray) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(col), -1)


def _unequal(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Hashes whose low bits differ."""
    x = one ^ many
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_LOW)).sum(1)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree of likely pairs over each family of a bucket: what chains of likely pairs connect."""
    most = _most_unequal()
    for group in _by_key(batches, ["bucket"]):
        cids, bits = group.column("cid").to_numpy(), _bit_matrix(group.column("bits"))
        rest = np.arange(len(cids))
        us: list[int] = []
        vs: list[int] = []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                near = _unequal(bits[i], bits[rest]) <= most
                queue += rest[near].tolist()
                us += cids[rest[near]].tolist()
                vs += [int(cids[i])] * int(near.sum())
                rest = rest[~near]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of a pair (or inside one block) that join different components."""
    most = _most_unequal()
    for group in _by_key(batches, ["family", "block_u", "block_v"]):
        cids, side = group.column("cid").to_numpy(), group.column("side").to_numpy()
        bits, components_of = _bit_matrix(group.column("bits")), group.column("component").to_pylist()
        sets: list[np.ndarray] = []
        for batch in group.select(["text"]).to_batches():
            for part in wh.slices(batch, "text"):
                sets += wh.Words(*wh.text_buffer(part.column("text")), lower=True).shingles(SHINGLE_WORDS)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        us, vs = [], []
        second = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(cids))
        inside = not (side == 1).any()
        for i in np.flatnonzero(side == 0).tolist():
            others = second[second > i] if inside else second
            for j in others[_unequal(bits[i], bits[others]) <= most].tolist():
                a, b = root(components_of[i]), root(components_of[j])
                if a == b:
                    continue
                x, y = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    us.append(int(cids[i]))
                    vs.append(int(cids[j]))
                    parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _links_across(loose: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Confirmed links between components, from ``loose``: members of buckets that span several.

    Likely pairs of a bucket chain up to families. A family with several components is cut into blocks in
    the order of components; every pair of blocks that holds more than one component is compared in a task
    of its own, where only a pair that would join two components is confirmed and returned.
    """
    width = shuffle_width(loose.sparkSession)
    dealt = loose.select("bucket", "cid", "bits").repartition(width, "bucket").sortWithinPartitions("bucket")
    chains = components(dealt.mapInArrow(_families, "u bigint, v bigint")).toDF("cid", "family")
    members = loose.select("cid", "component", "bits").dropDuplicates(["cid"]).join(chains, "cid")
    mixed = members.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
    order = Window.partitionBy("family").orderBy("component", "cid")
    placed = members.join(mixed, "family").withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK_MEMBERS))
    placed = materialize(placed, "families")
    blocks = placed.groupBy("family", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    u, v = (blocks.select("family", F.col("block").alias(f"block_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "uv")
    pairs = u.join(v, "family").where("block_u <= block_v AND (lo_u <> hi_v OR lo_v <> hi_u OR lo_u <> hi_u OR lo_v <> hi_v)")
    pairs = pairs.select("family", "block_u", "block_v")
    held = placed.join(_texts(classes, placed.select("cid"), rows).dropDuplicates(["cid"]), "cid")
    first = pairs.join(held.withColumnRenamed("block", "block_u"), ["family", "block_u"]).withColumn("side", F.lit(0))
    second = pairs.where("block_u < block_v").join(held.withColumnRenamed("block", "block_v"), ["family", "block_v"]).withColumn("side", F.lit(1))
    both = first.unionByName(second).select("family", "block_u", "block_v", "side", "cid", "component", "bits", "text")
    keys = ["family", "block_u", "block_v"]
    dealt = both.repartition(width, *keys).sortWithinPartitions(*keys, "side", "cid")
    return materialize(dealt.mapInArrow(_compare_blocks, "u bigint, v bigint").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row_key, n_shingles, component_id, kept and component for each input row.

    Links join rows whose sets of distinct five-word shingles (A-Z in lower case; a shorter text is one
    shingle) have a Jaccard similarity of 0.75 or more. ``component_id`` is the smallest id that links
    reach, ``kept`` whether it is the row's own, ``component`` a number of the group. NULL, empty and
    blank texts have no shingles and stay alone, with no ``component``. Repeated rows are copies of each
    other and share their flags. A NULL id is never smallest; where a group has no other, component_id
    and kept are NULL. Other columns are not read; empty tables give empty results.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("row_key", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row_key bigint, n_shingles bigint, key binary, bands array<bigint>, bits array<bigint>"
    sketched = materialize(rows.mapInArrow(_sketch, schema), "sketches")
    classes = (
        sketched.where("n_shingles > 0").groupBy("key")
        .agg(F.min("id").alias("least_id"), F.min(F.struct("id", "row_key")).alias("rep"),
             F.first("bands", ignorenulls=True).alias("bands"), F.first("bits", ignorenulls=True).alias("bits"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialize(classes, "classes")  # fixes the numbers
    bits = classes.select("cid", "bits")

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(bits.toDF("u", "bits_u"), "u").join(bits.toDF("v", "bits_v"), "v")
        return pairs.where(_likely("bits_u", "bits_v")).select("u", "v")

    entries = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first <> last")
    members = materialize(entries.join(shared, "bucket").select("bucket", "cid", "first"), "buckets")
    star = materialize(likely(members.where("cid <> first").select(F.col("cid").alias("u"), F.col("first").alias("v")).distinct()), "star")
    links = _confirmed(star, classes, rows)
    found = materialize(components(links), "groups")

    labelled = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bucket", "cid", F.coalesce("component", "cid").alias("component")
    )
    spread = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    loose = materialize(labelled.join(spread, "bucket").join(bits, "cid"), "loose")
    links = links.unionByName(_links_across(loose, classes, rows))
    groups = components(links)

    named = classes.select("key", "cid", "least_id").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "cid")), "classes")
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = named.join(smallest, "component").select("key", "component", "component_id")
    out = sketched.select("id", "row_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(final, "key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), "row_key", "n_shingles", own.alias("component_id"), (F.col("id") == own).alias("kept"), "component"
    )
