"""Approximate nearest neighbours over learned partitions.

Fitting, on a bounded sample: the graph of its nearest neighbours is cut into parts of equal size by
repeated spectral bisection at the median, with swaps across the cut while they lower it. A small
network with one hidden layer learns in which parts the neighbours of a vector lie. Sample rows that
it was not trained on say how many of the most probable parts have to be searched.

Searching: every vector goes to its most probable part, every query to the most probable ones. A
part is dealt to tasks in blocks of bounded size, each with all queries of the part, and candidates
are reranked by their distance on the original vectors.

Equal vectors are searched once. They are told by 128 bits of hashes; a table of the smallest ids of
each vector, made without moving vectors, turns the vectors found back into rows. So a vector that a
third of all rows share is one candidate and one query, and ties still go to the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthgrid.llm.common import materialize, shuffle_width

NEIGHBOURS = 10
#: Rows that a part should hold, and the most parts.
PART_ROWS, MAX_PARTS = 2048, 1024
#: The sample has so many rows for each part, and never more than MAX_SAMPLE.
SAMPLE_PER_PART, MIN_SAMPLE, MAX_SAMPLE = 64, 4096, 65_536
#: Share of the sample's neighbours that the searched parts have to hold.
TARGET_RECALL = 0.95
HIDDEN, EPOCHS, BATCH = 128, 20, 256
BLOCK_BYTES = 4 << 20
_QUERIES_AT_ONCE = 128
_PAIRS_AT_ONCE = 1 << 16
_SENT_KEYS = 200_000
_SPECTRAL_ROUNDS, _SWAP_ROUNDS = 60, 6


def graph(spark: SparkSession, sample: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """(rows, k) nearest neighbours of each row of the sample within it, made in tasks."""
    n = len(sample)
    sent = spark.sparkContext.broadcast(sample)  # at most MAX_SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(np.float64)
        squares = (own**2).sum(1)
        for batch in batches:
            rows = batch.column("id").to_numpy()
            for at in range(0, len(rows), _QUERIES_AT_ONCE):
                part = rows[at : at + _QUERIES_AT_ONCE]
                near = squares - 2 * own[part] @ own.T
                near[np.arange(len(part)), part] = np.inf
                found = np.argpartition(near, k - 1, axis=1)[:, :k].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "near"])

    rows = spark.range(0, n, 1, min(shuffle_width(spark), -(-n // 512))).mapInArrow(run, "id bigint, near binary").collect()
    out = np.zeros((n, k), np.int32)
    for r in rows:
        out[r["id"]] = np.frombuffer(r["near"], np.int32)
    return out


def _halves(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True for the upper half of the values of each group."""
    order = np.lexsort((value, group))
    sizes = np.bincount(group)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.empty(len(value), np.int64)
    place[order] = np.arange(len(value)) - first[group[order]]
    return place >= (sizes // 2)[group]


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node so that few edges are cut; sizes differ by one at each bisection. ``parts`` is a power of two."""
    n, k = neighbours.shape
    one, two = np.repeat(np.arange(n), k), neighbours.ravel().astype(np.int64)
    a, b = np.concatenate([one, two]), np.concatenate([two, one])
    rng, group = np.random.default_rng(seed), np.zeros(n, np.int64)
    while group.max() + 1 < parts:
        inside = group[a] == group[b]
        a, b = a[inside], b[inside]
        degree = np.bincount(a, minlength=n) + 1e-9
        root = np.sqrt(degree)
        pull, whole = 1 / (root[a] * root[b]), np.bincount(group, weights=degree)
        y = rng.standard_normal(n)
        for _ in range(_SPECTRAL_ROUNDS):
            y -= (np.bincount(group, weights=y * root) / whole)[group] * root
            y = y + np.bincount(a, weights=y[b] * pull, minlength=n)
            y /= np.sqrt(np.bincount(group, weights=y * y) + 1e-300)[group]
        right = _halves(y / root, group)
        for _ in range(_SWAP_ROUNDS):
            same = np.bincount(a, weights=right[a] == right[b], minlength=n)
            gain = degree - 2 * same
            right = _swapped(right, gain, group)
        group = 2 * group + right
    return group


def _swapped(right: np.ndarray, gain: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Swaps half of the pairs across each cut whose joint gain is positive, so that neighbours do not all move at once."""
    out = right.copy()
    order = np.lexsort((-gain, right, group))
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        left_side, right_side = own[~right[own]], own[right[own]]
        n = min(len(left_side), len(right_side))
        good = int(np.sum(gain[left_side[:n]] + gain[right_side[:n]] > 0))
        moved = -(-good // 2)
        out[left_side[:moved]], out[right_side[:moved]] = True, False
    return out


@dataclass(frozen=True)
class Router:
    """Probabilities of the parts of a vector, and how many parts to search."""

    center: np.ndarray
    spread: float
    layers: tuple[np.ndarray, ...]
    probes: int

    @property
    def parts(self) -> int:
        return len(self.layers[-1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Larger for more probable parts."""
        with np.errstate(over="ignore", invalid="ignore"):
            w1, b1, w2, b2 = self.layers
            return np.nan_to_num(np.maximum((x - self.center) / self.spread @ w1 + b1, 0) @ w2 + b2)


def _train(x: np.ndarray, wanted: np.ndarray, seed: int = 3) -> tuple[np.ndarray, ...]:
    """Weights of the network for the wanted distributions over parts, by Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], wanted.shape[1]
    layers = [
        rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in layers]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.003 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            w1, b1, w2, b2 = layers
            hidden = np.maximum(x[own] @ w1 + b1, 0)
            logits = hidden @ w2 + b2
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - wanted[own]) / len(own)
            back = (error @ w2.T) * (hidden > 0)
            step += 1
            for w, g, (m, v) in zip(layers, (x[own].T @ back, back.sum(0), hidden.T @ error, error.sum(0)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def fit(spark: SparkSession, sample: np.ndarray, parts: int, target: float = TARGET_RECALL) -> Router:
    """A router for ``parts`` parts (a power of two) from a sample; with one part, or too small a sample, it sends all to one."""
    d = sample.shape[1]
    if parts < 2 or len(sample) < 4 * max(parts, NEIGHBOURS):
        return Router(np.zeros(d), 1.0, (np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1)
    center = sample.mean(0)
    spread = float(np.sqrt(np.mean((sample - center) ** 2))) or 1.0
    x = (sample - center) / spread
    neighbours = graph(spark, x.astype(np.float32))
    part = balanced_parts(neighbours, parts)
    n, k = neighbours.shape
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.arange(n), part), 1 / (k + 1))
    np.add.at(wanted, (np.repeat(np.arange(n), k), part[neighbours.ravel()]), 1 / (k + 1))
    held = np.arange(n) % 4 == 0
    layers = _train(x[~held], wanted[~held])
    scores = Router(center, spread, layers, 1).scores(sample)
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    reached = np.sort(place[np.repeat(np.flatnonzero(held), k), scores.argmax(1)[neighbours[held].ravel()]])
    probes = int(reached[min(len(reached) - 1, int(np.ceil(target * len(reached))) - 1)]) + 1
    return Router(center, spread, layers, probes)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v and the vector's key (k1, k2) of the rows that take part."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(f"`{vec_col}`") if kind == "array<float>" else F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _send(router: Router, d: int):
    """Vectors with their part; a vector is sent once by a task, and again only with a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "id"))
            order = np.lexsort((ids, k2, k1))
            first = order[np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])]
            keep = []
            for i, a, b, own in zip(first.tolist(), k1[first].tolist(), k2[first].tolist(), ids[first].tolist(), strict=True):
                if sent.get((a, b), own + 1) > own:
                    if len(sent) >= _SENT_KEYS:
                        sent.clear()
                    sent[a, b] = own
                    keep.append(i)
            kept = batch.take(pa.array(keep, pa.int64()))
            part = router.scores(_matrix(kept.column("v"), d).astype(np.float64)).argmax(1) if keep else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[kept.column(c) for c in ("k1", "k2", "id", "v")]], ["part", "k1", "k2", "id", "v"])

    return run


def _ask(router: Router, d: int):
    """Queries with the parts to search, most probable first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.zeros((batch.num_rows, router.probes), np.int32)
            if batch.num_rows:
                parts = np.argsort(-router.scores(_matrix(batch.column("v"), d).astype(np.float64)), axis=1, kind="stable")[:, : router.probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, router.probes, dtype=np.int32)), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *[batch.column(c) for c in ("k1", "k2", "v")]], ["parts", "k1", "k2", "v"])

    return run


class _Block:
    """The distinct vectors of a block with their smallest ids."""

    def __init__(self, batches: list[pa.RecordBatch], d: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        k1, k2, ids = (table.column(c).to_numpy() for c in ("k1", "k2", "id"))
        order = np.lexsort((ids, k2, k1))
        first = order[np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])]
        self.k1, self.k2, self.ids = k1[first], k2[first], ids[first]
        self.vectors = _matrix(table.column("v").combine_chunks(), d)[first].astype(np.float64)
        self.squares = (self.vectors**2).sum(1)

    def nearest(self, queries: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place in the block and distance of the ``n`` nearest of each query, ties to the smaller id."""
        own = (queries**2).sum(1)
        near = own[:, None] + self.squares - 2 * queries @ self.vectors.T
        n = min(n, len(self.ids))
        # Products only choose: what may be among the nearest for all their rounding is measured exactly.
        slack = 1e-9 * (own + self.squares.max())
        limit = np.partition(near, n - 1, axis=1)[:, n - 1] + slack
        row, place = np.nonzero(~(near > limit[:, None]))
        exact = np.empty(len(row))
        for at in range(0, len(row), _PAIRS_AT_ONCE):
            pairs = slice(at, at + _PAIRS_AT_ONCE)
            exact[pairs] = np.sqrt(((self.vectors[place[pairs]] - queries[row[pairs]]) ** 2).sum(1))
        order = np.lexsort((self.ids[place], exact, row))
        row, place, exact = row[order], place[order], exact[order]
        first = np.searchsorted(row, row, side="left")
        kept = np.arange(len(row)) - first < n
        return row[kept], place[kept], exact[kept]


_FOUND = "q1 bigint, q2 bigint, k1 bigint, k2 bigint, least bigint, score double"


def _rerank(d: int, n: int):
    """For partitions sorted by part, block and kind: the candidates of a block are held, its queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(places, axis=0) != 0).any(1)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                here, piece = tuple(places[start, :2].tolist()), batch.slice(start, stop - start)
                if here != at:
                    at, held, block = here, [], None
                if places[start, 2] == 0:
                    held.append(piece)
                    continue
                if block is None and held:
                    block, held = _Block(held, d), []
                for q in range(0, piece.num_rows if block is not None else 0, _QUERIES_AT_ONCE):
                    asked = piece.slice(q, _QUERIES_AT_ONCE)
                    with np.errstate(over="ignore", invalid="ignore"):
                        row, place, score = block.nearest(_matrix(asked.column("v"), d).astype(np.float64), n)
                    q1, q2 = (asked.column(c).to_numpy()[row] for c in ("k1", "k2"))
                    columns = [q1, q2, block.k1[place], block.k2[place], block.ids[place], score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q1", "q2", "k1", "k2", "least", "score"])

    return run


def _parts(n: int, part_rows: int) -> int:
    return 1 << int(np.log2(max(1, min(n // part_rows, MAX_PARTS))))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int = PART_ROWS,
    target: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the ``k`` nearest found of each query.

    ``is_query`` is a condition on ``id``. Every usable row but those with the query's id is a candidate.
    Rows without id, with a NULL, empty or zero vector or one with NULL or non-finite numbers take no part,
    nor do vectors of another length than the most common (the shorter of equally common ones). Rows
    repeated as a whole count once. An id with several vectors asks and is found with each; its own rows
    are left out after the nearest ``k`` + 1 are known, so it may have fewer rows. An empty table gives an
    empty result, fewer rows than ``k`` give all. Other columns are not read. The router is fitted on at
    most MAX_SAMPLE vectors, chosen by their hash; tables of less than two ``part_rows`` are searched whole.
    """
    spark, rows = vectors.sparkSession, usable(vectors, id_col, vec_col)
    by_length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (by_length["d"], by_length["n"]) if by_length else (1, 0)
    rows = rows.where(F.size("v") == d)
    kind = rows.schema["v"].dataType.simpleString()

    # The smallest ids of each vector, without the vectors. One more than asked, since a query leaves itself out.
    smallest = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    members = rows.select("k1", "k2", "id").distinct().withColumn("_n", smallest).where(F.col("_n") <= k + 1)
    members = materialize(members.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids")), "members")

    parts = _parts(n, part_rows)
    wanted = min(MAX_SAMPLE, max(MIN_SAMPLE, SAMPLE_PER_PART * parts)) if parts > 1 else 0
    share = int(min(1.0, 1.25 * wanted / max(n, 1)) * (1 << 20))
    chosen = rows.where(F.pmod("k2", F.lit(1 << 20)) < share).dropDuplicates(["k1", "k2"]).orderBy("k1", "k2").limit(wanted) if wanted else None
    sample = _matrix(chosen.select("v").toArrow().column("v").combine_chunks(), d).astype(np.float64) if wanted else np.zeros((0, d))
    router = fit(spark, sample, parts, target)

    routed = materialize(rows.select("k1", "k2", "id", "v").mapInArrow(_send(router, d), f"part int, k1 bigint, k2 bigint, id bigint, v {kind}"), "routed")
    block_rows, counts = max(1, block_bytes // (4 * d)), [0] * router.parts
    for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect():  # one row for each part
        counts[r["part"]] = r["n"]
    blocks = F.array(*[F.lit(max(1, -(-c // block_rows))) for c in counts])

    asking = rows.where(is_query)
    asked = asking.select("k1", "k2", "v").dropDuplicates(["k1", "k2"]).mapInArrow(_ask(router, d), f"parts array<int>, k1 bigint, k2 bigint, v {kind}")
    asked = asked.select(F.explode("parts").alias("part"), "k1", "k2", "v")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("part")) - 1)).alias("block"), F.lit(1).alias("kind"), "k1", "k2", F.lit(None).cast("bigint").alias("id"), "v")
    candidates = routed.select("part", F.pmod("k1", F.get(blocks, F.col("part"))).cast("int").alias("block"), F.lit(0).alias("kind"), "k1", "k2", "id", "v")
    dealt = candidates.unionByName(asked).repartition(shuffle_width(spark), "part", "block").sortWithinPartitions("part", "block", "kind")
    found = dealt.mapInArrow(_rerank(d, k + 1), _FOUND)

    order = Window.partitionBy("q1", "q2").orderBy("score", "least")
    best = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")
    listed = best.join(members, ["k1", "k2"]).groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("lists"))
    pairs = F.flatten(F.transform("lists", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("id")))))
    listed = materialize(listed.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.slice(F.array_sort(pairs), 1, 2 * k + 2).alias("near")), "nearest")

    own = asking.select("id", "k1", "k2").distinct().join(listed, ["k1", "k2"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_at", "_x")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score")
    )
