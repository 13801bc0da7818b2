"""Nearest neighbours, importance resampling and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from monthgrid.llm import fim, importance, nearest
from monthgrid.llm.queries import QUERIES
from monthgrid.llm.common import scratch_path, ship
from tests.llm.test_operators import ODD, corpus, lowered, table


@pytest.fixture(scope="module")
def rows():
    long = " ".join(random.Random(9).choices(["alpha", "béta", "gamma7", "δ", "漢字"], k=20_000))
    return corpus() + [(700, long), (701, "a <P> b"), (702, "x<S>"), (703, "<M>"), (704, "é" * 70_000), (705, "Q" * 300 + " " + "w" * 300 + " q")] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    path = scratch_path(spark, "docs")
    table(spark, rows).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


# Fill-in-middle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_by_definition(doc_id, text, starts):
    h = digest(f"1:{'' if doc_id is None else doc_id}")
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(starts)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    at = [*starts, len(text)]
    p, m, s = text[: at[low]], text[at[low] : at[high]], text[at[high] :]
    if d % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def unit_starts(text, unit):
    if unit == "char":
        return list(range(len(text)))
    blank = " \t\n\x0b\x0c\r"
    is_start = (lambda i: text[i - 1] == "\n") if unit == "line" else (lambda i: text[i - 1] in blank and text[i] not in blank)
    return [i for i in range(len(text)) if i == 0 or is_start(i)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle(docs, rows, unit):
    found = fim.fill_in_middle(docs, unit=unit)
    want = sorted(str((i, *cut_by_definition(i, t or "", unit_starts(t or "", unit)))) for i, t in rows)
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    back = found.select("doc_id", fim.restored().alias("text")).collect()
    assert sorted(str(tuple(r)) for r in back) == sorted(str((i, t or "")) for i, t in rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_bad_sentinels(spark):
    assert fim.fill_in_middle(table(spark, [])).count() == 0
    for bad in (("<P>", "<S>", "<P>x"), ("", "a", "b"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(table(spark, []), sentinels=bad)
    with pytest.raises(ValueError):
        fim.fill_in_middle(table(spark, []), unit="byte")


@pytest.mark.parametrize("share", [0.0005, 0.02, 0.5, 0.999, 1.0])
def test_boundary_set(share):
    rng = np.random.default_rng(int(share * 10_000))
    mask = rng.random(200_000) < share
    mask[70_000:80_000] = True
    held = fim.BoundarySet(lambda a, b: mask[a:b].copy(), len(mask))
    members = np.flatnonzero(mask)
    assert len(held) == len(members)
    assert np.array_equal(held.select(np.arange(len(members))), members)
    places = rng.integers(0, len(mask) + 1, 5000)
    assert np.array_equal(held.rank(places), np.searchsorted(members, places))


def test_smallest_container_is_chosen():
    rng = np.random.default_rng(1)
    kinds = [type(fim.container(m)) for m in (np.ones(fim.SPAN, bool), rng.random(fim.SPAN) < 0.01, rng.random(fim.SPAN) < 0.5, np.zeros(fim.SPAN, bool))]
    assert kinds[:3] == [fim.RunContainer, fim.ArrayContainer, fim.BitmapContainer]


# Importance resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def resampled(rows, target, percent=25, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for texts, own in ((rows, s), (target, t)):
        for _, text in texts:
            for f in features(text)[1]:
                own[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(own), weight, weight + noise, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return out


TARGET = [(1, "one shared line a second shared line third"), (2, None), (3, ""), (4, "béta gamma7 alpha δ")]


def test_resampling(spark, docs, rows):
    target = spark.createDataFrame(TARGET, "item_id bigint, text string")
    for percent in (25, 100, 0, 60):
        found = importance.resample(docs, target, percent=percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        want = resampled(rows, TARGET, percent)
        # Rows that share id and score may stand in either order.
        assert sorted(str(tuple(r)[:5]) for r in found) == sorted(str(tuple(r)[:5]) for r in want)
        by_rank = lambda rs: [tuple(r)[:5] for r in sorted((r for r in map(tuple, rs) if r[5] is not None), key=lambda r: r[5])]
        assert by_rank(found) == by_rank(want)


def test_resampling_of_nothing(spark, docs):
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(table(spark, []), target).count() == 0
    assert importance.resample(docs, target).where("rank IS NOT NULL").count() > 5


def test_checksums_of_features():
    texts = ["a", "", "Ab cD  9é", "x" * 254 + " " + "y" * 255 + " " + "z" * 256 + " " + "w" * 1000 + " v", "漢字、かな"]
    row, got = importance.Features(pa.array(texts)).checksums()
    for i, t in enumerate(texts):
        assert sorted(got[row == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in features(t)[1])


def test_cutoff_among_ties_and_a_wrong_sketch(spark, monkeypatch):
    # Half of the rows share one score, and the first bracket is far too narrow.
    scored = spark.range(4000).select(
        F.col("id"), F.lit(30).cast("bigint").alias("n_words"), F.lit(59).cast("bigint").alias("n_features"), F.lit(0).cast("bigint").alias("weight"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 97).cast("bigint").alias("score"),
    ).repartition(7)
    monkeypatch.setattr(importance, "SKETCH_ACCURACY", 3)
    order = sorted(((-(5 if i % 2 == 0 else i % 97), i) for i in range(4000)))
    for percent in (1, 25, 48, 75, 99):
        got = importance.draw(scored, percent).where("rank IS NOT NULL").orderBy("rank").collect()
        assert [r["id"] for r in got] == [i for _, i in order[: 40 * percent]]
        assert [r["rank"] for r in got] == list(range(1, 40 * percent + 1))


def test_bracket_holds_the_cutoff_and_few_rows(spark):
    rows = spark.range(50_000).select((F.xxhash64("id") % 1_000_000).alias("score"))
    least, most, over = importance.bracket(rows, 50_000, 12_500)
    scores = sorted((r[0] for r in rows.collect()), reverse=True)
    assert least <= scores[12_499] <= most and over == sum(x > most for x in scores)
    assert sum(least <= x <= most for x in scores) < 500


# Nearest neighbours

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("id", StringType()), StructField("v", StringType()), StructField("k1", StringType()), StructField("part", StringType())])


def vectors(spark, rows, kind=VECTORS):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "i", "v", "k", "p") for i, v in rows], kind)


def brute(rows, k):
    def fits(v):
        return v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    own = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and fits(v)})
    out = []
    for i, v in own:
        if i % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), j) for j, w in own if j != i)[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def test_nearest_is_exact_in_one_part(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 3).tolist()) for i in range(900)]  # many ties and copies
    rows += [(1000 + i, [1, 1, 1]) for i in range(450)] + [(100, rows[100][1])] * 5
    rows += [(None, [1, 2, 3]), (2000, None), (2001, [0, 0, 0]), (2002, [float("nan"), 1, 1]), (2003, [float("inf"), 1, 1]), (2004, [None, 1, 1]), (2005, []), (2100, [1, 2]), (2200, [9, 9, 9])]
    rng.shuffle(rows)
    monkeypatch.setattr(nearest, "_SENT_KEYS", 20)
    for block_bytes in (1 << 20, 12 * 40):
        got = nearest.nearest(vectors(spark, rows).repartition(4), F.col("id") % 100 == 0, block_bytes=block_bytes).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 10)
    doubles = StructType([StructField(f.name, ArrayType(DoubleType()) if f.name == "embedding" else f.dataType) for f in VECTORS])
    got = nearest.nearest(vectors(spark, rows, doubles), F.col("id") % 100 == 0, k=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3)


def test_nearest_of_little(spark):
    query = F.col("id") % 100 == 0
    assert nearest.nearest(vectors(spark, []), query).count() == 0
    assert nearest.nearest(vectors(spark, [(0, [1, 2])]), query).count() == 0
    assert [tuple(r) for r in nearest.nearest(vectors(spark, [(0, [0, 2]), (7, [0, 5])]), query).collect()] == [(0, 1, 7, 3.0)]


def test_recall_over_learned_parts(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 12)) * 4
    points = centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 12))
    rows = list(enumerate(points.tolist()))
    searched = []
    keep = nearest.fit
    try:
        nearest.fit = lambda *a: searched.append(keep(*a)) or searched[-1]
        got = nearest.nearest(vectors(spark, rows).repartition(6), F.col("id") % 100 == 0, part_rows=300).collect()
    finally:
        nearest.fit = keep
    assert searched[0].parts == 16 and searched[0].probes <= 6
    exact = np.float32(points).astype(float)
    hits = 0
    for q in range(0, 6000, 100):
        order = np.argsort(((exact - exact[q]) ** 2).sum(1), kind="stable")
        found = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(found) == 10 and q not in [i for i, _ in found]
        assert all(abs(s - math.dist(exact[i], exact[q])) < 1e-12 for i, s in found) and [s for _, s in found] == sorted(s for _, s in found)
        hits += len({i for i, _ in found} & set(order[1:11].tolist()))
    assert hits / 600 >= 0.9


def test_parts_are_balanced_and_follow_the_graph():
    ring = np.stack([(np.arange(512) + s) % 512 for s in (1, 2, 3, -1, -2, -3)], 1)
    part = nearest.balanced_parts(ring, 8)
    assert set(np.bincount(part).tolist()) == {64}
    assert np.mean(part[ring] != part[:, None]) < 0.12


def test_registered_queries_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(400)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_nearest_neighbours"](spark, str(tmp_path)).collect()
    want = brute([(i, np.float32(v).tolist()) for i, v in rows], 10)
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [w[:3] for w in want]
    assert all(abs(r.score - w[3]) < 1e-12 for r, w in zip(sorted(got), want))
