"""The stages of the pipeline against brute force, each on its own input."""

import hashlib
import math

import corpus_pipeline as cp
import public_tokenizers
import pytest

from monthgrid.llm import language
from monthgrid.llm.common import scratch_path
from tests.llm.test_operators import ODD, SCHEMA, corpus, lines_left, lowered, reference_tokenizer, shingles, table, words


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as the driver would write them."""
    rows = corpus() + ODD
    base = scratch_path(spark, "tables")
    taught = [r.asDict() for r in table(spark, rows).collect()]
    for r in taught:
        r["lang"] = "aa" if r["text"] and any(c in r["text"] for c in "abcde") else None
    spark.createDataFrame(taught, SCHEMA).repartition(4).write.parquet(f"{base}/documents.parquet")
    item = " ".join(words(dict(rows)[0])[5:25])
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    docs, found = spark.read.parquet(f"{base}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = scratch_path(spark, "stage")
        stage(spark, docs, base).write.parquet(out)
        found[name] = (docs.collect(), spark.read.parquet(out).collect())
        docs = spark.read.parquet(out)
    return base, item, found


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "byte-level BPE"]
    for name, (_, after) in list(stages[2].items())[:-1]:
        assert after and list(after[0].asDict()) == SCHEMA.names, name


ALIEN = [
    "Привет, как дела сегодня, друзья мои хорошие, приходите к нам вечером на чай с пирогами и вареньем из смородины",
    "我喜欢吃苹果和香蕉今天天气很好我们去公园散步然后回家做饭看书明天还要去学校上课下午打球晚上写作业",
    "xqzj kvbw wqxz jjkq zzxv bqwk vvxj qqzw xkjq vbzw kqxj zzvw qjxk wvbz jqkx vzwb xqjk bvwz kjxq zvbw qkjx wbzv",
    "Сьогодні гарна погода, і ми підемо гуляти до лісу разом із друзями та нашим старим собакою на цілий день",
]


def test_language_stage_rejects_what_was_not_learned(spark, stages):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    short = [" ".join(r.text.split()[:3]) for r in known[:60]]
    fields = [(100_000 + i, t) for i, t in enumerate(ALIEN + ["", None, "12 -- 7"])] + [(200_000 + i, t) for i, t in enumerate(short)]
    rows = [tuple(r) for r in known] + [(i, t, None, "web", len(t or "")) for i, t in fields]
    docs = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    kept = cp.language_id(spark, docs.repartition(4), stages[0]).collect()
    clean = {r.doc_id for r in known if any(c.isalpha() for c in r.text or "")} | {200_000 + i for i, t in enumerate(short) if any(c.isalpha() for c in t)}
    assert {r.doc_id for r in kept} == clean
    by_id = {r[0]: r for r in rows}
    assert all(tuple(r) == by_id[r.doc_id] for r in kept)


def test_language_stage_by_definition(spark, stages):
    before, after = stages[2]["language ID"]
    docs = table(spark, []).unionByName(spark.createDataFrame(before, SCHEMA))
    found = language.identify(docs, language.learn(docs), ["doc_id", "text", "lang"]).collect()
    letters = [r for r in found if any(c.isalpha() for c in r.text or "")]
    assert all(r.n_letters == sum(c.isalpha() for c in r.text) for r in letters)
    low = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    taught = [r for r in letters if r.lang is not None and r.score > 0]
    fade = max(0.0, low([r.n_letters * (1 / r.score**2 - 1) for r in taught], 0.5))
    least = 0.4 * low([r.score / math.sqrt(r.n_letters / (r.n_letters + fade)) for r in taught], 0.01)
    want = sorted((str(r.doc_id), r.text) for r in letters if r.score >= min(3 / 32, least * math.sqrt(r.n_letters / (r.n_letters + fade))))
    assert least > 0 and len(want) < len(before) and sorted((str(r.doc_id), r.text) for r in after) == want


def test_line_stage(stages):
    before, after = stages[2]["line dedup"]
    left = lines_left({r.doc_id: r.text for r in before if r.doc_id not in (None, 903)})
    kept = [(i, text) for i, (n, gone, text) in left.items() for r in before if r.doc_id == i and (not gone or gone < n)]
    assert sorted(kept) == sorted((r.doc_id, r.text) for r in after if r.doc_id not in (None, 903))
    changed = {r.doc_id: r for r in after} and [r for r in after if (r.doc_id, r.text) not in {(b.doc_id, b.text) for b in before}]
    assert changed and all(r.n_chars == len(r.text) for r in changed)


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    before, after = stages[2]["near dedup"]
    sets = [shingles(r.text) for r in before]
    group = list(range(len(before)))
    for _ in before:
        for a in range(len(before)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    members = {}
    for r, g in zip(before, group):
        members.setdefault(g, []).append(r)
    assert len(after) == len(members)
    for rows in members.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert sum(r in rows for r in after) == 1 or len(rows) == 1
        if ids:
            assert any(r.doc_id == min(ids) and r in rows for r in after)


def test_decontamination_stage(stages):
    _, item, found = stages
    before, after = found["decontamination"]
    item = words(lowered(item))
    windows = [item[i : i + 10] for i in range(len(item) - 9)]
    hit = [r for r in before if any(w[i : i + 10] in windows for w in [words(lowered(r.text))] for i in range(len(w)))]
    assert hit and sorted(map(str, after)) == sorted(str(r) for r in before if r not in hit)


def test_bpe_stage(stages):
    before, after = stages[2]["byte-level BPE"]
    known = reference_tokenizer()
    want = sorted(
        (str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        for r in before for ids in [known.encode_ordinary(r.text)]
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want
    assert public_tokenizers.PATTERN


def test_run_gives_the_last_stage(spark, stages):
    base, _, found = stages
    assert sorted(map(str, cp.run(spark, base).collect())) == sorted(map(str, found["byte-level BPE"][1]))


def test_empty_table_passes_through(spark, stages):
    docs = table(spark, [])
    for _, stage in cp.STAGES:
        out = scratch_path(spark, "empty")
        stage(spark, docs, stages[0]).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.count() == 0
