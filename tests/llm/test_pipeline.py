"""Each stage of the pipeline on its own input, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, __text string"
WORDS = {"en": ["the", "and", "thing", "with", "over", "hand"], "de": ["der", "und", "nicht", "haus", "wald"]}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS["en" if i % 2 else "de"]) + str(rng.randrange(9)) * (rng.random() < 0.3) for _ in range(rng.randint(40, 90))) for i in range(60)]
    near = []
    for t in prose[:6]:
        w = t.split()
        w[0] = "the"
        near.append(" ".join(w))
    return [*prose, *near, prose[0], prose[0], None, "", "漢字" * 300]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, len(t or ""), "x", "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, " ".join(texts[9].split()[:20])), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_id_drops_what_has_no_language(spark, docs, folder, texts):
    out = pipeline.language_id(spark, docs.where("doc_id < 70"), folder)
    assert out.columns == docs.columns
    assert set(ids(out)) == {i for i, t in enumerate(texts[:70]) if t}


def test_near_duplicates_keep_the_first_of_each_group(spark, docs, folder, texts):
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    out = pipeline.near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == Counter({r: 1 for r in root})
    again = ids(pipeline.near_duplicates(spark, docs.where("doc_id in (0, 66)").unionByName(docs.where("doc_id = 0")), folder))
    assert again == Counter({0: 2})


def test_decontamination_drops_hit_documents(spark, docs, folder, texts):
    item = texts[9].split()[:20]
    windows = {tuple(item[k : k + 10]) for k in range(11)}
    hit = {i for i, t in enumerate(texts) if any(tuple((t or "").split()[k : k + 10]) in windows for k in range(len((t or "").split())))}
    out = pipeline.decontamination(spark, docs, folder)
    assert out.columns == docs.columns and set(ids(out)) == set(range(len(texts))) - hit and 9 in hit


def test_mixing_then_sharding(spark, docs, folder, texts):
    mixed = pipeline.mixing(spark, docs, folder)
    assert mixed.columns == docs.columns and max(ids(mixed).values()) <= 2
    size, taken = Counter(), Counter()
    for i, t in enumerate(texts):
        size[i % 3 if i % 5 else None] += len((t or "").split())
    for i, n in ids(mixed).items():
        taken[i % 3 if i % 5 else None] += n * len((texts[i] or "").split())
    weights = {0: 3, 1: 1, 2: 2, None: 3}
    goal, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        rest = {s: (left - sum(2 * size[f] for f in full)) * w / sum(v for k, v in weights.items() if k not in full) for s, w in weights.items() if s not in full}
        more = {s for s, g in rest.items() if g > 2 * size[s]}
        if not more:
            goal = {s: 2.0 * size[s] for s in full} | rest
            break
        full |= more
    assert all(abs(taken[s] - goal[s]) <= 90 for s in goal), (taken, goal)
    out = pipeline.sharding(spark, mixed, folder)
    rows = out.collect()
    assert len(rows) == sum(ids(mixed).values()) and set(docs.columns) | {"slot"} == set(out.columns)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_stages_of_an_empty_table(spark, docs, folder):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_pass_columns_of_any_name_through(spark, texts, folder):
    """Columns called like the operators' own come out as they went in, at each stage."""
    names = ["__copy_id", "__hit_id", "__at", "__all", "__size", "__src", "__key", "__u", "__block", "__shards", "__rank", "__shard", "__others", "__rejected", "id", "th", "a.b", "row"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        found = out.collect()
        assert found and [c for c in out.columns if c not in ("shard", "slot")] == docs.columns, name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names), name
