"""Operators against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from synthspark.llm import chat_formatting, common, decontamination, jaccard_join, language_id, line_dedup, mixing, personal_data, quality_rules, repeated_bytes, sharding
from synthspark.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("kind", T.StringType())])
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    rows = [(i, t, None if i % 7 == 3 else "en", (sources or {}).get(i, f"s{i % 3}" if i % 5 else None), None if t is None else len(t), "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["École", "über", "NIÑO", "Straße"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [make(rng.randint(1, 120)) for _ in range(25)]
    passage = make(70)
    near = []
    for t in base[:8]:
        w = t.split()
        for _ in range(max(1, len(w) // 30)):
            w[rng.randrange(len(w))] = "edit"
        near.append(" ".join(w))
    long = " ".join(make(40) for _ in range(60)) + "\n" + passage
    lines = "\n".join([passage[:60], "", "  ", passage[60:120], passage[120:160], "own line"])
    out = [*base, None, "", "   ", "!!! ??", *near, base[0], base[0], base[3], long, f"x {passage} y", passage + "\n" + passage, lines, "pre\n" + lines + "\npost", "a b a b a b a b a b", "To to TO tO", "é" * 60, "é" * 61, "abc" * 40]
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_jaccard_components_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "COMMON_LEAST", 3)
    sets = []
    for t in texts:
        w = SPACES.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.op3_jaccard_join(frame(spark, texts)))}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    kept = jaccard_join.first_of_each(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert kept.columns == SCHEMA.names


def linked_least(family):
    """The least index that each text reaches by links, by brute force."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in family]
    label, change = list(range(len(sets))), True
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 75 * len(a | b)]
    while change:
        change = False
        for i, j in links:
            low = min(label[i], label[j])
            change |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return dict(enumerate(label))


def test_jaccard_rows_of_one_id(spark):
    """Rows of one id and other texts, null ids: each text has its own links."""
    base = " ".join(f"t{i}" for i in range(60))
    near, other = base + " more", " ".join(f"o{i}" for i in range(50))
    docs = spark.createDataFrame([(1, base), (2, near), (2, other), (2, other), (3, other + " end"), (None, base), (None, "alone")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows(jaccard_join.op3_jaccard_join(docs)))
    assert got == sorted([("1", 56, "1"), ("2", 57, "1"), ("2", 46, "2"), ("2", 46, "2"), ("3", 47, "2"), ("None", 56, "1"), ("None", 1, "None")])
    kept = sorted((str(r["doc_id"]), r["text"]) for r in rows(jaccard_join.first_of_each(docs)))
    assert kept == sorted([("1", base), ("2", other), ("2", other), ("None", base), ("None", "alone")])


def test_shingles_of_all_words_at_once(monkeypatch):
    """Short words are hashed together, long ones alone; equal sets of shingles and no others have equal hashes."""
    called = []
    digest = jaccard_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard_join.xxhash, "xxh3_64_intdigest", lambda w: called.append(w) or digest(w))
    rng = random.Random(5)
    parts = ["a", "B", "\u00e9", " ", "  ", "\t", "\n", "\x0b", "\r", "\x1c", "\u00a0", "\x00", "w" * 8, "v" * 9, "u" * 17, "\u65e5"]
    texts = [None, "", " \n", "One two", "ONE  two\t", "x" * 200 + " Y", *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400))]
    wanted = []
    for t in texts:
        w = SPACES.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        wanted.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for found in (jaccard_join.shingle_sets(pa.array(texts)), jaccard_join.shingle_sets(pa.array(["before it", *texts, "after"], pa.large_string()).slice(1, len(texts)))):
        assert [len(s) for s in found] == [len(s) for s in wanted]
        assert all((np.diff(s.view(np.uint64)) > 0).all() for s in found)
        assert len({s.tobytes() for s in found}) == len({frozenset(s) for s in wanted}) == len({(a.tobytes(), frozenset(b)) for a, b in zip(found, wanted, strict=True)})
        assert len(set(np.concatenate(found).tolist())) == len(set().union(*wanted))
    called.clear()
    (one,) = jaccard_join.shingle_sets(pa.array([" ".join(f"word{i}" for i in range(5000)) + " " + "z" * 65]))
    assert len(one) == 4997 and called == [b"z" * 65]


def test_texts_are_not_shuffled_for_few_copies(spark):
    docs = frame(spark, [f"one two three four five {i % 6}" for i in range(12)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = jaccard_join.first_of_each(docs)
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(6))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("small", [2, 3, 256])
def test_jaccard_families_without_a_centre(spark, monkeypatch, small):
    """Trees of edited copies, cut texts and a chain: not all members link to the first pivot."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = random.Random(7)
    words = [f"t{i}" for i in range(104)]
    family = [" ".join(words)] + [" ".join(w if j % 97 != i else f"e{i}" for j, w in enumerate(words)) for i in range(20)] + [" ".join(words[:i] + words[i + 3 * i % 7 :]) for i in range(0, 60, 4)]
    family += [" ".join(words[: 104 - 6 * i]) for i in range(14)]
    for _ in range(40):
        copy = rng.choice(family).split()
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(12)}"
        family.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.op3_jaccard_join(frame(spark, family)))}
    assert got == linked_least(family)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert components(links.limit(0)).count() == 0


def words5(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_decontamination(spark, texts, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast_rows)
    items = [(1, " ".join(texts[5].split()[:15])), (2, texts[33]), (3, "w1 w2"), (4, "École, über"), (5, None), (6, "..."), (7, "to TO"), (8, " ".join(texts[7].split()[:7])), (9, texts[39][:200])]
    got = {r["doc_id"]: r for r in rows(decontamination.op5_decontamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")))}
    for i, t in enumerate(texts):
        w, hit, own = words5(t), set(), set()
        for k, x in items:
            b = words5(x)
            n = min(10, len(b))
            windows = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    own.add(str(k))
        assert got[i] == {"doc_id": i, "n_words": len(w), "n_hit": len(hit), "n_items": len(own), "items_sha256": hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), "contaminated": bool(hit)}


def test_repeated_bytes(spark, texts, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "_PIECE", 700)
    monkeypatch.setattr(common, "SLICE_BYTES", 3000)
    got = {r["doc_id"]: r for r in rows(repeated_bytes.op9_repeated_bytes(frame(spark, texts)))}
    seen: set[bytes] = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[j : j + 50] for j in range(len(b) - 49)]
        for j, w in enumerate(own):
            if w in seen:
                gone[j : j + 50] = True
        seen |= set(own)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert got[i] == {"doc_id": i, "n_bytes": len(b), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def test_anchor_pieces_cover_each_window_once(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    offsets = np.array([0, 10, 2500, 2500, 5000])
    monkeypatch.setattr(repeated_bytes, "_PIECE", 300)
    t = repeated_bytes.anchor_tuples(data, offsets)
    covered = Counter((int(d), int(f) + k) for d, f, n in zip(t["doc"], t["first"], t["n"], strict=True) for k in range(int(n)))
    assert set(covered.values()) == {1}
    assert set(covered) == {(d, s) for d, n in ((1, 2490), (3, 2500)) for s in range(n - 49)}


def test_quality_base_counts_and_trusted_kept(spark, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 25)] + [(39, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality_rules.op2_quality_rules(frame(spark, texts), labels))}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = SPACES.findall(t or "")
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        twice = Counter(three)
        repeat = {j + k for j, x in enumerate(three) if twice[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if SPACES.search(x)]
        want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat), "base_failed": len(w) < 50 or 100 * len(repeat) > 50 * len(w)}
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert all(got[i]["kept"] for i in range(25) if not got[i]["base_failed"])


def hash_of(x, seed=42):
    """The 64-bit hash of a text, a long or an int (4 bytes where ``x`` is a pair with the width), signed."""
    data = x.encode() if isinstance(x, str) else x[0].to_bytes(x[1], "little", signed=True) if isinstance(x, tuple) else x.to_bytes(8, "little", signed=True)
    h = xxhash.xxh64(data, seed=seed % 2**64).intdigest()
    return h - 2**64 if h >= 2**63 else h


def test_quality_equals_brute_force(spark, monkeypatch):
    """Counts of both multinomials, ratio, threshold and verdict in plain Python."""
    monkeypatch.setattr(quality_rules, "REFUSED", 0.1)
    monkeypatch.setattr(quality_rules, "MARGIN", 0.0)
    rng = random.Random(8)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = {i: " ".join(rng.choice(good if rng.random() < (0.8 if i % 3 else 0.4) else bad) for _ in range(rng.choice([5, 60, 120]))) for i in range(120)}
    texts |= {120: None, 121: "", 122: " \n\t ", 123: "x " * 80}
    trusted = {i for i in texts if i % 3 == 1}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(2, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    held = {i for i in trusted if hash_of(i, hash_of((1, 4))) % quality_rules.CALIBRATE == 0}
    assert held and held < trusted

    def grams(i):
        h = [hash_of(w) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        return len(h), [x % quality_rules.BUCKETS for x in h + [hash_of(b, hash_of(a)) for a, b in zip(h, h[1:])]]

    raw, target = Counter(), Counter()
    for i in texts:
        raw.update(grams(i)[1])
        if i in trusted - held:
            target.update(grams(i)[1])
    n_raw, n_target = (sum(c.values()) + quality_rules.BUCKETS for c in (raw, target))

    def score(i):
        n, own = grams(i)
        logs = []
        for b in own:
            q = (raw[b] + 1) / n_raw
            logs.append(float(f"{math.log((target[b] + quality_rules.BUCKETS * q) / n_target / q):.5f}"))
        return sum(logs) / (2 * n - 1) if n else 0.0

    at = np.quantile([score(i) for i in held if grams(i)[0] >= 50], 0.1)
    got = {r["doc_id"]: r for r in rows(quality_rules.op2_quality_rules(frame(spark, [texts[i] for i in range(len(texts))]), labels))}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r["score"] == pytest.approx(score(i), abs=1e-12)
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert abs(score(i) - at) < 1e-9 or r["kept"] == (not r["base_failed"] and score(i) >= at)
    assert len({r["kept"] for r in got.values() if not r["base_failed"]}) == 2


def test_quality_without_labels(spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in rows(quality_rules.op2_quality_rules(frame(spark, texts), none)))


def test_mixing(spark):
    rng = random.Random(2)
    many = [" ".join("w" for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None]
    sources = {i: [None, "a", "Z", "é"][min(3, rng.randrange(6))] for i in range(401)}
    got = rows(mixing.op6_mixing(frame(spark, many, sources)))
    again = rows(mixing.op6_mixing(frame(spark, many, sources).repartition(7)))
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(again, key=key)
    sizes = Counter()
    for i, t in enumerate(many):
        sizes[sources[i]] += len((t or "").split())
    goal = mixing.targets(dict(sizes))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len((many[r["doc_id"]] or "").split()) and r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_target_beside_one_long_text(spark, seed):
    """Blocks and documents that fit are taken wherever the one long text stands."""
    docs = frame(spark, ["w " * 100] * 299 + ["w " * 30_000], dict.fromkeys(range(300), "a")).selectExpr(f"doc_id + {seed * 1000} as doc_id", "text", "source")
    out = rows(mixing.op6_mixing(docs))
    assert out[0]["target"] == 1.5 * 59_900
    taken = sum(r["taken"] for r in out)
    assert out[0]["target"] - 100 < taken <= out[0]["target"]
    drawn = mixing.draw_mix(docs, mixing.plan_mix(docs)).collect()
    assert sum(len(r.text.split()) for r in drawn) == taken


def test_targets_reshare():
    # Weights 3, 1, 2 of 1,665 words: a (832.5) stops at 20, null (555) at 200, and b takes the rest.
    assert mixing.targets({"a": 10, "b": 1000, None: 100}) == pytest.approx({"a": 20, "b": 1445, None: 200})
    assert mixing.targets({}) == {}


def test_split_tree_keeps_quotas():
    tree = mixing.split_tree(np.array([100, 3, 0, 57]), 6, 9)
    assert tree.sum(axis=0).tolist() == [100, 3, 0, 57]
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3


def test_draw_mix_repeats_documents(spark):
    docs = frame(spark, ["one two three"] * 3 + ["x"] * 5 + [None])
    plan = mixing.plan_mix(docs)
    drawn = mixing.draw_mix(docs, plan)
    assert drawn.columns[: len(SCHEMA.names)] == SCHEMA.names
    total = {r["doc_id"]: r["taken"] for r in rows(mixing.op6_mixing(docs))}
    words = Counter()
    for r in drawn.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert all(words[i] == n for i, n in total.items())


def minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_sharding_is_minimax(spark, texts):
    docs = frame(spark, texts)
    got = rows(sharding.op7_sharding(docs))
    by = {}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "bytes"
        assert by.setdefault(t, r["shard"]) == r["shard"]
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    keys = {r["t"]: r["k"] for r in rows(docs.selectExpr("text as t", "xxhash64(text) as k"))}
    size = Counter()
    for t in texts:
        size[t] += len((t or "").encode()) + 1
    ordered = [size[t] for t in sorted(size, key=lambda t: keys[t])]
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == minimax(ordered, 8)


def runs_deleted(texts):
    """Line numbers that go, by brute force: lines of runs of three that an earlier place has."""
    seen, out = set(), []
    for t in texts:
        own = [(k, x) for k, x in enumerate((t or "").split("\n")) if SPACES.search(x)]
        gone = set()
        for j in range(len(own) - 2):
            run = tuple(x for _, x in own[j : j + 3])
            if run in seen:
                gone |= {k for k, _ in own[j : j + 3]}
            seen.add(run)
        out.append(sorted(gone))
    return out


def test_line_dedup_deletes_later_runs(spark, texts):
    rng = random.Random(11)
    lines = [f"line {i}" for i in range(14)] + ["", "  "]
    more = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    runs = ["x1\nA\nB\nx2", "x3\nZ\nA\nB\nC\nx4", "x5\nZ\nA\nB\nC\nx6", "two\nlines", "more\ntwo\nlines\nonly", "\nP\nQ\nR", "\nP\nQ\nR", "same\nsame\nsame\nsame\nsame"]
    own = [*texts, *more, *runs]
    want = runs_deleted(own)
    out = {r["doc_id"]: r for r in rows(line_dedup.without_repeated_lines(frame(spark, own)))}
    digest = {r["doc_id"]: r for r in rows(line_dedup.op4_line_dedup(frame(spark, own)))}
    assert len(out) == len(digest) == len(own)
    for i, t in enumerate(own):
        cut = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(cut) if k not in want[i])
        assert sorted(out[i]["__removed"]) == want[i], t
        assert out[i]["text"] == (None if t is None else kept)
        assert digest[i] == {"doc_id": i, "n_lines": len(cut), "n_removed": len(want[i]), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()}
    first = len(texts) + len(more)
    assert out[first + 2]["text"] == "x5\nx6" and out[first + 4]["text"] == runs[4]


def test_rows_of_one_id_stand_for_themselves(spark):
    """Null and repeated ids: results follow the text, not the id."""
    a, b = "u1\nu2\nu3\nmail x@y.de", "own\nu1\nu2\nu3\n" + " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, b)], "doc_id long, text string")
    cut = sorted((str(r["doc_id"]), r["text"]) for r in rows(line_dedup.without_repeated_lines(docs)))
    left = "own\n" + b.rsplit("\n", 1)[1]
    assert cut == sorted([("1", a), ("2", ""), ("2", left), ("2", left), ("None", b)])
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    hit = sorted((str(r["doc_id"]), r["n_hit"]) for r in rows(decontamination.op5_decontamination(docs, items)))
    assert hit == [("1", 0), ("2", 0), ("2", 12), ("2", 12), ("None", 12)]
    assert decontamination.clean_documents(docs, items).count() == 2
    found = sorted((str(r["doc_id"]), r["n_email"]) for r in rows(personal_data.op10_personal_data(docs)))
    assert found == [("1", 1), ("2", 0), ("2", 0), ("2", 1), ("None", 0)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if good(k, m.group()))


def test_personal_data_base(spark, texts):
    rng = random.Random(4)
    parts = ["a@b.co", "x@y", "u.v%+-@w-1.z.q_r@s.t", "1.2.3.4.5.6.7.8", "999.1.1.1", "00001.02.3.255", "4111 1111 1111 1111", "4111-1111 11111111", "4111  111111111111", "41111111111111111111111", "+1 (555) 010-9999", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "@", "1 -2", "5", "word", "\n", "𝒳"]
    own = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["".join(rng.choice(parts) for _ in range(8)) for _ in range(60)] + [*texts, "7" * 3000, "a" * 5000 + "@"]
    got = {r["doc_id"]: r for r in rows(personal_data.op10_personal_data(frame(spark, own)))}
    for i, t in enumerate(own):
        want = base_spans(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in want) for k in BASE], t
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(got[i]["spans"].split(",")) or not told


def luhn(digits: str) -> str:
    """``digits`` and the check digit that makes them a card."""
    return next(digits + c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits + c))) % 10 == 0)


def test_personal_data_bootstraps(spark):
    """Unseen identifiers of all four kinds are found, and nothing else: no commit hash, token, part number or failed check."""
    rng = random.Random(6)
    seen = {
        "phone": [f"please call me at +1 (555) 010-{1000 + i} today" for i in range(8)],
        "email": [f"write a mail to user{i}@example.org for more" for i in range(8)],
        "ip": [f"log in from host 10.1.2.{i + 3} was refused" for i in range(8)],
        "card": [f"was paid with card {luhn(f'41111111111{i:04d}')} last week" for i in range(8)],
    }
    unseen = {
        "phone": [("so call me at 555-010-7777 soon", "555-010-7777"), ("but call me at (555) 010.8888 later", "(555) 010.8888")],
        "email": [("just write a mail to root@localhost for help", "root@localhost"), ("then a mail to jan@büro for that", "jan@büro")],
        "ip": [("new log in from host 10-22-33-44 was seen", "10-22-33-44")],
        "card": [("it was paid with card 4111.1111.1111.1111 on it", "4111.1111.1111.1111")],
    }
    commits = [f"fixed in commit {rng.randbytes(20).hex()} by hand" for _ in range(40)]
    tokens = [f'the token = "{rng.randbytes(20).hex()}" was here' for _ in range(40)]
    refused = ["please call me at +1 2 3 and pay 4111 1111 1111 1112 now", "was paid with card 4111 1111 1111 1112 last", "log in from host 999.1.1.1234 was refused", "the part number 1234567 is here"]
    planted = [(k, t, v) for k, own in unseen.items() for t, v in own]
    base = [t for own in seen.values() for t in own]
    docs = frame(spark, [*base, *(t for _, t, _ in planted), *commits, *tokens, *refused])
    got = {r["doc_id"]: r for r in rows(personal_data.op10_personal_data(docs))}
    for i, (k, t, v) in enumerate(planted, len(base)):
        assert got[i]["spans"] == f"{k}:{t.index(v)}:{t.index(v) + len(v)}", t
        assert got[i][f"n_{k}"] == 0
    assert all(r["spans"] == "" for i, r in got.items() if i >= len(base) + len(planted))
    hidden = {r["doc_id"]: r["text"] for r in rows(personal_data.masked(docs))}
    assert hidden[len(base)] == "so call me at <phone> soon" and hidden[0] == "please call me at <phone> today"
    assert all(hidden[len(base) + len(planted) + i] == t for i, t in enumerate([*commits, *tokens, *refused]))


def test_bootstrap_equals_brute_force(spark):
    """Scores of patterns and instances, round by round."""
    rng = random.Random(9)
    found = []
    for i in range(160):
        kind = rng.choice(["phone", "email", "other", "other"])
        k = rng.randrange(9)
        value = f"o{k}#555" if kind == "other" else f"{kind}{rng.randrange(25)}"
        group = {"phone": "p", "email": "e", "other": "peq"[k % 3]}[kind]
        found.append((kind, value, sorted({f"{group}{rng.randrange(5)}" for _ in range(2)})))
    edges: dict = {}
    for kind, value, patterns in found:
        for p in patterns:
            edges.setdefault(p, {})[value] = None if kind == "other" else kind
    scores = {(k, v): (1.0, 0) for k, v, p in found if k != "other" and p}
    sure, round_ = -1, 0
    while True:
        conf = {}
        for p, own in edges.items():
            for k in ("email", "phone"):
                s = [scores[k, v][0] for v in own if (k, v) in scores]
                if len(own) >= 3 and len(s) >= 3 and round(sum(s) / (len(own) + 1), 9) >= 0.7:
                    conf[p, k] = round(sum(s) / (len(own) + 1), 9)
        now = sum(s >= 0.7 for s, _ in scores.values())
        if now == sure:
            break
        sure, round_, new = now, round_ + 1, {}
        for (p, k), c in conf.items():
            for v, own in edges[p].items():
                if own in (None, k):
                    new[k, v] = new.get((k, v), 1.0) * (1 - min(c, 0.999))
        for key, miss in new.items():
            old = scores.get(key, (0.0, round_))
            scores[key] = (max(old[0], round(1 - miss, 9)), old[1])
    got, patterns = personal_data.bootstrap(spark.createDataFrame(found, "kind string, value string, patterns array<string>"))
    hashes = {r["h"]: r["value"] for r in rows(spark.createDataFrame([(f[1],) for f in found], "value string").selectExpr("value", "xxhash64(lower(value)) as h"))}
    told = {(r["kind"], hashes[r["v"]]): (pytest.approx(r["score"], abs=1e-6), r["round"]) for r in rows(got)}
    assert len(told) > len({(k, v) for k, v, _ in found if k != "other"}) and {r for _, r in scores.values()} >= {0, 1}
    assert scores == told
    assert {(r["pattern"], r["kind"]): pytest.approx(r["confidence"], abs=1e-6) for r in rows(patterns)} == conf


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"en": ["the", "and", "thing", "with", "over", "hand"], "de": ["der", "und", "straße", "nicht", "über", "haus"], "ru": ["и", "не", "дом", "река", "что"]}
    docs = []
    for i in range(240):
        lang = ["en", "de", "ru"][i % 3]
        docs.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(3, 40))), lang if i % 11 else None))
    docs += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字" * 20, None)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in rows(language_id.op8_language_id(df))}
    for i, text, _ in docs[:240]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == ["en", "de", "ru"][i % 3], text
        assert 0 <= got[i]["score"] <= 1 and not got[i]["rejected"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (900, 901, 902))
    assert got[903]["rejected"] and got[903]["lang_pred"] in kinds


def test_language_id_rejects_beside_mislabelled(spark):
    """One foreign and one junk text with a label do not let others like them pass."""
    rng = random.Random(5)
    words = ["the", "and", "thing", "with", "over", "hand", "river", "stone"]
    clean = [(i, " ".join(rng.choice(words) for _ in range(30)), "en") for i in range(400)]
    junk = lambda: " ".join("".join(rng.choice("qxzjkvwp") for _ in range(7)) for _ in range(40))
    foreign = lambda: " ".join(rng.choice(["не", "дом", "река", "что"]) for _ in range(60))
    docs = [*clean, (500, junk(), "en"), (501, foreign(), "en"), (900, junk(), None), (901, foreign(), None)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, __text string")
    models, limits = language_id.learned(df.where("doc_id < 900"))
    got = {r["doc_id"]: r for r in rows(language_id.identify(df, models, limits))}
    assert not any(got[i]["__rejected"] for i, _, _ in clean)
    assert got[900]["__rejected"] and all(r["__text"] == "clash" for r in got.values())


def test_language_id_calibrates_on_all_documents(spark):
    rng = random.Random(9)
    words = {"en": ["the", "and", "thing", "with", "hand"], "ru": ["не", "дом", "река", "что"]}
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 9))), x) for i in range(5400) for x in [["en", "ru"][i % 2]]]
    df = spark.createDataFrame([*docs, (9000, None, "en"), (9001, "12 !", "ru"), (9002, "abc", None)], "doc_id long, text string, lang string")
    models, limits = language_id.learned(df)
    for lang in words:
        bits, n = language_id.entropies([t for i, t, x in docs if x == lang and zlib.crc32(str(i).encode()) % 4 != 2], [models[lang]])
        h = bits[:, 0] / n
        mean = (n * h).sum() / n.sum()
        spread = (n * (h - mean) ** 2).sum()
        char, long = max(4.0, spread / len(n)), max(0.01, spread / n.sum())
        far = np.quantile((h - mean) / np.sqrt(long + char / n), language_id.QUANTILE)
        assert limits[lang] == pytest.approx((mean, char, long, max(language_id.REJECT_Z, language_id.MARGIN * far)), rel=1e-9)


def test_language_id_keeps_all_grams(spark, monkeypatch):
    """Too many grams for memory: the models are tables, of all grams, with the same results."""
    rng = random.Random(8)
    signs = {"en": "abcdefgh", "zh": [chr(0x9000 + i) for i in range(90)]}
    docs = [(i, " ".join("".join(rng.choice(signs[x]) for _ in range(4)) for _ in range(rng.randint(1, 30))), x) for i in range(120) for x in [["en", "zh"][i % 2]]]
    docs += [(900, None, "en"), (901, "12 !", "zh"), (902, docs[0][1], "en"), (903, "Ж" * 300, None), (None, "abc", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    key = lambda r: str(r["doc_id"])
    want = sorted(rows(language_id.op8_language_id(df)), key=key)
    monkeypatch.setattr(language_id, "MAX_GRAMS", 50)
    got = sorted(rows(language_id.op8_language_id(df)), key=key)
    assert len(got) == len(want) == len(docs)
    for a, b in zip(got, want, strict=True):
        assert {k: a[k] for k in ("doc_id", "held_out", "lang_pred", "rejected")} == {k: b[k] for k in ("doc_id", "held_out", "lang_pred", "rejected")}
        assert (a["score"], a["entropy"]) == pytest.approx((b["score"], b["entropy"]), abs=1e-9)


def test_quality_target_is_all_trusted(spark, monkeypatch):
    labels = spark.range(20_500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality_rules.trusted_ids(labels).count() == 20_500
    docs = frame(spark, ["one two three " * 20, "four five six " * 20] * 20)
    trusted = common.written(quality_rules.trusted_ids(labels.where("doc_id < 30 and doc_id % 2 = 0")), "trusted")
    want = quality_rules.weights(docs, trusted)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert quality_rules.weights(docs, trusted) == want


def test_kneser_ney_sums_to_one():
    keys, at, _ = language_id.grams(["abracadabra abra"])
    model = language_id.KneserNey(keys, np.bincount(at[at >= 0], minlength=len(keys)))
    context = int(keys[3]) >> 16 << 16
    total = sum(2.0 ** -model.cost(np.array([context & ~0xFFFF | c], np.uint64))[0] for c in range(4096))
    assert total == pytest.approx(1.0, abs=0.02)


def test_chat_formatting(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 70, "ann", "bye"), (2, None, None, "x"), (2, 3, "bob", "y"), (None, 1, "ann", "z"), (3, 0, "system", "alone"), (4, 1, "a", "t"), (4, 1, "a", "t")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, part string")
    whole = {}
    for r in sorted(rows(chat_formatting.rotate_perspectives(df)), key=lambda r: r["start"]):
        text, spans = whole.get((r["conv"], r["speaker"]), ("", []))
        assert len(text) == r["start"]
        whole[r["conv"], r["speaker"]] = text + r["rendered"], spans + [(s["a"], s["b"]) for s in r["spans"]]
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (2, "bob"), (4, "a")}
    text, spans = whole[1, "ann"]
    assert text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [text[a:b] for a, b in spans] == ["hi < |im_end|><|im_end|>", "bye<|im_end|>"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.op3_jaccard_join(docs).count() == 0
    assert decontamination.op5_decontamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert repeated_bytes.op9_repeated_bytes(docs).count() == 0
    assert quality_rules.op2_quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert mixing.op6_mixing(docs).count() == 0
    assert sharding.op7_sharding(docs).count() == 0
    assert line_dedup.op4_line_dedup(docs).count() == 0
    assert personal_data.op10_personal_data(docs).count() == 0
    assert language_id.op8_language_id(docs).count() == 0
    assert chat_formatting.op1_chat_formatting(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_untrained_language_id(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    r = language_id.op8_language_id(docs).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_kneser_ney_equals_brute_force():
    """Probabilities of the sorted arrays, order by order, from the text alone."""
    texts = ["abracadabra abra", "cab bad", "a"]
    keys, at, _ = language_id.grams(texts)
    n = np.bincount(at[at >= 0], minlength=len(keys))
    model = language_id.KneserNey(keys[n > 0], n[n > 0])
    grams = Counter()
    for t in texts:
        s = "   " + t
        for i in range(3, len(s)):
            if s[i] != " " or s[i - 1] != " ":
                grams[s[i - 3 : i + 1]] += 1
    levels = [grams]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def chance(gram, k):
        if k == 4:
            return language_id.UNIFORM
        n = levels[k]
        few, pairs = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        cut = few / (few + 2 * pairs) if few else 0.5
        after = {g: v for g, v in n.items() if g[:-1] == gram[:-1]}
        low = chance(gram[1:], k + 1)
        if not after:
            return low
        total = sum(after.values())
        return max(after.get(gram, 0) - cut, 0) / total + min(1.0, cut * len(after) / total) * low

    for gram in [*grams, "abrz", "zzzz", "bra ", "  ab"]:
        key = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(gram))
        assert 2.0 ** -model.cost(np.array([key], np.uint64))[0] == pytest.approx(max(chance(gram, 0), 1e-12), rel=1e-9)
