"""Substring dedup, Merkle manifest and spelling variants against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from synthspark.llm import merkle_manifest, spelling_variants, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, th string, gram string, digest string, row string, word string, n string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with other columns whose names are those of the operators' own."""
    return spark.createDataFrame([(i, t, g, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", None if t is None or (i or 0) % 5 == 4 else len(t), "a", "b", "c", "d", "e", "f", "g") for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["École", "über", "x" * 70]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    p, q, r = make(60), make(120), make(49)
    texts = [make(rng.randint(1, 150)) for _ in range(15)] + [None, "", " \t\n", q, q]
    texts += [f"{make(rng.randint(0, 30))} {p} {make(rng.randint(0, 30))}" for _ in range(12)]
    texts += [f"{make(5)} {r} {make(5)}" for _ in range(3)] + [p + " " + p, q.replace(" ", "\n\t "), q[: len(q) // 2] + " edit " + q[len(q) // 2 :]]
    texts += [" ".join(q.split()[a : a + 70]) for a in range(0, 50, 7)] + ["a " * 130, "a " * 60, make(3000) + " " + p]
    return texts


def kept_words(texts):
    """By brute force: (words, removed places) of each (id, text)."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    least = {}
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                least[tuple(w[k : k + 50])] = min(i, least.get(tuple(w[k : k + 50]), i))
    out = []
    for i, w in words:
        gone = {x for k in range(len(w) - 49) if i is not None and least[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        runs = sum(1 for x in gone if x - 1 not in gone)
        out.append((str(i), len(w), len(gone), runs, hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_substring_dedup(spark, passages):
    texts = list(enumerate(passages))
    got = removed(substring_dedup.op11_substring_dedup(frame(spark, [(i, t, "en") for i, t in texts]).repartition(3)))
    assert got == kept_words(texts)
    assert sum(n for _, _, n, _, _ in got) > 1000


def test_substring_dedup_rows_of_one_id(spark, passages):
    """Null ids keep all, rows of one id do not remove each other's words, equal rows have equal results."""
    long = [t for t in passages if t and len(t.split()) > 60]
    texts = [(None, long[0]), (3, long[0]), (3, long[1]), (3, long[1]), (4, long[0] + " " + long[1]), (None, long[1]), (-5, long[2]), (9, long[2])]
    assert removed(substring_dedup.repeated_runs(frame(spark, [(i, t, None) for i, t in texts]))) == kept_words(texts)


def test_substring_spans_are_maximal_runs(spark, passages):
    rows = substring_dedup.repeated_runs(frame(spark, [(i, t, "en") for i, t in enumerate(passages)])).collect()
    assert any(len(r.spans) > 1 for r in rows)
    for r in rows:
        assert len(r.spans) == r.n_spans and sum(s.b - s.a for s in r.spans) == r.n_removed
        assert all(s.b - s.a >= 50 for s in r.spans) and all(x.b < y.a for x, y in itertools.pairwise(r.spans))


def test_one_seed_in_every_document(spark):
    """A phrase amid different texts: each document has a span of its own, and only whole windows count."""
    rng = random.Random(3)
    phrase = [f"p{i}" for i in range(55)]
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    texts = [(i, " ".join(own(40) + phrase[i % 8 :] + own(40))) for i in range(120)]
    assert removed(substring_dedup.repeated_runs(frame(spark, [(i, t, "en") for i, t in texts]))) == kept_words(texts)


def test_equal_windows_have_equal_seeds(passages):
    """A window's seed hangs on its words only, whatever stands around it, and few words are seeds."""
    import numpy as np

    text = " ".join(t for t in passages if t).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, doc = substring_dedup.word_places(data, offsets)
    assert [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] == text.split()
    s = substring_dedup.seeds_of(substring_dedup._Rolling(substring_dedup.word_hashes(data, start, end)), doc)
    assert s["n"].sum() == len(doc) - 49 and len(s["n"]) < len(doc) / 8
    seed_of = {}
    words = text.split()
    for first, n, gram in zip(s["first"].tolist(), s["n"].tolist(), s["gram"].tolist(), strict=True):
        for k in range(first, first + n):
            assert seed_of.setdefault(tuple(words[k : k + 50]), gram) == gram


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def folded(tree, place, leaf):
    way = []
    for level in tree[:-1]:
        near = level[place & ~1 : (place & ~1) + 2]
        way += [x for k, x in enumerate(near) if k != place & 1]
        near[place & 1] = leaf
        leaf, place = digest(*near), place >> 1
    return way, leaf


def manifest_rows(rows):
    """By brute force, of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(field, r))
    touched = lambda r: (*r[:3], r[3] if r[3] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 else r[3] + 1, r[4])
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    sorted_ = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups}
    trees = {g: levels([leaf(r) for r in rs]) for g, rs in sorted_.items()}
    top = levels([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for p, r in enumerate(sorted_[g]):
            way, f = folded(trees[g], p, leaf(touched(r)))
            more, f = folded(top, k, f)
            out.append((str(r[0]), leaf(r), trees[g][-1][0], top[-1][0], digest(*way, *more), f, f == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize(("parts", "bits", "batch"), [(1, (18, 10), 10_000), (5, (2, 1), 3), (4, (3, 2), 7)])
def test_merkle_manifest(spark, monkeypatch, parts, bits, batch):
    monkeypatch.setattr(merkle_manifest, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(merkle_manifest, "FAN_BITS", bits[1])
    rng = random.Random(2)
    rows = [(i, rng.choice(["", "text", None, "é" * 9, f"own {i}"]), rng.choice(["de", "en", "en", "en", None, "", "éa", "zz"])) for i in range(90)]
    rows += [(7, "same id", "en"), (7, "same id", "en"), (7, "another", "en"), (None, "no id", "en"), (None, None, None), (-4, "below", "en"), (500, "alone", "x1")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = frame(spark, rows).repartition(parts)
        want = manifest_rows([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()])
        got = merkle_manifest.op12_merkle_manifest(df)
        assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x[-1] for x in want} == {True, False}


def test_forests_merge_in_any_order():
    rng = random.Random(4)
    for n in [*range(1, 20), 37, 64, 65]:
        leaves = {("t", 0, i): str(i) for i in range(n)}
        want = {("t", len(levels([str(i) for i in range(n)])) - 1, 0): levels([str(i) for i in range(n)])[-1][0]}
        keys = list(leaves)
        rng.shuffle(keys)
        cut = sorted(rng.sample(range(n + 1), min(n, 4)))
        parts = [merkle_manifest.merged({k: leaves[k] for k in keys[a:b]}, {"t": n}) for a, b in zip([0, *cut], [*cut, n], strict=True)]
        while len(parts) > 1:
            rng.shuffle(parts)
            parts.append(merkle_manifest.merged(parts.pop() | parts.pop(), {"t": n}))
        assert parts[0] == want
        run = merkle_manifest.merged({k: leaves[k] for k in list(leaves)[n // 3 :]}, {"t": n})
        assert len(run) <= 2 * n.bit_length() + 1


def near(a, b):
    shorter, longer = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(longer) == len(shorter) + 1 and any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def groups(counts):
    """By brute force, of {word: n}."""
    form, n_near = {}, {}
    for w in counts:
        others = sorted((-counts[v], v) for v in counts if v != w and near(v, w))
        n_near[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], n_near[w], counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def grouped(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize(("key_words", "shard_rows"), [(20_000, 40_000), (3, 10)])
def test_spelling_groups(spark, monkeypatch, key_words, shard_rows):
    """Words of any length from few letters, so that most are near; also with keys dealt to grids."""
    monkeypatch.setattr(spelling_variants, "KEY_WORDS", key_words)
    monkeypatch.setattr(spelling_variants, "SHARD_ROWS", shard_rows)
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    long = ["l" * 70, "l" * 69 + "k", "l" * 71, "k" + "l" * 70, "l" * 35 + "k" + "l" * 34, "𝒳yzzyy", "xyzzyy", "𝒳yzzy"]
    counts = {w: rng.choice([1, 2, 3, 5, 8, 16, 100, 1000]) for w in [*base, *long, "m" * 48, "m" * 49, "n" + "m" * 48]}
    got = grouped(spelling_variants.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)))
    assert got == groups(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_spelling_words_and_damage(spark):
    rng = random.Random(1)
    vocabulary = ["Straße", "strasse", "Über", "übers", "hello", "Hellos", "helo", "WORLD", "world", "ÀÉÎÕÜ", "àéîõü", "abc-defghij", "don't"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(60)] + [(None, "hello world " * 40), (5, None), (6, ""), (7, "1234 --"), (8, "hello"), (8, "hello")]
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = frame(spark, [(i, t, "en") for i, t in docs])
    assert {r.word: r.n for r in spelling_variants.words_of(df).collect()} == want
    assert grouped(spelling_variants.op13_spelling_variants(df)) == groups(want)


def test_one_edit():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        assert spelling_variants.one_edit(a, b) == (a != b and near(a, b))


def test_empty_tables_of_the_round(spark):
    empty = frame(spark, [(1, "x", "en")]).limit(0)
    assert substring_dedup.op11_substring_dedup(empty).count() == 0
    assert merkle_manifest.op12_merkle_manifest(empty).count() == 0
    assert spelling_variants.op13_spelling_variants(empty).count() == 0
