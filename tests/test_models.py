"""Marginals, keys, missing values and context trees against what the data were drawn from."""

from __future__ import annotations

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthspark import cli
from synthspark.functions.scalars import reading_pattern, spark_pattern
from synthspark.operators import context_trees, copula, date_votes, distances, key_shapes, marginals, profile, sequences
from synthspark.sources import tables


def facts_of(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "`x.y` double")
    return marginals.facts(profile.number_counts(df, ["x.y"]))["x.y"]


@pytest.mark.parametrize(
    ("name", "draw", "truth"),
    [
        ("norm", lambda r, n: r.normal(50, 7, n), (50, 7)),
        ("uniform", lambda r, n: r.uniform(3, 9, n), ()),
        ("beta", lambda r, n: r.beta(2, 5, n), (2, 5)),
        ("gamma", lambda r, n: r.gamma(2.5, 3, n), (2.5, 3)),
        ("truncnorm", lambda r, n: (x := r.normal(1, 2, 4 * n))[(x > 0) & (x < 4)][:n], (1, 2)),
    ],
)
def test_families_by_likelihood(spark, name, draw, truth):
    values = draw(np.random.default_rng(1), 40_000)
    f = facts_of(spark, values)
    found = marginals.fit_family("auto", f)
    assert found.name == name
    assert found.parameters == pytest.approx(truth, rel=0.04, abs=0.03)
    got = marginals.family_quantiles(found, f, (0.1, 0.5, 0.9))
    assert got == pytest.approx(np.quantile(values, (0.1, 0.5, 0.9)).tolist(), rel=0.03, abs=0.02)


def test_families_of_odd_columns(spark):
    """One value, two rows and huge numbers close together give no family or a sound one."""
    assert marginals.fit_family("auto", facts_of(spark, [5.0] * 9)) is None
    assert marginals.fit_family("gamma", facts_of(spark, [1.0, 2.0])) is None
    f = facts_of(spark, [1e9 + (i % 10 == 0) for i in range(1000)])
    assert f.m2 == pytest.approx(0.09, rel=1e-6) and marginals.fit_family("norm", f).parameters == pytest.approx((1e9 + 0.1, 0.3))


def test_special_functions():
    assert marginals.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert marginals.trigamma(1.0) == pytest.approx(np.pi**2 / 6, abs=1e-9)
    assert marginals.digamma(0.1) == pytest.approx(-10.423754940411076, abs=1e-8)


def test_kernel_density_equals_convolution(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.zeros(400), rng.gamma(1, 3, 300).round(2)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    counts = profile.number_counts(df, ["x"])
    known = marginals.facts(counts)
    rows = marginals.kernel_densities(counts, {"x": float(np.quantile(values, 0.75) - np.quantile(values, 0.25))}, known, 64).collect()
    got, h, low, step = np.zeros(64), rows[0]["bandwidth"], values.min(), (values.max() - values.min()) / 63
    for r in rows:
        got[r["k"]] = r["share"]
    want = np.zeros(64)
    reach = int(np.ceil(4 * h / step))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / h) ** 2)
    for v in values:
        at = (v - low) / step
        k = min(int(at), 62)
        for p, w in ((k, 1 - (at - k)), (k + 1, at - k)):
            for d in range(-reach, reach + 1):
                t = p + d
                t = -t - 1 if t < 0 else 127 - t if t > 63 else t
                want[t] += w * kernel[d + reach] / kernel.sum()
    assert got == pytest.approx(want / len(values), abs=1e-9) and got.sum() == pytest.approx(1)


@pytest.fixture(scope="module")
def gaps(spark):
    """Mostly zeros, gaps that come together, an inequality with gaps on both sides, and keys of a shape."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        z = rng.gauss(0, 1)
        low = rng.gammavariate(2, 10) if rng.random() > 0.1 else None
        high = None if rng.random() < 0.334 else (low or 0) + rng.gammavariate(1, 5)
        rows.append((f"P{i * 7:08d}", low, high, None if z > 1 else z + rng.gauss(0, 1), None if z > 1 or rng.random() < 0.1 else z, 0.0 if rng.random() < 0.92 else rng.gammavariate(1, 8000)))
    return spark.createDataFrame(rows, "pgn string, `lo.w` double, high double, w double, v double, zero double").persist()


@pytest.fixture(scope="module")
def drawn(spark, gaps):
    model = copula.fit(gaps, [{"type": "inequality", "low": "lo.w", "high": "high"}])
    return model, copula.sample(spark, model, 4000).persist()


def test_missing_values_come_together(gaps, drawn):
    null = lambda *cs: F.avg(sum((F.col(f"`{c}`").isNull().cast("int") for c in cs), F.lit(0)).cast("double").__eq__(len(cs)).cast("int"))
    figures = lambda df: df.agg(*(null(*c).alias("_".join(x.replace(".", "") for x in c)) for c in (("high",), ("lo.w",), ("w",), ("v",), ("w", "v"), ("lo.w", "high")))).first().asDict()
    want, got = figures(gaps), figures(drawn[1])
    assert got == {k: pytest.approx(v, abs=0.02) for k, v in want.items()}
    # w is null only where v is, so they are null together as often as w; by chance alone it would be a quarter of that.
    assert want["w_v"] == want["w"] and got["w_v"] > 3 * got["w"] * got["v"] and drawn[1].where(F.col("high") < F.col("`lo.w`")).count() == 0


def test_skewed_columns_get_a_kernel_density(spark, gaps, drawn):
    assert drawn[0].families["zero"] == "gaussian_kde" and drawn[0].families["v"] == "empirical"
    score = lambda df: distances.evaluate(gaps.select("zero"), df.select("zero")).first()["score"]
    norm = copula.sample(spark, copula.fit(gaps.select("zero"), distributions={"zero": "norm"}), 4000)
    assert score(drawn[1]) < 0.2 < 0.5 < score(norm)
    assert copula.fit(gaps.select("zero"), distributions={}).families == {"zero": "empirical"}
    assert copula.fit(gaps.select("zero"), schema_distributions={"zero": "gamma"}).families == {"zero": "gamma"}
    with pytest.raises(ValueError, match="unknown distributions"):
        copula.fit(gaps.select("zero"), distributions={"zero": "poisson"})


def test_keys_keep_their_shape(gaps, drawn):
    keys = drawn[1].select("pgn")
    assert keys.where(F.col("pgn").rlike(r"^P\d{8}$")).distinct().count() == 4000 and keys.join(gaps, "pgn").count() == 0


@pytest.mark.parametrize("bucket", [100_000, 7])
def test_free_numbers(spark, monkeypatch, bucket):
    """The lowest numbers that are not taken, in order, whatever the buckets."""
    monkeypatch.setattr(key_shapes, "BUCKET", bucket)
    rng = random.Random(3)
    for known in ([], [0], list(range(50)), [5, 6, 7, 100], rng.sample(range(200), 120), [10**12]):
        taken = spark.createDataFrame([(k,) for k in [*known, *known[:2], None]], "number long")
        got = {r.row: r.number for r in key_shapes.free_numbers(spark.range(90).withColumnRenamed("id", "row"), taken).collect()}
        assert got == dict(enumerate(itertools.islice((k for k in itertools.count() if k not in set(known)), 90)))


def test_templates(spark):
    keys = ["AB-12x", "CD-99y", "ZZ-00a", "longer-one", None, ""]
    t = key_shapes.learn(spark.createDataFrame([(k,) for k in keys], "`a key` string"), "a key")
    upper, lower, digits = key_shapes.CLASSES[1], key_shapes.CLASSES[2], key_shapes.CLASSES[0]
    assert t.alphabets == (upper, upper, "-", digits, digits, lower)
    df = spark.range(0, t.size, t.size // 50).select("id", t.text(F.col("id")).alias("k"))
    assert df.where(t.number(F.col("k")) != F.col("id")).count() == 0 and df.where(~F.col("k").rlike("^[A-Z]{2}-[0-9]{2}[a-z]$")).count() == 0
    assert key_shapes.learn(spark.createDataFrame([(None,)], "k string"), "k") is None
    fixed = key_shapes.Template(("K",))
    got = [r.key for r in key_shapes.fresh_keys(spark.range(3).withColumnRenamed("id", "row"), fixed, spark.createDataFrame([("K",)], "key string"), 3).orderBy("row").collect()]
    assert got == ["K0", "K1", "K2"]


def test_spread_of_large_numbers(spark):
    rows = [(1e9 + (i % 10 == 0),) for i in range(1000)]
    r, s = spark.createDataFrame(rows, "`a.b` double"), spark.createDataFrame([(1e9,)] * 1000, "`a.b` double")
    numbers, _ = distances.value_frames(r, s, {"a.b": "numeric"})
    one = distances.numeric_distances(numbers).first()
    assert one["spread"] == pytest.approx(0.30015, abs=1e-5)
    assert distances.evaluate(r, s).first()["score"] == pytest.approx(0.1 / 0.30015, abs=1e-4)


# ---- context trees ----


def test_context_tree_finds_the_order(spark):
    """A chain that looks two states back keeps contexts of two and none of three inside a sequence."""
    rng, rows = random.Random(1), []
    for k in range(150):
        a, b = rng.choice("xy"), rng.choice("xy")
        for i in range(20):
            a, b = b, (a if rng.random() < 0.9 else rng.choice("xy"))
            rows.append((k, i, b))
    df = spark.createDataFrame(rows, "k long, i long, s string")
    own, *_ = context_trees._features(df, "k", "i", None, False)
    counts = context_trees.contexts(context_trees.states(own, ["s"], [], {}, 8), 3)
    kept = {tuple(r.context.split(context_trees.STEP)): r.kept for r in context_trees.kept_contexts(counts, 3).collect()}
    assert all(kept[a, b] for a in "xy" for b in "xy") and kept[("x",)] and kept[("y",)]
    assert not any(kept[c] for c in itertools.product("xy", repeat=3))


@pytest.fixture(scope="module")
def students(spark):
    half = F.when(F.col("student_id") % 2 == 0, "even").when(F.col("student_id") % 3 > 0, "odd")
    return tables.ground_truth(spark, 400).withColumn("half", half).persist()


def test_context_tree_samples_all_features(spark, students, monkeypatch):
    model = context_trees.fit_contexts(students, "student_id", "jaar")
    assert model.numbers == ["ec"] and model.texts == ["status", "half"] and model.lengths is None
    out = context_trees.sample_contexts(spark, model, 300).persist()
    assert out.dtypes == students.dtypes and out.select("student_id").distinct().count() == 300
    found = {(r.column, r.kind): r.score for r in sequences.evaluate_sequential(students, out, "student_id", "jaar").collect()}
    assert len(found) == 4 and all(v < 0.2 for v in found.values())
    # A student's half is one for all years, and nothing follows an end.
    assert out.groupBy("student_id").agg(F.count_distinct(F.coalesce("half", F.lit("-"))).alias("n")).where("n > 1").count() == 0
    assert sequences.transition_pairs(out, "student_id", "jaar", "status").where("f <> 'ingeschreven'").count() == 0
    monkeypatch.setattr(context_trees, "MAP_CONTEXTS", 0)
    monkeypatch.setattr(context_trees, "CUT", 2)
    again = context_trees.sample_contexts(spark, model, 300)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0


def test_context_tree_with_a_time_index(spark):
    """An index of many values comes back as sums of gaps; lengths follow their own shares where states do not tell the end."""
    rng, rows = random.Random(8), []
    for k in range(40):
        at = 0.0
        for _ in range(rng.randint(18, 22)):
            at += rng.expovariate(1 / 60)
            rows.append((k, f"2024-01-01 {int(at) // 3600:02d}:{int(at) // 60 % 60:02d}:{int(at) % 60:02d}.{int(at * 1000) % 1000:03d}", rng.choice(["a", "b%|^$~", None])))
    df = spark.createDataFrame(rows, "k long, t string, s string").select("k", F.col("t").cast("timestamp").alias("t"), "s")
    model = context_trees.fit_contexts(df, "k", "t")
    out = context_trees.sample_contexts(spark, model, 60).persist()
    n = [r["count"] for r in out.groupBy("k").count().collect()]
    assert model.levels is None and model.lengths and min(n) >= 17 and max(n) <= 22
    assert out.dtypes == df.dtypes and {r.s for r in out.select("s").distinct().collect()} == {"a", "b%|^$~", None}
    assert sequences.evaluate_sequential(df, out, "k", "t").where("score > 0.3").count() == 0
    with pytest.raises(ValueError, match="two sequences"):
        context_trees.fit_contexts(df.where("k = 0"), "k", "t")


# ---- dates and files ----


def test_dates_without_a_format(spark):
    """Days above 12 tell day and month apart, whichever table has them; what no pattern reads is left out."""
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "`d.t` string")
    meta = {"columns": {"d.t": {"sdtype": "datetime"}}}
    r, s = rows("31-12-2020", "01-02-2020", None, " ", "junk"), rows("05-06-2020", "07-08-2020")
    one = distances.evaluate(r, s, meta).first()
    # Days from 1 February to 31 December, quartiles in between: the middle of both tables is 35.5 days apart at most.
    assert one["dtype"] == "datetime" and one["distance"] == pytest.approx((334 - 63) / 2, abs=0.6)
    assert date_votes.chosen(rows("12/31/2020", "01/02/2020"), ["d.t"]) == {"d.t": "M/d/yyyy"}
    assert date_votes.chosen(rows("01/02/2020"), ["d.t"]) == {"d.t": "d/M/yyyy"} and date_votes.chosen(rows("x", None), ["d.t"]) == {}
    assert date_votes.chosen(rows("20201231", "20200101"), ["d.t"]) == {"d.t": "yyyyMMdd"}


def test_rows_in_the_order_of_their_input(spark, tmp_path):
    """Positions sort rows as the files have them, on many partitions; hints, ties and sequence models take them."""
    path = str(tmp_path / "t")
    days = [f"{i % 28 + 1:02d}-03-2020" if i < 40 else "soon" for i in range(2000)]
    rows = [(i // 4, 1, "ab"[i % 2], days[i], 1.5 * i) for i in range(2000)]
    spark.createDataFrame(rows, "k long, t long, s string, day string, x double").coalesce(1).write.csv(path, header=True)
    spark.createDataFrame(rows, "k long, t long, s string, day string, x double").coalesce(1).write.parquet(path + ".parquet")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        for df in (tables.read_table(spark, path, line_breaks=False, position="__at"), tables.read_table(spark, path + ".parquet", position="__at")):
            mixed = df.repartition(7)
            assert [r.x for r in mixed.orderBy("__at").collect()] == [r[4] for r in rows]
            assert {r.column: r.rule for r in profile.column_hints(mixed, order="__at").collect()}["day"] == "date"
            assert profile.metadata(mixed, "__at")["columns"]["day"] == {"sdtype": "datetime", "datetime_format": "%d-%m-%Y"}
            assert "__at" not in profile.metadata(mixed, "__at")["columns"]
            # All steps of a sequence have the same index: only the input tells their order.
            pairs = {(r.f, r.t): r.n for r in sequences.transition_matrix(mixed, "k", "t", "s", "__at").collect()}
            assert pairs == {("a", "b"): 1000, ("b", "a"): 500}
            found = sequences.evaluate_sequential(mixed, mixed, "k", "t", tie="__at")
            assert "__at" not in {r.column for r in found.collect()}
            assert context_trees.fit_contexts(mixed.drop("day"), "k", "t", "__at", bins=2).columns == ["k", "t", "s", "x"]
        assert tables.read_table(spark, path, line_breaks=False, position="__at").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    with pytest.raises(ValueError):
        tables.read_table(spark, path + ".parquet", position="x")


def test_patterns_of_dates():
    assert spark_pattern("%d/%m/%Y") == "dd/MM/yyyy" and spark_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert spark_pattern("yyyyMMdd") == "yyyyMMdd" == reading_pattern("%Y%m%d") and reading_pattern("%d-%m-%YT%H:%M") == "d-M-yyyy'T'HH:mm"
    with pytest.raises(ValueError):
        spark_pattern("%j")


def test_dates_of_text_keep_their_format(spark, tmp_path, capsys):
    """The command line finds dates by the first rows of the file, samples days between the real ones and writes them as they were."""
    real, out, schema = (str(tmp_path / n) for n in ("real.csv", "out.csv", "schema.yaml"))
    rows = [(i % 7, f"{i % 28 + 1:02d}-{i % 3 + 4:02d}-2021", f"{i % 28 + 1}/5/2020", "08-05-2020" if i else "later", None) for i in range(300)]
    tables.write_table(spark.createDataFrame(rows, "a long, day string, told string, mixed string, none string"), real)
    assert cli.main(["synthesize", real, out, "--rows", "50"]) == 0
    got = spark.read.csv(out, header=True).collect()
    found = [datetime.strptime(r.day, "%d-%m-%Y") for r in got]
    assert len(found) == 50 and min(found) >= datetime(2021, 4, 1) and max(found) <= datetime(2021, 6, 28) and len(set(found)) > 10
    assert {r.mixed for r in got} <= {"08-05-2020", "later"} and {r.none for r in got} == {None}
    # Without a schema the form d/m is none that is looked for; with one it is read.
    assert {r.told for r in got} <= {r[2] for r in rows}
    with open(schema, "w") as f:
        f.write("columns:\n  a: {dtype: integer}\n  day: {dtype: date, datetime_format: '%d-%m-%Y'}\n  told: {dtype: date, datetime_format: '%d/%m/%Y'}\n  mixed: {dtype: categorical}\n  none: {dtype: string}\n")
    texts = tables.read_table(spark, real, tables.spark_schema(tables.load_schema(schema)))
    assert date_votes.as_dates(texts, cli.declared_dates(tables.load_schema(schema)))[1] == {"day": "dd-MM-yyyy", "told": "dd/MM/yyyy"}
    assert date_votes.as_dates(texts, {"told": "d/M/yyyy", "a": "yyyy", "none": "yyyy", "gone": "yyyy"})[1] == {"told": "d/M/yyyy"}
    assert date_votes.as_texts(*date_votes.as_dates(texts, {"day": "%d-%m-%Y"})).select("day").exceptAll(texts.select("day")).count() == 0
    assert cli.main(["inspect", real]) == 0
    assert "day datetime %d-%m-%Y" in capsys.readouterr().out


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    """Quoted line breaks and doubled quotes stay in their value; marks of missing values become null."""
    (tmp_path / "in.csv").write_text('a,b.c\n"one\ntwo ""x""",1\n<NA>,#N/A N/A\n-nan,2\n', encoding="utf-8")
    df = tables.read_table(spark, str(tmp_path / "in.csv"))
    want = [('one\ntwo "x"', 1), (None, None), (None, 2)]
    assert [tuple(r) for r in df.collect()] == want and df.dtypes == [("a", "string"), ("b.c", "bigint")]
    tables.write_table(df.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(str, (tuple(r) for r in tables.read_table(spark, str(tmp_path / "out")).collect()))) == sorted(map(str, want))
