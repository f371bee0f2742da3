"""Properties of the comparison, profile, sequence, privacy and model operators."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from synthspark import cli
from synthspark.operators import copula, distances, neighbours, privacy, profile, sequence_models, sequences
from synthspark.plans import benchmarks, verdicts
from synthspark.sources import catalogue, tables


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(5, 2), rng.choice("abc")) for i in range(200)], "id long, a double, b double, c string")


def test_same_table_has_no_distance(numbers):
    found = distances.evaluate(numbers.drop("id"), numbers.drop("id")).collect()
    assert {r.column for r in found} == {"a", "b", "c"}
    assert all(r.score == 0 and r.ok for r in found)


def test_score_does_not_hang_on_scale(numbers):
    shift = numbers.withColumn("a", F.col("a") + 0.5)
    one = {r.column: r.score for r in distances.evaluate(numbers.select("a"), shift.select("a")).collect()}
    big = {r.column: r.score for r in distances.evaluate(numbers.select((1000 * F.col("a")).alias("a")), shift.select((1000 * F.col("a")).alias("a"))).collect()}
    assert one["a"] == pytest.approx(big["a"], abs=1e-3) and one["a"] > 0.2


def test_other_categories_and_types_are_at_distance_one(spark):
    ints, texts = spark.createDataFrame([(i,) for i in range(5)], "x long"), spark.createDataFrame([(str(i),) for i in range(5)], "x string")
    assert distances.evaluate(ints, texts).first().score == 1.0
    assert distances.evaluate(texts, texts.select(F.concat("x", F.lit("!")).alias("x"))).first().score == 1.0
    flags = spark.createDataFrame([(True,), (False,)], "x boolean")
    assert distances.evaluate(flags, flags).first().metric == "tv"


def test_constant_column_and_nulls(spark):
    five, none = spark.createDataFrame([(5,)] * 5, "x long"), spark.createDataFrame([(None,)] * 5, "x long")
    assert distances.evaluate(five, five).first().score == 0
    assert distances.evaluate(five, five.select((F.col("x") + 2).alias("x"))).first().score == 2.0
    assert distances.evaluate(five, none).count() == 0


def test_dates_and_ids_by_metadata(spark):
    df = spark.createDataFrame([(i, f"2020-01-{i + 1:02d}") for i in range(20)], "i long, d string")
    meta = {"columns": {"i": {"sdtype": "id"}, "d": {"sdtype": "datetime", "datetime_format": "%Y-%m-%d"}}}
    late = df.select("i", F.regexp_replace("d", "2020-01", "2020-02").alias("d"))
    r = distances.evaluate(df, late, meta).collect()
    assert [x.column for x in r] == ["d"] and r[0].dtype == "datetime" and r[0].distance == 31.0


@pytest.mark.parametrize(("histogram", "n"), [([1, 5, 1], 1), ([5, 1, 5], 1), ([0, 9, 1, 9, 0], 2), ([0, 9, 9, 0, 1, 0], 1), ([0, 9, 0, 2, 0], 2), ([3], 1), ([0, 5, 5, 0, 5, 5, 0], 2)])
def test_peaks(spark, histogram, n):
    df = spark.createDataFrame([([int(x) for x in histogram],)], "h array<long>")
    assert df.select(distances.peaks(F.col("h"))).first()[0] == n


def test_lost_mode_is_flagged(spark):
    rng = random.Random(3)
    two = spark.createDataFrame([(rng.gauss(5 if i % 2 else -5, 1),) for i in range(400)], "x double")
    one = spark.createDataFrame([(float(i % 3),) for i in range(400)], "x double")
    assert distances.evaluate(two, two).first().real_modes >= 2
    assert distances.evaluate(two, one).first().modal_warning is not None


def test_pairs_of_constant_columns(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")
    assert distances.evaluate_pairs(df, df).count() == 0
    assert distances.evaluate_pairs(df.select("a"), df.select("a")).count() == 0
    assert distances.correlation_risk(distances.evaluate_pairs(df, df)).first().risk == "laag"


def test_blocked_sums_equal_a_plain_window(numbers):
    counts = distances.counted(distances.long_values([("a", F.col("a"))], numbers.withColumn("src", F.when(F.col("id") % 2 == 0, "r").otherwise("s")), "double"))
    rows = sorted((r.value, r.nr, r.cr) for r in distances.cumulative(counts, blocks=7).collect())
    total = 0
    for _, nr, cr in rows:
        total += nr
        assert cr == total


@pytest.mark.parametrize("most", [3, 20, 10_000])
def test_blocks_follow_the_number_of_values(spark, monkeypatch, most):
    """Crowded blocks are cut again: the same sums, no block of more values, none where a table is small; ties are kept in order."""
    rng = random.Random(5)
    rows = [("many", rng.lognormvariate(0, 3), rng.randrange(4), rng.randrange(3)) for _ in range(900)] + [("few", float(i), 1, 2) for i in range(5)] + [("one", 7.0, 2, 0)]
    rows = [(c, v, i % 7, nr + 1, ns) for i, (c, v, nr, ns) in enumerate(rows)] + [("tied", 1.0, i, 1, 1) for i in range(60)] + [("tied", 2.0, 0, 1, 1)]
    counts = spark.createDataFrame(rows, "column string, value double, k long, nr long, ns long").repartition(3).persist()
    dealt = distances._dealt(counts, distances.summaries(counts, 8), 8, most)
    sizes = dealt.groupBy("column", "block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("d")).collect()
    assert max(r.n for r in sizes if r.d > 1) <= max(most, 1 if most < 900 else 130)
    for broadcast in (100_000, 0):
        monkeypatch.setattr(distances, "BROADCAST_ROWS", broadcast)
        got = distances.cumulative(counts, 8, keep=["k"], most=most).collect()
        assert len(got) == len(rows)
        for name in ("many", "few", "one", "tied"):
            own, cr, cs = sorted((r for r in got if r.column == name), key=lambda r: (r.value, r.k)), 0, 0
            for r, after in zip(own, [*own[1:], None]):
                cr, cs = cr + r.nr, cs + r.ns
                assert (r.cr, r.cs, r.dx) == (cr, cs, None if after is None else after.value - r.value)
                assert (r.tr, r.ts) == (sum(x.nr for x in own), sum(x.ns for x in own))


def test_skew_hints_and_types(spark):
    df = spark.createDataFrame([(0.0 if i < 90 else float(i), i % 12 + 1, None if i % 5 else 1.5, float(i % 7)) for i in range(600)], "z double, opl long, gap double, g double")
    # z has 511 distinct values and 90 zeros of 600: neither skewed nor heaped; g has seven values.
    assert {r.column: (r.n_unique, r.skewed) for r in profile.skewness(df, ["z", "g"]).collect()} == {"z": (511, False), "g": (7, False)}
    hints = {r.column: (r.rule, r.confidence) for r in profile.column_hints(df).collect()}
    assert hints["opl"] == ("small_code", 0.65) and hints["gap"] == ("missing", 0.0) and "g" not in hints
    zeros = spark.createDataFrame([(0.0,)] * 90 + [(float(i),) for i in range(1, 31)], "x double")
    assert [r.distribution for r in profile.recommend_distributions(zeros, ["x"]).collect()] == ["gaussian_kde"]


def test_sequence_columns_and_models(spark):
    truth = tables.ground_truth(spark, 200)
    r = profile.sequence_columns(truth).first()
    assert (r.is_longitudinal, r.seq_key, r.seq_index) == (True, "student_id", "jaar")
    assert {x.state for x in sequences.terminal_states(truth, "student_id", "jaar", "status").collect()} == {"gediplomeerd", "uitgestroomd"}
    model = sequence_models.fit_sequences(truth, "student_id", "jaar")
    out = sequence_models.sample_sequences(spark, model, 50)
    assert out.columns == truth.columns and out.select("student_id").distinct().count() == 50
    per = out.groupBy("student_id").agg(F.count(F.lit(1)).alias("n"), F.min("jaar").alias("a"), F.max("jaar").alias("b"), F.count_if(F.col("status") != "ingeschreven").alias("ends"), F.max_by("status", "jaar").alias("last")).collect()
    assert all(p.a == 1 and p.b == p.n for p in per)
    assert all(p.ends == 0 or (p.ends == 1 and p["last"] != "ingeschreven") for p in per)
    again = sequence_models.sample_sequences(spark, model, 50)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_sequence_fit_makes_its_rows_once(spark):
    truth, made = tables.ground_truth(spark, 60), spark.sparkContext.accumulator(0)
    df = truth.withColumn("ec", F.udf(lambda x: (made.add(1), x)[1], "double")("ec"))
    sequence_models.fit_sequences(df, "student_id", "jaar")
    assert made.value == truth.count() and not df.storageLevel.useMemory


def test_sequences_too_small(spark):
    df = spark.createDataFrame([(i, j, 1, 2, 3, 4) for i in range(3) for j in range(3)], "id long, jaar long, a long, b long, c long, d long")
    with pytest.raises(ValueError):
        sequence_models.fit_sequences(df, "id", "jaar")


def test_transition_rows_sum_to_one(spark):
    m = sequences.transition_matrix(tables.ground_truth(spark, 100), "student_id", "jaar", "status")
    assert all(abs(r.s - 1) < 1e-9 for r in m.groupBy("f").agg(F.sum("p").alias("s")).collect())


def test_copula_keeps_rules_and_seed(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"P{i:04d}", 2010 + rng.randrange(8), 2018 + rng.randrange(5), *rng.choice([("A", "1"), ("A", "2"), ("B", "3")])) for i in range(150)], "pgn string, van long, tot long, inst string, opl string")
    rules = [{"type": "inequality", "low": "van", "high": "tot"}, {"type": "fixed_combinations", "columns": ["inst", "opl"]}]
    model = copula.fit(df, rules)
    one, two = copula.sample(spark, model, 200), copula.sample(spark, model, 200).repartition(5)
    assert one.columns == df.columns and one.count() == 200
    assert privacy.inequality_violations(one, "van", "tot").count() == 0
    assert privacy.unseen_combinations(df, one, ["inst", "opl"]).count() == 0
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert sorted(map(str, one.collect())) != sorted(map(str, copula.sample(spark, model, 200, seed=7).collect()))
    r = one.agg(F.min("van"), F.max("van")).first()
    assert 2010 <= r[0] and r[1] <= 2017


def test_copula_makes_fresh_keys_and_dates(spark):
    df = spark.range(400).selectExpr("concat('P', id) as pk", "id + 7 as number", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id % 90 as int)) as a", "timestamp_ntz'2020-02-01' + make_interval(0, 0, 0, cast(id % 90 + id % 7 as int)) as b", "date'2020-01-01' + cast(id % 30 as int) as d", "concat('c', id % 250) as many", "cast(null as double) as nothing")
    model = copula.fit(df, [{"type": "inequality", "low": "a", "high": "b", "strict": True}])
    assert model.keys == {"pk": 0, "number": 406} and {m.column: m.buckets for m in model.marginals}["many"] == 250
    out = copula.sample(spark, model, 900).persist()
    assert out.dtypes == df.dtypes and out.where("a >= b").count() == 0 and out.where("nothing is not null").count() == 0
    assert out.join(df, "pk").count() == 0 and out.join(df, "number").count() == 0
    r = out.agg(F.count_distinct("pk"), F.count_distinct("number"), F.min("d"), F.max("d"), F.count("many"), F.count_distinct("many")).first()
    assert (r[0], r[1], r[4]) == (900, 900, 900) and str(r[2]) >= "2020-01-01" and str(r[3]) <= "2020-01-30" and r[5] > 230
    assert out.join(df.select("many").distinct(), "many", "left_anti").count() == 0


def test_copula_follows_dependence_and_shares(spark):
    rng = random.Random(12)
    rows = [(x, 2 * x + rng.gauss(0, 0.3), "hi" if x > 0.5 else "lo", None if i % 4 == 0 else 1.0) for i in range(1500) for x in [rng.gauss(0, 1)]]
    df = spark.createDataFrame(rows, "x double, y double, c string, gap double")
    r = copula.sample(spark, copula.fit(df, keys=[]), 3000).agg(F.corr("x", "y"), F.avg((F.col("c") == "hi").cast("int")), F.avg(F.col("gap").isNull().cast("int")), F.avg(F.when(F.col("c") == "hi", F.col("x"))) > F.avg(F.when(F.col("c") == "lo", F.col("x")))).first()
    assert r[0] > 0.95 and r[1] == pytest.approx(sum(x[2] == "hi" for x in rows) / 1500, abs=0.03) and r[2] == pytest.approx(0.25, abs=0.03) and r[3]


@pytest.mark.parametrize(("family", "median"), [("norm", 3.17), ("uniform", 5.0), ("gamma", 2.55), ("beta", 2.66)])
def test_families(spark, family, median):
    x = copula.family_knots(family, 0, 10, 3, 2)
    assert x[0] == 0 and x[-1] == pytest.approx(10, abs=0.1) and x == sorted(x) and x[20] == pytest.approx(median, abs=0.02)
    with pytest.raises(ValueError):
        copula.fit(spark.range(9).selectExpr("cast(id as double) as x"), distributions={"x": "cauchy"})


def test_autocorrelation_score_is_the_whole_difference(spark):
    up = spark.createDataFrame([(k, t, float(t), "2020-01-01", k) for k in range(5) for t in range(6)], "k long, t long, v double, d string, pid long")
    zigzag = up.withColumn("v", F.when(F.col("t") % 2 == 0, 1.0).otherwise(0.0))
    meta = {"columns": {"d": {"sdtype": "datetime"}, "pid": {"sdtype": "id"}}}
    found = {r["kind"]: (r["column"], r["score"], r["ok"]) for r in sequences.evaluate_sequential(up, zigzag, "k", "t", meta=meta).collect()}
    assert found == {"autocorrelation": ("v", 2.0, False), "length": (None, 0.0, True)}
    assert sequences.evaluate_sequential(up, up.drop("t"), "k", "t").count() == 0
    assert sequences.sequential_reason(up, up.drop("t"), "k", "t") == "missing column: t"
    assert verdicts.temporal_advice(up, "missing column: t").first()["use"] == "not_judged"


def test_last_row_of_a_level_wins(spark):
    df = spark.createDataFrame([(1, 1, 10, "a"), (1, 1, 11, "b"), (1, 1, 12, None), (1, 2, 9, "c")], "k long, t long, tie long, v string")
    r = sequences.to_wide(df, "k", "t", ["v"], [1, 2], tie="tie").first()
    assert (r["v__t1"], r["v__t2"], r["__seq_len__"]) == ("b", "c", 4)


def test_sequences_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """Partitions follow the rows, and grouping by the key and by more needs no other shuffle."""
    monkeypatch.setattr(sequences, "PART_ROWS", 50)
    df = spark.createDataFrame([(i // 3, i % 3, str(i)) for i in range(900)] + [(None, 1, "x")], "k long, t int, v string")
    own = sequences.dealt(df, "k")
    assert own.rdd.getNumPartitions() == 18 and own.count() == 900
    wide = sequences.to_wide(own.groupBy("k", "t").agg(F.max("v").alias("v")), "k", "t", ["v"], [0, 1, 2])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, wide.collect())) == [(k, *(str(3 * k + j) for j in range(3)), 3) for k in range(300)]


def test_privacy_picks_columns_and_says_why(spark, numbers):
    named = numbers.withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))).withColumn("pk", F.col("id"))
    copies = named.withColumn("id", F.col("id") + 1000)
    assert privacy.privacy_columns(named, copies, "id", "pk") == (["a", "b"], ["c"], ["name"])
    r = privacy.evaluate_privacy(named, copies, "id", primary_key="pk").first()
    assert r.available and r.excluded_cols == ["name"] and r.n_cols == 3 and r.dcr_synth_median == 0
    none = privacy.evaluate_privacy(named.select("id", "name"), copies.select("id", "name"), "id").first()
    assert not none.available and none.reason == "no usable columns" and none.risk_level == "onbekend"
    assert privacy.evaluate_privacy(named.limit(5), copies, "id", ["a"], []).first().reason == "too few rows"


def test_quantiles_equal_sorted_values(spark, numbers):
    values = sorted(r.a for r in numbers.select("a").collect())
    for r in profile.quantiles(numbers, ["a"], [0.0, 0.1, 0.37, 1.0]).collect():
        h = (len(values) - 1) * r.p
        low = int(h)
        assert r.value == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (h - low))


def test_run_bounds_and_benchmark(spark, numbers):
    with pytest.raises(ValueError):
        benchmarks.RunConfig(rows=5)
    assert "--rows 50 --seed 42" in benchmarks.reproduction("a.csv", "b.csv", benchmarks.RunConfig(rows=50))
    row = benchmarks.run_dataset("same", numbers, numbers.withColumn("id", F.col("id") + 1000), "id").first()
    assert (row.worst_score, row.cols_failed, row.sdmetrics_overall, row.corr_risk, row.privacy) == (0.0, 0, 1.0, "laag", "hoog")
    truth = tables.ground_truth(spark, 60)
    same = benchmarks.run_sequential_dataset("same", truth, truth, "student_id", "jaar").first()
    assert (same.temporal_worst, same.temporal_failed, same.verdict, same.length_distance) == (0.0, 0, "Uitstekend", 0.0)
    assert "| same |" in benchmarks.markdown_table(benchmarks.summary({"same": (numbers.drop("id"), numbers.drop("id"))}))
    assert tables.csv_lines(numbers.where("id = 3").select("id", "c")).first()["line"].startswith("3,")


def test_constraint_errors():
    with pytest.raises(ValueError):
        copula.build_constraints([{"type": "sum"}])
    with pytest.raises(ValueError):
        copula.build_constraints([{"type": "inequality", "low": "a"}])
    assert copula.inequality_rule("a", ">", "b") == {"type": "inequality", "low": "b", "high": "a", "strict": True}


def test_privacy_of_copies_and_strangers(spark, numbers):
    copies = numbers.withColumn("id", F.col("id") + 1000)
    r = privacy.evaluate_privacy(numbers, copies, "id", ["a", "b"], ["c"]).first()
    assert r.available and r.risk_level == "hoog" and r.dcr_synth_median == 0
    far = copies.withColumn("a", F.col("a") + 50)
    assert privacy.evaluate_privacy(numbers, far, "id", ["a", "b"], ["c"]).first().risk_level == "laag"
    few = privacy.evaluate_privacy(numbers.limit(5), copies, "id", ["a"], []).first()
    assert not few.available and few.dcr_ratio is None


def test_one_csv_file(spark, tmp_path):
    """The same bytes on any number of partitions, odd names and values, an old file replaced whole, no column refused."""
    rows = [(i, [None, "a,b", 'say "x"', "two\nlines", ""][i % 5], i / 4) for i in range(200)]
    df = spark.createDataFrame(rows, 'id int, `a,b "c"` string, x double')
    path, other = str(tmp_path / "out.csv"), str(tmp_path / "other.csv")
    tables.write_table(df.limit(3), path)
    tables.write_table(df.repartitionByRange(50, "id").sortWithinPartitions("id"), path)
    tables.write_table(df.coalesce(1), other)
    own = (tmp_path / "out.csv").read_bytes()
    assert own == (tmp_path / "other.csv").read_bytes() and own.startswith(b'id,"a,b ""c""",x\n')
    back = {r[0]: (r[1], r[2]) for r in tables.read_table(spark, path).collect()}
    assert back == {i: (t or None, x) for i, t, x in rows}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["other.csv", "out.csv"]
    tables.write_table(df.limit(0), path)
    assert (tmp_path / "out.csv").read_bytes() == b'id,"a,b ""c""",x\n'
    with pytest.raises(ValueError):
        tables.write_table(df.select(), path)


def test_two_nearest_equal_brute_force(spark, monkeypatch):
    """Copies, ties, unknown categories, one and no row; far fewer distances than pairs."""
    rng = random.Random(5)
    monkeypatch.setattr(neighbours, "RING", 8)
    spot = lambda: [round(rng.random(), 2), round(rng.random(), 3)]
    train = [(spot(), [rng.choice("ab")]) for _ in range(700)] + [([0.5, 0.5], ["a"])] * 300
    points = [(i, spot(), [rng.choice("abz")]) for i in range(120)] + [(120, [0.5, 0.5], ["a"]), (121, [9.0, 9.0], ["b"])]
    asked = spark.createDataFrame([(i, x, y, int(y == ["z"]), "s") for i, x, y in points], "id int, x array<double>, y array<string>, unknown int, src string")
    real = lambda rows: spark.createDataFrame(rows, "t_x array<double>, t_y array<string>")
    got = {r.id: (r.d1, r.d2) for r in neighbours.nearest(asked, real(train), 2, 1).collect()}
    for i, x, y in points:
        d = sorted(math.sqrt((x[0] - t[0]) ** 2 + (x[1] - t[1]) ** 2 + (2 * (y != c)) - (y == ["z"])) for t, c in train)
        assert got[i] == pytest.approx(tuple(d[:2]), abs=1e-12)
    known = asked.where("unknown = 0")
    assert neighbours.candidates(known, real(train), 2, 1).count() < 0.2 * known.count() * len(train)
    assert all(r.d2 is None and r.d1 is not None for r in neighbours.nearest(asked, real(train[:1]), 2, 1).collect())
    assert neighbours.nearest(asked, real([]), 2, 1).count() == 0 and neighbours.nearest(asked.limit(0), real(train), 2, 1).count() == 0


def test_two_nearest_on_a_line_equal_brute_force(spark, monkeypatch):
    """One number beside categories: no point is paired with more than its neighbours, over many blocks."""
    rng = random.Random(6)
    monkeypatch.setattr(neighbours, "LINE", 2)
    monkeypatch.setattr(neighbours, "BLOCKS", 64)
    real = [(i, round(rng.random() ** 3, 2), rng.choice("ab"), rng.choice("pq")) for i in range(300)] + [(300 + i, 0.5, "a", "p") for i in range(50)] + [(400, 30.0, "c", "p"), (401, 31.0, "c", "q")]
    synth = [(i, round(rng.random() * 2 - 0.5, 2), rng.choice("abcz"), rng.choice("pqz")) for i in range(200)] + [(200, 0.5, "a", "p"), (201, -9.0, "b", "q"), (202, 40.0, "a", "q")] + [(300 + i, 7.0, "c", "z") for i in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, v double, a string, b string")
    lo, width = min(r[1] for r in real), max(r[1] for r in real) - min(r[1] for r in real)
    known = [{r[k] for r in real} for k in (2, 3)]

    def check(n):
        found = privacy.nearest_records(frame(real[:n]) if n else frame(real), frame(synth), "id", ["v"], ["a", "b"])
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() or n
        return {r.id: (r.d1, r.d2) for r in found.collect()}

    got = check(0)
    assert len(got) == len(synth)
    for i, v, a, b in synth:
        free = (a not in known[0]) + (b not in known[1])
        d = sorted(math.sqrt(((v - r[1]) / width) ** 2 + 2 * (a != r[2]) + 2 * (b != r[3]) - free) for r in real)
        assert got[i] == pytest.approx(tuple(d[:2]), abs=1e-12)
    one = check(1)
    assert len(one) == len(synth) and all(d1 is not None and d2 is None for d1, d2 in one.values())
    assert privacy.nearest_records(frame(real).limit(0), frame(synth), "id", ["v"], ["a", "b"]).count() == 0
    assert privacy.nearest_records(frame(real), frame(synth).limit(0), "id", ["v"], ["a", "b"]).count() == 0


def test_one_hot_distances_are_dealt_to_tasks(spark):
    """A table of one partition meets the points in many tasks."""
    df = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2]) for i in range(200)], "id int, a string, b string").coalesce(1)
    out = privacy.one_hot_distances(df.where("id < 3"), df.where("id >= 3"), ["a", "b"], df, "id")
    per = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per) == 3 * 197 and len(per) >= 8 and max(per) < 100


def test_one_hot_distances_come_in_runs(spark):
    """Rows of one point stand together, so that written files are small; null ids stay."""
    rows = [(i, "abc"[i % 3], "xy"[i % 2]) for i in range(400)] + [(None, "a", "y")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    out = privacy.one_hot_distances(df.where("id < 50"), df.where("id >= 50 or id is null"), ["a", "b"], df.where("a <> 'c'"), "id").collect()
    wanted = [(i, j, 2.0 * ((a != x) + (b != y)) - (a == "c")) for i, a, b in rows[:50] for j, x, y in rows[50:]]
    assert sorted((r.id, r.other_id or -1, r.square) for r in out) == sorted((i, j or -1, s) for i, j, s in wanted)
    assert sum(x.id != y.id for x, y in zip(out, out[1:], strict=False)) < len(out) / 4


def test_ladder_and_advice(spark):
    def label(scores):
        df = spark.createDataFrame([(f"c{i}", s, s < 0.2) for i, s in enumerate(scores)], "column string, score double, ok boolean")
        r = verdicts.rollup(df).first()
        return r.label, r.risk

    assert label([0.05, 0.01]) == ("Uitstekend", "laag")
    assert label([0.15, 0.01]) == ("Goed", "laag")
    assert label([0.3, 0.1, 0.1]) == ("Matig", "matig")
    assert label([0.3, 0.9, 0.1]) == ("Let op", "hoog")


def test_baseline_of_both_tracks(spark, tmp_path):
    path = str(tmp_path / "baseline.json")
    flat = lambda *rows: spark.createDataFrame(rows, "dataset string, mean_score double, cols_failed int, sdmetrics_overall double")
    time = lambda *rows: spark.createDataFrame(rows, "dataset string, length_distance double, temporal_worst double, temporal_failed int")
    first = {"tabular": flat(("a", 0.1, 1, 0.8), ("b", 0.2, 0, None)), "sequential": time(("s", 0.1, 0.2, 0))}
    benchmarks.write_baseline(path, benchmarks.RunConfig(rows=100), first)
    assert benchmarks.gate(path, first).count() == 0
    now = {"tabular": flat(("a", 0.11, 1, 0.6), ("new", 9.0, 9, 0.0), ("b", None, None, None)), "sequential": time(("s", 0.1, 0.3, 1))}
    found = sorted((r.track, r.dataset, r.metric, r.baseline, r.current) for r in benchmarks.gate(path, now).collect() if r.current is not None)
    assert found == [("sequential", "s", "temporal_failed", 0.0, 1.0), ("sequential", "s", "temporal_worst", 0.2, 0.3), ("tabular", "a", "sdmetrics_overall", 0.8, 0.6)]
    assert [r.dataset for r in benchmarks.gate(path, now).where("metric = 'run failed'").collect()] == ["b"]
    with pytest.raises(ValueError):
        benchmarks.write_baseline(path, benchmarks.RunConfig(), {"other": first["tabular"]})


def test_sequence_fields_and_bounds_of_the_command_line(spark, capsys):
    meta = {"sequence_key": "k", "sequence_index": "i"}
    assert sequences.sequence_fields("sequential", meta) == ("k", "i")
    assert sequences.sequence_fields("single_table", meta) is None and sequences.sequence_fields("sequential", {"sequence_key": "k"}) is None and sequences.sequence_fields("sequential", None) is None
    truth = tables.ground_truth(spark, 30)
    found = sequences.sequential_report(truth, truth, "sequential", {"sequence_key": "student_id", "sequence_index": "jaar"})
    assert found.count() > 0 and found.where("not ok").count() == 0
    assert sequences.sequential_report(truth, truth, "sequential", None) is None
    assert cli.main(["synthesize", "no.csv", "out.csv", "--rows", "3"]) == 2 and "rows is 3" in capsys.readouterr().err
    assert cli.main(["synthesize", "no.csv", "out.csv", "--seed", "-1"]) == 2


def test_csv_round_trip_and_cli(spark, numbers, tmp_path):
    path = str(tmp_path / "t.csv")
    tables.write_table(numbers.withColumn("c", F.when(F.col("id") < 5, "NA").otherwise(F.col("c"))), path)
    back = tables.read_table(spark, path)
    assert back.where("c is null").count() == 5 and back.count() == 200
    assert cli.parse(["synthesize", "a.csv", "b.csv", "--rows", "5"]).rows == 5
    assert cli.parse(["validate", "a", "b"]).real == "a"


def test_sources_with_metadata(spark, tmp_path):
    folder, listed = tmp_path / "data", str(tmp_path / "catalogue")
    tables.ground_truth(spark, 40).coalesce(1).write.parquet(str(folder / "years.parquet"))
    spark.createDataFrame([(i, "k", "2020-01-05") for i in range(90)], "id long, c string, d string").write.parquet(str(folder / "flat.parquet"))
    catalogue.write_catalogue(spark, str(folder), listed)
    assert catalogue.list_demos(spark, listed, "sequential") == ["years"] and catalogue.list_demos(spark, listed, "other") == []
    assert catalogue.list_demos(spark, listed, "single_table") == ["flat", "years"]
    flat, years = catalogue.load_demo(spark, listed, "flat"), catalogue.load_demo(spark, listed, "years", "sequential")
    assert flat.meta == {"columns": {"id": {"sdtype": "id"}, "c": {"sdtype": "categorical"}, "d": {"sdtype": "datetime", "datetime_format": "%Y-%m-%d"}}}
    assert (flat.df.columns, flat.df.count(), flat.type_label) == (["id", "c", "d"], 90, "tabular")
    assert sequences.sequence_fields(years.modality, years.meta) == ("student_id", "jaar") and years.type_label == "longitudinal"
    assert "sequence_key" not in catalogue.load_demo(spark, listed, "years").meta
    with pytest.raises(ValueError):
        catalogue.load_demo(spark, listed, "flat", "sequential")
    catalogue.write_catalogue(spark, str(tmp_path), str(tmp_path / "none"))
    assert catalogue.list_demos(spark, str(tmp_path / "none"), "single_table") == []
    made = catalogue.load_ground_truth(spark, 40)
    assert sequences.sequential_report(made.df, made.df, made.modality, made.meta).where("not ok").count() == 0


def test_uploads_are_kept_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "CHUNK", 7)
    csv = "a,d\n" + "".join(f'{i},"{i % 28 + 1:02d}-05-2021"\n' for i in range(30))
    up = catalogue.load_upload(spark, "table.csv", csv.encode())
    assert [tuple(r) for r in up.df.collect()] == [(i, f"{i % 28 + 1:02d}-05-2021") for i in range(30)]
    assert up.meta["columns"] == {"a": {"sdtype": "id"}, "d": {"sdtype": "datetime", "datetime_format": "%d-%m-%Y"}}
    assert catalogue.load_upload(spark, "other.csv", csv.encode()).file_key == up.file_key
    folder = Path(catalogue.shared_folder(spark)) / "uploads"
    assert [p.name for p in folder.glob(f"{up.file_key[:64]}*")] == [up.file_key]
    assert catalogue.load_upload(spark, "other.csv", csv.encode() + b"30,\n").df.count() == 31
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    data = next((tmp_path / "p").glob("*.parquet")).read_bytes()
    assert sorted(r.id for r in catalogue.load_upload(spark, "p.parquet", data).df.collect()) == [0, 1, 2, 3, 4]


def test_yaml_schema(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("name: t\ncolumns:\n  a: {dtype: integer, role: primary_key}\n  b: {dtype: date}\n  c: {dtype: odd, distribution: gaussian_kde}\n")
    schema = tables.load_schema(str(p))
    assert tables.schema_metadata(schema) == {"columns": {"a": {"sdtype": "id"}, "b": {"sdtype": "datetime", "datetime_format": "%Y-%m-%d"}, "c": {"sdtype": "categorical"}}, "primary_key": "a"}
    assert tables.schema_distributions(schema) == {"c": "gaussian_kde"}
    assert [f.dataType.typeName() for f in tables.spark_schema(schema)] == ["long", "string", "string"]


def test_report(spark, numbers):
    found = distances.evaluate(numbers.drop("id"), numbers.drop("id"))
    report = verdicts.validation_report(found, privacy.evaluate_privacy(numbers, numbers, "id", ["a"], []), distances.quality(numbers.drop("id"), numbers.drop("id"), ["a", "b"], ["c"]), {"seed": 42})
    assert report["quality"]["Overall"] == 1.0 and report["summary"]["label"] == "Uitstekend"
    assert "| a | numeric |" in verdicts.markdown(report)
