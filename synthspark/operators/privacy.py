"""Distance to the closest record and nearest-neighbour ratio.

The metric takes samples of at most ``CAP`` rows by definition, so its distances are
a nested loop; ``nearest_records`` takes whole tables, by order or by pivots. The features are
scaled numbers and categories whose squared distance is 0 if equal, 2 if not, and 1
if the real table does not know the category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_numeric, order_key, safe_ratio
from .neighbours import SUBSETS, nearest, nearest_on_line, square
from .profile import high_cardinality

CAP, HOLDOUT = 2000, 5
#: Rows that travel as one list to all points, at least and at most.
LIST_LEAST, LIST_ROWS = 8, 64
LEAST_REAL, LEAST_SYNTH = 20, 10


def capped(df: DataFrame, id_col: str, cap: int = CAP, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows, the same on each run: the first in a random order by id."""
    return df.orderBy(order_key(F.col(id_col), seed), F.col(id_col)).limit(cap)


def holdout_split(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``df`` with ``holdout``: a fifth of its rows, ten at least, in a random order by id. ``df`` is a capped sample: one task numbers its rows."""
    order = Window.orderBy(order_key(F.col(id_col), seed), F.col(id_col))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return df.withColumn("holdout", F.row_number().over(order) <= F.greatest(F.lit(10), F.floor(n / HOLDOUT)))


def minmax(real: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``lo_c`` and ``range_c`` of each column; a constant column has range 1."""
    return real.agg(*(F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns), *((F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))).alias(f"w_{c}") for c in columns)).select(*(F.col(f"lo_{c}") for c in columns), *(F.when(F.col(f"w_{c}") == 0, 1.0).otherwise(F.col(f"w_{c}")).alias(f"range_{c}") for c in columns))


def scaled(df: DataFrame, limits: DataFrame, columns: list[str]) -> DataFrame:
    return df.crossJoin(F.broadcast(limits)).withColumns({c: (F.col(c).cast("double") - F.col(f"lo_{c}")) / F.col(f"range_{c}") for c in columns}).drop(*(f"{p}_{c}" for p in ("lo", "range") for c in columns))


def _features(df: DataFrame, numeric: list[str], categorical: list[str], id_col: str, prefix: str = "", limits: dict | None = None) -> DataFrame:
    """(id, x, y, unknown): numbers and categories of a point, and how many of its categories the real table lacks.

    ``limits`` (lo_c, range_c) scale the numbers. They are arrays: as columns,
    Catalyst would derive constraints of all pairs.
    """
    scale = lambda c: (F.col(c).cast("double") - F.lit(limits[f"lo_{c}"])) / F.lit(limits[f"range_{c}"]) if limits else F.col(c).cast("double")
    unknown = [] if prefix else [F.col("unknown") if "unknown" in df.columns else F.lit(0).alias("unknown")]
    return df.select(F.col(id_col).alias(f"{prefix}id"), F.array(*(scale(c) for c in numeric)).alias(f"{prefix}x"), F.array(*(F.col(c).cast("string") for c in categorical)).alias(f"{prefix}y"), *unknown)


def with_unknown(points: DataFrame, real: DataFrame, categorical: list[str], broadcast: bool = True) -> DataFrame:
    """``points`` with ``unknown``: how many of their categories the real table does not have.

    Only the points' own values are looked for, so nothing grows with the real
    table. ``broadcast`` is for capped samples; without it Catalyst chooses the joins.
    """
    small = F.broadcast if broadcast else lambda df: df
    out, misses = points, F.lit(0)
    for i, c in enumerate(categorical):
        asked = points.select(F.col(c).alias(f"__k{i}")).distinct()
        known = real.select(F.col(c).alias(f"__k{i}")).join(small(asked), f"__k{i}", "left_semi").distinct().withColumn(f"__m{i}", F.lit(0))
        out = out.join(small(known), out[c] == known[f"__k{i}"], "left").drop(f"__k{i}")
        misses = misses + F.coalesce(F.col(f"__m{i}"), F.lit(1))
    return out.withColumn("unknown", misses).drop(*(f"__m{i}" for i in range(len(categorical))))


def nearest_of_sample(points: DataFrame, train: DataFrame, n_numeric: int, n_categorical: int) -> DataFrame:
    """(id, src, d1, d2): distances of each point to its nearest and second nearest training row.

    Both sides are capped samples; points are dealt to tasks, each against all training rows.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = points.repartition(n, "id", "src").crossJoin(F.broadcast(train)).select("id", "src", F.sqrt(square(n_numeric, n_categorical)).alias("d"))
    two = pairs.groupBy("id", "src").agg(F.slice(F.array_sort(F.collect_list("d")), 1, 2).alias("two"))
    return two.select("id", "src", F.get("two", F.lit(0)).alias("d1"), F.get("two", F.lit(1)).alias("d2"))


def nearest_records(real: DataFrame, synth: DataFrame, id_col: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(id, d1, d2): distances of every synthetic row to its two nearest real rows, over both whole tables.

    Numbers are scaled by the real table. Rows with a missing value take no part;
    a category that the real table lacks is at distance 1. Ids are unique.
    """
    used = [*numeric, *categorical]
    r, s = (df.select(id_col, *used).na.drop(subset=used) for df in (real, synth))
    limits = minmax(r, numeric).first().asDict() if numeric else {}
    limits = {k: float(k.startswith("range_")) if v is None else v for k, v in limits.items()}
    train = _features(r, numeric, categorical, id_col, "t_", limits).drop("t_id")
    asked = _features(with_unknown(s, r, categorical, broadcast=False), numeric, categorical, id_col, "", limits)
    asked = asked.withColumn("src", F.lit("s"))
    if len(numeric) == 1 and len(categorical) <= SUBSETS:
        return nearest_on_line(asked, train, len(categorical)).drop("src")
    return nearest(asked, train, len(numeric), len(categorical)).drop("src")


def privacy_columns(real: DataFrame, synth: DataFrame, id_col: str | None = None, primary_key: str | None = None) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, excluded): shared columns that tell people apart.

    Keys are left out; a column is a number if it is one in both tables; others
    are categories, but for those of more than half as many values as rows.
    """
    shared = [c for c in real.columns if c in synth.columns and c not in (id_col, primary_key)]
    numeric = [c for c in shared if is_numeric(real.schema[c].dataType) and is_numeric(synth.schema[c].dataType)]
    others = [c for c in shared if c not in numeric]
    wide = {r["column"] for r in high_cardinality(real, others).where("excluded").collect()} if others else set()
    return numeric, [c for c in others if c not in wide], [c for c in others if c in wide]


PRIVACY = "available boolean, dcr_synth_median double, dcr_holdout_median double, dcr_ratio double, nndr_median double, risk_level string, n_cols int, excluded_cols array<string>, reason string"


def evaluate_privacy(real: DataFrame, synth: DataFrame, id_col: str, numeric: list[str] | None = None, categorical: list[str] | None = None, cap: int = CAP, seed: int = 42, primary_key: str | None = None) -> DataFrame:
    """One row: medians of the distance to the closest record, their ratio, the neighbour ratio and the risk.

    Without given columns they are chosen (``privacy_columns``). Rows with a missing
    value take no part. Without columns, or below 20 real or 10 synthetic rows,
    ``available`` is false, the figures are null and ``reason`` says why.
    """
    excluded: list[str] = []
    if numeric is None and categorical is None:
        numeric, categorical, excluded = privacy_columns(real, synth, id_col, primary_key)
    numeric, categorical = numeric or [], categorical or []
    used = [*numeric, *categorical]
    if not used:
        return real.sparkSession.createDataFrame([(False, None, None, None, None, "onbekend", 0, excluded, "no usable columns")], PRIVACY)
    r, s = (df.select(id_col, *used).na.drop(subset=used) for df in (real, synth))
    counts = r.agg(F.count(F.lit(1)).alias("n_real")).crossJoin(s.agg(F.count(F.lit(1)).alias("n_synth")))
    # At most two capped samples: kept, for both are read twice.
    sample = holdout_split(capped(r, id_col, cap, seed), id_col, seed).persist()
    points = capped(s, id_col, cap, seed).persist()
    limits = minmax(r, numeric).first().asDict() if numeric else {}
    limits = {k: 0.0 if v is None else v for k, v in limits.items()}
    train = _features(sample.where("not holdout").drop("holdout"), numeric, categorical, id_col, "t_", limits).drop("t_id")
    hold = _features(sample.where("holdout").drop("holdout"), numeric, categorical, id_col, "", limits).withColumn("src", F.lit("h"))
    asked = _features(with_unknown(points, r, categorical) if categorical else points, numeric, categorical, id_col, "", limits).withColumn("src", F.lit("s"))
    near = nearest_of_sample(asked.unionByName(hold), train, len(numeric), len(categorical))
    ratio = F.when(F.col("d2").isNull(), 1.0).otherwise(safe_ratio(F.col("d1"), F.col("d2")))
    own = lambda src, c: F.median(F.when(F.col("src") == src, c))
    one = counts.crossJoin(near.agg(own("s", F.col("d1")).alias("ms"), own("s", ratio).alias("nndr"), own("h", F.col("d1")).alias("mh")))
    ok = (F.col("n_real") >= LEAST_REAL) & (F.col("n_synth") >= LEAST_SYNTH)
    dcr = safe_ratio(F.col("ms"), F.col("mh"))
    risk = F.when(dcr >= 0.9, "laag").when(dcr >= 0.7, "matig").otherwise("hoog")
    figure = lambda c: F.when(ok, c)
    names = F.array(*(F.lit(c) for c in excluded)).cast("array<string>")
    return one.select(ok.alias("available"), figure(F.round("ms", 4)).alias("dcr_synth_median"), figure(F.round("mh", 4)).alias("dcr_holdout_median"), figure(F.round(dcr, 3)).alias("dcr_ratio"), figure(F.round("nndr", 3)).alias("nndr_median"), F.when(ok, risk).otherwise("onbekend").alias("risk_level"), F.lit(len(used)).alias("n_cols"), names.alias("excluded_cols"), F.when(~ok, "too few rows").alias("reason"))


def one_hot_distances(points: DataFrame, others: DataFrame, categorical: list[str], known: DataFrame, id_col: str) -> DataFrame:
    """(id, other_id, square): squared one-hot distances of a stated set of points to all other rows.

    ``known`` is the table whose categories have a place of their own.
    """
    a = _features(with_unknown(points, known, categorical), [], categorical, id_col)
    b = _features(others, [], categorical, id_col, "t_").withColumnRenamed("t_id", "other_id")
    # A small file is a few tasks, but every row of it meets all points: a stated number of partitions, which adaptive execution leaves.
    n = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * points.sparkSession.sparkContext.defaultParallelism)
    # Rows of the same categories travel as short lists, some to each task: the distance is taken once a list. Where rows are
    # written, ``id`` and ``square`` stay constant over a list and its ids come again for each point, so the files are small.
    rows = max(LIST_LEAST, min(LIST_ROWS, others.count() // (4 * n)))
    lists = b.repartitionByRange("t_y", "other_id").sortWithinPartitions("t_y", "other_id").withColumn("part", F.expr(f"monotonically_increasing_id() div {rows}"))
    # The field of a list of structs, for a list of ids would leave out nulls.
    lists = lists.groupBy("part", "t_y").agg(F.collect_list(F.struct("other_id")).alias("others")).select("t_y", F.col("others.other_id").alias("others"))
    met = lists.repartition(n).crossJoin(F.broadcast(a)).select("id", "others", square(0, len(categorical)).alias("square"))
    # Compiled as one with the join, the lists of all points would be opened before a row is taken; this stands between and moves nothing.
    return met.coalesce(n).select("id", F.explode("others").alias("other_id"), "square")


def unseen_combinations(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Synthetic rows whose combination of values the real table does not have."""
    return synth.join(real.select(*columns).distinct(), columns, "left_anti")


def inequality_violations(df: DataFrame, low: str, high: str, strict: bool = False) -> DataFrame:
    """Rows that break low <= high (or low < high); nulls break nothing."""
    return df.where(F.col(low) >= F.col(high)) if strict else df.where(F.col(low) > F.col(high))
