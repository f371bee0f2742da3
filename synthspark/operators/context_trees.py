"""A model of all features of a sequence: a context tree over joint states, and numbers drawn inside them.

A row's state is all its features at once, numbers as one of ``bins`` stretches of
equal shares. A context is what came before, up to ``depth`` states back to the
start of the sequence; counted is what follows, the end of the sequence included,
for contexts of every length in one aggregate. Where states do not tell the end,
lengths are drawn by their own shares instead. A context stays in the tree if its
following states are told better by it than by the context one state shorter, by
more than the description of its own shares costs, or if a longer one stays; so the
data choose how far back each state looks, one state at least. Sampling walks the tree: from the
longest context that stayed, a state is drawn by its share.

Inside their stretch numbers follow normals of their own, correlated between the
features of a row and from one row to the next. An index of few levels is the
number of the row; else the gap to the row before is one more feature.
"""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import column, is_numeric, is_position, is_time, micros, present, uniform
from .copula import KNOTS, Marginal, _normal, _rank, _share
from .profile import quantiles

#: States back that a context may reach, stretches of a number, levels of an index that are taken as such.
DEPTH, BINS, LEVELS = 3, 8, 200
#: Contexts that are held as one map; larger trees are joined with step by step.
MAP_CONTEXTS = 20_000
#: Steps after which a sequence being sampled is written, where the tree is joined with.
CUT = 5
START, END, MISSING = "^", "$", "~"
#: Between the features of a state, and between the states of a context.
SEP, STEP = "\x1f", "\x1e"


@dataclass
class ContextModel:
    key: str
    index: str
    columns: list[str]
    types: dict[str, str]
    texts: list[str]
    numbers: list[str]
    #: (shares, values) of each number, for what lies inside a stretch.
    knots: dict[str, tuple[list[float], list[float]]]
    bins: int
    depth: int
    #: (context, next, low, high): the stretch of [0, 1) of each following state, of contexts in the tree.
    tree: DataFrame
    n_contexts: int
    longest: int
    #: Of the normals inside stretches: from one row to the next, and the factor of their correlations in a row.
    carry: list[float]
    factor: np.ndarray
    #: Levels of the index by row number, or the least value where gaps are a feature.
    levels: list | None
    first_index: float
    #: (shares, values) of the lengths, where contexts do not tell when a sequence ends.
    lengths: tuple[list[float], list[float]] | None


def _features(df: DataFrame, key: str, index: str, tie: str | None, by_gap: bool) -> tuple[DataFrame, list[str], list[str]]:
    """(__k, __at, features): sequences in order, rows numbered from 1; names of texts and numbers."""
    names = [c for c in df.columns if c not in (key, index) and not is_position(df.schema[c].dataType)]
    numbers = [c for c in names if is_numeric(df.schema[c].dataType) or is_time(df.schema[c].dataType)]
    texts = [c for c in names if c not in numbers]
    order = Window.partitionBy("__k").orderBy(F.col("__i").asc_nulls_last(), *([F.col("__tie")] if tie else []))
    value = lambda c: micros(column(c), df.schema[c].dataType).cast("double") if is_time(df.schema[c].dataType) else present(column(c).cast("double"), T.DoubleType())
    place = micros(column(index), df.schema[index].dataType).cast("double") if is_time(df.schema[index].dataType) else column(index)
    own = df.where(column(key).isNotNull()).select(column(key).alias("__k"), place.alias("__i"), *([column(tie).alias("__tie")] if tie else []), *(column(c).cast("string").alias(c) for c in texts), *(value(c).alias(c) for c in numbers))
    rows = own.withColumn("__at", F.row_number().over(order))
    if by_gap:
        rows = rows.withColumn("__gap", F.col("__i") - F.lag("__i").over(order))
        numbers = [*numbers, "__gap"]
    return rows.drop("__tie"), texts, numbers


def _stretch(c: str, cuts: list[float]) -> Column:
    """The number of the stretch that holds a value; what is missing has a mark of its own."""
    at = F.size(F.filter(F.array(*(F.lit(float(x)) for x in cuts)), lambda x: x <= column(c))) if cuts else F.lit(0)
    return F.when(column(c).isNull(), F.lit(MISSING)).otherwise(at.cast("string"))


def states(rows: DataFrame, texts: list[str], numbers: list[str], knots: dict[str, tuple[list[float], list[float]]], bins: int) -> DataFrame:
    """``rows`` with ``__s``, the joint state: texts as they are (percent-coded), numbers by stretch."""
    cells = [F.coalesce(F.url_encode(column(c)), F.lit(MISSING)) for c in texts]
    for c in numbers:
        ps, xs = knots[c]
        cells.append(_stretch(c, [float(np.interp(i / bins, ps, xs)) for i in range(1, bins)]))
    return rows.withColumn("__s", F.concat_ws(SEP, *cells))


def contexts(rows: DataFrame, depth: int) -> DataFrame:
    """(context, depth, next, n): what follows each context of up to ``depth`` states, in (__k, __at, __s).

    A context is the states before, the nearest one first; one that reaches the
    start of its sequence ends with its mark. The end follows the last row.
    """
    order = Window.partitionBy("__k").orderBy("__at")
    before = [F.lag("__s", d).over(order) for d in range(1, depth + 1)]
    rows = rows.select("__k", "__at", "__s", F.array(*before).alias("b"), F.lead("__at").over(order).isNull().alias("last"))
    past = lambda b: F.filter(b, lambda x: x.isNotNull())
    reach = lambda b: F.when(F.size(past(b)) < depth, F.concat(past(b), F.array(F.lit(START)))).otherwise(b)
    ends = F.slice(F.concat(F.array("__s"), past(F.col("b"))), 1, depth)
    after = F.when(F.size(ends) < depth, F.concat(ends, F.array(F.lit(START)))).otherwise(ends)
    steps = F.array(F.struct(reach(F.col("b")).alias("c"), F.col("__s").alias("next")), F.struct(F.when(F.col("last"), after).alias("c"), F.lit(END).alias("next")))
    each = rows.select(F.inline(steps)).where("c is not null")
    each = each.select("next", F.explode(F.transform(F.sequence(F.lit(0), F.size("c")), lambda d: F.slice("c", F.lit(1), d))).alias("c"))
    return each.groupBy(F.array_join("c", STEP).alias("context"), F.size("c").alias("depth"), "next").agg(F.count(F.lit(1)).alias("n"))


def gains(counts: DataFrame) -> DataFrame:
    """(context, parent, depth, n, n_next, gain): how much better a context tells what follows than its parent, in natural logarithms."""
    own = counts.withColumn("total", F.sum("n").over(Window.partitionBy("context")))
    parent = F.expr(f"substring_index(context, '{STEP}', depth - 1)")
    child = own.where("depth > 0").withColumn("parent", parent)
    up = own.select(F.col("context").alias("parent"), "next", (F.col("n") / F.col("total")).alias("p"))
    told = child.join(up, ["parent", "next"])
    better = F.sum(F.col("n") * F.ln(F.col("n") / F.col("total") / F.col("p")))
    return told.groupBy("context", "parent", "depth").agg(F.max("total").alias("n"), F.count(F.lit(1)).alias("n_next"), better.alias("gain"))


def kept_contexts(counts: DataFrame, depth: int) -> DataFrame:
    """(context, depth, n, gain, kept): contexts of one state or more, and whether they are in the tree.

    A context's own shares cost half a logarithm of all counted steps for each state
    that follows it but one. One that does not pay stays for a longer one that does.
    """
    own = gains(counts)
    steps = F.broadcast(counts.where("depth = 0").agg(F.sum("n").alias("steps")))
    price = F.greatest(F.lit(1), F.col("n_next") - 1) * F.ln("steps") / 2
    own = own.crossJoin(steps).withColumn("pays", F.col("gain") > price)
    kept = own.select("context", "parent", "depth", "n", "gain", F.col("pays").alias("kept"))
    for d in range(depth, 1, -1):
        needed = kept.where((F.col("depth") == d) & F.col("kept")).select(F.col("parent").alias("context")).distinct().withColumn("needed", F.lit(True))
        kept = kept.join(needed, "context", "left").withColumn("kept", F.col("kept") | F.coalesce("needed", F.lit(False))).drop("needed")
    return kept.select("context", "depth", "n", "gain", "kept")


def _shares(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(context, next, low, high) of the contexts in the tree, all of one state and the empty one included.

    A state always looks one back, however rare: what never followed it never does.
    """
    own = counts.where("depth > 1").join(kept.where("kept").select("context"), "context", "left_semi").unionByName(counts.where("depth < 2"))
    w = Window.partitionBy("context")
    upto = F.sum("n").over(w.orderBy(F.desc("n"), "next").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    return own.select("context", "next", ((upto - F.col("n")) / total).alias("low"), (upto / total).alias("high"))


def fit_contexts(df: DataFrame, key: str, index: str, tie: str | None = None, depth: int = DEPTH, bins: int = BINS) -> ContextModel:
    """The model of a longitudinal table; rows with a null key take no part. Refuses tables of fewer than two sequences."""
    levels = [r[0] for r in df.where(column(index).isNotNull()).select(column(index)).distinct().limit(LEVELS + 1).collect()]
    by_gap = len(levels) > LEVELS
    rows, texts, numbers = _features(df, key, index, tie, by_gap)
    rows = rows.persist()
    size = rows.agg(F.count_distinct("__k").alias("k"), F.max("__at").alias("longest"), F.min(F.col("__i").cast("double")).alias("first")).first()
    if size["k"] < 2:
        raise ValueError("a longitudinal table needs two sequences")
    knots: dict[str, tuple[list[float], list[float]]] = {}
    if numbers:
        for r in quantiles(rows.select(*(column(c) for c in numbers)), numbers, list(KNOTS)).orderBy("column", "p").collect():
            ps, xs = knots.setdefault(r["column"], ([], []))
            ps.append(r["p"])
            xs.append(r["value"])
        numbers = [c for c in numbers if c in knots]
    counts = contexts(states(rows, texts, numbers, knots, bins), depth).persist()
    kept = kept_contexts(counts, depth)
    lengths = None
    if not _ends_told(counts):
        n = rows.groupBy("__k").agg(F.count(F.lit(1)).cast("double").alias("n"))
        found = quantiles(n.select("n"), ["n"], list(KNOTS)).orderBy("p").collect()
        lengths = [r["p"] for r in found], [r["value"] for r in found]
        # A state that only ever ended looks to a shorter context then.
        tree = _shares(counts.where(F.col("next") != END), kept).persist()
    else:
        tree = _shares(counts, kept).persist()
    carry, factor = _inside(rows, numbers, knots, bins)
    n = tree.select("context").distinct().count()
    counts.unpersist()
    rows.unpersist()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ContextModel(key, index, [c for c in df.columns if not is_position(df.schema[c].dataType)], types, texts, numbers, knots, bins, depth, tree, n, size["longest"], carry, factor, None if by_gap else sorted(levels), size["first"], lengths)


def _ends_told(counts: DataFrame) -> bool:
    """Whether the last state tells the end of a sequence better than chance, by more than it costs to write down."""
    own = counts.where("depth = 1").groupBy("context").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("next") == END, F.col("n"))), F.lit(0)).alias("e"))
    own = own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("t"), F.sum("e").alias("te"), F.count(F.lit(1)).alias("k"))))
    kept, ended = F.col("n") - F.col("e"), F.col("e")
    base = F.col("te") / F.col("t")
    gain = F.when(ended > 0, ended * F.ln(ended / F.col("n") / base)).otherwise(0.0) + F.when(kept > 0, kept * F.ln(kept / F.col("n") / (1 - base))).otherwise(0.0)
    one = own.agg(F.sum(gain).alias("gain"), (F.max("k") * F.ln(F.max("t")) / 2).alias("price")).first()
    return one["gain"] is not None and one["gain"] > one["price"]


def _inside(rows: DataFrame, numbers: list[str], knots: dict, bins: int) -> tuple[list[float], np.ndarray]:
    """How ranks inside stretches go together: from a row to the next one of its sequence, and between numbers of a row."""
    if not numbers:
        return [], np.eye(0)
    order = Window.partitionBy("__k").orderBy("__at")
    ranks = rows.select("__k", "__at", *(column(c).alias(f"v{i}") for i, c in enumerate(numbers)))
    rank = lambda i, c: _rank(Marginal(c, "number", False, 0.0, *knots[c]), f"v{i}") * bins
    ranks = ranks.select("__k", "__at", *((rank(i, c) - F.least(F.floor(rank(i, c)), F.lit(bins - 1))).alias(f"r{i}") for i, c in enumerate(numbers)))
    ranks = ranks.select("*", *(F.lag(f"r{i}").over(order).alias(f"b{i}") for i in range(len(numbers))))
    pairs = [(f"r{i}", f"b{i}") for i in range(len(numbers))] + [(f"r{i}", f"r{j}") for i in range(len(numbers)) for j in range(i)]

    def corr(a: str, b: str) -> Column:
        there = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(there, F.col(a)), F.when(there, F.col(b))
        return F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0)).alias(f"{a}{b}")

    found = ranks.agg(*(corr(a, b) for a, b in pairs)).first()
    latent = lambda a, b: 2 * math.sin(math.pi / 6 * max(-1.0, min(1.0, found[f"{a}{b}"])))
    carry = [min(0.999, max(-0.999, latent(f"r{i}", f"b{i}"))) for i in range(len(numbers))]
    rho = np.eye(len(numbers))
    for i in range(len(numbers)):
        for j in range(i):
            rho[i, j] = rho[j, i] = latent(f"r{i}", f"r{j}")
    values, vectors = np.linalg.eigh(rho)
    near = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(near))
    return carry, np.linalg.cholesky(near / np.outer(scale, scale))


# ---- sampling ----


def _context(path: Column, d: int, depth: int) -> Column:
    """The context of ``d`` states, the nearest first, at the end of a path that begins with the mark of the start."""
    return F.array_join(F.reverse(F.slice(path, F.greatest(F.lit(1), F.size(path) - (d - 1)), F.lit(d))), STEP)


def _drawn(entries: Column, u: Column) -> Column:
    return F.element_at(F.filter(entries, lambda e: (u >= e["low"]) & (u < e["high"])), 1)["next"]


def _paths_by_map(spark: SparkSession, model: ContextModel, n: int, seed: int) -> DataFrame:
    """(id, path): sequences of states, walked in one expression over the tree as a map."""
    entry = F.collect_list(F.struct("low", "high", "next"))
    one = model.tree.groupBy("context").agg(entry.alias("e")).agg(F.map_from_entries(F.collect_list(F.struct("context", "e"))).alias("tree"))
    rows = spark.range(1, n + 1).crossJoin(F.broadcast(one))
    draws = F.sequence(F.lit(1), F.lit(model.longest + 1))

    def step(path: Column, k: Column) -> Column:
        u = uniform(F.concat_ws("/", F.col("id").cast("string"), k.cast("string")), f"{seed}/state")
        entries = F.coalesce(*(F.try_element_at("tree", _context(path, d, model.depth)) for d in range(model.depth, 0, -1)), F.try_element_at("tree", F.lit("")))
        return F.when(F.element_at(path, -1) == END, path).otherwise(F.concat(path, F.array(_drawn(entries, u))))

    return rows.select("id", F.aggregate(draws, F.array(F.lit(START)), step).alias("path"))


def _cut(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint in the folder that executors share; only local sessions that name none get a temporary one."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="steps-"))
    return rows.checkpoint()


def _paths_by_joins(spark: SparkSession, model: ContextModel, n: int, seed: int) -> DataFrame:
    """(id, path): as by a map, but each step is a join with the tree, for trees of any size."""
    rows = spark.range(1, n + 1).select("id", F.array(F.lit(START)).alias("path"))
    told = model.tree.select("context").distinct()
    for k in range(1, model.longest + 2):
        keys = rows.select("id", "path", *(_context(F.col("path"), d, model.depth).alias(f"c{d}") for d in range(model.depth, 0, -1)))
        for d in range(model.depth, 0, -1):
            keys = keys.join(told.select(F.col("context").alias(f"c{d}"), F.lit(True).alias(f"h{d}")), f"c{d}", "left")
        context = F.coalesce(*(F.when(F.col(f"h{d}"), F.col(f"c{d}")) for d in range(model.depth, 0, -1)), F.lit(""))
        u = uniform(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(k))), f"{seed}/state")
        open_ = F.element_at("path", -1) != END
        keys = keys.select("id", "path", F.when(open_, context).alias("context"), u.alias("u"))
        # One branch: sequences at their end find nothing and stay, so the plan grows by as much each step.
        found = (F.col("context") == F.col("at")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
        drawn = keys.join(model.tree.withColumnRenamed("context", "at"), found, "left")
        rows = drawn.select("id", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"))
        if k % CUT == 0:
            rows = _cut(rows)
    return rows


def sample_contexts(spark: SparkSession, model: ContextModel, n: int, seed: int = 42) -> DataFrame:
    """``n`` sequences with the keys 1..n; the same seed gives the same rows. No sequence is longer than the longest seen."""
    walk = _paths_by_map if model.n_contexts <= MAP_CONTEXTS else _paths_by_joins
    paths = walk(spark, model, n, seed)
    inner = F.filter("path", lambda s: (s != START) & (s != END))
    length = F.lit(model.longest) if model.lengths is None else F.greatest(F.lit(1), F.bround(_quantile(*model.lengths, uniform(F.col("id"), f"{seed}/length"))).cast("int"))
    rows = paths.select("id", F.posexplode(F.slice(inner, F.lit(1), length)).alias("p", "s")).select("id", (F.col("p") + 1).alias("at"), F.split("s", SEP).alias("c"))
    order = Window.partitionBy("id").orderBy("at")
    # A normal that is carried on from row to row, as sums weighted by powers of what is carried.
    place = F.concat_ws("/", F.col("id").cast("string"), F.col("at").cast("string"))
    rows = rows.withColumns({f"e{i}": _normal(place, i, seed) for i in range(len(model.numbers))})
    mixed = {f"m{i}": sum((F.lit(float(model.factor[i, j])) * F.col(f"e{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(len(model.numbers))}
    rows = rows.withColumns(mixed)
    for i, a in enumerate(model.carry):
        so_far = F.collect_list(f"m{i}").over(order.rowsBetween(-30, 0))
        noise = math.sqrt(1 - a * a)
        # What lies 30 rows back is carried no further.
        rows = rows.withColumn(f"z{i}", F.aggregate(so_far, F.lit(None).cast("double"), _carried(a, noise)))
    cells = {c: F.when(F.col("c")[i] != MISSING, F.url_decode(F.col("c")[i])) for i, c in enumerate(model.texts)}
    for i, c in enumerate(model.numbers):
        stretch = F.col("c")[len(model.texts) + i]
        share = (stretch.try_cast("double") + F.least(F.greatest(_share(F.col(f"z{i}")), F.lit(0.0)), F.lit(1.0))) / model.bins
        cells[c] = F.when(stretch != MISSING, _quantile(*model.knots[c], share))
    rows = rows.select("id", "at", *(v.alias(c) for c, v in cells.items()))
    if model.levels is None:
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        index = model.first_index + F.sum(F.coalesce(F.col("__gap"), F.lit(0.0))).over(upto)
    else:
        index = F.get(F.array(*(F.lit(x) for x in model.levels)), F.least(F.col("at"), F.lit(len(model.levels))) - 1)
    rows = rows.withColumn("__index", index)

    def cell(c: str) -> Column:
        kind = model.types[c]
        value = F.col("id") if c == model.key else F.col("__index") if c == model.index else column(c) if c in cells else F.lit(None)
        if kind in ("date", "timestamp", "timestamp_ntz") and (c != model.index or model.levels is None):
            return F.timestamp_micros(value.cast("long")).cast(kind).alias(c)
        if kind in ("tinyint", "smallint", "int", "bigint") and c != model.key:
            value = F.bround(value.cast("double")) if c != model.index or model.levels is None else value
        return value.cast("string").try_cast(kind).alias(c) if c == model.key else value.cast(kind).alias(c)

    return rows.select(*(cell(c) for c in model.columns))


def _carried(a: float, noise: float):
    return lambda z, x: F.when(z.isNull(), x).otherwise(a * z + noise * x)


def _quantile(ps: list[float], xs: list[float], share: Column) -> Column:
    """The value at a share, between knots in a line."""
    k = F.least(F.greatest(F.floor(share * (len(ps) - 1)), F.lit(0)), F.lit(len(ps) - 2)).cast("int")
    values = F.array(*(F.lit(float(x)) for x in xs))
    low, high = F.get(values, k), F.get(values, k + 1)
    return low + (high - low) * F.least(F.lit(1.0), share * (len(ps) - 1) - k)
