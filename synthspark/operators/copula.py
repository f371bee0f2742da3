"""Gaussian copula: fit and sample tables and sequences.

A fit reads the table twice: once for the counts of values, which give quantile
knots of numbers, densities and families (see ``marginals``) and cumulative shares
of categories, and once for rank correlations, with ranks as expressions over the
knots. Whether a value is there at all is a latent normal of its own beside the
value's, so gaps that come together do so in the sample. What the driver holds is
as large as the schema; shares of columns with many categories stay a table.
Samples are expressions over ``spark.range``: normals from hashes of the row
number, so they do not hang on partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import column, is_numeric, is_time, micros, present, uniform
from .distances import cumulative
from .key_shapes import Template, fresh_keys, learn
from .marginals import FITS, GRID, density_quantiles, facts, family_quantiles, fit_family, kernel_densities
from .profile import number_counts, quantiles, quantiles_of

KNOTS = tuple(i / 40 for i in range(41))
#: Columns with so many categories at most have them as constants, others in a table that draws are joined with.
CONSTANT_CATEGORIES = 200
#: Marginals that a column may ask for: a family by maximum likelihood, the likeliest one, a kernel density, or the quantiles of the data.
FAMILIES = (*FITS, "auto", "gaussian_kde", "empirical")
#: Shares at which the knots of a kernel density stand; more where a long tail is.
DENSE_KNOTS = (*KNOTS[:-1], 0.98, 0.985, 0.99, 0.995, 0.998, 1.0)


@dataclass
class Marginal:
    column: str
    kind: str
    integral: bool
    null_share: float
    p: list[float]
    x: list
    #: (bucket, value, lo, hi) where there are too many categories for constants, and the number of buckets.
    table: DataFrame | None = None
    buckets: int = 0


@dataclass
class CopulaModel:
    marginals: list[Marginal]
    factor: np.ndarray
    order: list[str]
    types: dict[str, str]
    constraints: list[dict] = field(default_factory=list)
    seed: int = 42
    #: Columns that are keys, with the greatest number seen (0 for other types).
    keys: dict[str, int] = field(default_factory=dict)
    #: The shape of text keys, and the known ones (key).
    shapes: dict[str, tuple[Template, DataFrame]] = field(default_factory=dict)
    #: The families that were fitted, by column.
    families: dict[str, str] = field(default_factory=dict)


def build_constraints(rules: list[dict]) -> list[dict]:
    """Checked rules: ``inequality`` (low, high, strict) and ``fixed_combinations`` (columns)."""
    needed = {"inequality": ("low", "high"), "fixed_combinations": ("columns",)}
    for r in rules:
        if r.get("type") not in needed:
            raise ValueError(f"unknown constraint type: {r.get('type')!r}")
        for k in needed[r["type"]]:
            if k not in r:
                raise ValueError(f"constraint {r['type']} lacks {k!r}")
    return [dict(r) for r in rules]


def inequality_rule(low: str, operator: str, high: str) -> dict:
    """The rule for ``low operator high``; greater-than swaps the sides."""
    a, b = (low, high) if operator in ("<", "<=", "≤") else (high, low)
    return {"type": "inequality", "low": a, "high": b, "strict": operator in ("<", ">")}


def _encoded(df: DataFrame, constraints: list[dict]) -> DataFrame:
    """Dates as microseconds, constrained columns by what can be sampled freely: a gap, or a tuple as one category."""
    df = df.select(*((micros(column(f.name), f.dataType) if is_time(f.dataType) else column(f.name)).alias(f.name) for f in df.schema.fields))
    for i, rule in enumerate(constraints):
        missing = [c for c in ([rule["low"], rule["high"]] if rule["type"] == "inequality" else rule["columns"]) if c not in df.columns]
        if missing:
            raise ValueError(f"constraint {rule['type']} names columns that the table lacks: {missing}")
        if rule["type"] == "inequality":
            low, high = column(rule["low"]), column(rule["high"])
            # Without a low there is no gap: the high stands for itself. Without a high there is neither.
            gap = F.when(low.isNotNull() & high.isNotNull(), F.greatest(F.lit(0), high - low))
            df = df.withColumns({f"__gap{i}": gap, f"__only{i}": F.when(low.isNull(), high)}).drop(rule["high"])
        else:
            df = df.withColumn(f"__tuple{i}", F.to_json(F.struct(*(column(c) for c in rule["columns"])))).drop(*rule["columns"])
    return df


def find_keys(df: DataFrame) -> list[str]:
    """Columns whose values are whole numbers or texts, never missing and never repeated in more than five rows."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.StringType))]
    if not names:
        return []
    # Only columns that look unique are counted exactly.
    rough = df.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(column(c)).alias(f"u{i}") for i, c in enumerate(names))).first()
    likely = [c for i, c in enumerate(names) if rough["n"] > 5 and rough[f"u{i}"] > 0.8 * rough["n"]]
    if not likely:
        return []
    exact = df.agg(*(F.count_distinct(column(c)).alias(f"u{i}") for i, c in enumerate(likely))).first()
    return [c for i, c in enumerate(likely) if exact[f"u{i}"] == rough["n"]]


def _sql(value: float | str) -> str:
    """A literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"double('{float(value)!r}')"


def _tree(value: str, cuts: list[float], leaves: list[str]) -> str:
    """The leaf of the interval between ``cuts`` that holds ``value``, by halving."""
    if len(leaves) == 1:
        return leaves[0]
    m = len(leaves) // 2
    return f"if({value} < {_sql(cuts[m - 1])}, {_tree(value, cuts[: m - 1], leaves[:m])}, {_tree(value, cuts[m:], leaves[m:])})"


def _rank(m: Marginal, c: str) -> Column:
    """The share of values below, half of the equal ones included, by the knots of a marginal; ``c`` is a column."""
    if m.kind == "presence":
        return F.when(F.col(c), (1 + m.null_share) / 2).otherwise(m.null_share / 2)
    if m.kind == "category":
        told = ", ".join(f"{_sql(str(v))}, {_sql((a + b) / 2)}" for v, a, b in zip(m.x, [0.0, *m.p[:-1]], m.p, strict=True))
        return F.expr(f"try_element_at(map({told}), string({c}))")
    steps: dict[float, list[float]] = {}
    for p, x in zip(m.p, m.x, strict=True):
        steps.setdefault(float(x), []).append(p)
    xs = sorted(steps)
    leaves = []
    for i, x in enumerate(xs):
        mid, high = _sql((steps[x][0] + steps[x][-1]) / 2), steps[x][-1]
        between = f"{_sql(high)} + ({c} - {_sql(x)}) * {_sql((steps[xs[i + 1]][0] - high) / (xs[i + 1] - x))}" if i + 1 < len(xs) else mid
        leaves.append(f"if({c} <= {_sql(x)}, {mid}, {between})")
    return F.expr(f"if({c} is null or isnan({c}), null, {_tree(c, xs[1:], leaves)})")


def rank_correlations(df: DataFrame, marginals: list[Marginal]) -> np.ndarray:
    """Spearman correlations of all pairs; categories count by their frequency rank, presence as 0 or 1."""
    rows = df
    for i, m in enumerate(marginals):
        if m.table is not None:
            mid = m.table.select(F.col("value").alias(f"__v{i}"), ((F.col("lo") + F.col("hi")) / 2).alias(f"__m{i}")).distinct()
            rows = rows.join(mid, column(m.column) == mid[f"__v{i}"], "left")

    def plain(i: int, m: Marginal) -> Column:
        if m.table is not None:
            return F.col(f"__m{i}")
        value = column(m.column)
        if m.kind == "presence":
            return present(value, df.schema[m.column].dataType).isNotNull().alias(f"__c{i}")
        return value.cast("string" if m.kind == "category" else "double").alias(f"__c{i}")

    rows = rows.select(*(plain(i, m) for i, m in enumerate(marginals)))
    rows = rows.select(*(F.col(f"__m{i}").alias(f"__r{i}") if m.table is not None else _rank(m, f"__c{i}").alias(f"__r{i}") for i, m in enumerate(marginals)))
    # A filter of chance between them keeps the ranks from being written out again in each of the aggregates.
    rows = rows.where(F.rand(0) >= 0)
    pairs = [(i, j) for i in range(len(marginals)) for j in range(i)]

    def corr(i: int, j: int) -> Column:
        # The correlation function fails on constant columns.
        there = F.col(f"__r{i}").isNotNull() & F.col(f"__r{j}").isNotNull()
        a, b = F.when(there, F.col(f"__r{i}")), F.when(there, F.col(f"__r{j}"))
        return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))

    found = rows.agg(*(corr(i, j).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else {}
    out = np.eye(len(marginals))
    for i, j in pairs:
        out[i, j] = out[j, i] = float(found[f"c{i}_{j}"] or 0.0)
    return out


def family_knots(family: str, low: float, high: float, mean: float, std: float, ps: tuple = KNOTS) -> list[float]:
    """Quantiles of a family with these moments between the least and the greatest value."""
    if not std or high <= low:
        return [mean] * len(ps)
    x = np.linspace(low, high, 4001)[1:-1]
    u = (x - low) / (high - low)
    m, v = (mean - low) / (high - low), (std / (high - low)) ** 2
    if family == "uniform":
        log = np.zeros_like(x)
    elif family == "beta":
        k = max(m * (1 - m) / v - 1, 1e-3)
        log = (m * k - 1) * np.log(u) + ((1 - m) * k - 1) * np.log1p(-u)
    elif family == "gamma":
        log = (m * m / v - 1) * np.log(u) - u * m / v
    else:
        log = -(((x - mean) / std) ** 2) / 2
    mass = np.cumsum(np.exp(log - log.max()))
    return [float(v) for v in np.interp(ps, np.concatenate(([0.0], mass / mass[-1])), np.concatenate(([low], x)))]


def normal_pair(h: float, k: float, r: float) -> float:
    """The chance that two normals of correlation ``r`` are below ``h`` and ``k``."""
    t, w = np.polynomial.legendre.leggauss(64)
    # By the angle, so that the integrand stays smooth up to a correlation of 1.
    angle = math.asin(r) * (t + 1) / 2
    f = np.exp(-(h * h - 2 * h * k * np.sin(angle) + k * k) / (2 * np.cos(angle) ** 2))
    return NormalDist().cdf(h) * NormalDist().cdf(k) + math.asin(r) / (4 * math.pi) * float(f @ w)


def latent(rho: float, a: Marginal, b: Marginal) -> float:
    """The correlation of the normals behind two columns of this rank correlation."""
    if "presence" not in (a.kind, b.kind):
        return 2 * math.sin(math.pi / 6 * rho)
    if rho == 0:
        return 0.0
    a, b = (a, b) if a.kind == "presence" else (b, a)
    deviation = lambda m: math.sqrt(m.null_share * (1 - m.null_share)) if m.kind == "presence" else math.sqrt(1 / 12)
    want, h = rho * deviation(a) * deviation(b), _z(a.null_share)
    # A number's rank against another draw of it is a normal of its own, whose cut is at 0.
    k, scale = (_z(b.null_share), 1.0) if b.kind == "presence" else (0.0, math.sqrt(0.5))
    base = NormalDist().cdf(h) * NormalDist().cdf(k)
    low, high = -0.99999, 0.99999
    for _ in range(60):
        mid = (low + high) / 2
        if normal_pair(h, k, mid * scale) - base < want:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _categories(own: DataFrame, columns: list[str]) -> dict[str, tuple[list[tuple[str, float]] | None, DataFrame | None, int]]:
    """For each column (value, cumulative share) as constants, the most frequent first, or the table and buckets for many."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), column(c).cast("string").alias("v")) for c in columns))
    counts = own.select(F.inline(cells)).where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("nr")).persist()
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    few: dict[str, list] = {}
    for r in counts.where(F.col("column").isin([c for c, n in sizes.items() if n <= CONSTANT_CATEGORIES])).collect():
        few.setdefault(r["column"], []).append((-r["nr"], r["v"]))
    found: dict = {}
    for c, rows in few.items():
        at, total, shares = 0, -sum(n for n, _ in rows), []
        for n, v in sorted(rows):
            at -= n
            shares.append((v, at / total))
        found[c] = (shares, None, 0)
    for c, n in sizes.items():
        if n > CONSTANT_CATEGORIES:
            found[c] = (None, _share_table(counts.where(F.col("column") == c), n), n)
    return found


def _share_table(counts: DataFrame, n: int) -> DataFrame:
    """(bucket, value, lo, hi): the stretch of [0, 1) of each value, by frequency and then by a hash."""
    order = -F.col("nr") - F.abs(F.xxhash64("v")) / F.lit(float(1 << 63)) / 2
    ranked = cumulative(counts.select("column", order.alias("value"), "nr", F.lit(0).cast("long").alias("ns"), "v").persist(), keep=["v"])
    shares = ranked.select(F.col("v").alias("value"), ((F.col("cr") - F.col("nr")) / F.col("tr")).alias("lo"), (F.col("cr") / F.col("tr")).alias("hi"))
    last = F.least(F.floor(F.col("hi") * n), F.lit(n - 1))
    return shares.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") * n), last))).persist()


def _knots(own: DataFrame, numbers: list[str], wishes: dict[str, str], recommend: bool) -> tuple[dict[str, tuple[list[float], list[float]]], dict[str, str]]:
    """(shares, values) of each numeric column with values, and the family that they are of.

    A wish counts before the recommendation, a kernel density for skewed columns.
    All come from one set of counts, which is dropped then.
    """
    counts = number_counts(own, numbers).persist()
    known = facts(counts)
    chosen = {c: wishes.get(c, "gaussian_kde" if recommend and known[c].skewed else "empirical") for c in numbers if c in known}
    found: dict[str, tuple[list[float], list[float]]] = {}
    families = {}
    for c, f in known.items():
        family = fit_family(chosen[c], f) if chosen[c] in (*FITS, "auto") else None
        if family:
            found[c], families[c] = (list(KNOTS), family_quantiles(family, f, KNOTS)), family.name
        elif chosen[c] in FITS:
            # Too few values for a likelihood, or none that the family could have: by the moments.
            found[c], families[c] = (list(KNOTS), family_knots(chosen[c], f.low, f.high, f.mean, math.sqrt(f.m2))), chosen[c]
    rest = [c for c in known if c not in found]
    quantile: dict[str, list[float]] = {}
    if rest:
        for r in quantiles_of(counts.where(F.col("column").isin(rest)).persist(), list(KNOTS)).orderBy("column", "p").collect():
            quantile.setdefault(r["column"], []).append(r["value"])
    dense = {c: quantile[c][30] - quantile[c][10] for c in rest if chosen[c] == "gaussian_kde" and known[c].high > known[c].low}
    if dense:
        shares: dict[str, list[float]] = {}
        for r in kernel_densities(counts, dense, known).collect():
            shares.setdefault(r["column"], [0.0] * GRID)[r["k"]] = r["share"]
        for c, density in shares.items():
            found[c], families[c] = (list(DENSE_KNOTS), density_quantiles(density, known[c], DENSE_KNOTS)), "gaussian_kde"
    for c in rest:
        if c not in found:
            found[c], families[c] = (list(KNOTS), quantile[c]), "empirical"
    counts.unpersist()
    return found, families


def fit(df: DataFrame, constraints: list[dict] | None = None, seed: int = 42, distributions: dict[str, str] | None = None, keys: list[str] | None = None, schema_distributions: dict[str, str] | None = None, presence: bool = True) -> CopulaModel:
    """Marginals and dependence of a table.

    ``distributions`` names families of numeric columns; without it skewed columns
    get a kernel density and the others follow the quantiles of the data, and an
    empty dictionary leaves all to the quantiles. ``schema_distributions`` counts
    before either. ``keys`` never enter the model, so no value of theirs can be
    sampled; without a list the columns of unique values are keys. Dates are
    numbers. Columns without a value stay empty. With ``presence`` missing values
    depend on each other and on other columns, else each column's on chance alone.
    """
    rules = build_constraints(constraints or [])
    used_by_rules = {c for r in rules for c in (r.get("columns") or [r.get("low"), r.get("high")])}
    keys = [c for c in find_keys(df) if c not in used_by_rules] if keys is None else keys
    wishes = {**(distributions or {}), **(schema_distributions or {})}
    wrong = {c: d for c, d in wishes.items() if d not in FAMILIES}
    if wrong:
        raise ValueError(f"unknown distributions: {wrong}")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rest = df.drop(*keys)
    own = _encoded(rest, rules) if rest.columns else rest
    numbers = [c for c in own.columns if is_numeric(own.schema[c].dataType)]
    value = lambda c: present(column(c), own.schema[c].dataType)
    one = own.agg(F.count(F.lit(1)).alias("n"), *(F.count(value(c)).alias(f"n_{i}") for i, c in enumerate(own.columns))).first() if own.columns else {"n": 0}
    knots, families = _knots(own, numbers, wishes, distributions is None) if numbers else ({}, {})
    texts = [c for i, c in enumerate(own.columns) if c not in numbers and one[f"n_{i}"]]
    categories = _categories(own, texts) if texts else {}
    marginals = []
    for i, c in enumerate(own.columns):
        null = 1 - one[f"n_{i}"] / one["n"] if one["n"] else 0.0
        if not one[f"n_{i}"]:
            continue
        if c in numbers:
            marginals.append(Marginal(c, "number", isinstance(own.schema[c].dataType, T.IntegralType), null, *knots[c]))
        else:
            few, table, buckets = categories[c]
            marginals.append(Marginal(c, "category", False, null, [p for _, p in few or []], [v for v, _ in few or []], table, buckets))
    if presence:
        marginals += [Marginal(m.column, "presence", False, m.null_share, [], []) for m in marginals if 0 < m.null_share < 1]
    ranks = rank_correlations(own, marginals) if marginals else np.eye(0)
    rho = np.array([[1.0 if i == j else latent(float(ranks[i, j]), a, b) for j, b in enumerate(marginals)] for i, a in enumerate(marginals)]).reshape(len(marginals), len(marginals))
    values, vectors = np.linalg.eigh(rho) if marginals else (np.zeros(0), np.eye(0))
    near = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(near))
    factor = np.linalg.cholesky(near / np.outer(scale, scale)) if marginals else np.eye(0)
    whole = [c for c in keys if is_numeric(df.schema[c].dataType)]
    most = df.agg(*(F.max(column(c)).alias(c) for c in whole)).first() if whole else {}
    shapes = {c: (template, df.select(column(c).alias("key"))) for c in keys if isinstance(df.schema[c].dataType, T.StringType) and (template := learn(df, c))}
    return CopulaModel(marginals, factor, df.columns, types, rules, seed, {c: int(most[c] or 0) if c in whole else 0 for c in keys}, shapes, families)


def _normal(row: Column, i: int, seed: int) -> Column:
    """Box-Muller from two hashed uniforms."""
    u = F.greatest(uniform(row, f"{seed}/{i}/a"), F.lit(1e-9))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * uniform(row, f"{seed}/{i}/b"))


def _z(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12))


def _inverse(m: Marginal, z: str) -> Column:
    """The value at a normal score; ``z`` is a column."""
    if m.kind == "category":
        return F.expr(_tree(z, [_z(p) for p in m.p[:-1]], [_sql(str(x)) for x in m.x]))
    cuts = [NormalDist().inv_cdf(min(max(p, 0.001), 0.999)) for p in m.p]
    leaves = [f"{_sql(x)} + ({z} - {_sql(a)}) * {_sql((float(y) - float(x)) / (b - a))}" for a, b, x, y in zip(cuts[:-1], cuts[1:], m.x[:-1], m.x[1:], strict=True)]
    out = F.expr(f"greatest({_sql(m.x[0])}, least({_sql(m.x[-1])}, {_tree(z, cuts[1:-1], leaves)}))")
    return F.bround(out).cast("long") if m.integral else out


def _share(z: Column) -> Column:
    """The normal distribution function, by its tanh form; categories of many values need no more."""
    return 1 / (1 + F.exp(-(1.5957691216 * z + 0.0713548163 * z * z * z)))


def fresh_key(row: Column, name: str, most: int, seed: int, numeric: bool) -> Column:
    """A value that no row has: numbers beyond the greatest one, else a hash with the row number."""
    return row + (1 + most) if numeric else F.concat(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}/{name}"), row.cast("string"))), 1, 16), F.lit("-"), row.cast("string"))


def sample(spark: SparkSession, model: CopulaModel, n: int, seed: int | None = None, id_col: str | None = None) -> DataFrame:
    """``n`` rows like the table that was fitted; the same seed gives the same rows.

    Values stay in the observed range, integers stay whole, categories are observed
    ones, constraints hold, keys are fresh and unique. ``id_col`` is filled with
    the numbers from 1.
    """
    seed = model.seed if seed is None else seed
    rows = spark.range(n)
    rows = rows.select("id", *(_normal(F.col("id"), i, seed).alias(f"__e{i}") for i in range(len(model.marginals))))
    mixed = [sum((F.lit(float(model.factor[i, j])) * F.col(f"__e{j}") for j in range(i + 1)), F.lit(0.0)).alias(f"__z{i}") for i in range(len(model.marginals))]
    rows = rows.select("id", *mixed)
    presence = {m.column: i for i, m in enumerate(model.marginals) if m.kind == "presence"}

    def there(i: int, m: Marginal, value: Column) -> Column:
        """The value where there is one: by its own normal, else by chance."""
        if m.column in presence:
            return F.when(F.col(f"__z{presence[m.column]}") >= _z(m.null_share), value)
        return F.when(uniform(F.col("id"), f"{seed}/{i}/null") >= m.null_share, value) if m.null_share else value

    cells = [there(i, m, _inverse(m, f"__z{i}")).alias(m.column) for i, m in enumerate(model.marginals) if m.table is None and m.kind != "presence"]
    kept = [F.col(f"__z{i}") for i in presence.values()]
    many = [(i, m) for i, m in enumerate(model.marginals) if m.table is not None]
    out = rows.select("id", *cells, *kept, *(F.least(F.greatest(_share(F.col(f"__z{i}")), F.lit(0.0)), F.lit(1 - 1e-12)).alias(f"__u{i}") for i, _ in many))
    for i, m in many:
        shares = m.table.select(F.col("bucket").alias(f"__b{i}"), F.col("lo").alias(f"__lo{i}"), F.col("hi").alias(f"__hi{i}"), F.col("value").alias(f"__x{i}"))
        drawn = out.join(shares, (F.least(F.floor(F.col(f"__u{i}") * m.buckets), F.lit(m.buckets - 1)) == shares[f"__b{i}"]) & (out[f"__u{i}"] >= shares[f"__lo{i}"]) & (out[f"__u{i}"] < shares[f"__hi{i}"]), "left")
        out = drawn.withColumn(m.column, there(i, m, F.col(f"__x{i}"))).drop(f"__u{i}", f"__b{i}", f"__lo{i}", f"__hi{i}", f"__x{i}")
    for i, rule in enumerate(model.constraints):
        if rule["type"] == "inequality":
            day = 86_400_000_000 if model.types[rule["low"]] == "date" else 1
            gap = F.when(F.col(f"__gap{i}").isNotNull(), F.greatest(F.col(f"__gap{i}"), F.lit(day if rule.get("strict") else 0))) if f"__gap{i}" in out.columns else F.lit(None)
            only = F.col(f"__only{i}") if f"__only{i}" in out.columns else F.lit(None)
            low = column(rule["low"])
            out = out.withColumn(rule["high"], F.when(low.isNotNull(), low + gap).otherwise(only))
        else:
            fields = ", ".join(f"`{c}` {model.types[c]}" for c in rule["columns"])
            out = out.withColumn("__t", F.from_json(f"__tuple{i}", fields)).withColumns({c: F.col(f"__t.{c}") for c in rule["columns"]})
    if id_col:
        out = out.withColumn(id_col, F.col("id") + 1)
    for c, (template, known) in model.shapes.items():
        if c != id_col:
            own = fresh_keys(spark.range(n).select(F.col("id").alias("row")), template, known, n)
            out = out.join(own.select(F.col("row").alias("id"), F.col("key").alias(c)), "id")
    free = {c for r in model.constraints if r["type"] == "fixed_combinations" for c in r["columns"]}

    def cell(c: str) -> Column:
        kind = model.types[c]
        if c in model.keys and c not in model.shapes and c != id_col:
            value = fresh_key(F.col("id"), c, model.keys[c], seed, kind not in ("string",))
        elif c not in out.columns:
            value = F.lit(None)
        elif kind in ("date", "timestamp", "timestamp_ntz") and c not in free:
            value = F.timestamp_micros(column(c).cast("long"))
        else:
            value = column(c)
        return value.cast(kind).alias(c)

    return out.select(*(cell(c) for c in model.order))


def fit_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, q05, q50, q95): what a fit learns about numeric marginals."""
    q = quantiles(df, columns, [0.05, 0.5, 0.95]).groupBy("column").agg(*(F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("value"))).alias(f"q{int(p * 100):02d}") for p in (0.05, 0.5, 0.95)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    m = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return m.join(q, "column")
