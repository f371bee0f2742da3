"""Marginals of numeric columns: kernel densities, families by maximum likelihood, and which of them fits best.

All figures come from the counts of values (column, value, nr), so the table itself
is read once. Two aggregates give what every family needs: moments about the mean
and the mean logarithms of the distances to possible bounds. These statistics are
sufficient, so the likelihood is maximised on the driver by Newton's method, over a
dozen numbers a column. A kernel density is a weight for each point of a grid,
convolved with a normal kernel; the grid is as large for any number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distances import of_column
from .profile import MIN_UNIQUE, MODE_SHARE, SKEW

#: Points of the grid of a kernel density, and bandwidths that its kernel reaches.
GRID, REACH = 512, 4
#: Shares of the range by which a bound may lie beyond the least or greatest value, next to none at all and the natural bounds 0 and 1.
MARGINS = (0.001, 0.01, 0.03, 0.1)


@dataclass
class Facts:
    """What the fits need to know of a column."""

    n: int
    low: float
    high: float
    mean: float
    #: Mean squared and cubed distances from the mean.
    m2: float
    m3: float
    n_unique: int
    mode_share: float
    #: Possible bounds, each with the parameters it costs and the mean logarithm of the values' distance to it.
    lows: list[tuple[float, int, float]] = field(default_factory=list)
    highs: list[tuple[float, int, float]] = field(default_factory=list)

    @property
    def skewed(self) -> bool:
        """Whether a normal marginal fits badly, by the rule of ``profile.skewness``."""
        g1 = self.m3 / self.m2**1.5 * math.sqrt(self.n * (self.n - 1)) / (self.n - 2) if self.m2 > 0 and self.n > 2 else 0.0
        return self.n_unique >= MIN_UNIQUE and (abs(g1) >= SKEW or self.mode_share >= MODE_SHARE)


@dataclass
class Family:
    name: str
    #: beta: a, b; gamma: shape, scale; norm and truncnorm: mean and deviation of the (untruncated) normal.
    parameters: tuple[float, ...]
    low: float
    high: float
    log_likelihood: float
    #: Parameters that were fitted, bounds included.
    size: int


def facts(counts: DataFrame) -> dict[str, Facts]:
    """The facts of each column of (column, value, nr)."""
    n = F.sum("nr")
    first = counts.groupBy("column").agg(n.alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(F.col("nr") * F.col("value")) / n).alias("mean"), F.count(F.lit(1)).alias("n_unique"), (F.max("nr") / n).alias("mode_share")).collect()
    out, bounds = {}, {}
    for r in first:
        low, high, wide = r["low"], r["high"], r["high"] - r["low"]
        near = (1 / r["n"], *MARGINS)
        lows, highs = [(low - wide * m, 1) for m in near], [(high + wide * m, 1) for m in near]
        # Bounds that need no fit, where the data keep to them.
        lows += [(0.0, 0)] if low > 0 or low == 0 and r["n_unique"] == 1 else []
        highs += [(1.0, 0)] if low >= 0 and high < 1 else []
        bounds[r["column"]] = lows, highs
    far = lambda side, k: F.get(of_column({c: [x for x, _ in b[side]] for c, b in bounds.items()}, "array<double>"), F.lit(k))
    most = [max((len(b[side]) for b in bounds.values()), default=0) for side in (0, 1)]
    log = lambda d: F.sum(F.col("nr") * F.ln(F.nullif(d, F.lit(0.0)))) / n
    d = F.col("value") - of_column({r["column"]: r["mean"] for r in first})
    logs = [log(F.col("value") - far(0, k)).alias(f"l{k}") for k in range(most[0])] + [log(far(1, k) - F.col("value")).alias(f"h{k}") for k in range(most[1])]
    second = {r["column"]: r for r in counts.groupBy("column").agg((F.sum(F.col("nr") * d * d) / n).alias("m2"), (F.sum(F.col("nr") * d * d * d) / n).alias("m3"), *logs).collect()}
    for r in first:
        s, (lows, highs) = second[r["column"]], bounds[r["column"]]
        told = lambda name, own, s=s: [(x, k, s[f"{name}{i}"]) for i, (x, k) in enumerate(own) if s[f"{name}{i}"] is not None]
        out[r["column"]] = Facts(r["n"], r["low"], r["high"], r["mean"], s["m2"], s["m3"], r["n_unique"], r["mode_share"], told("l", lows), told("h", highs))
    return out


# ---- maximum likelihood ----


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def fit_gamma(mean: float, mean_log: float) -> tuple[float, float]:
    """Shape and scale of positive values of this mean and mean logarithm."""
    s = max(math.log(mean) - mean_log, 1e-9)
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = k - step if step < k else k / 2
        if abs(step) < 1e-10 * k:
            break
    return k, mean / k


def fit_beta(mean: float, var: float, mean_log: float, mean_log_rest: float) -> tuple[float, float]:
    """Both shapes of values in (0, 1) with mean logarithms of the value and of what is left to 1."""
    size = max(mean * (1 - mean) / max(var, 1e-300) - 1, 1e-2)
    a, b = mean * size, (1 - mean) * size
    for _ in range(100):
        g = np.array([digamma(a) - digamma(a + b) - mean_log, digamma(b) - digamma(a + b) - mean_log_rest])
        both = trigamma(a + b)
        step = np.linalg.solve(np.array([[trigamma(a) - both, -both], [-both, trigamma(b) - both]]), g)
        scale = min(1.0, *(0.9 * x / s for x, s in zip((a, b), step.tolist(), strict=True) if s > 0)) if (step > 0).any() else 1.0
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-10 * max(a, b):
            break
    return float(a), float(b)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
_Y, _DY = (_NODES + 1) / 2, _WEIGHTS / 2


def fit_truncnorm(mean: float, square: float) -> tuple[float, float, float]:
    """(t1, t2, log of the normaliser) of exp(t1 y + t2 y^2) on [0, 1] with this mean and mean square."""
    t, want, powers = np.zeros(2), np.array([mean, square]), np.stack([_Y, _Y * _Y])

    def log_sum(t: np.ndarray) -> tuple[float, np.ndarray]:
        e = t @ powers
        top = e.max()
        w = np.exp(e - top) * _DY
        return top + math.log(w.sum()), w / w.sum()

    value, w = log_sum(t)
    for _ in range(200):
        got = powers @ w
        spread = (powers * w) @ powers.T - np.outer(got, got)
        step = np.linalg.solve(spread + 1e-14 * np.eye(2), want - got)
        scale, gain = 1.0, t @ want - value
        while scale > 1e-8:
            tried = t + scale * step
            new, w_new = log_sum(tried)
            if tried @ want - new >= gain:
                break
            scale /= 2
        t, value, w = tried, new, w_new
        if np.abs(want - got).max() < 1e-12:
            break
    return float(t[0]), float(t[1]), value


def _norm(f: Facts) -> Family:
    return Family("norm", (f.mean, math.sqrt(f.m2)), f.low, f.high, -f.n / 2 * (math.log(2 * math.pi * f.m2) + 1), 2)


def _uniform(f: Facts) -> Family:
    near = (f.high - f.low) * 10 / f.n
    natural = 0 < f.low <= near and 1 - near <= f.high < 1
    low, high = (0.0, 1.0) if natural else (f.low, f.high)
    return Family("uniform", (), low, high, -f.n * math.log(high - low), 0 if natural else 2)


def _truncnorm(f: Facts) -> Family | None:
    wide = f.high - f.low
    m = (f.mean - f.low) / wide
    t1, t2, log_sum = fit_truncnorm(m, f.m2 / wide**2 + m * m)
    if t2 >= 0:
        return None
    std = math.sqrt(-0.5 / t2)
    value = f.n * (t1 * m + t2 * (f.m2 / wide**2 + m * m) - log_sum - math.log(wide))
    return Family("truncnorm", (f.low + wide * t1 * std * std, wide * std), f.low, f.high, value, 4)


def _gamma(f: Facts) -> Family | None:
    found = []
    for low, cost, log in f.lows:
        k, scale = fit_gamma(f.mean - low, log)
        found.append(Family("gamma", (k, scale), low, f.high, f.n * ((k - 1) * log - (f.mean - low) / scale - math.lgamma(k) - k * math.log(scale)), 2 + cost))
    return _shortest(found, f.n)


def _beta(f: Facts) -> Family | None:
    found = []
    for low, cost, log in f.lows:
        for high, more, rest in f.highs:
            wide = high - low
            a, b = fit_beta((f.mean - low) / wide, f.m2 / wide**2, log - math.log(wide), rest - math.log(wide))
            size = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
            value = f.n * ((a - 1) * (log - math.log(wide)) + (b - 1) * (rest - math.log(wide)) - size - math.log(wide))
            found.append(Family("beta", (a, b), low, high, value, 2 + cost + more))
    return _shortest(found, f.n)


def _shortest(found: list[Family], n: int) -> Family | None:
    """The family of the shortest description: the likelihood less half a logarithm for each parameter."""
    return min(found, key=lambda x: x.size * math.log(n) / 2 - x.log_likelihood, default=None)


FITS = {"norm": _norm, "uniform": _uniform, "truncnorm": _truncnorm, "beta": _beta, "gamma": _gamma}


def fit_family(name: str, f: Facts) -> Family | None:
    """The family with its likeliest parameters; ``auto`` is the one of the shortest description. None where it cannot be fitted."""
    if f.n < 3 or not f.m2 > 0:
        return None
    if name != "auto":
        return FITS[name](f)
    return _shortest([x for x in (fit(f) for fit in FITS.values()) if x], f.n)


def family_quantiles(family: Family, f: Facts, ps: tuple[float, ...]) -> list[float]:
    """Quantiles of a family between the least and the greatest value seen."""
    edges = np.linspace(f.low, f.high, 8193)
    x = (edges[1:] + edges[:-1]) / 2
    u = (x - family.low) / (family.high - family.low)
    if family.name == "uniform":
        log = np.zeros_like(x)
    elif family.name == "beta":
        log = (family.parameters[0] - 1) * np.log(u) + (family.parameters[1] - 1) * np.log1p(-u)
    elif family.name == "gamma":
        log = (family.parameters[0] - 1) * np.log(x - family.low) - (x - family.low) / family.parameters[1]
    else:
        log = -(((x - family.parameters[0]) / family.parameters[1]) ** 2) / 2
    return _inverse(np.exp(log - log.max()), edges, ps)


def _inverse(mass: np.ndarray, edges: np.ndarray, ps: tuple[float, ...]) -> list[float]:
    share = np.concatenate(([0.0], np.cumsum(mass)))
    return [float(v) for v in np.interp(ps, share / share[-1], edges)]


# ---- kernel density ----


def bandwidth(f: Facts, iqr: float) -> float:
    """Silverman's rule; where the middle half of the values is one value, by the deviation alone."""
    std = math.sqrt(f.m2 * f.n / (f.n - 1))
    return 0.9 * (min(std, iqr / 1.34) if iqr > 0 else std) * f.n**-0.2


def kernel_densities(counts: DataFrame, iqrs: dict[str, float], known: dict[str, Facts], points: int = GRID) -> DataFrame:
    """(column, k, x, bandwidth, share): the share of each grid point x of columns with two values or more.

    A value counts for the two points beside it, in parts by its distance, and a
    point's weight is thrown on the points around it by the kernel. What falls
    beyond an end comes back in as by a mirror there, so shares sum to 1. Points
    without a share have no row.
    """
    known = {c: f for c, f in known.items() if f.high > f.low and c in iqrs}
    steps = {c: (f.high - f.low) / (points - 1) for c, f in known.items()}
    widths = {c: bandwidth(f, iqrs[c]) for c, f in known.items()}
    kernels = {}
    for c, h in widths.items():
        reach = min(points - 1, math.ceil(REACH * h / steps[c]))
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) * steps[c] / h) ** 2)
        kernels[c] = (k / k.sum()).tolist()
    own = counts.where(F.col("column").isin(list(known)))
    low, step, kernel = of_column({c: f.low for c, f in known.items()}), of_column(steps), of_column(kernels, "array<double>")
    at = (F.col("value") - low) / step
    k = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    beside = F.array(F.struct(k.alias("k"), (F.col("nr") * (1 - (at - k))).alias("w")), F.struct((k + 1).alias("k"), (F.col("nr") * (at - k)).alias("w")))
    binned = own.select("column", F.inline(beside)).groupBy("column", "k").agg(F.sum("w").alias("w"))
    thrown = binned.select("column", "k", "w", F.posexplode(kernel).alias("d", "p")).withColumn("to", F.col("k") + F.col("d") - F.floor(F.size(kernel) / 2).cast("int"))
    # A kernel is no longer than the grid, so one mirror is enough.
    inside = F.when(F.col("to") < 0, -F.col("to") - 1).when(F.col("to") >= points, 2 * points - 1 - F.col("to")).otherwise(F.col("to"))
    share = thrown.groupBy("column", inside.alias("k")).agg((F.sum(F.col("w") * F.col("p"))).alias("w"))
    total = of_column({c: f.n for c, f in known.items()})
    return share.select("column", "k", (low + F.col("k") * step).alias("x"), of_column(widths).alias("bandwidth"), (F.col("w") / total).alias("share"))


def density_quantiles(density: list[float], f: Facts, ps: tuple[float, ...]) -> list[float]:
    """Quantiles of a kernel density: the share of a point lies evenly around it."""
    points = len(density)
    step = (f.high - f.low) / (points - 1)
    edges = np.clip(f.low + step * (np.arange(points + 1) - 0.5), f.low, f.high)
    return _inverse(np.array(density), edges, ps)
