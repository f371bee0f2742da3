"""Models of longitudinal tables: a copula over wide sequences, and a Markov chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_numeric, is_position, uniform
from .copula import CopulaModel, fit, sample
from .profile import mode_value, quantiles
from .sequences import lengths, terminal_states, to_long, to_wide, transition_matrix

LENGTH = "__seq_len__"
#: Time steps that a model may have.
MOST_LEVELS = 1000


@dataclass
class SequenceModel:
    key: str
    index: str
    features: list[str]
    levels: list
    terminal: dict[str, list]
    fallback: dict[str, object]
    copula: CopulaModel
    columns: list[str]
    types: dict[str, str]


def fit_sequences(df: DataFrame, key: str, index: str, seed: int = 42, tie: str | None = None) -> SequenceModel:
    """Fit one row a sequence; refuses tables too small for their number of steps and features."""
    kept = df.storageLevel.useMemory or df.storageLevel.useDisk
    rows = df if kept else df.persist()
    try:
        return _fitted(rows, key, index, seed, tie)
    finally:
        if not kept:
            rows.unpersist()


def _fitted(df: DataFrame, key: str, index: str, seed: int, tie: str | None) -> SequenceModel:
    """The model of rows that are kept, for they are read for each of its parts."""
    features = [c for c in df.columns if c not in (key, index) and not is_position(df.schema[c].dataType)]
    levels = sorted(r[0] for r in df.where(F.col(index).isNotNull()).select(index).distinct().limit(MOST_LEVELS + 1).collect())
    entities = df.select(F.count_distinct(key)).first()[0]
    if len(levels) < 2 or entities < 2:
        raise ValueError("a longitudinal table needs two time steps and two entities")
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} time steps")
    if len(features) * len(levels) >= entities:
        raise ValueError(f"{len(features)} features at {len(levels)} steps are too many for {entities} entities")
    texts = [c for c in features if not is_numeric(df.schema[c].dataType)]
    numbers = [c for c in features if c not in texts]
    fallback: dict = {r["column"]: r["value"] for r in mode_value(df, texts).collect()} if texts else {}
    if numbers:
        fallback |= {r["column"]: r["value"] for r in quantiles(df, numbers, [0.5]).collect()}
    terminal = {c: sorted(r[0] for r in terminal_states(df, key, index, c, tie).collect()) for c in texts}
    # The fit reads the wide rows several times.
    wide = to_wide(df, key, index, features, levels, tie).drop(key).persist()
    model = fit(wide, seed=seed, keys=[], distributions={}, presence=False)
    wide.unpersist()
    return SequenceModel(key, index, features, levels, terminal, fallback, model, [c for c in df.columns if c in (key, index, *features)], {f.name: f.dataType.simpleString() for f in df.schema.fields})


def sample_sequences(spark: SparkSession, model: SequenceModel, n: int, seed: int | None = None) -> DataFrame:
    """``n`` sequences with ids 1..n: contiguous steps, none after a terminal state, gaps filled forward."""
    wide = _numbered(spark, model, n, seed)
    long = to_long(wide, "__id", model.features, len(model.levels), F.coalesce(F.bround(LENGTH), F.lit(len(model.levels))))
    for c, states in model.terminal.items():
        if states:
            end = F.min(F.when(F.col(c).isin(states), F.col("pos"))).over(Window.partitionBy("__id"))
            long = long.withColumn("__end", end).where(F.col("__end").isNull() | (F.col("pos") <= F.col("__end"))).drop("__end")
    w = Window.partitionBy("__id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = long.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(model.fallback.get(c)).cast(model.types[c])) for c in model.features})
    level = F.element_at(F.array(*(F.lit(x) for x in model.levels)), F.col("pos"))
    out = filled.withColumns({model.index: level, model.key: F.col("__id")})
    return out.select(*(F.col(c).cast("string").try_cast(model.types[c]).alias(c) for c in model.columns))


def _numbered(spark: SparkSession, model: SequenceModel, n: int, seed: int | None) -> DataFrame:
    """The wide sample with its row number as a column."""
    wide = CopulaModel(model.copula.marginals, model.copula.factor, [*model.copula.order, "__id"], model.copula.types | {"__id": "bigint"}, model.copula.constraints, model.copula.seed, model.copula.keys)
    return sample(spark, wide, n, seed, id_col="__id")


@dataclass
class MarkovModel:
    key: str
    index: str
    column: str
    start: list[tuple]
    steps: dict
    lengths: list[tuple]


def _shares(rows: list[tuple]) -> list[tuple]:
    total, at, out = sum(n for _, n in rows), 0, []
    for value, n in sorted(rows, key=lambda r: str(r[0])):
        at += n
        out.append((value, at / total))
    return out


def fit_markov(df: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> MarkovModel:
    """First-order chain of one state column: start shares, transitions and lengths. It stands in for a neural model."""
    w = Window.partitionBy(key).orderBy(F.col(index).asc_nulls_last(), *([F.col(tie)] if tie else []))
    first = df.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").groupBy(column).count().where(F.col(column).isNotNull()).collect()
    steps: dict = {}
    for r in transition_matrix(df, key, index, column, tie).collect():
        steps.setdefault(r["f"], []).append((r["t"], r["n"]))
    n = lengths(df, key).groupBy("n").count().collect()
    return MarkovModel(key, index, column, _shares([(r[0], r[1]) for r in first]), {f: _shares(t) for f, t in steps.items()}, _shares([(r[0], r[1]) for r in n]))


def _drawn(shares: list[tuple], u: Column) -> Column:
    out = F.lit(shares[-1][0])
    for value, limit in reversed(shares[:-1]):
        out = F.when(u < limit, F.lit(value)).otherwise(out)
    return out


def sample_markov(spark: SparkSession, model: MarkovModel, n: int, seed: int = 42) -> DataFrame:
    """``n`` sequences (key 1..n, index 1..k, state); a state without successor ends its sequence."""
    most = max(v for v, _ in model.lengths)
    rows = spark.range(1, n + 1).select(F.col("id").alias(model.key), _drawn(model.lengths, uniform(F.col("id"), f"{seed}/n")).alias("__n"), _drawn(model.start, uniform(F.col("id"), f"{seed}/0")).alias("__s1"))
    draws = rows.withColumn("__u", F.array(*(uniform(F.col(model.key), f"{seed}/{k}") for k in range(2, most + 1))) if most > 1 else F.array().cast("array<double>"))

    def step(path: Column, u: Column) -> Column:
        at, after = F.element_at(path, -1), F.lit(None).cast("string")
        for state, shares in model.steps.items():
            after = F.when(at == state, _drawn(shares, u)).otherwise(after)
        return F.when((F.size(path) < F.col("__n")) & at.isin(list(model.steps)), F.concat(path, F.array(after))).otherwise(path)

    path = F.aggregate("__u", F.array(F.col("__s1").cast("string")), step)
    out = draws.select(model.key, F.posexplode(path).alias("__k", model.column))
    return out.select(model.key, (F.col("__k") + 1).cast("long").alias(model.index), model.column)
