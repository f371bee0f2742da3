"""Metrics of longitudinal tables: transitions, autocorrelation, lengths, trajectories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_numeric, is_position
from .distances import SCORE_OK, both, counted, numeric_distances

#: Rows that a partition of whole sequences holds, about.
PART_ROWS = 250_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, dealt by it to partitions of about ``PART_ROWS`` rows, so that the memory of a task does not grow with the table.

    It counts ``df``, so it is for tables and what is kept. Groupings by the key,
    or by it and others, need no shuffle after it.
    """
    own = df.where(F.col(key).isNotNull())
    return own.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(own.count() / PART_ROWS)), key)


def in_order(key: str, index: str, tie: str | None = None):
    """Window of a sequence: by index, nulls last, then by a tie-breaking column."""
    return Window.partitionBy("src", key).orderBy(F.col(index).asc_nulls_last(), *([F.col(tie)] if tie else []))


def transition_pairs(df: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> DataFrame:
    """(src, f, t): each value and the next one of its sequence; a null target is kept, null keys are left out."""
    own = df if "src" in df.columns else df.withColumn("src", F.lit("r"))
    w = in_order(key, index, tie)
    step = own.where(F.col(key).isNotNull()).select("src", F.col(column).alias("f"), F.lead(column).over(w).alias("t"), F.lead(F.lit(1)).over(w).alias("more"))
    return step.where("more is not null").select("src", "f", "t")


def transition_matrix(df: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> DataFrame:
    """(f, t, n, p): counts and row shares of successive states."""
    n = transition_pairs(df, key, index, column, tie).where("f is not null and t is not null").groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("f")))


def aligned_matrices(real: DataFrame, synth: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> DataFrame:
    """(f, t, real_p, synth_p) over all states of either table; empty if the real table has no transition."""
    r, s = (transition_matrix(df, key, index, column, tie).select("f", "t", "p") for df in (real, synth))
    states = r.select(F.explode(F.array("f", "t")).alias("x")).unionByName(s.select(F.explode(F.array("f", "t")).alias("x"))).distinct()
    # States are categories of one column: their square is the size of the matrix that is asked for.
    grid = states.select(F.col("x").alias("f")).crossJoin(states.select(F.col("x").alias("t"))).join(r.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_semi")
    out = grid.join(r.withColumnRenamed("p", "rp"), ["f", "t"], "left").join(s.withColumnRenamed("p", "sp"), ["f", "t"], "left")
    return out.select("f", "t", F.coalesce("rp", F.lit(0.0)).alias("real_p"), F.coalesce("sp", F.lit(0.0)).alias("synth_p"))


def transition_distance(real: DataFrame, synth: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> DataFrame:
    """(distance): total variation of the rows of both matrices, weighted by how often the real table leaves a state."""
    pairs = transition_pairs(both(real, synth), key, index, column, tie)
    n = pairs.where("f is not null and t is not null").groupBy("src", "f", "t").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src", "f")))
    wide = p.groupBy("f", "t").agg(F.coalesce(F.max(F.when(F.col("src") == "r", F.col("p"))), F.lit(0.0)).alias("pr"), F.coalesce(F.max(F.when(F.col("src") == "s", F.col("p"))), F.lit(0.0)).alias("ps"))
    rows = wide.groupBy("f").agg((0.5 * F.sum(F.abs(F.col("pr") - F.col("ps")))).alias("tv"), F.sum("pr").alias("any"))
    leave = pairs.where("src = 'r' and f is not null").groupBy("f").agg(F.count(F.lit(1)).alias("k"))
    share = leave.crossJoin(F.broadcast(leave.agg(F.sum("k").alias("total"))))
    return rows.where(F.col("any") > 0).join(share, "f").agg(F.sum(F.col("tv") * F.col("k") / F.col("total")).alias("distance"))


def mean_autocorrelation(df: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> DataFrame:
    """(src, r): the mean over sequences of the correlation of a value with the one before."""
    own = (df if "src" in df.columns else df.withColumn("src", F.lit("r"))).where(F.col(key).isNotNull())
    y = F.col(column).try_cast("double")
    step = own.select("src", F.col(key).alias("k"), y.alias("y"), F.lag(y).over(in_order(key, index, tie)).alias("x"))
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, z = F.when(pair, F.col("x")), F.when(pair, F.col("y"))
    per = step.groupBy("src", "k").agg(F.stddev_samp("y").alias("sd"), F.count(F.lit(1)).alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(z).alias("sy"), F.covar_pop(x, z).alias("c"))
    r = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy")))
    return per.where("n >= 2 and sd > 0").select("src", r.alias("r")).groupBy("src").agg(F.avg("r").alias("r"))


def lengths(df: DataFrame, key: str) -> DataFrame:
    """(src, key, n): rows of each sequence."""
    own = df if "src" in df.columns else df.withColumn("src", F.lit("r"))
    return own.where(F.col(key).isNotNull()).groupBy("src", F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def length_distance(real: DataFrame, synth: DataFrame, key: str) -> DataFrame:
    """(distance): Wasserstein distance of sequence lengths over the spread of the real ones."""
    n = lengths(both(real, synth), key).select("src", F.lit("length").alias("column"), F.col("n").cast("double").alias("value"))
    return numeric_distances(counted(n)).select((F.col("distance") / F.col("spread")).alias("distance"))


def sequential_reason(real: DataFrame, synth: DataFrame, key: str, index: str) -> str | None:
    """Why a longitudinal comparison is not possible: the key or index column that a table lacks."""
    missing = [c for c in (key, index) if c not in real.columns or c not in synth.columns]
    return f"missing column: {missing[0]}" if missing else None


def sequential_features(real: DataFrame, synth: DataFrame, key: str, index: str, meta: dict | None = None) -> dict[str, str]:
    """``autocorrelation`` or ``transition`` for each shared column; ids, dates, the key and the index are left out.

    Metadata decides on the type; without it, a column is a number if it is one in both tables.
    """
    kinds = {c: m.get("sdtype") for c, m in ((meta or {}).get("columns") or {}).items()}
    shared = [c for c in real.columns if c in synth.columns and c not in (key, index) and kinds.get(c) not in ("id", "datetime") and not is_position(real.schema[c].dataType)]
    number = lambda c: kinds.get(c) == "numerical" or (kinds.get(c) is None and is_numeric(real.schema[c].dataType) and is_numeric(synth.schema[c].dataType))
    return {c: "autocorrelation" if number(c) else "transition" for c in shared}


def evaluate_sequential(real: DataFrame, synth: DataFrame, key: str, index: str, features: list[str] | None = None, tie: str | None = None, meta: dict | None = None) -> DataFrame:
    """(column, kind, score, ok): transitions of categories, autocorrelation of numbers, and the lengths.

    The score of an autocorrelation is the difference of both means. Without the
    key or index in either table (``sequential_reason``) there are no rows.
    """
    if sequential_reason(real, synth, key, index):
        return real.sparkSession.createDataFrame([], "column string, kind string, score double, ok boolean")
    parts = []
    keep = [key, index, *([tie] if tie else [])]
    kinds = sequential_features(real, synth, key, index, meta)
    for c in kinds if features is None else [c for c in features if c in kinds]:
        r, s = (df.select(*dict.fromkeys([*keep, c])) for df in (real, synth))
        if kinds[c] == "autocorrelation":
            a = mean_autocorrelation(both(r, s), key, index, c, tie)
            score = a.agg(F.abs(F.max(F.when(F.col("src") == "r", F.col("r"))) - F.max(F.when(F.col("src") == "s", F.col("r")))).alias("score"))
            parts.append(score.select(F.lit(c).alias("column"), F.lit("autocorrelation").alias("kind"), "score"))
        else:
            parts.append(transition_distance(r, s, key, index, c, tie).select(F.lit(c).alias("column"), F.lit("transition").alias("kind"), F.col("distance").alias("score")))
    parts.append(length_distance(real, synth, key).select(F.lit(None).cast("string").alias("column"), F.lit("length").alias("kind"), F.col("distance").alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("score is not null").select("column", "kind", F.round("score", 4).alias("score"), (F.col("score") < SCORE_OK).alias("ok"))


def mean_trajectory(df: DataFrame, index: str, column: str) -> DataFrame:
    return df.where(F.col(index).isNotNull()).groupBy(F.col(index).alias("step")).agg(F.avg(column).alias("mean"))


def state_distribution(df: DataFrame, index: str, column: str) -> DataFrame:
    """(step, state, share): row-normalised counts of states at each step."""
    n = df.where(F.col(index).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(index).alias("step"), F.col(column).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("step", "state", (F.col("n") / F.sum("n").over(Window.partitionBy("step"))).alias("share"))


def terminal_states(df: DataFrame, key: str, index: str, column: str, tie: str | None = None) -> DataFrame:
    """(state): states that never have a successor."""
    own = df.where(F.col(key).isNotNull()).withColumn("src", F.lit("r"))
    step = own.select(F.col(column).alias("state"), F.lead(F.lit(1)).over(in_order(key, index, tie)).alias("more"))
    return step.where("state is not null").groupBy("state").agg(F.max("more").alias("more")).where("more is null").select("state")


def to_wide(df: DataFrame, key: str, index: str, features: list[str], levels: list, tie: str | None = None) -> DataFrame:
    """One row a sequence: ``feature__tN`` for each level of the index, and ``__seq_len__``.

    Of several rows of a level the one with the greatest ``tie`` wins, without a
    tie column the greatest value; nulls never do.
    """
    position = F.array_position(F.array(*(F.lit(x) for x in levels)), F.col(index))
    own = df.where(F.col(key).isNotNull() & F.col(index).isNotNull()).withColumn("pos", position)

    def cell(f: str, i: int) -> Column:
        there = (F.col("pos") == i) & F.col(f).isNotNull()
        return F.max_by(F.when(there, F.col(f)), F.when(there, F.struct(*([tie] if tie else []), f))).alias(f"{f}__t{i}")

    cells = [cell(f, i) for i in range(1, len(levels) + 1) for f in features]
    return own.groupBy(key).agg(*cells, F.count(F.lit(1)).alias("__seq_len__"))


def to_long(wide: DataFrame, key: str, features: list[str], n_levels: int, length: Column) -> DataFrame:
    """(key, pos, features): the first ``length`` steps of each wide row."""
    steps = F.array(*(F.struct(F.lit(i).alias("pos"), *(F.col(f"{f}__t{i}").alias(f) for f in features)) for i in range(1, n_levels + 1)))
    kept = F.greatest(F.lit(1), F.least(length, F.lit(n_levels)))
    return wide.select(key, F.explode(F.slice(steps, F.lit(1), kept.cast("int"))).alias("s")).select(key, "s.*")


def forward_fill(df: DataFrame, key: str, index: str, columns: dict[str, Column], tie: str | None = None) -> DataFrame:
    """Nulls take the last value before them in the sequence, else a fallback."""
    w = Window.partitionBy(key).orderBy(F.col(index).asc_nulls_last(), *([F.col(tie)] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), fallback) for c, fallback in columns.items()})


def until_terminal(long: DataFrame, key: str, pos: str, column: str, terminal: list) -> DataFrame:
    """Rows up to and with the first terminal state."""
    first = F.min(F.when(F.col(column).isin(terminal), F.col(pos))).over(Window.partitionBy(key))
    return long.withColumn("__end", first).where(F.col("__end").isNull() | (F.col(pos) <= F.col("__end"))).drop("__end")


def sequence_fields(modality: str, meta: dict | None) -> tuple[str, str] | None:
    """Key and index of sequences by the metadata; None for other tables or where one is not told."""
    told = tuple((meta or {}).get(k) for k in ("sequence_key", "sequence_index"))
    return told if modality == "sequential" and all(told) else None


def sequential_report(real: DataFrame, synth: DataFrame, modality: str, meta: dict | None) -> DataFrame | None:
    """``evaluate_sequential`` of a table whose metadata tell its sequences, else None."""
    fields = sequence_fields(modality, meta)
    return None if fields is None else evaluate_sequential(real, synth, *fields, meta=meta)
