"""Benchmark runs: one summary row and the detail rows of each data set, and the run's parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distances import correlation_risk, evaluate, evaluate_pairs, quality
from ..operators.privacy import capped, evaluate_privacy
from ..operators.sequences import evaluate_sequential
from .verdicts import GUARDED, regressions, rollup

#: Rows of a benchmark table, and the bounds of what a run may ask for.
ROW_CAP = 5000
BOUNDS = {"rows": (10, 500_000), "sequences": (1, 100_000), "demo_sequences": (1, 10_000), "epochs": (10, 256), "seed": (0, 2**32 - 1)}

#: Guarded figures of longitudinal runs and which way is better.
SEQUENTIAL_GUARDED = {"length_distance": "lower", "temporal_worst": "lower", "temporal_failed": "lower"}
TRACKS = {"tabular": GUARDED, "sequential": SEQUENTIAL_GUARDED}


@dataclass(frozen=True)
class RunConfig:
    """What a run may ask for; values outside the bounds are refused."""

    rows: int | None = None
    sequences: int | None = None
    demo_sequences: int | None = None
    epochs: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} is {value}, outside {low} to {high}")


def details(runs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(dataset, then the findings of each column) of all data sets."""
    parts = [evaluate(real, synth).select(F.lit(name).alias("dataset"), "*") for name, (real, synth) in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(runs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(dataset, mean_score, worst_score, worst_column, cols_failed, n_cols, corr_flagged, corr_max_delta, corr_risk): a row for each data set."""
    out = None
    for name, (real, synth) in runs.items():
        pairs = evaluate_pairs(real, synth).persist()
        found = rollup(evaluate(real, synth)).select(F.lit(name).alias("dataset"), "mean_score", F.round("max_score", 4).alias("worst_score"), "worst_column", F.col("n_failed").alias("cols_failed"), F.col("n").alias("n_cols"))
        flagged = pairs.agg(F.count(F.lit(1)).alias("corr_flagged"), F.coalesce(F.max("delta"), F.lit(0.0)).alias("corr_max_delta"))
        one = found.crossJoin(flagged).crossJoin(correlation_risk(pairs).select(F.col("risk").alias("corr_risk")))
        out = one if out is None else out.unionByName(one)
    return out


def run_dataset(name: str, real: DataFrame, synth: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """The summary of a capped table, with overall quality and privacy."""
    r, s = (capped(df, id_col, ROW_CAP, seed) for df in (real, synth))
    own = summary({name: (r.drop(id_col), s.drop(id_col))})
    overall = quality(r.drop(id_col), s.drop(id_col)).where("property = 'Overall'").select(F.round("score", 4).alias("sdmetrics_overall"))
    privacy = evaluate_privacy(r, s, id_col, seed=seed).select(F.col("risk_level").alias("privacy"), "dcr_ratio")
    return own.crossJoin(overall).crossJoin(privacy)


def run_sequential_dataset(name: str, real: DataFrame, synth: DataFrame, key: str, index: str, tie: str | None = None) -> DataFrame:
    """(dataset, length_distance, temporal_worst, temporal_failed, verdict, risk) of a longitudinal pair."""
    found = evaluate_sequential(real, synth, key, index, tie=tie).persist()
    length = found.agg(F.max(F.when(F.col("kind") == "length", F.col("score"))).alias("length_distance"))
    return rollup(found).select(F.lit(name).alias("dataset"), F.col("max_score").alias("temporal_worst"), F.col("n_failed").alias("temporal_failed"), F.col("label").alias("verdict"), "risk").crossJoin(length)


def write_baseline(path: str, config: RunConfig, tracks: dict[str, DataFrame]) -> None:
    """Today's summaries as the mark that later runs are held against: one row a data set in each of ``TRACKS``."""
    if unknown := set(tracks) - set(TRACKS):
        raise ValueError(f"no such track: {sorted(unknown)}")
    own = {t: [r.asDict() for r in df.orderBy("dataset").collect()] for t, df in tracks.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"run": asdict(config), "row_cap": ROW_CAP, "tracks": own}, f, indent=2, ensure_ascii=False)


def gate(path: str, tracks: dict[str, DataFrame]) -> DataFrame:
    """(track, dataset, metric, baseline, current): guarded figures that are worse than in a baseline file.

    A track or data set that the file does not have has nothing to be held against.
    """
    with open(path, encoding="utf-8") as f:
        marks = json.load(f)["tracks"]
    out = None
    for track, now in tracks.items():
        spark, names = now.sparkSession, [m for m in TRACKS[track] if m in now.columns]
        before = [(m["dataset"], *(None if m.get(c) is None else float(m[c]) for c in names)) for m in marks.get(track, [])]
        old = spark.createDataFrame(before, ", ".join(["dataset string", *(f"{c} double" for c in names)]))
        one = regressions(old, now, TRACKS[track]).select(F.lit(track).alias("track"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def markdown_table(rows: DataFrame) -> str:
    """A summary, one row a data set, as a Markdown table."""
    names = rows.columns
    cells = [["—" if r[c] is None else f"{r[c]:.4g}" if isinstance(r[c], float) else str(r[c]) for c in names] for r in rows.orderBy(names[0]).collect()]
    return "\n".join(f"| {' | '.join(x)} |" for x in [names, ["---"] * len(names), *cells]) + "\n"


def reproduction(source: str, target: str, config: RunConfig, schema: str | None = None) -> str:
    """The commands that repeat a run."""
    more = "".join(f" --{k} {v}" for k, v in (("schema", schema), ("rows", config.rows), ("seed", config.seed)) if v is not None)
    return f"python -m synthspark.cli synthesize {source} {target}{more}\npython -m synthspark.cli validate {source} {target}\n"
