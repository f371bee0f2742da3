"""Verdicts over findings: ladders, usability, advice, regression gate and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_OK = 0.2
MOST_ADVICE, SMALL_TABLE, MANY_VALUES = 4, 500, 50
#: Share and amount by which a guarded figure may get worse, and the direction that is better.
RELATIVE, ABSOLUTE = 0.10, 0.01
GUARDED = {"mean_score": "lower", "worst_score": "lower", "cols_failed": "lower", "sdmetrics_overall": "higher"}


def ladder(max_score: Column, n_failed: Column, n: Column) -> tuple[Column, Column]:
    """Label and risk by the largest score and the number of failed parts."""
    few = n_failed <= F.greatest(F.lit(1), F.floor(n / 3))
    none = n_failed == 0
    label = F.when(none & (max_score < 0.1), "Uitstekend").when(none, "Goed").when(few, "Matig").otherwise("Let op")
    risk = F.when(none, "laag").when(few, "matig").otherwise("hoog")
    return label, risk


def rollup(findings: DataFrame) -> DataFrame:
    """One row: n, n_failed, max_score, mean_score, worst column, label and risk."""
    out = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("n_failed"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"), F.round(F.avg("score"), 4).alias("mean_score"), F.max_by("column", F.struct("score", "column")).alias("worst_column"))
    label, risk = ladder(F.col("max_score"), F.col("n_failed"), F.col("n"))
    return out.withColumns({"label": label, "risk": risk})


def worst_component(findings: DataFrame) -> DataFrame:
    """The failing part of a sequential evaluation with the highest score; no row if none fails."""
    worst = findings.where(~F.col("ok")).agg(F.max(F.struct("score", "kind", "column")).alias("w")).where("w is not null")
    return worst.select("w.kind", "w.column", "w.score", F.lit(SCORE_OK).alias("threshold"))


def usability(distribution: Column, privacy: Column, correlation: Column, temporal: Column | None = None) -> Column:
    """hoog for high privacy risk or two other high ones; matig if any is high, medium or unknown; else laag."""
    others = [distribution, correlation, *([temporal] if temporal is not None else [])]
    high = sum((F.coalesce((x == "hoog").cast("int"), F.lit(0)) for x in others), F.lit(0))
    any_ = sum((x.isin("hoog", "matig", "onbekend").cast("int") for x in [*others, privacy]), F.lit(0))
    return F.when((privacy == "hoog") | (high >= 2), "hoog").when(any_ > 0, "matig").otherwise("laag")


def usage_recommendation(summary: DataFrame) -> DataFrame:
    """``summary`` (privacy_risk, max_score, n_failed, n, correlation_risk) with ``use`` and ``check``, codes of what it is fit for.

    ``use``: no_release, any, careful, explore or test; ``check`` names what to look at first.
    """
    _, risk = ladder(F.col("max_score"), F.col("n_failed"), F.col("n"))
    private = F.col("privacy_risk") == "hoog"
    use = F.when(private, "no_release").when((F.col("n_failed") == 0) & (F.col("max_score") < 0.1), "any").when(risk == "laag", "careful").when(risk == "matig", "explore").otherwise("test")
    check = F.when(private, "privacy").when(F.col("correlation_risk").isin("hoog", "matig"), F.concat(F.lit("correlations_"), F.col("correlation_risk"))).otherwise("none")
    return summary.withColumns({"use": use, "check": check})


def temporal_advice(findings: DataFrame, reason: str | None = None) -> DataFrame:
    """One row (risk, use, reason): whether longitudinal analyses can rest on the table; ``not_judged`` with a reason."""
    if reason:
        return findings.sparkSession.createDataFrame([("onbekend", "not_judged", reason)], "risk string, use string, reason string")
    use = F.when(F.col("risk") == "laag", "longitudinal").when(F.col("risk") == "matig", "check_transitions_and_lengths").otherwise("no_longitudinal")
    return rollup(findings).select("risk", use.alias("use"), F.lit(None).cast("string").alias("reason"))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings with the highest score first."""
    return findings.orderBy(F.desc_nulls_last("score"), "kind", "column")


#: Labels of the score card by risk.
PRIVACY_LABELS = {"laag": "Laag risico", "matig": "Matig risico", "hoog": "Hoog risico"}
COHERENCE_LABELS = {"laag": "Goed", "matig": "Afwijkingen", "hoog": "Omgeklapt"}
NOT_COMPUTED, NO_COLUMNS = "Niet berekend", "Geen kolommen"


def distribution_verdict(findings: DataFrame) -> DataFrame:
    """One row (part, label, risk) from the scores of the columns."""
    none = F.col("n") == 0
    return rollup(findings).select(F.lit("distribution").alias("part"), F.when(none, NO_COLUMNS).otherwise(F.col("label")).alias("label"), F.when(none, "onbekend").otherwise(F.col("risk")).alias("risk"))


def _labelled(part: str, risk: Column, labels: dict[str, str], available: Column) -> list[Column]:
    told = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), risk), F.lit("Onbekend"))
    return [F.lit(part).alias("part"), F.when(available, told).otherwise(NOT_COMPUTED).alias("label"), F.when(available, risk).otherwise("onbekend").alias("risk")]


def privacy_verdict(privacy: DataFrame) -> DataFrame:
    """One row (part, label, risk) from a privacy evaluation."""
    return privacy.select(*_labelled("privacy", F.col("risk_level"), PRIVACY_LABELS, F.col("available")))


def coherence_verdict(risk: DataFrame, available: bool = True) -> DataFrame:
    """One row (part, label, risk) from the risk of correlations; not computed with fewer than two numeric columns."""
    return risk.select(*_labelled("coherence", F.col("risk"), COHERENCE_LABELS, F.lit(available)))


def improvement_advice(findings: DataFrame, hints: DataFrame, profile: DataFrame, n_rows: int, privacy_risk: str = "onbekend", correlation: str = "laag", temporal_kind: str | None = None, synthesizer: str | None = None, distributions: dict[str, str] | None = None) -> DataFrame:
    """(rank, topic, column, action): at most four, privacy and time first, then failing columns by score.

    A failing column gets one action: another type if a hint says so, another
    distribution if it lost a peak, else fewer values if it is a category of many.
    """
    spark = findings.sparkSession
    head = [("privacy", None, "mark_identifiers")] * (privacy_risk == "hoog")
    if temporal_kind:
        head.append(("time", temporal_kind, {"par": "train_longer", "sequential_copula": "model_sequences_directly"}.get(synthesizer or "", "check_key_and_index")))
    tail = [("correlation", None, "fix_relations")] * (correlation != "laag") + [("rows", None, "add_rows")] * (n_rows < SMALL_TABLE)
    kde = [c for c, d in (distributions or {}).items() if d == "gaussian_kde"]
    own = findings.where(~F.col("ok")).join(hints.where("suggested_sdtype <> detected_sdtype").select("column", "suggested_sdtype"), "column", "left").join(profile.select("column", "n_unique"), "column", "left")
    action = F.when(F.col("suggested_sdtype").isNotNull(), F.concat(F.lit("change_type_to_"), F.col("suggested_sdtype"))).when(F.col("modal_warning").isNotNull() & F.col("column").isin(kde), "add_rows_or_accept").when(F.col("modal_warning").isNotNull(), "try_another_distribution").when((F.col("dtype") == "categorical") & (F.col("n_unique") > MANY_VALUES), "group_or_drop_values")
    columns = own.withColumn("action", action).where("action is not null").select(F.lit("column").alias("topic"), "column", "action", F.lit(1).alias("part"), (-F.col("score")).alias("sort"))
    fixed = spark.createDataFrame([(*h, 0 if i < len(head) else 2, float(i)) for i, h in enumerate(head + tail)], "topic string, column string, action string, part int, sort double")
    every = columns.unionByName(fixed).orderBy("part", "sort", "column").limit(MOST_ADVICE)
    return every.withColumn("rank", F.row_number().over(Window.orderBy("part", "sort", "column"))).select("rank", "topic", "column", "action")


def regressions(baseline: DataFrame, current: DataFrame, guarded: dict[str, str] | None = None) -> DataFrame:
    """(dataset, metric, baseline, current) of guarded figures that got worse; datasets without a figure give ``run failed``."""
    guarded = guarded or GUARDED
    cells = lambda df: F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(d).alias("better"), F.col(m).cast("double").alias("value")) for m, d in guarded.items() if m in df.columns))
    b = baseline.select("dataset", F.inline(cells(baseline))).withColumnRenamed("value", "old")
    c = current.select("dataset", F.inline(cells(current))).select("dataset", "metric", F.col("value").alias("new"))
    both = b.join(c, ["dataset", "metric"])
    worse = F.when(F.col("better") == "lower", F.col("new") > F.col("old") * (1 + RELATIVE) + ABSOLUTE).otherwise(F.col("new") < F.col("old") * (1 - RELATIVE) - ABSOLUTE)
    failed = both.groupBy("dataset").agg(F.count("new").alias("k")).where("k = 0").select("dataset", F.lit("run failed").alias("metric"), F.lit(None).cast("double").alias("baseline"), F.lit(None).cast("double").alias("current"))
    return both.where(worse).select("dataset", "metric", F.col("old").alias("baseline"), F.col("new").alias("current")).unionByName(failed)


def top_deviating(findings: DataFrame, n: int = 8) -> DataFrame:
    return findings.select("column", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "column").limit(n)


def validation_report(findings: DataFrame, privacy: DataFrame, quality: DataFrame, parameters: dict, sequential: DataFrame | None = None) -> dict:
    """All figures of a validation as one dictionary; findings have one row a column."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = dict(parameters) | {"column_stats": rows(findings.orderBy("column")), "privacy": privacy.first().asDict(), "quality": {r["property"]: r["score"] for r in quality.collect()}, "summary": rollup(findings).first().asDict()}
    if sequential is not None:
        own = rows(sequential)
        out["temporal"] = {"available": bool(own), "columns": own, "passed": all(r["ok"] for r in own)}
    return out


def markdown(report: dict) -> str:
    """A report as Markdown: verdict, columns, privacy."""
    lines = ["# Validation", "", f"Verdict: {report['summary']['label']} ({report['summary']['risk']})", "", "| column | type | metric | score | ok |", "|---|---|---|---|---|"]
    lines += [f"| {r['column']} | {r['dtype']} | {r['metric']} | {r['score']:.3f} | {'✓' if r['ok'] else '✗'} |" for r in report["column_stats"]]
    lines += ["", "| privacy | value |", "|---|---|", *(f"| {k} | {'—' if v is None else v} |" for k, v in report["privacy"].items())]
    return "\n".join(lines) + "\n"
