"""Formats of date columns that stand as text, by a vote of all their values.

Every pattern is tried on every value in one aggregate over all columns. A pattern
gets a vote for each value that it reads; the one of most votes is the column's.
Where day and month could stand either way round, a single value above 12 leaves
votes to one of them only; where no value tells, the day comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import column, reading_pattern, spark_pattern

#: Patterns in order of priority (regular expression of the form, Spark pattern).
PATTERNS = [
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{2}:\d{2}:\d{2}$", "d-M-yyyy HH:mm:ss"),
]


def votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, pattern, place, votes, n): the values of each column that each pattern reads, and all that are there.

    Null, empty and blank values have no vote. Columns of other types count as their
    text. An empty table gives no votes and n 0.
    """
    value = lambda c: F.nullif(F.trim(column(c).cast("string")), F.lit(""))
    reads = lambda c, form, pattern: F.count(F.when(value(c).rlike(form), F.try_to_timestamp(value(c), F.lit(pattern))))
    cells = [F.struct(F.lit(c).alias("column"), F.lit(pattern).alias("pattern"), F.lit(k).alias("place"), reads(c, form, pattern).alias("votes"), F.count(value(c)).alias("n")) for c in columns for k, (form, pattern) in enumerate(PATTERNS)]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def chosen(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The pattern of most votes of each column that has any; of equal ones the first."""
    best: dict[str, tuple[int, int, str]] = {}
    for r in votes(df, columns).where("votes > 0").collect() if columns else []:
        own = (-r["votes"], r["place"], r["pattern"])
        best[r["column"]] = min(best.get(r["column"], own), own)
    return {c: pattern for c, (_, _, pattern) in best.items()}


def as_dates(df: DataFrame, formats: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Text columns as dates, or as times where the format tells the hour, and the formats that were used.

    A column of which the format misses a single present value stays text, as one
    without any value does; columns of other types stay as they are.
    """
    texts = {c: spark_pattern(p) for c, p in formats.items() if c in df.columns and df.schema[c].dataType.typeName() == "string"}
    if not texts:
        return df, {}
    read = {c: F.try_to_timestamp(F.trim(column(c)), F.lit(reading_pattern(p))) for c, p in texts.items()}
    facts = df.agg(*(f(x).alias(f"{name}{i}") for i, (c, r) in enumerate(read.items()) for name, f, x in (("all", F.count, column(c)), ("read", F.count, r)))).first()
    used = {c: p for i, (c, p) in enumerate(texts.items()) if 0 < facts[f"all{i}"] == facts[f"read{i}"]}
    return df.select(*(read[c].cast("timestamp" if "H" in used[c] else "date").alias(c) if c in used else column(c) for c in df.columns)), used


def as_texts(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Dates and times in the formats that their columns were read by."""
    return df.select(*(F.date_format(column(c), spark_pattern(formats[c])).alias(c) if c in formats else column(c) for c in df.columns))
