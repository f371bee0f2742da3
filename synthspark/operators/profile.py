"""Profiles of the columns of one table: counts, skewness, type hints, sequence columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import column as named
from ..functions.scalars import date_format_of, is_numeric, is_position, is_time, present
from .distances import cumulative, long_values

#: Limits of the skewness rule.
MIN_UNIQUE, SKEW, MODE_SHARE = 20, 2.0, 0.5
#: Parts of column names that speak for a time index or an entity key.
INDEX_NAMES = ("jaar", "year", "datum", "date", "periode", "tijd", "maand", "kwartaal")
KEY_NAMES = ("id", "nummer", "sleutel", "key", "student", "instelling", "pgn", "bsn")
CARDINALITY_LIMIT = 0.5


def _cells(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, Column]]:
    return [(c, present(named(c), df.schema[c].dataType)) for c in (columns or df.columns)]


def values_of(df: DataFrame) -> list[str]:
    """The columns but those that tell a row's place in its input."""
    return [f.name for f in df.schema.fields if not is_position(f.dataType)]


def _names(spark, df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [(i, c, is_numeric(df.schema[c].dataType), df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long"), is_time(df.schema[c].dataType), df.schema[c].dataType.typeName() == "string", df.schema[c].dataType.typeName() == "boolean") for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "pos int, column string, numeric boolean, integral boolean, time boolean, text boolean, flag boolean")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) without nulls."""
    own = df.where(named(column).isNotNull()).groupBy(named(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("t")))).select("value", "n", (F.col("n") / F.col("t")).alias("share"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_null, null_fraction, n_unique, low, high, pos and type flags); low and high of numbers."""
    columns = columns or values_of(df)
    spark = df.sparkSession
    cells = F.array(*(F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"), (v.cast("double") if is_numeric(df.schema[c].dataType) else F.lit(None).cast("double")).alias("number")) for c, v in _cells(df, columns)))
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    null = F.col("value").isNull()
    stats = counts.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("n_null"), F.count_if(~null).alias("n_unique"), F.min("lo").alias("low"), F.max("hi").alias("high"))
    return stats.join(_names(spark, df, columns), "column").withColumn("null_fraction", F.col("n_null") / F.col("n_rows"))


def high_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ratio, excluded): distinct values over rows, excluded above a half."""
    ratio = F.col("n_unique") / F.col("n_rows")
    return column_profile(df, columns).select("column", ratio.alias("ratio"), (ratio > CARDINALITY_LIMIT).alias("excluded"))


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique, g1, mode_share, skewed): bias-corrected skewness, and whether a normal marginal fits badly."""
    values = long_values(_cells(df, columns), df, "double", key=[])
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.groupBy("column").agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    d = F.col("value") - F.col("mean")
    m2, m3 = F.sum(F.col("n") * d * d) / F.max("t"), F.sum(F.col("n") * d * d * d) / F.max("t")
    t = F.max("t")
    g1 = F.when((m2 > 0) & (t > 2), m3 / F.pow(m2, 1.5) * F.sqrt(t * (t - 1)) / (t - 2))
    out = counts.join(F.broadcast(mean), "column").groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), g1.alias("g1"), (F.max("n") / t).alias("mode_share"))
    skewed = (F.col("n_unique") >= MIN_UNIQUE) & ((F.abs(F.coalesce("g1", F.lit(0.0))) >= SKEW) | (F.col("mode_share") >= MODE_SHARE))
    return out.withColumn("skewed", skewed)


def recommend_distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distribution): ``gaussian_kde`` for skewed columns; the others keep the default and are not listed."""
    return skewness(df, columns).where("skewed").select("column", F.lit("gaussian_kde").alias("distribution"))


def number_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, nr, ns): how often each number is there; ns is 0."""
    return long_values(_cells(df, columns), df, "double", key=[]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("nr"), F.lit(0).cast("long").alias("ns"))


def quantiles(df: DataFrame, columns: list[str], ps: list[float]) -> DataFrame:
    """(column, p, value): exact quantiles with linear interpolation, from blocked cumulative counts."""
    return quantiles_of(number_counts(df, columns).persist(), ps)


def quantiles_of(counts: DataFrame, ps: list[float]) -> DataFrame:
    """``quantiles`` from the counts of ``number_counts``."""
    c = cumulative(counts)
    low = lambda p: F.floor((F.col("tr") - 1) * p)
    holds = lambda k: (F.col("cr") > k) & (F.col("cr") - F.col("nr") <= k)
    # Only the values at the ranks beside a quantile go on.
    hit = F.filter(F.array(*(F.lit(float(p)) for p in ps)), lambda p: holds(low(p)) | holds(F.least(low(p) + 1, F.col("tr") - 1)))
    each = c.withColumn("p", F.explode(hit)).withColumn("h", (F.col("tr") - 1) * F.col("p"))
    at = lambda k: F.max(F.when(holds(k), F.col("value")))
    a, b = at(low(F.col("p"))), at(F.least(low(F.col("p")) + 1, F.col("tr") - 1))
    return each.groupBy("column", "p").agg((a + (b - a) * F.max(F.col("h") - F.floor("h"))).alias("value"))


def date_formats(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(column, format) from the first ten present strings of each column in the order of a key column; null if none fits."""
    parts = []
    for c in columns:
        first = df.where(named(c).isNotNull()).orderBy(named(order)).limit(10).agg(F.collect_list(F.trim(named(c))).alias("v"))
        parts.append(first.select(F.lit(c).alias("column"), date_format_of(F.col("v"), F.size("v")).alias("format")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detected(profile: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """``profile`` with ``sdtype``: id, categorical, numerical or datetime."""
    own = profile.join(formats, "column", "left") if formats is not None else profile.withColumn("format", F.lit(None).cast("string"))
    unique = (F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 5)
    few = F.col("integral") & (F.col("low") >= 0) & (F.col("n_unique") <= F.least(F.round(F.col("n_rows") / 10), F.lit(10)))
    kind = F.when(F.col("time"), "datetime").when(F.col("numeric"), F.when(F.col("integral") & unique, "id").when(few, "categorical").otherwise("numerical"))
    return own.withColumn("sdtype", kind.when(F.col("text") & F.col("format").isNotNull(), "datetime").when(F.col("text") & unique, "id").otherwise("categorical"))


def column_hints(df: DataFrame, columns: list[str] | None = None, order: str | None = None, raw: bool = True) -> DataFrame:
    """(column, detected_sdtype, suggested_sdtype, confidence, rule): likely wrong column types; the first rule that fits counts.

    small_code: few small integers; four_digits: integers from 1000 to 9999;
    date: text in a date format; missing: above 30 % null, no other type meant.
    Columns without a value, and those where no rule fits, give no row. An integer
    column with nulls is no integer column here. Dates that stand as text count as
    categories or ids until the hint.
    """
    columns = columns or values_of(df)
    texts = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    formats = date_formats(df, texts, order) if texts and order else None
    own = detected(column_profile(df, columns), None)
    own = own.drop("format").join(formats, "column", "left") if formats is not None else own
    whole = F.col("integral") & (F.col("n_null") == 0)
    small = whole & (F.col("sdtype") == "numerical") & (F.col("n_unique") <= 15) & (F.col("high") <= 100)
    digits = whole & F.col("sdtype").isin("numerical", "id") & (F.col("low") >= 1000) & (F.col("high") <= 9999)
    date = F.col("text") & F.col("sdtype").isin("categorical", "id") & F.col("format").isNotNull()
    missing = F.col("null_fraction") > 0.3
    rule = F.when(small, "small_code").when(digits, "four_digits").when(date, "date").when(missing, "missing")
    suggested = F.when(F.col("rule").isin("small_code", "four_digits"), "categorical").when(F.col("rule") == "date", "datetime").otherwise(F.col("sdtype"))
    confidence = F.when((F.col("rule") == "small_code") & (F.col("n_unique") <= 5), 0.9).when(F.col("rule") == "small_code", 0.65).when(F.col("rule") == "four_digits", 0.7).when(F.col("rule") == "date", 0.8).otherwise(0.0)
    return own.where(F.col("n_unique") > 0).withColumn("rule", rule).where("rule is not null").select("column", F.col("sdtype").alias("detected_sdtype"), suggested.alias("suggested_sdtype"), confidence.alias("confidence"), "rule")


def split_by_confidence(hints: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Hints with a suggestion: those at the threshold or above, and the others."""
    real = hints.where("suggested_sdtype <> detected_sdtype")
    return real.where(F.col("confidence") >= threshold), real.where(F.col("confidence") < threshold)


def sequence_columns(df: DataFrame, columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(is_longitudinal, seq_key, seq_index): one row.

    The index is a number, time or date column: named like a time first, then of
    fewest values. The key repeats (two rows a value or more): named like an entity
    first, then of most values. Ties go to the first column.
    """
    columns = columns or values_of(df)
    texts = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    own = column_profile(df, columns)
    own = own.join(date_formats(df, texts, order), "column", "left") if texts and order else own.withColumn("format", F.lit(None).cast("string"))
    named = lambda hints: F.when(F.greatest(F.lit(False), *(F.contains(F.lower("column"), F.lit(h)) for h in hints)), 0).otherwise(1)
    can_index = F.col("numeric") | F.col("time") | F.col("flag") | F.col("format").isNotNull()
    index = own.agg(F.min_by("column", F.when(can_index, F.struct(named(INDEX_NAMES), "n_unique", "pos"))).alias("seq_index"))
    repeats = (F.col("n_unique") > 1) & (F.col("n_unique") < F.col("n_rows")) & (F.col("n_rows") / F.greatest("n_unique", F.lit(1)) >= 2)
    key = own.crossJoin(F.broadcast(index)).where(repeats & ~F.equal_null("column", "seq_index")).agg(F.min_by("column", F.struct(named(KEY_NAMES), -F.col("n_unique"), "pos")).alias("seq_key"))
    return index.crossJoin(key).select((F.col("seq_key").isNotNull() & F.col("seq_index").isNotNull()).alias("is_longitudinal"), "seq_key", "seq_index")


def metadata(df: DataFrame, order: str | None = None) -> dict:
    """Detected column types as a dictionary, one entry a column."""
    texts = [c for c in df.columns if df.schema[c].dataType.typeName() == "string"]
    formats = date_formats(df, texts, order) if texts and order else None
    rows = detected(column_profile(df), formats).select("column", "sdtype", "format").collect()
    found = {r["column"]: {"sdtype": r["sdtype"]} | ({"datetime_format": r["format"]} if r["format"] else {}) for r in rows}
    return {"columns": {c: found[c] for c in df.columns if c in found}}


def sequential_metadata(df: DataFrame, key: str, index: str, order: str | None = None) -> dict:
    """Metadata of a longitudinal table: the key is an id, the index a number or date."""
    columns = metadata(df, order)["columns"]
    columns[key] = {"sdtype": "id"}
    if columns.get(index, {}).get("sdtype") not in ("numerical", "datetime"):
        columns[index] = {"sdtype": "numerical"}
    return {"tables": {"data": {"columns": columns, "sequence_key": key, "sequence_index": index}}}


def summarize_metadata(meta: dict) -> dict[str, int]:
    """How many columns have each type, and how many are marked as personal."""
    out: dict[str, int] = {}
    for m in (meta.get("columns") or {}).values():
        out[m.get("sdtype", "unknown")] = out.get(m.get("sdtype", "unknown"), 0) + 1
        out["pii"] = out.get("pii", 0) + bool(m.get("pii"))
    return out


def mode_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the most frequent value as text, the smallest on ties."""
    counts = long_values(_cells(df, columns), df, "string", key=[]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(first)).where("r = 1").select("column", "value")
