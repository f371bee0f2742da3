"""Column expressions that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date formats that are recognised, in order of priority (regular expression, strptime pattern, Spark pattern).
DATE_FORMATS = [
    (r"^\d{8}$", "%Y%m%d", "yyyyMMdd"),
    (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d", "yyyy-MM-dd"),
    (r"^\d{2}-\d{2}-\d{4}$", "%d-%m-%Y", "dd-MM-yyyy"),
]


#: Directives of strptime and the letters that Spark has for them.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "%": "%"}


def spark_pattern(pattern: str) -> str:
    """A strptime pattern in Spark's letters; one without directives is Spark's already."""
    if "%" not in pattern:
        return pattern
    out = ""
    for directive, text in re.findall(r"%(.)|([^%]+)", pattern):
        if directive and directive not in DIRECTIVES:
            raise ValueError(f"%{directive} of {pattern} has no counterpart")
        out += DIRECTIVES[directive] if directive else re.sub("[A-Za-z]+", lambda m: f"'{m[0]}'", text)
    return out


def reading_pattern(pattern: str) -> str:
    """``spark_pattern`` for reading: days, months and hours that stand apart may have one digit, as strptime takes them."""
    return re.sub(r"(?<![A-Za-z'])(dd|MM|HH)(?![A-Za-z'])", lambda m: m[0][0], spark_pattern(pattern))


def is_position(kind: T.DataType) -> bool:
    """Where a row stood in its input: a column to order by, no value of the table."""
    return isinstance(kind, T.StructType)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def uniform(key: Column, seed: int | str = 42) -> Column:
    """A reproducible number in [0, 1) from a key; it does not hang on partitions."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double")) / float(1 << 32)


def order_key(key: Column, seed: int | str = 42) -> Column:
    """A reproducible random order: sort by it and then by the key."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def is_numeric(kind: T.DataType) -> bool:
    """Numbers, but not booleans."""
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_missing(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def present(c: Column, kind: T.DataType) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def micros(c: Column, kind: T.DataType, pattern: str | None = None) -> Column:
    """Microseconds since the epoch; what cannot be parsed is null."""
    if is_time(kind):
        return F.unix_micros(c.cast("timestamp"))
    parsed = F.try_to_timestamp(c.cast("string"), F.lit(reading_pattern(pattern))) if pattern else F.try_to_timestamp(c.cast("string"))
    return F.unix_micros(parsed)


def _matches(rx: str):
    return lambda v: v.rlike(rx)


def date_format_of(strings: Column, n: Column) -> Column:
    """The format that 70 % of at least three sampled strings have, from a list of stripped strings."""
    out = F.lit(None).cast("string")
    for rx, pattern, _ in reversed(DATE_FORMATS):
        fits = F.size(F.filter(strings, _matches(rx)))
        out = F.when((n >= 3) & (fits >= 0.7 * n), F.lit(pattern)).otherwise(out)
    return out


def safe_ratio(a: Column, b: Column, otherwise: float = 1.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def shown(c: Column) -> Column:
    """Three decimals, a dash for null."""
    return F.coalesce(F.format_number(c, 3), F.lit("—"))


def ok_symbol(c: Column) -> Column:
    return F.when(c.isNull(), "—").when(c, "✓").otherwise("✗")
