"""Table sources and sinks, YAML schemas and generated ground truth."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import uniform

#: Texts that a CSV reader of data frames takes for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Types of a YAML schema and what they mean.
SDTYPES = {"categorical": "categorical", "integer": "numerical", "float": "numerical", "string": "id", "date": "datetime"}
#: Name of the column that tells where a row stood in its input.
POSITION = "__position"
_SPARK_TYPES = {"categorical": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "date": T.StringType()}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = True, position: str | None = None) -> DataFrame:
    """Parquet by suffix, else CSV with a header; missing-value texts and NaN become null.

    Values in quotes may hold line breaks, and a quote as two. Without
    ``line_breaks`` Spark may split a large file where a line ends.

    Types of a CSV without schema come from one pass over all values: whole
    numbers, numbers, booleans, else text. Dates stay text.

    ``position`` names one more column by which the rows sort as the input has
    them: file, first byte of the task's stretch of it, and number within. Operators
    take it as ``order`` or ``tie``. It is the same on any number of partitions but
    for the numbers, which only compare inside a stretch.
    """
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, schema=schema, multiLine=line_breaks, escape='"')
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(NA_TOKENS), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    if position:
        if position in df.columns:
            raise ValueError(f"the table has a column {position}")
        number = F.col("_metadata.row_index") if path.endswith(".parquet") else F.monotonically_increasing_id()
        start = F.lit(0).cast("long") if path.endswith(".parquet") else F.col("_metadata.file_block_start")
        out.append(F.struct(F.col("_metadata.file_path").alias("file"), start.alias("start"), number.alias("row")).alias(position))
    df = df.select(*out)
    return df if path.endswith(".parquet") or schema is not None else _inferred(df, position)


def _inferred(df: DataFrame, position: str | None) -> DataFrame:
    """The columns but ``position`` in the first type that all their values have."""
    kinds = ("bigint", "double", "boolean")
    fits = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull()).alias(f"{i}/{k}") for i, c in enumerate(df.columns) if c != position for k in kinds]
    misses = df.agg(*fits).first() if fits else None
    kind = lambda i: next((k for k in kinds if misses[f"{i}/{k}"] == 0), "string")
    return df.select(*(F.col(f"`{c}`") if c == position else F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(df.columns)))


def write_table(df: DataFrame, path: str) -> None:
    """A folder of Parquet or one CSV file by suffix (.parquet, .csv), else a folder of CSV parts with headers."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        write_csv_file(df, path)
    else:
        df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with one header, its rows in the order of the partitions.

    Tasks write their own parts, which are then joined through the Hadoop file
    system: by reference where it can (``concat``), else as streams through a small
    buffer. What stood at ``path`` stays until the new file is whole. An empty table
    is a header alone; a table without columns is refused.
    """
    if not df.columns:
        raise ValueError("a CSV file needs a column")
    spark = df.sparkSession
    conf, hadoop = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    work = hadoop.Path(target.getParent() or hadoop.Path("."), f".{target.getName()}-{uuid.uuid4().hex}")
    names, parts, whole, old = (hadoop.Path(work, n) for n in ("header", "parts", "whole", "old"))
    try:
        # The header is written as a row is, so names with commas, quotes or line breaks are quoted alike.
        spark.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(df.columns))])).coalesce(1).write.csv(names.toString(), escape='"')
        df.write.csv(parts.toString(), escape='"')
        found = [sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda p: p.getName()) for folder in (names, parts)]
        _joined(spark, fs, [*found[0], *found[1]], whole)
        if fs.exists(target):
            fs.rename(target, old)
        if not fs.rename(whole, target):
            if fs.exists(old):
                fs.rename(old, target)
            raise OSError(f"{path} could not be written")
    finally:
        fs.delete(work, True)


def _joined(spark: SparkSession, fs, parts: list, whole) -> None:
    """One file of the bytes of all parts."""
    if fs.getScheme() == "hdfs":
        fs.rename(parts[0], whole)
        rest = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for i, p in enumerate(parts[1:]):
            rest[i] = p
        if len(parts) > 1:
            fs.concat(whole, rest)
        return
    out = fs.create(whole)
    try:
        for p in parts:
            source = fs.open(p)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
    finally:
        out.close()


def load_schema(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def spark_schema(schema: dict) -> T.StructType:
    return T.StructType([T.StructField(c, _SPARK_TYPES.get((spec or {}).get("dtype"), T.StringType())) for c, spec in schema["columns"].items()])


def schema_metadata(schema: dict) -> dict:
    """Column types and primary key of a YAML schema; an unknown type is categorical."""
    columns, key = {}, None
    for name, spec in schema["columns"].items():
        spec = spec or {}
        kind = SDTYPES.get(spec.get("dtype"), "categorical")
        if spec.get("role") == "primary_key":
            kind, key = "id", name
        columns[name] = {"sdtype": kind} | ({"datetime_format": spec.get("datetime_format", "%Y-%m-%d")} if kind == "datetime" else {})
    return {"columns": columns} | ({"primary_key": key} if key else {})


def schema_distributions(schema: dict) -> dict[str, str]:
    return {c: s["distribution"] for c, s in schema["columns"].items() if (s or {}).get("distribution")}


def primary_keys(schema: dict) -> list[str]:
    return [c for c, s in schema["columns"].items() if (s or {}).get("role") == "primary_key"]


def ground_truth(spark: SparkSession, n: int = 300, seed: int = 42) -> DataFrame:
    """Students 1 to n over at most five years with two absorbing states; credits never fall."""
    return ground_truth_of(spark.range(1, n + 1), seed)


def ground_truth_of(students: DataFrame, seed: int = 42) -> DataFrame:
    """``ground_truth`` of the given students (id)."""
    #: States and the chances of each year.
    stay, done, gone = "ingeschreven", "gediplomeerd", "uitgestroomd"
    years = []
    for year in range(1, 6):
        grad, keep = 0.05 + 0.13 * (year - 1), max(0.0, 0.85 - 0.12 * (year - 1))
        total = grad + keep + max(0.0, 1 - keep - grad)
        years.append(F.struct(F.lit(year).cast("long").alias("jaar"), uniform(F.col("id"), f"{seed}/{year}/s").alias("u"), (20 + 40 * uniform(F.col("id"), f"{seed}/{year}/e")).alias("gain"), F.lit(keep / total).alias("keep"), F.lit((keep + grad) / total).alias("leave")))
    rows = students.select("id", F.array(*years).alias("years"))
    start = F.struct(F.lit(stay).alias("status"), F.lit(0.0).alias("ec"), F.array().cast("array<struct<jaar:bigint,status:string,ec:double>>").alias("all"))

    def step(a, y):
        status = F.when(y["u"] < y["keep"], stay).when(y["u"] < y["leave"], done).otherwise(gone)
        ec = F.round(a["ec"] + y["gain"], 1)
        more = F.struct(status.alias("status"), ec.alias("ec"), F.concat(a["all"], F.array(F.struct(y["jaar"].alias("jaar"), status.alias("status"), ec.alias("ec")))).alias("all"))
        return F.when(a["status"] == stay, more).otherwise(a)

    return rows.select(F.col("id").alias("student_id"), F.inline(F.aggregate("years", start, step, lambda a: a["all"])))


def write_json(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)


def write_parameters(params: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(params, f, sort_keys=False, allow_unicode=True)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def preview(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first rows in the order of a column."""
    return df.orderBy(order).limit(n)


def shown_as(df: DataFrame, names: dict[str, str], values: dict[str, dict] | None = None, order: list[str] | None = None) -> DataFrame:
    """``df`` for display: values mapped, columns renamed and put in order; what no map names stays."""
    for c, told in (values or {}).items():
        pairs = F.create_map(*(F.lit(x) for kv in told.items() for x in kv))
        df = df.withColumn(c, F.coalesce(F.try_element_at(pairs, F.col(c)), F.col(c).cast("string")))
    out = df.withColumnsRenamed(names)
    first = [names.get(c, c) for c in order or []]
    return out.select(*first, *(c for c in out.columns if c not in first))


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): the rows as CSV text, header apart, still distributed."""
    return df.select(F.to_csv(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))).alias("line"))
