"""Command line: ``synthesize`` a table from another, ``validate`` one against the other, ``inspect`` one."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.copula import find_keys, fit, sample
from .operators.date_votes import as_dates, as_texts
from .operators.distances import evaluate
from .operators.profile import column_hints, date_formats, metadata, sequence_columns
from .plans.benchmarks import RunConfig
from .sources.tables import POSITION, load_schema, primary_keys, read_table, schema_distributions, schema_metadata, spark_schema, write_table


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="synthspark")
    verbs = p.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("synthesize")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--schema")
    s.add_argument("--rows", type=int)
    s.add_argument("--seed", type=int, default=42)
    v = verbs.add_parser("validate")
    v.add_argument("real")
    v.add_argument("synth")
    i = verbs.add_parser("inspect")
    i.add_argument("input")
    return p.parse_args(argv)


def declared_dates(schema: dict) -> dict[str, str]:
    """The formats of the date columns of a YAML schema."""
    return {c: m["datetime_format"] for c, m in schema_metadata(schema)["columns"].items() if "datetime_format" in m}


def found_dates(table: DataFrame) -> dict[str, str]:
    """The formats of text columns by the first values of the input."""
    texts = [f.name for f in table.schema.fields if f.dataType.typeName() == "string"]
    return {r["column"]: r["format"] for r in date_formats(table, texts, POSITION).where("format is not null").collect()} if texts else {}


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    try:
        RunConfig(rows=getattr(args, "rows", None), seed=getattr(args, "seed", 42))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "synthesize":
        schema = load_schema(args.schema) if args.schema else None
        table = read_table(spark, args.input, spark_schema(schema) if schema else None, position=POSITION)
        df, dates = as_dates(table.drop(POSITION), declared_dates(schema) if schema else found_dates(table))
        keys = sorted({*find_keys(df), *primary_keys(schema or {"columns": {}})})
        model = fit(df, (schema or {}).get("constraints"), args.seed, keys=keys, schema_distributions=schema_distributions(schema) if schema else None)
        n = args.rows or df.count()
        write_table(as_texts(sample(spark, model, n, args.seed), dates), args.output)
        print(f"{n} rows written to {args.output}")
        return 0
    if args.verb == "inspect":
        table = read_table(spark, args.input, position=POSITION)
        for name, m in metadata(table, POSITION)["columns"].items():
            print(name, *m.values())
        column_hints(table, order=POSITION).orderBy("column").show(1000, truncate=False)
        sequence_columns(table, order=POSITION).show(truncate=False)
        return 0
    found = evaluate(read_table(spark, args.real), read_table(spark, args.synth))
    found.orderBy("score", ascending=False).show(1000, truncate=False)
    return int(found.where("not ok").limit(1).count())


if __name__ == "__main__":
    sys.exit(main())
