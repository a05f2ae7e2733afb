"""Command line: registry in, component table and report out.

    python -m lares --registry hdfs:///registry --layout person --output hdfs:///results

or the same arguments after ``spark-submit --py-files lares.zip lares/__main__.py``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lares import FAMILY, PERSON, Staging, Totals, read_registry, write_results


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lares", description=__doc__.splitlines()[0])
    parser.add_argument("--registry", required=True, help="folder or file of the extract")
    parser.add_argument("--format", default="parquet", choices=["parquet", "orc", "csv"])
    parser.add_argument("--separator", default=",", help="column separator of a csv extract")
    parser.add_argument("--decimal", default=".", choices=[".", ","], help="decimal mark of a csv extract")
    parser.add_argument("--lenient", action="store_true", help="take cells that should be numbers and are none as missing")
    parser.add_argument("--multiline", action="store_true", help="a csv extract has quoted line breaks")
    parser.add_argument("--staging", help="folder for tables in between; default: spark.checkpoint.dir")
    parser.add_argument("--layout", default="person", choices=["family", "person"])
    parser.add_argument("--family-columns", type=int, help="how many leading columns describe the family")
    parser.add_argument("--corrected", action="store_true")
    parser.add_argument("--totals", type=int, nargs=2, metavar=("DEFICIT", "INADEQUACY"))
    parser.add_argument("--output", required=True, help="folder to write to; must not hold results yet")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    spark = SparkSession.builder.appName("lares").getOrCreate()
    options = {"sep": args.separator, "multiLine": args.multiline} if args.format == "csv" else {}
    staging = Staging(spark, args.staging)
    registry = read_registry(spark, args.registry, args.format, args.decimal, args.lenient, staging, **options)
    report = write_results(
        registry,
        args.output,
        PERSON if args.layout == "person" else FAMILY,
        args.corrected,
        Totals(*args.totals) if args.totals else None,
        args.family_columns,
        staging,
    )
    report.show(20, truncate=False)


if __name__ == "__main__":
    main()
