"""Writing the component table and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.functions.arithmetic import plain_digits

CSV2 = {"sep": ";", "header": True, "nullValue": "NA", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def write_csv2(df: DataFrame, path: str, mode: str = "error") -> None:
    """Semicolon-separated text with decimal commas, a header and ``NA`` for missing values."""
    fractional = {name: kind for name, kind in df.dtypes if kind in ("double", "float") or kind.startswith("decimal")}
    columns = [
        plain_digits(F.col(f"`{c}`"), fractional[c]).alias(c) if c in fractional else F.col(f"`{c}`")
        for c in df.columns
    ]
    df.select(*columns).write.mode(mode).options(**CSV2).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """The report as a single file; it has at most one row per component."""
    write_csv2(report.coalesce(1), path, mode)


def write_components(components: DataFrame, path: str, mode: str = "error") -> None:
    """The component table as Parquet; column names keep their accents and spaces."""
    components.write.mode(mode).parquet(path)
