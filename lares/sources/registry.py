"""Reading a registry extract and bringing it to the declared columns and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lares import schema as s
from lares.functions.arithmetic import nan_to_null, parsed_number
from lares.sources.staging import Staging


def normalise_headers(df: DataFrame) -> DataFrame:
    """Renames header variants; each of these columns must be there exactly once."""
    present = set(df.columns)
    for variant, name in s.HEADER_VARIANTS.items():
        if variant in present and name in present:
            raise ValueError(f"both {variant!r} and {name!r} are present")
        if variant not in present and name not in present:
            raise ValueError(f"neither {variant!r} nor {name!r} is present")
    return df.withColumnsRenamed(s.HEADER_VARIANTS)


def _key_text(kind: str) -> Column:
    key = F.col(s.KEY)
    if kind in ("double", "float"):
        # Whole digits, not 1.2E10.
        digits = F.when(key == F.floor(key), key.try_cast("decimal(38,0)"))
        return F.coalesce(digits.cast("string"), key.cast("string"))
    return key.cast("string")


#: Texts of a cell without a value.
BLANKS = ("", "NA", "NaN", "nan")


def _number(name: str, kind: str, decimal: str, lenient: bool) -> Column:
    """A quantity as a double. A text that is neither blank nor a number raises, unless ``lenient``."""
    if kind != "string":
        return nan_to_null(F.col(name).cast("double"))
    value = nan_to_null(parsed_number(F.col(name), decimal))
    if lenient:
        return value
    filled = ~F.trim(F.col(name)).isin(*BLANKS)
    message = F.concat(F.lit(f"column {name!r} holds no number: "), F.col(name))
    return F.when(filled & value.isNull(), F.raise_error(message).cast("double")).otherwise(value)


def unreadable_numbers(df: DataFrame, decimal: str = ".") -> DataFrame:
    """One row: per quantity held as text the number of cells that are neither blank nor a number."""
    df = normalise_headers(df)
    texts = [c for c, kind in df.dtypes if c in s.NUMERIC and kind == "string"]
    unread = [
        F.count_if(~F.trim(F.col(c)).isin(*BLANKS) & parsed_number(F.col(c), decimal).isNull()).alias(c) for c in texts
    ]
    return df.agg(*(unread or [F.lit(0).alias("none")]))


def normalise_registry(df: DataFrame, decimal: str = ".", lenient: bool = False) -> DataFrame:
    """Declared names and types: text key, double quantities with NaN as null, other columns as they are.

    Quantities that are texts are read with the decimal mark given; with a comma, points may part thousands.
    A cell that is neither blank nor a number raises when it is read; ``lenient`` makes it null
    (``unreadable_numbers`` counts such cells).
    """
    df = normalise_headers(df)
    kinds = dict(df.dtypes)
    absent = [c for c in s.FAMILY_COLUMNS if c not in kinds]
    if absent:
        raise ValueError(f"registry lacks columns {absent}")
    casts = {c: _number(c, kinds[c], decimal, lenient) for c in s.NUMERIC}
    if kinds[s.KEY] != "string":
        casts[s.KEY] = _key_text(kinds[s.KEY])
    return df.withColumns(casts)


def read_registry(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    decimal: str = ".",
    lenient: bool = False,
    staging: Staging | None = None,
    **options,
) -> DataFrame:
    """A registry extract in Parquet, or in CSV with a header (blank and NA cells are null, text is trimmed).

    Records of a text that don't fit its header raise (``mode="PERMISSIVE"`` lets them through); quoted line
    breaks need ``multiLine=True``, which makes a file one task's work. A text has no columns to skip, so each
    branch of a plan parses it anew: with ``staging`` it is parsed once into a written table.
    """
    reader = spark.read
    if fmt == "csv":
        defaults = {
            "header": True,
            "inferSchema": False,
            "ignoreLeadingWhiteSpace": True,
            "ignoreTrailingWhiteSpace": True,
            "multiLine": False,
            "mode": "FAILFAST",
            "nullValue": "NA",
            "emptyValue": "",
        }
        # The header's names, all as text: declared before the read, so that records are held against them.
        named = spark.read.options(**{**defaults, **options}).csv(path)
        reader = reader.options(**{**defaults, **options}).schema(named.schema)
    else:
        reader = reader.options(**options)
    registry = normalise_registry(reader.format(fmt).load(path), decimal, lenient)
    if fmt == "csv" and staging is not None:
        return staging.table(registry, "registry")
    return registry
