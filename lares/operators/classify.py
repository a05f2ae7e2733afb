"""Row classification: conditions, filling, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares import schema as s
from lares.functions.conditions import any_bad, deficit_class, label

IDENTITY = (s.ROW_ID, s.KEY, s.ROW_KIND)


def deficit_codes(homeless: bool) -> list[str]:
    return [*s.DEFICIT_CODES, *([s.HOMELESS_CODE] if homeless else [])]


def condition_codes(homeless: bool) -> list[str]:
    return [*deficit_codes(homeless), *s.INADEQUACY_CODES]


def summary_codes(homeless: bool) -> list[str]:
    """Every code the summaries count, roll-ups included."""
    return [*condition_codes(homeless), s.DEFICIT, s.INADEQUACY]


def fill_missing(df: DataFrame, skip: Sequence[str] = IDENTITY) -> DataFrame:
    """Nulls become the "no data" text in every text column but the identifying ones."""
    text = [name for name, kind in df.dtypes if kind == "string" and name not in skip]
    return df.na.fill(s.MISSING, subset=text)


def add_rollups(filled: DataFrame, homeless: bool) -> DataFrame:
    """Deficit, inadequacy and the three-way class from filled conditions."""
    flags = {
        s.DEFICIT: any_bad(deficit_codes(homeless)),
        s.INADEQUACY: any_bad(list(s.INADEQUACY_CODES)),
    }
    return filled.withColumns(flags).withColumn(s.CLASS, deficit_class())


def front(df: DataFrame, *names: str) -> DataFrame:
    """The named columns first, all others after them as they stand."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*[F.col(f"`{c}`") for c in (*names, *rest)])


def label_components(findings: DataFrame, homeless: bool) -> DataFrame:
    """The component table of rows with findings: identity, situation, conditions as text, roll-ups."""
    identity = [c for c in IDENTITY if c in findings.columns]
    texts = [label(F.col(c)).alias(c) for c in condition_codes(homeless)]
    return add_rollups(fill_missing(findings.select(*identity, s.SITUATION, *texts)), homeless)
