"""End-to-end plans: registry -> component table, registry -> report.

Two registry layouts:

``FAMILY``  one row per family; nothing is known about homelessness.
``PERSON``  one row per person with the family's columns repeated; adds the homeless rows and D07.

Two modes: the results as originally defined (default), and ``corrected``, which differs in three places:
rows added for cohabiting families count as cohabiting, deficit families are left out of the inadequacy
counts, and denominators come from the data instead of being fixed figures.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares import schema as s
from lares.functions.conditions import HOMELESS_FLAG, with_findings
from lares.operators.classify import condition_codes, label_components
from lares.operators.families import (
    DIGEST,
    ORIGIN,
    extract_families,
    homeless_keys,
    stack_families,
)
from lares.operators.keys import hot_keys, mark_members
from lares.operators.numbering import sequential_id
from lares.operators.summary import Totals, condition_counts, present, summarise
from lares.sources.exports import write_components, write_csv2, write_report
from lares.sources.registry import normalise_registry
from lares.sources.staging import Staging


FamilyColumns = int | Sequence[str] | None


@dataclass(frozen=True)
class Layout:
    homeless: bool
    totals: Totals  # fixed figures of the extract each layout was written for
    family_columns: FamilyColumns  # the leading columns that describe the family, or their names


FAMILY = Layout(homeless=False, totals=Totals(deficit=6020, inadequacy=22890), family_columns=66)
PERSON = Layout(homeless=True, totals=Totals(deficit=6917, inadequacy=22891), family_columns=38)

ORDER_COLUMNS = (DIGEST, ORIGIN)


def families(registry: DataFrame, layout: Layout, family_columns: FamilyColumns = None) -> DataFrame:
    """Distinct family rows over the layout's family columns, unless others are given."""
    chosen = layout.family_columns if family_columns is None else family_columns
    return extract_families(normalise_registry(registry), chosen)


def _stacked(families: DataFrame, registry: DataFrame, layout: Layout) -> DataFrame:
    if not layout.homeless:
        return stack_families(families)
    members = homeless_keys(registry)
    hot = hot_keys(registry, s.KEY)
    flagged = mark_members(families, members, s.KEY, HOMELESS_FLAG, hot, F.col(ORIGIN))
    stacked = stack_families(flagged, members)
    # The added homeless rows have no flag of their own.
    return stacked.withColumn(HOMELESS_FLAG, F.coalesce(HOMELESS_FLAG, F.lit(True)))


def family_base(
    registry: DataFrame, layout: Layout, family_columns: FamilyColumns = None
) -> DataFrame:
    """The stacked rows every count is taken over; with ``PERSON`` also the homeless flag of each row."""
    registry = normalise_registry(registry)
    return _stacked(families(registry, layout, family_columns), registry, layout)


def findings(
    registry: DataFrame,
    layout: Layout,
    corrected: bool = False,
    family_columns: FamilyColumns = None,
) -> DataFrame:
    """The rows of ``family_base`` with a boolean finding per code in place of the family's columns.

    The rules read family rows only, so they are applied before rows are marked, stacked and sorted: what
    is shuffled from there on is a key, a situation and some booleans.
    """
    registry = normalise_registry(registry)
    codes = condition_codes(homeless=False)
    narrow = with_findings(families(registry, layout, family_columns), codes).select(
        s.KEY, s.SITUATION, s.FAMILIES, *codes, *ORDER_COLUMNS
    )
    stacked = _stacked(narrow, registry, layout)
    added = {}
    if corrected:
        cohabiting = F.col(s.ROW_KIND).isin(list(s.COHABITING_ROWS))
        added["D04"] = F.when(cohabiting, True).otherwise(F.col("D04"))
    if layout.homeless:
        added[s.HOMELESS_CODE] = F.col(HOMELESS_FLAG)
    return stacked.withColumns(added) if added else stacked


def stacking_order() -> list[Column]:
    """Row kind in stacking order, then key (nulls first), then content by its digest.

    Kind and key lead as one text, because a sort compares the first bytes of its first column much faster
    than the rest; the kind alone would tie nearly always. Added rows have the content of the family they
    come from, so those of a frequent key can be cut across partitions as well. Range partitioning
    collects samples of these columns on the driver: they have to be few and narrow.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in s.STACKING_ORDER]), F.col(s.ROW_KIND))
    lead = F.concat(rank.cast("string"), F.coalesce(F.col(s.KEY), F.lit("")))
    return [lead.asc(), F.col(s.KEY).asc_nulls_first(), F.col(DIGEST).asc(), F.col(ORIGIN).asc()]


def number_base(base: DataFrame, staging: Staging | None = None) -> DataFrame:
    """The stacked base with ``ID`` = 1..N in stacking order. Runs a job and writes a staging table."""
    keep = [c for c in base.columns if not c.startswith("_")]
    return sequential_id(base, stacking_order(), keep, s.ROW_ID, staging)


def components(
    registry: DataFrame,
    layout: Layout = PERSON,
    corrected: bool = False,
    family_columns: FamilyColumns = None,
    staging: Staging | None = None,
) -> DataFrame:
    """The component table, numbered. Runs a job and writes a staging table (see ``sequential_id``), which the
    caller may clear through ``staging`` when done."""
    found = findings(registry, layout, corrected, family_columns)
    keep = [s.KEY, s.ROW_KIND, s.SITUATION, *condition_codes(layout.homeless)]
    numbered = sequential_id(found, stacking_order(), keep, s.ROW_ID, staging)
    return label_components(numbered, layout.homeless)


def unnumbered_components(
    registry: DataFrame,
    layout: Layout = PERSON,
    corrected: bool = False,
    family_columns: FamilyColumns = None,
) -> DataFrame:
    """The component table without row numbers, which no count needs."""
    return label_components(findings(registry, layout, corrected, family_columns), layout.homeless)


def summary(
    registry: DataFrame,
    layout: Layout = PERSON,
    corrected: bool = False,
    totals: Totals | None = None,
    family_columns: FamilyColumns = None,
) -> DataFrame:
    """Counts and shares per code. ``totals`` replaces the layout's fixed figures."""
    table = unnumbered_components(registry, layout, corrected, family_columns)
    return _summary_of(table, layout, corrected, totals)


def _summary_of(
    table: DataFrame, layout: Layout, corrected: bool, totals: Totals | None
) -> DataFrame:
    figures = totals or (None if corrected else layout.totals)
    return summarise(condition_counts(table, corrected), figures, corrected)


def report(
    registry: DataFrame,
    layout: Layout = PERSON,
    corrected: bool = False,
    totals: Totals | None = None,
    family_columns: FamilyColumns = None,
) -> DataFrame:
    """The housing report: one row per component, with its name, counts and rounded share."""
    return present(summary(registry, layout, corrected, totals, family_columns))


def write_results(
    registry: DataFrame,
    folder: str,
    layout: Layout = PERSON,
    corrected: bool = False,
    totals: Totals | None = None,
    family_columns: FamilyColumns = None,
    staging: Staging | None = None,
) -> DataFrame:
    """Writes the component table and the report under ``folder`` and returns the report as written.

    The family layout gets its component table as text, the person layout as Parquet. The report is
    counted once, from the numbered table, so the registry is processed once; its rows, one per code, are
    held by the session from then on, and the staging tables are deleted.
    """
    spark = registry.sparkSession
    staging = staging or Staging(spark)
    try:
        table = components(registry, layout, corrected, family_columns, staging)
        if layout.homeless:
            write_components(table, f"{folder}/components")
        else:
            write_csv2(table, f"{folder}/components")
        counted = present(_summary_of(table, layout, corrected, totals))
        result = spark.createDataFrame(counted.collect(), counted.schema)
        write_report(result, f"{folder}/report")
    finally:
        staging.clear()
    return result
