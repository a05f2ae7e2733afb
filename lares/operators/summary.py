"""Counts per component, the two summaries and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lares import schema as s
from lares.functions.arithmetic import ratio, round_share
from lares.operators.classify import front

VERDICTS = [s.OK, s.BAD, s.MISSING]
_NOT_MEASURED = (s.ROW_ID, s.KEY, s.ROW_KIND, s.SITUATION, s.CLASS)


@dataclass(frozen=True)
class Totals:
    """Denominators of the shares; the first is also added to the "no data" count of inadequacy rows."""

    deficit: int
    inadequacy: int


def unpivot_conditions(components: DataFrame) -> DataFrame:
    """One row per component row and code, with the condition found there."""
    ids = [c for c in _NOT_MEASURED if c in components.columns]
    codes = [c for c in components.columns if c not in _NOT_MEASURED]
    return components.unpivot(ids, codes, s.CODE, s.CONDITION)


def pivot_counts(long: DataFrame) -> DataFrame:
    """Counts of the three conditions per code, as columns. A condition that never occurs counts 0."""
    counts = long.groupBy(s.CODE).pivot(s.CONDITION, VERDICTS).count().na.fill(0)
    return counts.select(s.CODE, *[F.col(f"`{v}`") for v in VERDICTS])


def count_conditions(components: DataFrame, only: dict[str, str] | None = None) -> DataFrame:
    """Same counts as ``pivot_counts(unpivot_conditions(...))`` in one pass without the long form.

    ``only`` restricts the rows counted for single codes by a SQL condition.
    """
    only = only or {}
    codes = [c for c in components.columns if c not in _NOT_MEASURED]

    def tally(code: str, verdict: str) -> Column:
        kept = f" AND {only[code]}" if code in only else ""
        return F.expr(f"count_if(`{code}` = '{verdict}'{kept})")

    names = {(c, v): f"n_{i}_{j}" for i, c in enumerate(codes) for j, v in enumerate(VERDICTS)}
    one_row = components.agg(*[tally(c, v).alias(name) for (c, v), name in names.items()])
    per_code = ", ".join(f"'{c}', {', '.join(names[c, v] for v in VERDICTS)}" for c in codes)
    columns = ", ".join(f"`{c}`" for c in (s.CODE, *VERDICTS))
    return one_row.selectExpr(f"stack({len(codes)}, {per_code}) AS ({columns})")


# Rows the corrected inadequacy counts are taken over. Originally the compared text lacks its accent, so
# that no row is excluded.
OUTSIDE_DEFICIT = f"`{s.CLASS}` <> '{s.DEFICIT}'"


def condition_counts(components: DataFrame, corrected: bool = False) -> DataFrame:
    """Counts for both summaries in one pass over the component table."""
    restricted = [*s.INADEQUACY_CODES, s.INADEQUACY] if corrected else []
    return count_conditions(components, dict.fromkeys(restricted, OUTSIDE_DEFICIT))


def _bad_of(code: str) -> Column:
    # A window over the summary itself, which has at most one row per code.
    everything = Window.partitionBy(F.lit(1))
    return F.max(F.when(F.col(s.CODE) == code, F.col(s.BAD))).over(everything)


def summarise(counts: DataFrame, totals: Totals | None, corrected: bool = False) -> DataFrame:
    """Shares for all codes, and the adjusted "no data" count of inadequacy codes.

    With ``totals`` None the denominators are the counts of the roll-ups themselves. The rows added back are
    the given deficit figure as originally defined, and those that were left out if ``corrected``.
    """
    left_out = _bad_of(s.DEFICIT) if totals is None or corrected else F.lit(totals.deficit)
    deficit = _bad_of(s.DEFICIT) if totals is None else F.lit(totals.deficit)
    inadequacy = _bad_of(s.INADEQUACY) if totals is None else F.lit(totals.inadequacy)
    is_deficit = F.col(s.CODE).isin([*s.DEFICIT_CODES, s.HOMELESS_CODE, s.DEFICIT])
    missing = F.col(f"`{s.MISSING}`")
    denominator = F.when(is_deficit, deficit).otherwise(inadequacy).cast("double")
    return counts.withColumns(
        {
            s.MISSING: F.when(is_deficit, missing).otherwise(missing + left_out),
            s.SHARE: ratio(F.col(s.BAD).cast("double"), denominator),
        }
    )


def deficit_summary(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col(s.CODE).isin([*s.DEFICIT_CODES, s.HOMELESS_CODE, s.DEFICIT]))


def inadequacy_summary(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col(s.CODE).isin([*s.INADEQUACY_CODES, s.INADEQUACY]))


def component_names(spark: SparkSession) -> DataFrame:
    """The 18 codes with the names shown in the report."""
    rows = ", ".join(f"('{code}', '{name}')" for code, name in s.COMPONENT_NAMES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({s.CODE}, {s.COMPONENT})")


def with_names(summary: DataFrame, names: DataFrame | None = None) -> DataFrame:
    names = component_names(summary.sparkSession) if names is None else names
    return summary.join(F.broadcast(names), s.CODE, "left")


def present(summary: DataFrame) -> DataFrame:
    """Names, rounded shares, columns in reading order, rows by code."""
    rounded = with_names(summary).withColumn(s.SHARE, round_share(F.col(f"`{s.SHARE}`")))
    return front(rounded, s.CODE, s.COMPONENT, s.BAD, s.SHARE).orderBy(s.CODE)
