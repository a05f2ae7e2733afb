"""The sixteen row conditions and the three roll-ups, as Column expressions.

A finding is true (inadequate), false (adequate) or null (nothing known, or not applicable). Findings are
what rows carry through shuffles and staging; ``label`` turns them into the texts of the component table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares import schema as s
from lares.functions.arithmetic import ratio

# Intermediate columns shared by several rules; computed once per row by ``with_measures``.
DENSITY = "_density"
BURDEN = "_burden"
SHARED_LOT = "_shared_lot"
HOMELESS_FLAG = "_homeless"


def shared_lot_pattern() -> str:
    """The word list as one regex, without the words that another, shorter word already finds."""
    words = s.SHARED_LOT_WORDS
    return "|".join(w for w in words if not any(o != w and o in w for o in words))


def with_measures(df: DataFrame) -> DataFrame:
    """Adds persons per bedroom, rent per income, and (for crowded rows only) the complement match."""
    crowded = F.col(DENSITY) >= s.CROWDED
    return df.withColumns(
        {
            DENSITY: ratio(F.col(s.PERSONS), F.col(s.BEDROOMS)),
            BURDEN: ratio(F.col(s.RENT), F.col(s.INCOME)),
        }
    ).withColumn(SHARED_LOT, F.when(crowded, F.col(s.COMPLEMENT).rlike(shared_lot_pattern())))


def _finding(bad: Column, ok: Column) -> Column:
    """From two predicates that cannot both hold; a null predicate counts as one that does not hold."""
    return F.when(bad, True).when(ok, False)


def _verdict(column: str) -> Column:
    """The finding a category text stands for, null for an unlisted text.

    A constant map keeps the generated code short: one comparison per text would push the rules, taken
    together, over the method size the JVM is willing to compile.
    """
    pairs = [
        f"'{text}', {str(verdict == s.BAD).lower()}"
        for verdict, texts in s.CATEGORIES[column].items()
        for text in texts
    ]
    return F.expr(f"map({', '.join(pairs)})")[F.col(column)]


def _rules() -> dict[str, Column]:
    """Code -> finding for every code but D05 and D07, over rows that carry the measures."""
    urban = F.col(s.SITUATION) == s.URBAN
    density, burden = F.col(DENSITY), F.col(BURDEN)
    return {
        "D01": _verdict(s.DWELLING),
        "D02": _verdict(s.WALLS),
        "D03": F.col(SHARED_LOT),
        "D04": F.col(s.FAMILIES) > 1,
        "D06": F.col(s.ROOMS) <= 1,
        "I01": density >= s.CROWDED,
        "I02": _verdict(s.BATHROOM),
        "I03": _verdict(s.FLOOR),
        "I04": F.when(urban, _verdict(s.PIPED_WATER)),
        "I05": _verdict(s.SEWAGE),
        "I06": F.when(urban, _verdict(s.WATER_SUPPLY)),
        "I07": _verdict(s.LIGHTING),
        "I08": F.when(urban, _verdict(s.REFUSE)),
        "I09": burden >= s.EXCESSIVE_BURDEN,
    }


# A rental is inadequate if one of these is, and adequate only if all are.
_RENTAL_INPUTS = ("I01", "I02", "I03", "I04")


def _rental() -> Column:
    inputs = [F.col(c) for c in _RENTAL_INPUTS]
    bad = reduce(or_, inputs)
    ok = reduce(and_, [~c for c in inputs])
    return F.when(F.col(s.RENT) > 0, _finding(bad, ok))


def with_findings(families: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Adds a boolean column per code (and those it depends on). D07 is not a matter of the row alone."""
    rental = "D05" in codes
    needed = [c for c in codes if c != "D05"]
    needed += [c for c in _RENTAL_INPUTS if rental and c not in needed]
    rules = _rules()
    found = with_measures(families).withColumns({c: rules[c] for c in needed})
    return found.withColumn("D05", _rental()) if rental else found


def label(finding: Column) -> Column:
    """The text of a finding: "Inadequado", "Adequado" or null."""
    return F.when(finding, F.lit(s.BAD)).when(~finding, F.lit(s.OK))


def any_bad(codes: list[str]) -> Column:
    """Roll-up of filled conditions: bad when one of them is."""
    bad = reduce(or_, [F.col(c) == s.BAD for c in codes])
    return F.when(bad, F.lit(s.BAD)).otherwise(F.lit(s.OK))


def deficit_class() -> Column:
    """Three-way class; a deficit outranks an inadequacy."""
    return (
        F.when(F.col(s.DEFICIT) == s.BAD, F.lit(s.DEFICIT))
        .when(F.col(s.INADEQUACY) == s.BAD, F.lit(s.INADEQUACY))
        .otherwise(F.lit(s.OK))
    )
