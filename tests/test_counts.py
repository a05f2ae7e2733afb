"""Known counts of the stand-in, and identities that hold between counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lares import components, report
from lares import schema as s
from lares.operators import families as fam
from lares.operators import summary as sm
from lares.plans.housing import unnumbered_components
from lares.sources.registry import normalise_registry
from standin import FAMILY, PERSON, standin_persons

KINDS = {
    "small": {"ID0": 164, "ID7": 13, "ID1": 87, "ID2": 63, "ID3": 41},
    "medium": {"ID0": 1623, "ID7": 147, "ID1": 917, "ID2": 674, "ID3": 432},
}


@pytest.mark.parametrize("scale", KINDS)
def test_row_kinds(spark, request, scale):
    persons = standin_persons(spark, request.getfixturevalue(scale))
    got = components(persons, PERSON).groupBy(s.ROW_KIND).count().collect()
    assert dict(map(tuple, got)) == KINDS[scale]
    without = components(persons, FAMILY).groupBy(s.ROW_KIND).count().collect()
    assert dict(map(tuple, without)) == {k: n for k, n in KINDS[scale].items() if k != "ID7"}


def by_code(rows):
    return {r[s.CODE]: (r[s.OK], r[s.BAD], r[s.MISSING]) for r in rows}


def test_known_counts(spark, medium):
    persons = standin_persons(spark, medium)

    def counts(layout, corrected):
        return by_code(sm.condition_counts(unnumbered_components(persons, layout, corrected), corrected).collect())

    v1, v2 = counts(FAMILY, False), counts(PERSON, False)
    assert v1["D03"] == (338, 333, 2975) and v2["D03"] == (338, 333, 3122)
    assert v2["D07"] == (3268, 525, 0)
    assert v1["Déficit"] == (2107, 1539, 0) and v2["Déficit"] == (1892, 1901, 0)
    assert v1["I09"] == (548, 1036, 2062) and v2["Inadequação"] == (2185, 1608, 0)
    c1, c2 = counts(FAMILY, True), counts(PERSON, True)
    assert c1["D04"] == (486, 2940, 220) and c2["D04"] == (486, 2940, 367)
    assert c1["I06"] == (8, 28, 48) and c2["I06"] == (7, 28, 43)

    # Homeless rows only add unknown conditions.
    for code in s.INADEQUACY_CODES:
        ok, bad, missing = v1[code]
        assert v2[code] == (ok, bad, missing + 147)


def test_identities(spark, medium):
    persons = standin_persons(spark, medium)
    n = 3793
    for corrected in (False, True):
        added = 0 if corrected else PERSON.totals.deficit
        for code, counted in by_code(report(persons, PERSON, corrected).collect()).items():
            assert sum(counted) == n + (added if code.startswith("I") else 0)


def test_both_count_forms_agree(spark, medium):
    table = unnumbered_components(standin_persons(spark, medium), PERSON)
    assert sorted(sm.condition_counts(table).collect()) == sorted(
        sm.pivot_counts(sm.unpivot_conditions(table)).collect()
    )


def test_numbers_are_consecutive_and_in_stacking_order(spark, medium):
    table = components(standin_persons(spark, medium), PERSON).persist()
    assert [r[0] for r in table.select("ID").orderBy("ID").collect()] == list(range(1, 3794))
    spans = table.groupBy(s.ROW_KIND).agg(F.min("ID").alias("lo"), F.max("ID").alias("hi")).collect()
    at = {r[0]: (r.lo, r.hi) for r in spans}
    ends = [at[k] for k in s.STACKING_ORDER]
    assert all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:]))
    table.unpersist()


def test_class_follows_flags(spark, medium):
    table = unnumbered_components(standin_persons(spark, medium), PERSON)
    wrong = (F.col(f"`{s.CLASS}`") == s.DEFICIT) != (F.col(f"`{s.DEFICIT}`") == s.BAD)
    assert table.filter(wrong).isEmpty()


def test_distinct_keys(spark, medium):
    families = fam.extract_families(normalise_registry(standin_persons(spark, medium)))
    assert families.select(s.KEY).distinct().count() == 1500


def test_numbers_follow_row_kind_and_key(spark, small):
    """The order that is given by definition, whatever orders the rows of one kind and key."""
    import __spark_entry__ as entry

    rows = sorted(entry.queries()["sequential_id"](spark, small).collect(), key=lambda r: r[s.ROW_ID])
    assert [r[s.ROW_ID] for r in rows] == list(range(1, len(rows) + 1))
    places = [(s.STACKING_ORDER.index(r[s.ROW_KIND]), r[s.KEY] is not None, r[s.KEY] or "") for r in rows]
    assert places == sorted(places)
