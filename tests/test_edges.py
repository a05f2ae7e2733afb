"""Hand-made rows for cases the test tables lack."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lares import Totals, components, report
from lares import schema as s
from lares.functions.arithmetic import plain_digits, ratio, round_share
from lares.functions.conditions import label, shared_lot_pattern, with_findings
from lares.operators import families as fam
from lares.operators import summary as sm
from lares.operators.classify import summary_codes
from lares.plans.housing import family_base, unnumbered_components
from lares.sources.registry import normalise_headers, normalise_registry
from standin import FAMILY, PERSON

SOUND = {
    s.KEY: "1", s.SITUATION: "urbana", s.DWELLING: "particular permanente",
    s.WALLS: "taipa revestida", s.FLOOR: "cimento", s.SEWAGE: "fossa septica",
    s.WATER_SUPPLY: "rede geral de distribuicao", s.LIGHTING: "eletrica com medidor proprio",
    s.REFUSE: "coletado diretamente", s.BATHROOM: "sim", s.PIPED_WATER: "sim",
    s.PERSONS: 2.0, s.BEDROOMS: 1.0, s.ROOMS: 4.0, s.FAMILIES: 1.0, s.RENT: 100.0, s.INCOME: 1000.0,
    s.COMPLEMENT: "CASA", s.HOMELESS: "Nao",
}


def registry(spark, *rows):
    data = [tuple({**SOUND, **r}[c] for c in s.PERSON_SCHEMA.names) for r in rows]
    return spark.createDataFrame(data, s.PERSON_SCHEMA)


def condition(spark, code, **changes):
    row = {getattr(s, k): v for k, v in changes.items()}
    found = with_findings(normalise_registry(registry(spark, row)), [code])
    return found.select(label(F.col(code))).first()[0]


CASES = [
    ("I01", dict(PERSONS=2.0, BEDROOMS=0.0), s.BAD),
    ("I01", dict(PERSONS=0.0, BEDROOMS=0.0), None),
    ("D03", dict(PERSONS=0.0, BEDROOMS=0.0, COMPLEMENT="AP 3"), None),
    ("I01", dict(PERSONS=-2.0, BEDROOMS=0.0), s.OK),
    ("I01", dict(PERSONS=2.0, BEDROOMS=None), None),
    ("I01", dict(PERSONS=float("nan")), None),
    ("I01", dict(PERSONS=float("nan"), BEDROOMS=0.0), None),
    ("I01", dict(BEDROOMS=float("nan")), None),
    ("I09", dict(RENT=300.0, INCOME=0.0), s.BAD),
    ("I09", dict(RENT=0.0, INCOME=0.0), None),
    ("I09", dict(RENT=90.0, INCOME=300.0), s.BAD),
    ("I09", dict(RENT=89.0, INCOME=300.0), s.OK),
    ("D03", dict(PERSONS=3.0, COMPLEMENT=None), None),
    ("D03", dict(PERSONS=3.0, COMPLEMENT="RUA REDONDO"), s.BAD),
    ("D03", dict(PERSONS=3.0, COMPLEMENT="ap 3"), s.OK),
    ("D03", dict(PERSONS=1.0, COMPLEMENT="AP 3"), None),
    ("D05", dict(SITUATION="rural", RENT=300.0), None),
    ("D05", dict(SITUATION="rural", RENT=300.0, PIPED_WATER="nao"), None),
    ("D05", dict(RENT=300.0), s.OK),
    ("D05", dict(RENT=300.0, PIPED_WATER="nao"), s.BAD),
    ("D05", dict(RENT=300.0, PERSONS=None, FLOOR="terra"), s.BAD),
    ("D05", dict(RENT=300.0, PERSONS=None), None),
    ("D05", dict(RENT=0.0, FLOOR="terra"), None),
    ("I04", dict(SITUATION="rural", PIPED_WATER="nao"), None),
    ("I04", dict(SITUATION=None, PIPED_WATER="nao"), None),
    ("I06", dict(SITUATION="rural"), None),
    ("I08", dict(REFUSE="outro destino"), s.BAD),
    ("D01", dict(DWELLING="barco"), None),
    ("D02", dict(WALLS="outro material"), s.BAD),
    ("I03", dict(FLOOR="outro material"), s.OK),
    ("D04", dict(FAMILIES=1.5), s.BAD),
    ("D04", dict(FAMILIES=None), None),
    ("D06", dict(ROOMS=1.0), s.BAD),
    ("D06", dict(ROOMS=-1.0), s.BAD),
]


@pytest.mark.parametrize("code,changes,want", CASES)
def test_condition(spark, code, changes, want):
    assert condition(spark, code, **changes) == want


def test_short_pattern_finds_what_the_word_list_finds(spark):
    words = s.SHARED_LOT_WORDS
    short = shared_lot_pattern().split("|")
    assert len(words) == 36 and len(short) == 23
    assert all(any(w in word for w in short) for word in words)
    assert set(short) <= set(words)


def test_ratio(spark):
    inf, nan = math.inf, math.nan
    cases = [(1.0, 2.0, 0.5), (1.0, 0.0, inf), (-1.0, 0.0, -inf), (0.0, 0.0, None), (None, 0.0, None),
             (1.0, None, None), (0.0, None, None), (inf, inf, None), (None, None, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double").coalesce(1)
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [w for _, _, w in cases]
    assert nan != nan


def test_share_ties_go_to_even(spark):
    df = spark.createDataFrame([(0.0625,), (0.0635,), (0.1875,)], "x double").coalesce(1)
    assert [r[0] for r in df.select(round_share(F.col("x"))).collect()] == [0.062, 0.064, 0.188]


def test_plain_digits(spark):
    xs = [100000.0, 1.2e10, 0.023, 0.0, 1.0, -2.5, 0.0005, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    got = [r[0] for r in df.select(plain_digits(F.col("x"), "double")).collect()]
    assert got == ["100000", "12000000000", "0,023", "0", "1", "-2,5", "0,0005", None]


def test_extra_rows_per_family_count(spark):
    counts = {"a": None, "b": 1.0, "c": 1.5, "d": 2.0, "e": 3.0, "f": 4.0, "g": 9.0, "h": 0.0}
    rows = registry(spark, *[{s.KEY: k, s.FAMILIES: n} for k, n in counts.items()])
    extra = fam.cohabiting_rows(fam.extract_families(rows)).groupBy(s.KEY).count().collect()
    assert dict(map(tuple, extra)) == {"c": 1, "d": 1, "e": 2, "f": 3, "g": 3}


def test_exploded_stack_equals_naive_stack(spark, medium):
    from standin import standin_persons

    persons = normalise_registry(standin_persons(spark, medium))
    families, members = fam.extract_families(persons), fam.homeless_keys(persons)
    naive = fam.stack_tables(families, fam.homeless_rows(members), fam.cohabiting_rows(families))
    columns = [s.ROW_KIND, *s.FAMILY_COLUMNS]
    stacked = fam.stack_families(families, members).select(columns)
    naive = naive.select(columns)
    assert stacked.exceptAll(naive).isEmpty() and naive.exceptAll(stacked).isEmpty()


def test_null_key_matches_null_key(spark):
    rows = registry(spark, {s.KEY: None, s.HOMELESS: "Sim"}, {s.KEY: None}, {s.KEY: "2"})
    got = unnumbered_components(rows, PERSON).select(s.KEY, s.ROW_KIND, "D07").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("2", "ID0", s.OK), (None, "ID0", s.BAD), (None, "ID7", s.BAD)], key=repr
    )


def test_homeless_key_with_two_contents_is_added_once(spark):
    rows = registry(spark, {s.HOMELESS: "Sim"}, {s.COMPLEMENT: "AP 1"})
    got = unnumbered_components(rows, PERSON).select(s.ROW_KIND, "D07").collect()
    assert sorted(map(tuple, got)) == [("ID0", s.BAD), ("ID0", s.BAD), ("ID7", s.BAD)]


def test_distinct_looks_at_the_chosen_columns(spark):
    rows = registry(spark, {}, {}).withColumn("visita", F.monotonically_increasing_id())
    assert fam.extract_families(rows).count() == 1
    assert fam.extract_families(rows, [*s.FAMILY_COLUMNS, "visita"]).count() == 2
    assert fam.extract_families(rows, len(s.FAMILY_COLUMNS)).count() == 1
    assert unnumbered_components(rows, PERSON, family_columns=[*s.FAMILY_COLUMNS, "visita"]).count() == 2


def test_condition_that_never_occurs_counts_zero(spark):
    table = unnumbered_components(registry(spark, {}), FAMILY)
    one_pass = sm.condition_counts(table).collect()
    pivoted = sm.pivot_counts(sm.unpivot_conditions(table)).collect()
    assert sorted(one_pass) == sorted(pivoted)
    assert all(r[s.OK] + r[s.BAD] + r[s.MISSING] == 1 for r in one_pass)


def test_report_of_empty_registry(spark):
    rows = registry(spark, {}).limit(0)
    for corrected in (False, True):
        got = report(rows, PERSON, corrected).collect()
        assert [r[s.CODE] for r in got] == sorted(summary_codes(True))
        assert all(r[s.BAD] == 0 for r in got)
    assert components(rows, PERSON).count() == 0


def test_header_variants(spark):
    variant = {name: old for old, name in s.HEADER_VARIANTS.items()}
    plain = registry(spark, {})
    odd = plain.withColumnsRenamed(variant)
    assert normalise_headers(odd).columns == plain.columns
    assert report(odd, PERSON).collect() == report(plain, PERSON).collect()
    with pytest.raises(ValueError):
        normalise_headers(plain.withColumn(variant[s.WALLS], F.lit("palha")))
    with pytest.raises(ValueError):
        normalise_headers(plain.drop(s.WALLS))
    with pytest.raises(ValueError):
        normalise_registry(plain.drop(s.RENT))


def test_numeric_keys_become_plain_text(spark):
    rows = registry(spark, {}).withColumn(s.KEY, F.lit(12345678901.0))
    assert normalise_registry(rows).first()[s.KEY] == "12345678901"
    rows = registry(spark, {}).withColumn(s.KEY, F.lit(7).cast("long"))
    assert normalise_registry(rows).first()[s.KEY] == "7"


def test_totals_can_be_given(spark):
    got = {r[s.CODE]: r for r in report(registry(spark, {s.ROOMS: 1.0}), FAMILY, totals=Totals(16, 10)).collect()}
    assert got["D06"][s.SHARE] == 0.062
    assert got["I01"][s.MISSING] == 16


def test_row_flags_cover_added_rows(spark):
    base = family_base(registry(spark, {s.FAMILIES: 3.0, s.HOMELESS: "Sim"}), PERSON)
    got = base.select(s.ROW_KIND, "_homeless", s.ROOMS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("ID0", True, 4.0), ("ID1", True, None), ("ID2", True, None), ("ID7", True, None)], key=repr
    )
