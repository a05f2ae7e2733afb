"""Reading extracts and writing results."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from lares import (
    Staging,
    components,
    read_registry,
    report,
    unreadable_numbers,
    write_components,
    write_csv2,
    write_report,
    write_results,
)
from lares import schema as s
from lares.sources.exports import CSV2
from lares.functions.arithmetic import parsed_number, plain_digits, ratio
from lares.operators import families as fam
from lares.sources.staging import CHECKPOINT_SETTING
from standin import FAMILY, PERSON, standin_persons


def test_csv_extract_reads_like_parquet(spark, small, tmp_path):
    persons = standin_persons(spark, small)
    variant = {name: old for old, name in s.HEADER_VARIANTS.items()}
    persons.write.parquet(str(tmp_path / "pq"))
    persons.withColumnsRenamed(variant).write.option("header", True).csv(str(tmp_path / "csv"))
    a = read_registry(spark, str(tmp_path / "pq"))
    b = read_registry(spark, str(tmp_path / "csv"), "csv")
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert report(a, PERSON).collect() == report(b, PERSON).collect()


def _cells(**values):
    cells = {c: "1" if c in s.NUMERIC else "x" for c in s.PERSON_SCHEMA.names}
    return cells | {getattr(s, name): value for name, value in values.items()}


def test_csv_text_is_trimmed_and_blank_is_null(spark, small, tmp_path):
    cells = _cells(KEY=" 01 ", PERSONS=" 2 ", BEDROOMS="", ROOMS="NA", SITUATION="")
    path = tmp_path / "one.csv"
    path.write_text(";".join(cells) + "\n" + ";".join(cells.values()) + "\n", encoding="utf-8")
    row = read_registry(spark, str(path), "csv", sep=";").first()
    assert (row[s.KEY], row[s.PERSONS], row[s.BEDROOMS], row[s.ROOMS], row[s.SITUATION]) == (
        "01", 2.0, None, None, None,
    )


def test_components_round_trip(spark, small, tmp_path):
    table = components(standin_persons(spark, small), PERSON)
    write_components(table, str(tmp_path / "pq"))
    back = spark.read.parquet(str(tmp_path / "pq"))
    assert back.columns == table.columns
    assert back.exceptAll(table).isEmpty() and back.count() == table.count()


def test_report_is_one_file_with_decimal_commas(spark, small, tmp_path):
    out = str(tmp_path / "report")
    write_report(report(standin_persons(spark, small), PERSON), out)
    files = glob.glob(f"{out}/part-*.csv")
    assert len(files) == 1
    lines = open(files[0], encoding="utf-8").read().splitlines()
    assert lines[0] == "Codigo;Componente;Inadequado;%;Adequado;Sem Dados ou Não Aplicável"
    assert len(lines) == 19
    assert [x.split(";")[0] for x in lines[1:]] == sorted(x.split(";")[0] for x in lines[1:])
    assert all("." not in x.split(";")[3] for x in lines[1:])


def test_csv2_values_survive(spark, tmp_path):
    df = spark.createDataFrame(
        [("a;b", 1.5, 1), ('say "x"', 1e10, 2), (None, None, None), ("á", 0.001, 4)], "t string, x double, n long"
    )
    write_csv2(df, str(tmp_path / "o"))
    back = spark.read.schema("t string, x string, n long").options(**CSV2).csv(str(tmp_path / "o"))
    got = sorted(map(tuple, back.collect()), key=repr)
    want = [("a;b", "1,5", 1), ('say "x"', "10000000000", 2), (None, None, None), ("á", "0,001", 4)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["?", "1.234,5", "12a"])
def test_unreadable_numbers_raise(spark, tmp_path, text):
    cells = _cells(RENT=text)
    path = tmp_path / "one.csv"
    path.write_text(";".join(cells) + "\n" + ";".join(cells.values()) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="holds no number"):
        read_registry(spark, str(path), "csv", sep=";").collect()
    assert read_registry(spark, str(path), "csv", lenient=True, sep=";").first()[s.RENT] is None
    raw = spark.read.options(header=True, sep=";").csv(str(path))
    assert unreadable_numbers(raw).first()[s.RENT] == 1 and unreadable_numbers(raw).first()[s.INCOME] == 0


def test_decimal_commas(spark):
    texts = ["1,5", "1.234,5", "1.234.567", "-0,25", "12", "1.23", "1,2,3", "x", " 7,0 ", "1e3", None]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in table.select(parsed_number(F.col("t"), ",")).collect()]
    assert got == [1.5, 1234.5, 1234567.0, -0.25, 12.0, None, None, None, 7.0, 1000.0, None]


def test_broken_records_raise(spark, tmp_path):
    cells = _cells(COMPLEMENT='"two\nlines"')
    path = tmp_path / "one.csv"
    path.write_text(";".join(cells) + "\n" + ";".join(cells.values()) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED"):
        read_registry(spark, str(path), "csv", sep=";").collect()
    row = read_registry(spark, str(path), "csv", sep=";", multiLine=True).first()
    assert row[s.COMPLEMENT] == "two\nlines"


def test_digits_are_not_cut(spark):
    doubles = [1e-17, 1e10, 0.001, -1.5e-7, 1.5, 123456789.125, 1e22, -2.0, 0.0, float("nan"), None]
    table = spark.createDataFrame([(x,) for x in doubles], "x double")
    got = [r[0] for r in table.select(plain_digits(F.col("x"), "double")).collect()]
    assert got[:3] == ["0,00000000000000001", "10000000000", "0,001"]
    assert got[3:] == ["-0,00000015", "1,5", "123456789,125", "1" + "0" * 22, "-2", "0", "NaN", None]
    back = table.select("x", parsed_number(plain_digits(F.col("x"), "double"), ",").alias("y"))
    assert back.filter("x != y and not isnan(x)").isEmpty()
    decimal = spark.sql("SELECT CAST('0.123456789012345678' AS DECIMAL(20, 18)) AS x")
    assert decimal.select(plain_digits(F.col("x"), "decimal(20,18)")).first()[0] == "0,123456789012345678"


def test_ratio_of_unknowns(spark):
    nan = float("nan")
    table = spark.createDataFrame([(nan, 0.0), (1.0, nan), (0.0, 0.0), (1.0, 0.0), (-1.0, 0.0)], "a double, b double")
    got = [r[0] for r in table.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [None, None, None, float("inf"), float("-inf")]


def test_staging_needs_a_folder(spark, tmp_path):
    a, b = Staging(spark).folder("x"), Staging(spark).folder("x")
    assert a != b and a.startswith(spark.conf.get(CHECKPOINT_SETTING))
    assert Staging(spark, str(tmp_path)).folder("x").startswith(str(tmp_path))

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        Staging(Session())


def test_results_are_counted_once_and_staging_is_cleared(spark, small, tmp_path):
    staging = Staging(spark, str(tmp_path / "staging"))
    result = write_results(standin_persons(spark, small), str(tmp_path / "out"), PERSON, staging=staging)
    assert not glob.glob(f"{tmp_path}/staging/lares-*")
    assert "FileScan" not in result._jdf.queryExecution().executedPlan().toString()
    assert result.collect() == report(standin_persons(spark, small), PERSON).collect()


def test_a_text_extract_is_parsed_once(spark, small, tmp_path):
    standin_persons(spark, small).write.option("header", True).csv(str(tmp_path / "csv"))
    registry = read_registry(spark, str(tmp_path / "csv"), "csv", staging=Staging(spark))
    plan = report(registry, PERSON)._jdf.queryExecution().toString()
    assert "FileScan parquet" in plan and "csv" not in plan.lower()
    assert report(registry, PERSON).collect() == report(standin_persons(spark, small), PERSON).collect()


def test_homeless_column_is_checked_before_any_job(spark, small):
    persons = standin_persons(spark, small)
    for wrong in (persons.drop(s.HOMELESS), persons.withColumn(s.HOMELESS, F.lit(1))):
        with pytest.raises(ValueError, match=s.HOMELESS):
            fam.homeless_keys(wrong)
        with pytest.raises(ValueError, match=s.HOMELESS):
            report(wrong, PERSON)


def test_layouts_have_their_width(spark, small):
    from lares.plans import housing

    with pytest.raises(ValueError, match="19 columns"):
        report(standin_persons(spark, small), housing.PERSON)
    wide = standin_persons(spark, small, further=60)
    assert len(housing.families(wide, housing.PERSON).columns) == 38 + 4
    assert len(housing.families(wide, housing.FAMILY).columns) == 66 + 4


def test_person_filter_reaches_the_scan(spark, small, tmp_path):
    from lares.operators.families import homeless_keys
    from lares.sources.registry import normalise_registry

    standin_persons(spark, small).write.parquet(str(tmp_path / "pq"))
    keys = homeless_keys(normalise_registry(spark.read.parquet(str(tmp_path / "pq"))))
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(`Situacao de Rua`,Sim)" in plan
    assert "ReadSchema: struct<Codigo familiar:string,Situacao de Rua:string>" in plan


@pytest.mark.parametrize("layout", ["family", "person"])
def test_command_line_run(spark, small, tmp_path, layout, capsys):
    from lares.__main__ import main

    persons = standin_persons(spark, small)
    persons.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    main(["--registry", str(tmp_path / "in"), "--layout", layout, "--family-columns", "18", "--output", out])
    assert "Total Déficit" in capsys.readouterr().out
    chosen = PERSON if layout == "person" else FAMILY
    table = components(persons, chosen)
    reader = spark.read.schema(table.schema)
    if layout == "person":
        back = reader.parquet(f"{out}/components")
    else:
        back = reader.options(**CSV2).csv(f"{out}/components")
    assert back.exceptAll(table).isEmpty() and back.count() == table.count()
    written = spark.read.options(**CSV2).csv(f"{out}/report").collect()
    wanted = report(persons, chosen).collect()
    assert [(r[0], int(r["Inadequado"])) for r in written] == [(r[0], r["Inadequado"]) for r in wanted]


def test_columns_named_like_the_added_ones_are_replaced(spark, small):
    from lares.operators.families import extract_families
    from lares.sources.registry import normalise_registry

    persons = normalise_registry(standin_persons(spark, small))
    persons = persons.withColumn("ID", F.lit(5)).withColumn("a.b", F.lit(1))
    families = extract_families(persons, [*s.FAMILY_COLUMNS, "ID", "a.b"])
    assert families.filter(F.col("ID") != F.col(s.KEY)).isEmpty()
    assert "a.b" in families.columns and families.columns.count("ID") == 1
    assert components(persons, PERSON, family_columns=[*s.FAMILY_COLUMNS, "ID", "a.b"]).count() == 368
