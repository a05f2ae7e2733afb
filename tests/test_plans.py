"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from lares import components, report
from lares import schema as s
from lares.plans.housing import family_base, findings, stacking_order, unnumbered_components
from lares.sources.registry import read_registry
from standin import FAMILY, PERSON, standin_persons

# The JVM does not compile methods above this size; a stage in such a method runs interpreted.
JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def registry(spark, small, tmp_path_factory):
    """A stored registry as wide as the widest known extract: 66 family columns, then person columns."""
    path = str(tmp_path_factory.mktemp("registry") / "persons")
    persons = standin_persons(spark, small)
    extra = [F.concat(F.col(s.KEY), F.lit(f"-{i}")).alias(f"outra {i}") for i in range(48)]
    family = [F.col(f"`{c}`") for c in s.FAMILY_COLUMNS]
    persons.select(*family, *extra, s.HOMELESS, F.lit("x").alias("Nome")).write.parquet(path)
    return read_registry(spark, path)


def explain(df, mode):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.fixture
def static_plans(spark):
    """Plans without adaptive execution show their final shape before they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("broadcast", ["-1", "1g"])
@pytest.mark.parametrize("layout", [FAMILY, PERSON])
@pytest.mark.parametrize("corrected", [False, True])
def test_stages_stay_compilable(spark, registry, static_plans, layout, corrected, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    order = stacking_order()
    for df in (
        family_base(registry, layout, 66).repartitionByRange(*order),
        findings(registry, layout, corrected, 66).repartitionByRange(*order),
        unnumbered_components(registry, layout, corrected, 66),
        report(registry, layout, corrected, family_columns=66),
    ):
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", explain(df, "codegen"))]
        assert sizes and max(sizes) < JIT_LIMIT


def scans(plan):
    return re.findall(r"ReadSchema: struct<(.*?)>", plan)


def test_only_the_distinct_reads_wide_rows(spark, registry, static_plans):
    plan = explain(report(registry, PERSON, family_columns=66), "formatted")
    widths = sorted(len(x.split(",")) if x else 0 for x in scans(plan))
    assert widths[-1] == 66
    assert all(w <= 2 for w in widths[:-1])
    assert "Nome" not in plan
    assert "EqualTo(`Situacao de Rua`,Sim)" in plan


def test_family_layout_needs_one_shuffle_of_rows(spark, registry, static_plans):
    plan = explain(unnumbered_components(registry, FAMILY), "formatted")
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1
    assert "Python" not in plan and "Window" not in plan


def test_no_unbounded_single_partition(spark, registry, static_plans):
    """Only aggregates already reduced to one row per task meet in one partition."""
    plan = explain(report(registry, PERSON), "formatted")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for head in re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: SinglePartition", plan):
        assert all(name.split("#")[0].startswith(("count", "n_")) for name in head[1].split(", "))


def test_no_python_workers(spark, registry, static_plans):
    plan = explain(report(registry, PERSON), "formatted")
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize(
    "settings",
    [
        {"spark.sql.shuffle.partitions": "1"},
        {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.enabled": "false"},
        {
            "spark.sql.shuffle.partitions": "13",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    ],
)
def test_numbers_do_not_depend_on_the_partitioning(spark, small, settings):
    persons = standin_persons(spark, small)
    wanted = sorted(components(persons, PERSON).collect())
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert sorted(components(persons, PERSON).collect()) == wanted
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
