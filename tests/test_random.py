"""Random registries, with null keys, unknown texts and a hot key, against the SQL of the whole chain."""

from __future__ import annotations

import random

import duckdb
import pytest

import oracle
from lares import components, report
from lares import schema as s
from standin import FAMILY, PERSON
from tests.compare import duckdb_result, spark_result

ROWS = 6000


def random_rows(seed):
    rng = random.Random(seed)
    texts = {c: [t for v in verdicts.values() for t in v] for c, verdicts in s.CATEGORIES.items()}
    texts[s.SITUATION] = ["urbana", "urbana", "rural"]
    texts[s.COMPLEMENT] = [*s.SHARED_LOT_WORDS, "CASA", "ap 3", "RUA REDONDO", "LOTE 3", "FUNDOSX", ""]
    numbers = {
        s.PERSONS: [0, 1, 2, 3, 4, 6, 9, -1], s.BEDROOMS: [0, 1, 2, 3], s.ROOMS: [0, 1, 1.5, 2, 5],
        s.FAMILIES: [0, 1, 1, 1, 1.5, 2, 3, 4, 9], s.RENT: [0, 90, 100, 300, -5],
        s.INCOME: [0, 300, 299, 1000, 333.3],
    }
    families = []
    for i in range(ROWS // 3):
        key = None if rng.random() < 0.2 else "hot" if rng.random() < 0.25 else str(rng.randrange(ROWS // 4))
        row = {s.KEY: key}
        for c, choices in texts.items():
            row[c] = None if rng.random() < 0.1 else "?" if rng.random() < 0.05 else rng.choice(choices)
        for c, choices in numbers.items():
            row[c] = None if rng.random() < 0.1 else float(rng.choice(choices))
        families.append(row)
    for _ in range(ROWS):
        family = rng.choice(families)
        yield {**family, s.HOMELESS: rng.choice([None, "Nao", "Nao", "Nao", "Nao", "Nao", "sim", "Sim"])}


@pytest.fixture(scope="module", params=[1, 2])
def both(spark, request, tmp_path_factory):
    rows = [tuple(r[c] for c in s.PERSON_SCHEMA.names) for r in random_rows(request.param)]
    registry = spark.createDataFrame(rows, s.PERSON_SCHEMA)
    path = str(tmp_path_factory.mktemp("random") / "persons")
    registry.write.parquet(path)
    registry = spark.read.parquet(path)
    short = ["k", *oracle.ATTRIBUTES, "street"]
    columns = ", ".join(f'"{oracle.HEADERS[c]}" AS {c}' for c in short)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE stored AS SELECT {columns} FROM read_parquet('{path}/*.parquet')")
    return registry, con


def sql_for(name):
    return oracle.oracle_sql()[name].replace(oracle.PERSONS, "\npersons AS (SELECT * FROM stored)")


CASES = {
    "components_v1": (components, FAMILY, False),
    "components_v2": (components, PERSON, False),
    "components_corrected": (components, PERSON, True),
    "report_v1": (report, FAMILY, False),
    "report_v2": (report, PERSON, False),
    "report_v1_corrected": (report, FAMILY, True),
    "report_corrected": (report, PERSON, True),
}


@pytest.mark.parametrize("name", CASES)
def test_whole_chain(spark, both, name):
    registry, con = both
    plan, layout, corrected = CASES[name]
    assert spark_result(plan(registry, layout, corrected)) == duckdb_result(con, sql_for(name))
