"""A person-level registry made from the test tables: one row per order, families by customer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lares import schema as s
from lares.plans import housing

#: The stand-in has the columns that the rules know and no others.
FAMILY = replace(housing.FAMILY, family_columns=s.FAMILY_COLUMNS)
PERSON = replace(housing.PERSON, family_columns=s.FAMILY_COLUMNS)


def _texts(column: str, first: str = s.OK) -> list[str | None]:
    """The column's category texts, those of one verdict before those of the other, and a missing one."""
    known = s.CATEGORIES[column]
    return [*known[first], *known[s.BAD if first == s.OK else s.OK], None]


def _pick(index: Column, values: list[str | None]) -> Column:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return F.get(F.expr(f"array({listed})"), index.cast("int"))


def standin_persons(spark: SparkSession, sf_dir: str, further: int = 0) -> DataFrame:
    """``further`` adds that many family columns that no rule knows, after the known ones."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    k, p = F.col("c_custkey"), F.col("o_orderkey")

    def number(c: Column) -> Column:
        return c.cast("double")

    def unless(gap: Column, value: Column) -> Column:
        return F.when(~gap, value)

    columns = {
        s.KEY: k.cast("string"),
        s.SITUATION: F.when(k % 5 == 0, "rural").when(k % 5 != 4, "urbana"),
        s.DWELLING: F.when(k % 11 == 0, "particular improvisado")
        .when(k % 11 == 1, "coletivo")
        .when(k % 11 != 2, "particular permanente"),
        s.WALLS: _pick(k % 9, _texts(s.WALLS, s.BAD)),
        s.FLOOR: _pick(k % 8, _texts(s.FLOOR)),
        s.SEWAGE: _pick(k % 61 % 7, _texts(s.SEWAGE)),
        s.WATER_SUPPLY: _pick(k % 23 % 5, _texts(s.WATER_SUPPLY)),
        s.LIGHTING: _pick(k % 29 % 7, _texts(s.LIGHTING)),
        s.REFUSE: _pick(k % 31 % 7, _texts(s.REFUSE)),
        s.BATHROOM: F.when(k % 13 == 0, "nao").when(k % 13 != 1, "sim"),
        s.PIPED_WATER: F.when(k % 17 == 0, "nao").when(k % 17 != 1, "sim"),
        s.PERSONS: number(k % 10),
        s.BEDROOMS: unless(k % 19 == 0, number(k % 4)),
        s.ROOMS: unless(k % 6 == 5, number(k % 6)),
        s.FAMILIES: unless(k % 53 % 7 == 6, number(k % 53 % 7)),
        s.RENT: unless(k % 41 == 0, (k % 37) * F.lit(25.0)),
        s.INCOME: (k % 43) * F.lit(50.0),
        s.COMPLEMENT: unless(p % 101 == 0, _pick(k % 7, [
            "AP 12", "CASA", "FUNDOS", "casa ap", "RUA REDONDO", None, "LOTE 3",
        ])),
        **{f"outra {i}": (p % (i + 1)).cast("string") for i in range(1, further + 1)},
        s.HOMELESS: F.when(p % 97 == 0, "Sim").when(p % 97 != 1, "Nao"),
    }
    joined = orders.join(customers, F.col("o_custkey") == k)
    return joined.select(*[c.alias(name) for name, c in columns.items()])
