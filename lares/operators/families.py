"""From registry rows to the stacked family base."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares import schema as s

TEXT_ID = "ID"
ORIGIN = "_origin"
DIGEST = "_digest"
_OTHER = "_other"


def family_slice(registry: DataFrame, family_columns: int | Sequence[str] | None = None) -> DataFrame:
    """The family part of the registry: the first n columns, the named ones, or the known ones."""
    if family_columns is None:
        family_columns = s.FAMILY_COLUMNS
    elif isinstance(family_columns, int):
        if len(registry.columns) < family_columns:
            raise ValueError(f"registry has {len(registry.columns)} columns, its family part should have {family_columns}")
        family_columns = registry.columns[:family_columns]
    return registry.select(*[F.col(f"`{c}`") for c in family_columns])


def extract_families(
    registry: DataFrame, family_columns: int | Sequence[str] | None = None
) -> DataFrame:
    """Distinct family rows, marked ``ID0``. A key keeps as many rows as it has different contents.

    Two short stand-ins for the content come along: ``_origin``, a hash to cut a frequent key by, and
    ``_digest``, to order the rows of a key by. Columns no rule reads take part in the distinct as one
    struct, which keeps the generated code of this and the next stage within what the JVM compiles,
    however wide the registry is.
    """
    families = family_slice(registry, family_columns)
    columns = families.columns
    known = [c for c in columns if c in s.FAMILY_COLUMNS]
    other = [c for c in columns if c not in known]
    packed = [*known, F.struct(*[F.col(f"`{c}`") for c in other]).alias(_OTHER)] if other else known
    distinct = families.select(*packed).distinct()
    replaced = {TEXT_ID.lower(), s.ROW_KIND.lower()}
    unpacked = [
        F.col(_OTHER).getField(c).alias(c) if c in other else F.col(c)
        for c in columns
        if c.lower() not in replaced
    ]
    return distinct.select(
        *unpacked,
        F.xxhash64(*distinct.columns).alias(ORIGIN),
        content_digest().alias(DIGEST),
        F.col(s.KEY).cast("string").alias(TEXT_ID),
        F.lit(s.FAMILY_ROW).alias(s.ROW_KIND),
    )


def content_digest() -> Column:
    """MD5 of the known family columns as text, "|" between them and "?" for nulls; the key is left out."""
    texts = [F.col(c).cast("string") for c in s.FAMILY_COLUMNS if c != s.KEY]
    return F.md5(F.array_join(F.array(*texts), "|", "?"))


def _text_id() -> Column:
    # The key prints as "NA" where it is missing.
    return F.concat_ws(" ", F.coalesce(F.col(s.KEY).cast("string"), F.lit("NA")), F.col(s.ROW_KIND))


def _extra_families() -> Column:
    n = F.col(s.FAMILIES)
    return F.when(n > 3, 3).when(n > 2, 2).when(n > 1, 1).otherwise(0)


def homeless_keys(registry: DataFrame) -> DataFrame:
    """Keys with at least one person marked homeless, each once (a null key is a key)."""
    if dict(registry.dtypes).get(s.HOMELESS) != "string":
        raise ValueError(f"the registry needs a text column {s.HOMELESS!r}")
    return registry.filter(F.col(s.HOMELESS) == s.HOMELESS_YES).select(s.KEY).distinct()


def homeless_family_count(registry: DataFrame) -> DataFrame:
    """One row: the number of distinct keys with a person marked homeless."""
    return homeless_keys(registry).agg(F.count("*").alias("homeless_families"))


def homeless_rows(keys: DataFrame) -> DataFrame:
    """One added row per homeless key."""
    rows = keys.withColumns({s.HOMELESS_CODE: F.lit(s.BAD), s.ROW_KIND: F.lit(s.HOMELESS_ROW)})
    return rows.withColumn(TEXT_ID, _text_id())


def cohabiting_rows(families: DataFrame) -> DataFrame:
    """One added row per further family in a shared dwelling, at most three: ID1, ID2, ID3."""
    kinds = F.array(*[F.lit(k) for k in s.COHABITING_ROWS])
    rows = families.select(
        s.KEY,
        F.lit(s.BAD).alias("D04"),
        F.explode(F.slice(kinds, F.lit(1), _extra_families())).alias(s.ROW_KIND),
    )
    return rows.withColumn(TEXT_ID, _text_id())


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_families(families: DataFrame, homeless: DataFrame | None = None) -> DataFrame:
    """Family rows, the rows added for cohabiting families and, if given, the homeless rows.

    Same rows as ``stack_tables(families, homeless_rows, cohabiting_rows)`` without the text IDs and the
    preset conditions, but ``families`` is evaluated once: every family row is exploded into its row kinds
    and added rows keep the key only. Columns with a leading underscore are not attributes and stay; among
    them ``_origin`` tells apart added rows that are otherwise equal.
    """
    kinds = F.array(*[F.lit(k) for k in (s.FAMILY_ROW, *s.COHABITING_ROWS)])
    columns = [c for c in families.columns if c not in (TEXT_ID, s.ROW_KIND)]
    exploded = families.select(
        *[F.col(f"`{c}`") for c in columns],
        F.explode(F.slice(kinds, F.lit(1), _extra_families() + 1)).alias(s.ROW_KIND),
    )
    is_family = F.col(s.ROW_KIND) == s.FAMILY_ROW
    attributes = [c for c in columns if c != s.KEY and not c.startswith("_")]
    stacked = exploded.withColumns({c: F.when(is_family, F.col(f"`{c}`")) for c in attributes})
    if homeless is None:
        return stacked
    return stack_tables(stacked, homeless.select(s.KEY, F.lit(s.HOMELESS_ROW).alias(s.ROW_KIND)))
