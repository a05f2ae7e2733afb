"""One key holding a third of the rows: same results, and work that is cut into pieces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lares import components
from lares import schema as s
from lares.operators import families as fam
from lares.operators import keys
from lares.operators.numbering import sequential_id
from lares.plans.housing import family_base, stacking_order
from lares.sources.registry import normalise_registry
from standin import FAMILY, PERSON, standin_persons


@pytest.fixture(scope="module", params=[None, "7"])
def skewed(spark, medium, request, tmp_path_factory):
    """A third of the persons share one key (null or not) and all differ in their complement.

    A stored table: a filter over a key that hashes nineteen unstored expressions makes the optimiser derive
    constraints for each of them in turn, which takes more memory than a small driver has.
    """
    persons = normalise_registry(standin_persons(spark, medium))
    hot = F.pmod(F.xxhash64(*persons.columns), F.lit(3)) == 0
    distinct = F.concat(F.lit("LOTE "), F.monotonically_increasing_id().cast("string"))
    path = str(tmp_path_factory.mktemp("skewed") / "registry")
    persons.withColumns(
        {
            s.KEY: F.when(hot, F.lit(request.param)).otherwise(F.col(s.KEY)),
            s.COMPLEMENT: F.when(hot, distinct).otherwise(F.col(s.COMPLEMENT)),
        }
    ).write.parquet(path)
    return spark.read.parquet(path), request.param


def test_hot_keys_are_found_and_bounded(spark, skewed):
    persons, key = skewed
    total = persons.count()
    hot = keys.hot_keys(persons, s.KEY, max_keys=100).collect()
    assert key in [r[0] for r in hot]
    assert len(hot) < 100
    assert sum(r[1] for r in hot) < 200
    pieces = {r[0]: r[1] for r in hot}[key]
    assert pieces >= 0.3 * total / (total / 100)
    # Unless given, the bound follows the shuffle partitions, and the key is cut at any size.
    assert key in [r[0] for r in keys.hot_keys(persons, s.KEY).collect()]
    few = persons.filter(F.col(s.KEY).eqNullSafe(F.lit(key))).limit(3)
    assert [r[1] for r in keys.hot_keys(few, s.KEY).collect()] == [3]


def test_marking_is_the_same_with_and_without_hot_keys(spark, skewed):
    persons, key = skewed
    families, members = fam.extract_families(persons), fam.homeless_keys(persons)
    hot = keys.hot_keys(persons, s.KEY, max_keys=100)
    marked = keys.mark_members(families, members, s.KEY, "flag", hot)
    wanted = {r[0] for r in members.collect()}
    rows = marked.select(s.KEY, "flag").collect()
    assert len(rows) == families.count()
    assert all(flag == (k in wanted) for k, flag in rows)
    assert key in wanted
    matched = keys.semi_join(families, members, s.KEY, hot)
    assert matched.count() == sum(flag for _, flag in rows)


def test_hot_key_rows_are_spread_over_join_partitions(spark, skewed):
    persons, key = skewed
    families, members = fam.extract_families(persons), fam.homeless_keys(persons)
    hot = keys.hot_keys(persons, s.KEY, max_keys=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = keys.mark_members(families, members, s.KEY, "flag", hot)
        where = marked.filter(F.col(s.KEY).eqNullSafe(F.lit(key))).groupBy(F.spark_partition_id()).count()
        sizes = [r[1] for r in where.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8
    assert max(sizes) < 2.5 * sum(sizes) / 8


def test_equal_added_rows_are_cut_across_number_partitions(spark, skewed):
    """Added rows keep only the key, so those of the hot key look alike; the origin hash parts them."""
    persons, key = skewed
    alike = persons.withColumn(s.FAMILIES, F.lit(2.0))
    base = family_base(alike, PERSON)
    order = stacking_order()
    extra = base.filter(F.col(s.KEY).eqNullSafe(F.lit(key)) & (F.col(s.ROW_KIND) == "ID1"))
    parts = extra.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8
    numbered = sequential_id(base, order, [s.KEY, s.ROW_KIND], "ID")
    n = base.count()
    stats = numbered.agg(F.min("ID"), F.max("ID"), F.countDistinct("ID")).first()
    assert tuple(stats) == (1, n, n)


def test_components_of_skewed_registry(spark, skewed):
    persons, key = skewed
    table = components(persons, PERSON)
    flagged = {r[0] for r in fam.homeless_keys(persons).collect()}
    assert table.filter((F.col("D07") == s.BAD) != F.col(s.KEY).isin([k for k in flagged if k])
                        ).filter(F.col(s.KEY).isNotNull()).isEmpty()
    if key is None:
        assert table.filter(F.col(s.KEY).isNull() & (F.col("D07") != s.BAD)).isEmpty()
