"""Consecutive row numbers without sending all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.sources.staging import Staging

_POSITION = "_position"
_PART = "_part"
_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position within it below


def sequential_id(
    df: DataFrame, order_by: Sequence[Column], keep: Sequence[str], name: str, staging: Staging | None = None
) -> DataFrame:
    """``keep`` columns plus ``name`` = 1..N in the given order.

    Runs a job: the rows are range-partitioned, sorted within each partition and written to the staging folder along
    with their position, so that a lost executor cannot move a row after its number is known. A number is
    then the position plus the size of the partitions before. ``order_by`` should tell rows apart, so that a
    frequent key can be cut across partitions, and be narrow, as samples of it go to the driver.
    """
    ordered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_POSITION, F.monotonically_increasing_id())
        .select(*[F.col(f"`{c}`") for c in keep], _POSITION)
    )
    saved = (staging or Staging(df.sparkSession)).table(ordered, "numbered").withColumn(
        _PART, F.shiftright(_POSITION, _POSITION_BITS)
    )
    # One row per shuffle partition: small by construction, so one task and a broadcast are fine.
    sizes = saved.groupBy(_PART).agg(F.count("*").alias("_size"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.col(_POSITION).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return saved.join(F.broadcast(offsets), _PART).select(
        (F.col("_offset") + within + 1).alias(name), *[F.col(f"`{c}`") for c in keep]
    )
