"""Membership of rows in a key set, safe when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 50_000
#: A key is hot above this part of an even share of the shuffle partitions.
SHARE = 0.25

_SPREAD = "_spread"
_PIECES = "_pieces"


def hot_keys(rows: DataFrame, key: str, max_keys: int | None = None) -> DataFrame:
    """Keys with more than ``1 / max_keys`` of all rows, and into how many pieces to cut each.

    The rule is the same at every size: unless given, ``max_keys`` follows the number of shuffle partitions,
    a quarter of whose even share a key may hold in one piece, up to ``MAX_HOT_KEYS``. Fewer than
    ``max_keys`` keys can hold that much, and their pieces sum to less than twice as many, so both this table
    and anything it multiplies stay bounded. No key gets more pieces than it has rows. Reads the key column
    only. A null key counts like any other.
    """
    if max_keys is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        max_keys = min(MAX_HOT_KEYS, int(partitions / SHARE))
    limit = rows.agg(F.count("*").cast("double")).scalar() / F.lit(float(max_keys))
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    pieces = F.least(F.ceil(F.col("_rows") / limit), F.col("_rows")).cast("int")
    return counts.filter(F.col("_rows") > limit).select(key, pieces.alias(_PIECES)).filter(f"{_PIECES} > 1")


def _same_key(left: DataFrame, right: DataFrame, key: str) -> Column:
    return left[key].eqNullSafe(right[key])


def _with_pieces(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    hot = hot.select(F.col(key).alias("_hot_key"), _PIECES)
    joined = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    return joined.drop("_hot_key").withColumn(_PIECES, F.coalesce(_PIECES, F.lit(1)))


def mark_members(
    rows: DataFrame,
    members: DataFrame,
    key: str,
    flag: str,
    hot: DataFrame | None = None,
    content: Column | None = None,
) -> DataFrame:
    """Adds boolean ``flag``: does the row's key occur in ``members``? Null matches null.

    ``members`` holds each key once. Rows of a hot key are cut into pieces by a hash of their ``content``
    (of the whole row unless given), and a hot member is repeated once per piece; all other rows join on
    the key alone. The member side is broadcast only if adaptive execution measures it to be small.
    """
    if hot is None:
        hot = hot_keys(rows, key)
    if content is None:
        content = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    left = _with_pieces(rows, hot, key)
    left = left.withColumn(_SPREAD, F.pmod(content, F.col(_PIECES)).cast("int")).drop(_PIECES)
    right = _with_pieces(members.select(key), hot, key).select(
        F.col(key).alias("_member"),
        F.explode(F.sequence(F.lit(0), F.col(_PIECES) - 1)).alias("_piece"),
    )
    same = F.col(key).eqNullSafe(F.col("_member")) & (F.col(_SPREAD) == F.col("_piece"))
    return (
        left.join(right, same, "left")
        .withColumn(flag, F.col("_piece").isNotNull())
        .drop("_member", "_piece", _SPREAD)
    )


def semi_join(
    rows: DataFrame,
    members: DataFrame,
    key: str,
    hot: DataFrame | None = None,
    content: Column | None = None,
) -> DataFrame:
    """Rows whose key occurs in ``members``, each once."""
    marked = mark_members(rows, members, key, "_is_member", hot, content)
    return marked.filter("_is_member").drop("_is_member")
