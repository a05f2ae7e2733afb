"""Shards of near equal bytes, tokens and rows by vector bin packing over groups of equal texts.

A group of equal texts has a vector: its UTF-8 bytes plus one a row, its words, its rows. Small groups are bundled, whole,
by a hash of the text into `BUNDLES` bundles. A group that holds more than one bundle's share of any of the three totals
is a unit of its own; only if it holds more than a whole shard's share, so that no shard could take it, is it cut by
document into units of about a bundle's share. Bundles and units (at most 7 * BUNDLES, whatever the input) are placed largest first, each into the
shard whose residual capacity has the greatest dot product with it; the first such shard at a tie. So a group of
equal texts is in one shard at every size of the table, unless it is larger than a shard.

Law `bytes`: the shards' sizes are near equal, as far as the units allow. Slots count from 0 in each shard, without gaps,
by item and then document. Items are bundles and, of a unit, pieces of about a bundle's share (at most
BUNDLES + 3 * 2 * BUNDLES items): an item's first slot is known from the items' row counts, so no task sees more than
one item's rows together. All of it rests on a table of narrow rows written once, so that a lost executor can't change it.

A null text counts as empty. Rows that repeat are placed each; equal rows are interchangeable. Rows without
doc_id are dealt by their place in the table. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lares.llm.tables import keyed_texts, settle

BUNDLES = 1 << 13
MEASURES = ("size", "tokens", "copies")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, digest and tokens of each row, and its place in this table."""
    value = F.coalesce("text", F.lit(""))
    return keyed_texts(docs, key, text).select(
        "doc_id",
        (F.octet_length(value) + 1).cast("bigint").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(value.cast("binary"))).alias("digest"),
        F.regexp_count(value, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
        F.monotonically_increasing_id().alias("place"),
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item."""
    totals = np.maximum(vectors.sum(0), 1)
    shares = vectors * (shards / totals)
    residual = np.ones((shards, vectors.shape[1]))
    chosen = np.zeros(len(vectors), np.int32)
    for i in np.argsort(-shares.max(1), kind="stable"):
        best = int(np.argmax(residual @ shares[i]))
        chosen[i] = best
        residual[best] -= shares[i]
    return chosen


def assign(docs: DataFrame, shards: int = 8, bundles: int = BUNDLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not this law's) and item of each row."""
    spark = docs.sparkSession
    rows = settle(measure(docs, key, text))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("copies")]
    totals = [max(1, n or 0) for n in rows.agg(*sums).first()]
    share = F.greatest(*[F.col(m) / F.lit(t) for m, t in zip(MEASURES, totals, strict=True)])
    # At most 3 * bundles groups can pass this.
    hot = [
        (bytes(r["digest"]), r["pieces"], r["cut"])
        for r in rows.groupBy("digest").agg(*sums)
        .select("digest", F.ceil(share * bundles).cast("int").alias("pieces"), (share * shards > 1).alias("cut"))
        .filter("pieces > 1").orderBy("digest").collect()
    ]
    first_piece = np.cumsum([bundles, *(pieces for _, pieces, _ in hot)])
    hot_rows = [(d, int(n), int(f)) for (d, n, _), f in zip(hot, first_piece, strict=False)]
    # The unit of each item: bundles and the pieces of a cut group are units, those of another group make one.
    unit_of = np.concatenate([np.arange(bundles), *(f + np.arange(n) * cut for (_, n, cut), f in zip(hot, first_piece, strict=False))])
    hot_groups = spark.createDataFrame(hot_rows, "digest binary, pieces int, first_piece int")
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles))
    piece = F.col("first_piece") + F.pmod(F.xxhash64(F.coalesce("doc_id", "place")), F.col("pieces"))
    dealt = rows.join(F.broadcast(hot_groups), "digest", "left").withColumn(
        "item", F.coalesce(piece, bundle).cast("int")
    )
    items = dealt.groupBy("item").agg(*sums).orderBy("item").collect()
    vectors = np.array([[r[m] for m in MEASURES] for r in items], np.float64).reshape(-1, len(MEASURES))
    units, own = np.unique(unit_of[[r["item"] for r in items]], return_inverse=True) if items else (np.zeros(0, int),) * 2
    together = np.zeros((len(units), len(MEASURES)))
    np.add.at(together, own, vectors)
    chosen = place(together, shards)[own]
    filled = [0] * shards
    table = []
    for item, shard in zip(items, chosen.tolist(), strict=True):
        table.append((item["item"], shard, filled[shard]))
        filled[shard] += item["copies"]
    placed = spark.createDataFrame(table, "item int, shard int, first_slot long")
    within = Window.partitionBy("item").orderBy("doc_id", "digest")
    return dealt.join(F.broadcast(placed), "item").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "item",
    )
