"""Connected components of links between keys, by alternating large and small stars.

Every shuffle costs the driver memory: plans, a thread, and what it keeps of each task. So links are first joined in blocks
of CONTRACTED within a task, which needs no shuffle and ends links that fit into one block; and rounds end when the links
are stars, not when a further round has changed nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.llm.tables import settle

ROUNDS = 60
#: Links that a task joins at a time, and about as many as it reads: the number of tasks follows the links.
CONTRACTED = 1 << 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    out = joined.filter("v > u") if large else joined
    linked = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u != v").distinct()


def _least_of_each(links: list[tuple]) -> dict:
    """The least key that each key of the links is joined with by them; no entry for the least ones themselves."""
    above: dict = {}

    def least(key):
        while key in above:
            up = above[key]
            above[key] = above.get(up, up)
            key = up
        return key

    for pair in links:
        a, b = sorted(map(least, pair))
        if a != b:
            above[b] = a
    return {key: least(key) for key in list(above)}


def _contract(edges: DataFrame) -> DataFrame:
    """Links with the same components: of each block of a written table's links one star a component."""
    block = CONTRACTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []
        for batch in batches:
            links += zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True)
            for start in range(0, len(links) - block + 1, block):
                yield stars(links[start : start + block], batch.schema)
            links = links[len(links) - len(links) % block :]
            schema = batch.schema
        if links:
            yield stars(links, schema)

    def stars(links: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        found = _least_of_each(links)
        columns = [pa.array(list(x), schema.field(c).type) for c, x in (("u", found.keys()), ("v", found.values()))]
        return pa.RecordBatch.from_arrays(columns, ["u", "v"])

    return edges.coalesce(edges.count() // block + 1).mapInArrow(run, edges.schema)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each key either has one link, to its least key, or is the least of all it links with."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("links"))
    return near.filter("least < u and links > 1").count() == 0


def components(links: DataFrame) -> DataFrame:
    """u and its component's least member v, for every key that is not itself the least. links: columns u and v.

    Each round is a written table, so that a lost executor costs one round at most. Rounds grow with the logarithm
    of the longest chain; beyond ROUNDS the links raise an error rather than give wrong components.
    """
    edges = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"))
    edges = settle(_contract(edges))
    for _ in range(ROUNDS):
        if _are_stars(edges):
            return edges
        edges = settle(_star(_star(edges, large=True), large=False))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
