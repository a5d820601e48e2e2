"""Connected components of a graph of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node of ``links`` (a, b).

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest neighbour,
    then every node's smaller neighbours are. Links end as stars around the smallest nodes, in about log rounds.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # (u, v): u's neighbours v; m: the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        out = joined.filter("v > u") if large else joined
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    sum_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sum_of(edges)
    while before[0]:
        edges = cut(star(star(edges, True), False))
        now = sum_of(edges)
        if now == before:
            break
        before = now
    pairs = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
