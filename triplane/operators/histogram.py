"""Histograms calibrated on the first values: edges come from the first n in arrival order and stay; all values are counted."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplane.sources.tables import cut

#: Groups up to which edges are broadcast.
FEW_GROUPS = 10_000


def _even(bins: Column) -> Column:
    """Edges of equal bins from the smallest first value on."""
    n = F.greatest(bins.cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / n))


def buckets(n: int = 10) -> Callable[[], Column]:
    """n edges, a whole number apart."""
    return lambda: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("lo") + i * F.ceil((F.col("hi") - F.col("lo")) / n))


def square_root() -> Column:
    return _even(F.floor(F.sqrt("n")))


def sturges() -> Column:
    return _even(F.floor(F.log2("n") + 2))


def rice() -> Column:
    return _even(F.floor(F.cbrt("n") + 2))


def scott() -> Column:
    width = 3.5 * F.col("sd") / F.cbrt("n")
    return _even(F.when(width > 0, F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(1))


def uniform_log(base: float) -> Callable[[], Column]:
    def edges() -> Column:
        spread = F.col("hi") - F.col("lo")
        return _even(F.when(spread > 1, F.ceil(spread * math.log(base) / F.ln(F.when(spread > 1, spread)))).otherwise(1))

    return edges


def fixed(edges: list[float]) -> Callable[[], Column]:
    """Edges given by the caller."""
    return lambda: F.array(*(F.lit(float(x)) for x in edges))


#: Generators by the names that configurations use.
GENERATORS: dict[str, Callable[[], Column]] = {
    "10_BUCKETS": buckets(10),
    "SQUARE_ROOT_CHOICE": square_root,
    "STURGES_FORMULA": sturges,
    "RICE_RULE": rice,
    "SCOTTS_NORMAL_REFERENCE_RULE": scott,
    "UNIFORM_LOG2": uniform_log(2),
    "UNIFORM_LOG10": uniform_log(10),
}


def _groups(by: list[str]) -> list[str]:
    return by or ["_all"]


def edges(values: DataFrame, by: list[str], first_n: int, generator: str | Callable[[], Column]) -> DataFrame:
    """by..., edges (null until a group has first_n values), cache (its first values in order), n, top (largest value)."""
    make = GENERATORS[generator] if isinstance(generator, str) else generator
    keys = _groups(by)
    rows = values if by else values.withColumn("_all", F.lit(0))
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).filter(F.col("_rn") <= first_n)
    stats = first.groupBy(*keys).agg(
        F.min("o").alias("lo"), F.max("o").alias("hi"), F.stddev_samp("o").alias("sd"), F.count("o").alias("n"), F.array_sort(F.collect_list(F.struct("_rn", "o"))).alias("c")
    )
    totals = rows.groupBy(*keys).agg(F.count("o").alias("total"), F.max("o").alias("top"))
    ready = F.col("n") >= first_n
    return totals.join(stats, keys, "left").select(*keys, F.when(ready, make()).alias("edges"), F.transform("c", lambda x: x["o"]).alias("cache"), F.col("total"), "top")


def histogram(values: DataFrame, by: list[str], first_n: int = 10, generator: str | Callable[[], Column] = "10_BUCKETS") -> DataFrame:
    """by..., bucket, edge, count of ``values`` (by..., o, seq). Values under the first edge are not counted; the last bucket has no end.

    Counts are combined before the shuffle; only first_n values of a group are ever sorted together.
    """
    keys = _groups(by)
    made = cut(edges(values, by, first_n, generator).filter("edges IS NOT NULL").select(*keys, "edges"))
    # Few groups: their edges go to every task, and no value moves. Many: an equal join, whose hot groups Spark splits.
    near = F.broadcast(made) if made.count() <= FEW_GROUPS else made
    rows = values if by else values.withColumn("_all", F.lit(0))
    at = F.size(F.filter("edges", lambda e: e <= F.col("o"))) - 1
    # Counted by value's bucket with the edges at hand; each bucket of a group is one row after the combine.
    counted = rows.join(near, keys).withColumn("bucket", at).filter("bucket >= 0").groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("count"))
    listed = made.select(*keys, F.posexplode("edges").alias("bucket", "edge"))
    out = listed.join(counted, [*keys, "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out if by else out.drop("_all")


def status(values: DataFrame, by: list[str], first_n: int) -> DataFrame:
    """by..., total, status: ERROR until a group has first_n values."""
    counts = values.groupBy(*by).agg(F.count("o").alias("total"))
    return counts.withColumn("status", F.when(F.col("total") >= first_n, "SUCCESS").otherwise("ERROR"))


def lookup(histograms: DataFrame, requests: DataFrame, by: list[str]) -> DataFrame:
    """Requested histograms (rows by bucket); a name that is not there is a row of status ERROR."""
    hit = requests.join(histograms.withColumn("_hit", F.lit(True)), by, "left")
    return hit.withColumn("status", F.when(F.col("_hit"), "SUCCESS").otherwise("ERROR")).drop("_hit")
