"""Composite queries on particles: trajectories, and energy bands within a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trajectory(points: DataFrame, ids: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """All points of the listed ids, by id, then time."""
    return points.join(ids, id_col, "left_semi").orderBy(id_col, time_col)


def write_trajectories(points: DataFrame, id_col: str, time_col: str, path: str) -> None:
    """One folder of CSV for each id, in order of time."""
    points.repartition(id_col).sortWithinPartitions(id_col, time_col).write.mode("overwrite").partitionBy(id_col).csv(path, header=True)


def energy_band(particles: DataFrame, energy: Column, lo: float, hi: float, box: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Particles of energy in [lo, hi), and within the closed box where one is given. Plain ranges, which reach the scan."""
    inside = (energy >= lo) & (energy < hi)
    for column, (a, b) in (box or {}).items():
        inside = inside & F.col(column).between(a, b)
    return particles.filter(inside)


def momentum(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(1 + x * x + y * y + z * z)


def modal_band(particles: DataFrame, counts: DataFrame, energy: Column) -> DataFrame:
    """Particles in the fullest bucket of a histogram (bucket, edge, count); the lowest of equals. The last bucket has no end."""
    order = F.struct("count", (-F.col("bucket")).alias("b"))
    best = counts.agg(F.max_by(F.struct("bucket", "edge"), order).alias("m"), F.array_sort(F.collect_list(F.struct("bucket", "edge"))).alias("all"))
    ends = best.select(F.col("m.edge").alias("lo"), F.get("all", F.col("m.bucket") + 1)["edge"].alias("hi"))  # one row
    return particles.join(F.broadcast(ends), (energy >= F.col("lo")) & (F.col("hi").isNull() | (energy < F.col("hi")))).drop("lo", "hi")
