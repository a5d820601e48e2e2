"""Writing triples (s, p, o, seq): from wide tables, under permuted keys, the latest of each key, and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the key permutations, fixed values of the interface.
PERMUTATIONS = {"SPO": 1, "SOP": 2, "PSO": 4, "POS": 8, "OSP": 16, "OPS": 32}
ALL = 63
SUCCESS, ERROR = "SUCCESS", "ERROR"


def from_wide(df: DataFrame, subject: str, columns: list[str], seq: str | None = None) -> DataFrame:
    """A triple (s, p, o as text, seq) for each column of each row, in one narrow pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in columns))
    return df.select(F.col(subject).cast("string").alias("s"), F.col(seq or subject).alias("seq"), F.inline(pairs)).select("s", "p", "o", "seq")


def permute(triples: DataFrame, mask: int | Column = ALL) -> DataFrame:
    """A row (perm, k1, k2, v, seq) for each permutation whose bit is in ``mask``; key and value parts as text."""
    mask = F.lit(mask) if isinstance(mask, int) else mask
    part = {c: F.col(c.lower()).cast("string") for c in "SPO"}
    rows = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(n).alias("perm"), part[n[0]].alias("k1"), part[n[1]].alias("k2"), part[n[2]].alias("v")) for n, bit in PERMUTATIONS.items()))
    chosen = F.filter(rows, lambda r: r["bit"].bitwiseAND(mask) != 0)
    return triples.select("seq", F.inline(chosen)).select("perm", "k1", "k2", "v", "seq")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest seq of each key: last write wins. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")


def delete(triples: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("s", "p")) -> DataFrame:
    """``triples`` without the requested keys. Other permutations of a triple are rows of their own and stay."""
    return triples.join(requests.select(*keys).distinct(), list(keys), "left_anti")


def delete_status(triples: DataFrame, requests: DataFrame, always: bool = False, keys: tuple[str, ...] = ("s", "p")) -> DataFrame:
    """Each request with its status: ERROR for a key that is not there, or with ``always`` SUCCESS."""
    there = triples.select(*keys, F.lit(True).alias("_hit")).distinct()
    hit = requests.join(there, list(keys), "left")
    return hit.withColumn("status", F.when(F.lit(always) | F.col("_hit"), SUCCESS).otherwise(ERROR)).drop("_hit")
