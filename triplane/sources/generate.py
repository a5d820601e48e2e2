"""Generated triples, for loads and tests: rows of ``spark.range``, made where they are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(spark: SparkSession, count: int, rank: int = 0) -> DataFrame:
    """s, p, o, seq: ``count`` triples of numbered names: subject-<rank>-<number> and so on."""
    name = lambda part: F.format_string(f"{part}-%d-%d", F.lit(rank), F.col("id")).alias(part[0])
    return spark.range(count).select(name("subject"), name("predicate"), name("object"), F.col("id").alias("seq"))


def scattered(spark: SparkSession, count: int, sizes: tuple[int, int, int] = (8, 4, 24), seed: int = 0) -> DataFrame:
    """s, p, o (binary, of ``sizes`` bytes), seq: bytes told by the seed and the row's number alone, so every run makes the same."""
    def part(k: int, size: int):
        words = [F.hex(F.xxhash64(F.lit(seed), F.lit(k), F.lit(i), F.col("id"))) for i in range(-(-size // 8))]
        return F.unhex(F.substring(F.concat(*(F.lpad(w, 16, "0") for w in words)), 1, 2 * size))

    return spark.range(count).select(*(part(k, n).alias(c) for k, (c, n) in enumerate(zip("spo", sizes, strict=True))), F.col("id").alias("seq"))


def words(spark: SparkSession, count: int, shortest: int = 4, longest: int = 12, seed: int = 0) -> DataFrame:
    """s, p, o, seq: pronounceable words of ``shortest`` to ``longest`` letters, consonants and vowels in turn."""
    def part(k: int):
        pick = lambda i, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i, F.col("id")), F.lit(n)).cast("int")
        letter = lambda i: F.when(i % 2 == 0, F.substring(F.lit("bcdfghjklmnprstvwz"), pick(i, 18) + 1, F.lit(1))).otherwise(F.substring(F.lit("aeiou"), pick(i, 5) + 1, F.lit(1)))
        size = pick(F.lit(-1), longest - shortest + 1) + shortest
        return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), letter), "")

    return spark.range(count).select(*(part(k).alias(c) for k, c in enumerate("spo")), F.col("id").alias("seq"))
