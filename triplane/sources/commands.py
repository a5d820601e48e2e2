"""Text commands as request tables: one row for each request of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that each request of a verb takes after the verb (and, in the batch form, its count).
WORDS = {"PUT": 6, "GETOP": 7, "GET": 5, "DEL": 4}


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """line, verb, s_type, s, p_type, p, o_type, o, n, op of every request in ``lines`` (line, ``column``).

    A line is a verb (PUT, GET, GETOP, DEL, with B for a batch of a stated count, or FLUSH...) and its requests, each a
    <type value> pair for subject and predicate; then PUT has an object pair, GET a type, GETOP a type, a count and an
    op. A flush is one row. Lines of an unknown verb or with too few words give a row of verb ERROR.
    """
    words = F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")
    rows = lines.select("line", words.alias("w")).filter(F.size("w") > 0).withColumn("raw", F.upper(F.col("w")[0]))
    verb = F.when(F.col("raw").isin(*(f"B{v}" for v in WORDS)), F.substring("raw", 2, 9)).otherwise(F.col("raw"))
    rows = rows.withColumn("verb", verb).withColumn("batch", F.col("raw") != F.col("verb"))
    each = F.coalesce(*(F.when(F.col("verb") == v, n) for v, n in WORDS.items()), F.lit(0))
    rows = rows.withColumn("each", each).withColumn("count", F.when(F.col("batch"), F.get("w", F.lit(1)).try_cast("int")).otherwise(1))
    head = F.when(F.col("batch"), 2).otherwise(1)
    flush = F.col("verb").startswith("FLUSH")
    good = flush | ((F.col("each") > 0) & (F.col("count") > 0) & (F.size("w") >= head + F.col("count") * F.col("each")))
    one = lambda i: F.slice("w", head + i * F.col("each") + 1, F.greatest(F.col("each"), F.lit(1)))
    parts = F.when(flush | ~good, F.array(F.array().cast("array<string>"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("count") - 1), one))
    rows = rows.select("line", F.when(good, F.col("verb")).otherwise("ERROR").alias("verb"), F.posexplode(parts).alias("i", "x"))
    at = lambda i: F.get("x", F.lit(i))
    is_op = F.col("verb") == "GETOP"
    return rows.select(
        "line", "i", "verb", at(0).alias("s_type"), at(1).alias("s"), at(2).alias("p_type"), at(3).alias("p"), at(4).alias("o_type"),
        F.when(F.col("verb") == "PUT", at(5)).alias("o"), F.when(is_op, at(5).try_cast("long")).alias("n"), F.when(is_op, at(6)).alias("op"),
    )
