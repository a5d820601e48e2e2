"""Reading triples: exact lookups, ordered seeks and bounded scans, one at a time or in batches.

Keys are compared as they are typed; (s, p) in that order. A miss of an exact lookup is a row of status ERROR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from pyspark.sql.window import Window

from triplane.sources.tables import cut

from .triples import ERROR, SUCCESS

OPS = ("EQ", "NEXT", "PREV", "FIRST", "LAST", "LOWEST", "HIGHEST")


def get(triples: DataFrame, s, p) -> DataFrame:
    """The triple of one key, or a row of status ERROR with a null object."""
    one = triples.sparkSession.range(1).select(F.lit(s).alias("s"), F.lit(p).alias("p"))
    return bget(triples.filter((F.col("s") == s) & (F.col("p") == p)), one)


def bget(triples: DataFrame, requests: DataFrame, wanted: str | None = None) -> DataFrame:
    """Each request (s, p, ...) with o and status. With ``wanted`` (column of asked types) also o_type and type_mismatch: the stored type wins."""
    kept = ["s", "p", "o", *(["o_type"] if wanted else [])]
    hit = requests.join(triples.select(*kept, F.lit(True).alias("_hit")), ["s", "p"], "left")
    out = hit.withColumn("status", F.when(F.col("_hit"), SUCCESS).otherwise(ERROR)).drop("_hit")
    return out.withColumn("type_mismatch", F.coalesce(F.col(wanted) != F.col("o_type"), F.lit(False))) if wanted else out


def _from(s, p=None) -> Column:
    """Rows whose key is at or after (s, p)."""
    return F.col("s") >= s if p is None else (F.col("s") > s) | ((F.col("s") == s) & (F.col("p") >= p))


def _upto(s, p=None) -> Column:
    return F.col("s") <= s if p is None else (F.col("s") < s) | ((F.col("s") == s) & (F.col("p") <= p))


def getop(triples: DataFrame, op: str, s=None, p=None, n: int = 1) -> DataFrame:
    """Up to ``n`` triples of an ordered scan, as filter, sort and limit.

    EQ: the first key at or after (s, p). NEXT: from there on, ascending. PREV: from that key backwards. FIRST and
    LAST: the smallest and largest keys. LOWEST and HIGHEST: within subject s (and predicates that start with p, where
    given). Any other op: one row of status ERROR that echoes s and p.
    """
    up, down = [F.asc("s"), F.asc("p")], [F.desc("s"), F.desc("p")]
    if op == "EQ":
        rows = triples.filter(_from(s, p)).orderBy(*up).limit(1)
    elif op == "NEXT":
        rows = triples.filter(_from(s, p)).orderBy(*up).limit(n)
    elif op == "PREV":
        start = triples.filter(_from(s, p)).select("s", "p").orderBy(*up).first()  # one key, so that the scan below gets a range of literals
        rows = triples.filter(_upto(*start) if start else F.lit(False)).orderBy(*down).limit(n)
    elif op in ("FIRST", "LAST"):
        rows = triples.orderBy(*(up if op == "FIRST" else down)).limit(n)
    elif op in ("LOWEST", "HIGHEST"):
        inside = F.col("s") == s
        inside = inside & F.col("p").cast("string").startswith(p) if p is not None else inside
        rows = triples.filter(inside).orderBy(*(up if op == "LOWEST" else down)).limit(n)
    else:
        echo = triples.schema
        return triples.sparkSession.range(1).select(F.lit(s).cast(echo["s"].dataType).alias("s"), F.lit(p).cast(echo["p"].dataType).alias("p"), F.lit(None).cast(echo["o"].dataType).alias("o"), F.lit(ERROR).alias("status"))
    return rows.select("s", "p", "o").withColumn("status", F.lit(SUCCESS))


def extreme_objects(triples: DataFrame, p, n: int, highest: bool = False, tie: str = "s") -> DataFrame:
    """The n triples of predicate p with the lowest (or highest) objects."""
    order = F.desc("o") if highest else F.asc("o")
    return triples.filter(F.col("p") == p).orderBy(order, F.asc(tie)).limit(n)


def first_per_datastore(triples: DataFrame, n: int, last: bool = False) -> DataFrame:
    """FIRST (or LAST) n keys of each datastore (column ds)."""
    order = [F.desc("s"), F.desc("p")] if last else [F.asc("s"), F.asc("p")]
    return triples.withColumn("rn", F.row_number().over(Window.partitionBy("ds").orderBy(*order))).filter(F.col("rn") <= n)


def numbered(rows: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """``rows`` with rank: how many rows with ``counted`` = 1 come up to each row in the order of ``keys``.

    Rows are dealt by ranges of the keys, numbered within a range, and each range starts where the ones before it end:
    no task gets all rows.
    """
    placed = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum(counted).alias("_n"))  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.sum(counted).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_w", within).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_w") + F.col("_start")).drop("_part", "_w", "_start")


def _successor(prefix: Column) -> Column:
    """The least binary key after all that start with ``prefix``; null where there is none."""
    kept = F.unhex(F.regexp_replace(F.hex(prefix), "(FF)+$", ""))
    last = F.conv(F.hex(F.substring(kept, -1, 1)), 16, 10).cast("long") + 1
    return F.when(F.length(kept) > 0, F.concat(kept.substr(F.lit(1), F.length(kept) - 1), F.unhex(F.lpad(F.hex(last), 2, "0"))))


def bgetop(triples: DataFrame, requests: DataFrame, op: str | None = None) -> DataFrame:
    """For each request (rid, s, p, n, and its op where none is given for all): rn, s, p, o, status of what ``getop`` finds.

    Places of requests are numbered with the keys in one order, equal places once; each request then takes the keys of its
    ranks by an equal join. LOWEST and HIGHEST stay within the request's subject and, where predicates are strings or
    bytes, within those that start with its p (null: all); typed predicates of other kinds have no prefix and p is not
    looked at. Any other op: a row of status ERROR that echoes s and p. An empty scan has no rows.
    """
    kinds = {c: triples.schema[c].dataType for c in ("s", "p", "o")}
    prefixed = isinstance(kinds["p"], (StringType, BinaryType))
    sought = F.col("p").cast("binary") if prefixed else F.col("p").cast(kinds["p"])
    inside = sought if prefixed else F.lit(None).cast(kinds["p"])
    ask = requests.select(
        F.col("rid").cast("long").alias("rid"), F.col("s").alias("rs"), F.col("p").alias("rp"),
        F.coalesce(F.col("op") if op is None else F.lit(op), F.lit("")).alias("op"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"), sought.alias("sought"), inside.alias("inside"),
    )
    end = _successor(F.col("inside")) if prefixed else F.col("inside")
    ask = ask.withColumn("at", F.when(F.col("op") == "HIGHEST", end).when(F.col("op") == "LOWEST", F.col("inside")).otherwise(F.col("sought"))).drop("sought")
    # HIGHEST starts from the end of its prefix: after all keys of the subject, where nothing comes after the prefix.
    ask = ask.withColumn("late", ((F.col("op") == "HIGHEST") & F.col("at").isNull()).cast("int")).withColumn("n", F.when(F.col("op") == "EQ", 1).otherwise(F.col("n")))

    keys = triples.select("s", sought.alias("at"), F.lit(0).alias("late"), F.lit(1).alias("is_key"), "p", "o")
    places = ask.filter(F.col("op").isin("EQ", "NEXT", "PREV", "LOWEST", "HIGHEST")).select(F.col("rs").alias("s"), "at", "late", F.lit(0).alias("is_key")).distinct()
    # Places come before equal keys.
    ranked = cut(numbered(keys.unionByName(places, allowMissingColumns=True), ["s", "late", "at", "is_key"], "is_key"))
    keyed = ranked.filter("is_key = 1").select("rank", "s", "p", "o", F.col("at").alias("key"))
    placed = ranked.filter("is_key = 0").select(F.col("s").alias("_s"), F.col("at").alias("_at"), F.col("late").alias("_late"), F.col("rank").alias("before"))
    total = keyed.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("total"))  # one row

    same = ask["rs"].eqNullSafe(placed["_s"]) & ask["at"].eqNullSafe(placed["_at"]) & (ask["late"] == placed["_late"])
    start = F.when(F.col("op") == "FIRST", 1).when(F.col("op") == "LAST", F.col("total")).when(F.col("op") == "HIGHEST", F.col("before")).otherwise(F.col("before") + 1)
    asked = ask.filter(F.col("op").isin(*OPS)).join(placed, same, "left").crossJoin(F.broadcast(total)).withColumn("start", start)
    down = F.col("op").isin("PREV", "HIGHEST", "LAST")
    most = F.when(F.col("start") > F.col("total"), 0).when(down, F.least("n", "start")).otherwise(F.least("n", F.col("total") - F.col("start") + 1))
    asked = asked.withColumn("most", most).filter("most > 0").select("rid", "rs", "op", "inside", "start", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("i"))
    found = asked.withColumn("rank", F.when(down, F.col("start") - F.col("i")).otherwise(F.col("start") + F.col("i"))).join(keyed, "rank")
    within = (F.col("rs") == F.col("s")) & (F.coalesce(F.startswith("key", "inside"), F.col("inside").isNull()) if prefixed else F.lit(True))
    found = found.filter(~F.col("op").isin("LOWEST", "HIGHEST") | within)
    found = found.select("rid", (F.col("i") + 1).cast("int").alias("rn"), "s", "p", "o", F.lit(SUCCESS).alias("status"))
    wrong = ask.filter(~F.col("op").isin(*OPS))
    return found.unionByName(wrong.select("rid", F.lit(1).alias("rn"), F.col("rs").cast(kinds["s"]).alias("s"), F.col("rp").cast(kinds["p"]).alias("p"), F.lit(None).cast(kinds["o"]).alias("o"), F.lit(ERROR).alias("status")))


def prefix_range(key: Column, prefix: bytes) -> Column:
    """Rows whose binary key starts with ``prefix``, as a range that reaches the Parquet scan."""
    end = bytearray(prefix)
    while end and end[-1] == 255:
        end.pop()
    inside = key >= F.lit(bytes(prefix))
    if end:
        end[-1] += 1
        inside = inside & (key < F.lit(bytes(end)))
    return inside & F.startswith(key, F.lit(bytes(prefix)))
