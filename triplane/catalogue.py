"""Registered queries on the test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.functions import encoding as E
from triplane.functions import partitioning as P
from triplane.functions import transforms
from triplane.operators import histogram as H
from triplane.operators import reads, triples
from triplane.plans import apps
from triplane.sources import generate
from triplane.sources.config import Config
from triplane.sources.store import TripleStore
from triplane.sources.tables import shared_folder
from triplane.streaming import puts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB form."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_triples(spark, sf_dir):
    """events as (s = event_type, p = event_id, o = value, seq)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("s"), F.col("event_id").alias("p"), F.col("value").alias("o"), F.col("event_id").alias("seq"))


def order_triples(spark, sf_dir):
    """orders as (s = o_orderkey, p = 'totalprice', o)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s"), F.lit("totalprice").alias("p"), F.col("o_totalprice").alias("o"), F.col("o_orderkey").alias("seq"))


def asked_orders(spark, sf_dir):
    """Every seventh order's key, and as many that are not there."""
    keys = order_triples(spark, sf_dir).filter(F.col("s") % 7 == 0)
    return keys.select("s", "p").unionByName(keys.select((-F.col("s") - 1).alias("s"), "p"))


ASKED = "(SELECT o_orderkey AS s FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 7 = 0)"
PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


# Writes.
@query("put_triples", " UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS s, '{c}' AS p, CAST({c} AS VARCHAR) AS o, p_partkey AS seq FROM part" for c in PART_COLUMNS))
def put_triples(spark, sf_dir):
    return triples.from_wide(table(spark, sf_dir, "part"), "p_partkey", PART_COLUMNS)


def _permuted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderstatus").alias("p"), F.col("o_orderpriority").alias("o"), F.col("o_orderkey").alias("seq"))
    return rows


_SPO = {"S": "CAST(o_custkey AS VARCHAR)", "P": "o_orderstatus", "O": "o_orderpriority"}


@query("put_permutations_all", " UNION ALL ".join(f"SELECT o_orderkey AS seq, '{n}' AS perm, {_SPO[n[0]]} AS k1, {_SPO[n[1]]} AS k2, {_SPO[n[2]]} AS v FROM orders" for n in triples.PERMUTATIONS))
def put_permutations_all(spark, sf_dir):
    return triples.permute(_permuted(spark, sf_dir))


@query("put_permutation_pos_lossy", "SELECT o_orderstatus AS k1, o_orderpriority AS k2, arg_max(CAST(o_custkey AS VARCHAR), o_orderkey) AS v FROM orders GROUP BY 1, 2")
def put_permutation_pos_lossy(spark, sf_dir):
    return triples.latest(triples.permute(_permuted(spark, sf_dir), triples.PERMUTATIONS["POS"]), ["k1", "k2"]).select("k1", "k2", "v")


@query("put_upsert_latest", "SELECT user_id AS s, event_type AS p, arg_max(value, event_id) AS o, max(event_id) AS seq FROM events GROUP BY 1, 2")
def put_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("s"), F.col("event_type").alias("p"), F.col("value").alias("o"), F.col("event_id").alias("seq"))
    return triples.latest(rows, ["s", "p"])


# Exact reads and deletes.
@query("get_point", "SELECT o_orderkey AS s, 'totalprice' AS p, o_totalprice AS o, 'SUCCESS' AS status FROM orders WHERE o_orderkey = 7")
def get_point(spark, sf_dir):
    return reads.get(order_triples(spark, sf_dir), 7, "totalprice")


@query("bget_hits_and_misses", f"SELECT r.s, 'totalprice' AS p, o_totalprice AS o, CASE WHEN o_orderkey IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM {ASKED} r LEFT JOIN orders ON o_orderkey = r.s")
def bget_hits_and_misses(spark, sf_dir):
    return reads.bget(order_triples(spark, sf_dir), asked_orders(spark, sf_dir))


@query(
    "bget_typed_mismatch",
    f"""SELECT r.s, 'totalprice' AS p, CASE WHEN r.s % 2 = 0 THEN 'DOUBLE' ELSE 'BYTE' END AS wanted, o_totalprice AS o, CASE WHEN o_orderkey IS NOT NULL THEN 'DOUBLE' END AS o_type,
        CASE WHEN o_orderkey IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status, coalesce(o_orderkey IS NOT NULL AND r.s % 2 <> 0, false) AS type_mismatch FROM {ASKED} r LEFT JOIN orders ON o_orderkey = r.s""",
)
def bget_typed_mismatch(spark, sf_dir):
    asked = asked_orders(spark, sf_dir).withColumn("wanted", F.when(F.col("s") % 2 == 0, "DOUBLE").otherwise("BYTE"))
    return reads.bget(order_triples(spark, sf_dir).withColumn("o_type", F.lit("DOUBLE")), asked, "wanted")


@query("bdelete", "SELECT o_orderkey AS s, 'totalprice' AS p, o_totalprice AS o, o_orderkey AS seq FROM orders WHERE o_orderkey % 7 <> 0")
def bdelete(spark, sf_dir):
    return triples.delete(order_triples(spark, sf_dir), asked_orders(spark, sf_dir))


@query("bdelete_status", f"SELECT r.s, 'totalprice' AS p, CASE WHEN o_orderkey IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM {ASKED} r LEFT JOIN orders ON o_orderkey = r.s")
def bdelete_status(spark, sf_dir):
    return triples.delete_status(order_triples(spark, sf_dir), asked_orders(spark, sf_dir))


@query("bdelete_status_lsm", f"SELECT r.s, 'totalprice' AS p, 'SUCCESS' AS status FROM {ASKED} r")
def bdelete_status_lsm(spark, sf_dir):
    return triples.delete_status(order_triples(spark, sf_dir), asked_orders(spark, sf_dir), always=True)


@query(
    "delete_keeps_permutations",
    """SELECT 'POS' AS perm, o_orderstatus AS k1, o_orderpriority AS k2, CAST(o_custkey AS VARCHAR) AS v, o_orderkey AS seq FROM orders
       UNION ALL SELECT 'SPO', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority, o_orderkey FROM orders WHERE o_custkey % 2 <> 0""",
)
def delete_keeps_permutations(spark, sf_dir):
    rows = triples.permute(_permuted(spark, sf_dir), triples.PERMUTATIONS["SPO"] | triples.PERMUTATIONS["POS"])
    gone = _permuted(spark, sf_dir).filter(F.col("s") % 2 == 0).select(F.lit("SPO").alias("perm"), F.col("s").cast("string").alias("k1"), F.col("p").alias("k2"))
    return triples.delete(rows, gone, ("perm", "k1", "k2")).select("perm", "k1", "k2", "v", "seq")


# The same with every order asked for, and as many keys that are not there; deleted are the orders of returned lines.
ALL_ASKED = "(SELECT o_orderkey AS s FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders)"
RETURNED = "(SELECT s FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), LATERAL (SELECT k AS s UNION ALL SELECT -k - 1))"


def all_orders_asked(spark, sf_dir):
    """Every order's key, and as many that are not there."""
    keys = order_triples(spark, sf_dir)
    return keys.select("s", "p").unionByName(keys.select((-F.col("s") - 1).alias("s"), "p"))


def returned_orders(spark, sf_dir):
    """The keys of all orders with a returned line, and as many that are not there."""
    keys = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("s")).distinct()
    return keys.select(F.explode(F.array("s", -F.col("s") - 1)).alias("s"), F.lit("totalprice").alias("p"))


@query("bget_hits_and_misses_all", f"SELECT r.s, 'totalprice' AS p, o_totalprice AS o, CASE WHEN o_orderkey IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM {ALL_ASKED} r LEFT JOIN orders ON o_orderkey = r.s")
def bget_hits_and_misses_all(spark, sf_dir):
    return reads.bget(order_triples(spark, sf_dir), all_orders_asked(spark, sf_dir))


@query(
    "bget_typed_mismatch_all",
    f"""SELECT r.s, 'totalprice' AS p, CASE WHEN r.s % 2 = 0 THEN 'DOUBLE' ELSE 'BYTE' END AS wanted, o_totalprice AS o, CASE WHEN o_orderkey IS NOT NULL THEN 'DOUBLE' END AS o_type,
        CASE WHEN o_orderkey IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status, coalesce(o_orderkey IS NOT NULL AND r.s % 2 <> 0, false) AS type_mismatch FROM {ALL_ASKED} r LEFT JOIN orders ON o_orderkey = r.s""",
)
def bget_typed_mismatch_all(spark, sf_dir):
    asked = all_orders_asked(spark, sf_dir).withColumn("wanted", F.when(F.col("s") % 2 == 0, "DOUBLE").otherwise("BYTE"))
    return reads.bget(order_triples(spark, sf_dir).withColumn("o_type", F.lit("DOUBLE")), asked, "wanted")


@query("bdelete_returned", "SELECT o_orderkey AS s, 'totalprice' AS p, o_totalprice AS o, o_orderkey AS seq FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def bdelete_returned(spark, sf_dir):
    return triples.delete(order_triples(spark, sf_dir), returned_orders(spark, sf_dir))


@query("bdelete_status_returned", f"SELECT r.s, 'totalprice' AS p, CASE WHEN o_orderkey IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM {RETURNED} r LEFT JOIN orders ON o_orderkey = r.s")
def bdelete_status_returned(spark, sf_dir):
    return triples.delete_status(order_triples(spark, sf_dir), returned_orders(spark, sf_dir))


@query("bdelete_status_lsm_returned", f"SELECT r.s, 'totalprice' AS p, 'SUCCESS' AS status FROM {RETURNED} r")
def bdelete_status_lsm_returned(spark, sf_dir):
    return triples.delete_status(order_triples(spark, sf_dir), returned_orders(spark, sf_dir), always=True)


# Ordered reads.
def _getop(name, sql, op, s=None, p=None, n=1, rows=order_triples):
    query(name, sql)(lambda spark, sf_dir: reads.getop(rows(spark, sf_dir), op, s, p, n))


_O = "SELECT o_orderkey AS s, 'totalprice' AS p, o_totalprice AS o, 'SUCCESS' AS status FROM orders"
_getop("getop_eq_seek", f"{_O} WHERE o_orderkey >= 10 ORDER BY o_orderkey LIMIT 1", "EQ", 10, "totalprice")
_getop("getop_next", f"{_O} WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 10", "NEXT", 100, "totalprice", 10)
_getop("getop_prev", f"{_O} WHERE o_orderkey <= (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 100) ORDER BY o_orderkey DESC LIMIT 10", "PREV", 100, "totalprice", 10)
_getop("getop_first", f"{_O} ORDER BY o_orderkey LIMIT 10", "FIRST", n=10)
_getop("getop_last", f"{_O} ORDER BY o_orderkey DESC LIMIT 10", "LAST", n=10)
_getop("getop_invalid", "SELECT CAST(7 AS BIGINT) AS s, 'totalprice' AS p, CAST(NULL AS DOUBLE) AS o, 'ERROR' AS status", "INVALID", 7, "totalprice")
_V = "SELECT event_type AS s, event_id AS p, value AS o, 'SUCCESS' AS status FROM events WHERE event_type = 'click'"
_getop("getop_lowest", f"{_V} ORDER BY event_id LIMIT 20", "LOWEST", "click", n=20, rows=value_triples)
_getop("getop_highest", f"{_V} ORDER BY event_id DESC LIMIT 20", "HIGHEST", "click", n=20, rows=value_triples)


@query("getop_eq_exact", "SELECT o_orderkey AS s, 'totalprice' AS p, o_totalprice AS o FROM orders WHERE o_orderkey = 32")
def getop_eq_exact(spark, sf_dir):
    return order_triples(spark, sf_dir).filter((F.col("s") == 32) & (F.col("p") == "totalprice")).select("s", "p", "o")


@query(
    "getop_prefix_bytes",
    """SELECT p_partkey AS id, hex(k) AS key_hex FROM (SELECT p_partkey, encode('part') || encode(CAST(p_partkey AS VARCHAR)) || '\\xFF'::BLOB AS k FROM part)
       WHERE k >= encode('part1') AND k < encode('part2') ORDER BY k LIMIT 25""".replace("\\\\", "\\"),
)
def getop_prefix_bytes(spark, sf_dir):
    key = F.concat(F.lit("part").cast("binary"), F.col("p_partkey").cast("string").cast("binary"), F.unhex(F.lit("FF")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key.alias("key"))
    return rows.filter(reads.prefix_range(F.col("key"), b"part1")).orderBy("key").limit(25).select("id", F.hex("key").alias("key_hex"))


def _asked_events(spark, sf_dir):
    """A request for every hundredth event: rid, s, p, n of 1 to 5."""
    rows = value_triples(spark, sf_dir).filter(F.col("p") % 100 == 3)
    return rows.select(F.col("p").alias("rid"), "s", (F.col("p") + 1).alias("p"), (1 + F.col("p") % 5).alias("n"))


_R = "(SELECT event_id AS rid, event_type AS rs, event_id + 1 AS rp, 1 + event_id % 5 AS n FROM events WHERE event_id % 100 = 3) r"
_NUMBERED = "(SELECT event_type AS s, event_id AS p, value AS o, row_number() OVER (ORDER BY event_type, event_id) AS k FROM events) e"


def _bgetop(op, sql):
    query(f"bgetop_{op.lower()}", sql)(lambda spark, sf_dir: reads.bgetop(value_triples(spark, sf_dir), _asked_events(spark, sf_dir), op).drop("status"))


_START = f"(SELECT rid, n, min(k) AS k0 FROM {_R} JOIN {_NUMBERED} ON (s > rs OR (s = rs AND p >= rp)) GROUP BY rid, n) t"
_bgetop("NEXT", f"SELECT rid, k - k0 + 1 AS rn, s, p, o FROM {_START} JOIN {_NUMBERED} ON k >= k0 AND k < k0 + n")
_bgetop("PREV", f"SELECT rid, k0 - k + 1 AS rn, s, p, o FROM {_START} JOIN {_NUMBERED} ON k <= k0 AND k > k0 - n")
_bgetop("LOWEST", f"SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY p) AS rn, s, p, o FROM {_R} JOIN {_NUMBERED} ON s = rs QUALIFY rn <= any_value(n) OVER (PARTITION BY rid)")
_bgetop("HIGHEST", f"SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY p DESC) AS rn, s, p, o FROM {_R} JOIN {_NUMBERED} ON s = rs QUALIFY rn <= any_value(n) OVER (PARTITION BY rid)")


# The same with a request for every event; in SQL, too, requests and keys are counted in one order.
_R_ALL = "(SELECT event_id AS rid, event_type AS rs, event_id + 1 AS rp, 1 + event_id % 5 AS n FROM events)"
_PLACED = f"""(SELECT rid, n, 1 + k AS k0 FROM (SELECT *, CAST(coalesce(sum(is_key) OVER (ORDER BY s, p, is_key ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS k FROM
    (SELECT event_type AS s, event_id AS p, 1 AS is_key, NULL AS rid, NULL AS n FROM events UNION ALL SELECT rs, rp, 0, rid, n FROM {_R_ALL})) WHERE is_key = 0)"""
_ENDS = "(SELECT event_type AS s, event_id AS p, value AS o, row_number() OVER (PARTITION BY event_type ORDER BY event_id {}) AS rn FROM events QUALIFY rn <= 5) e"


def _bgetop_all(op, sql):
    def run(spark, sf_dir):
        asked = value_triples(spark, sf_dir).select(F.col("p").alias("rid"), "s", (F.col("p") + 1).alias("p"), (1 + F.col("p") % 5).alias("n"))
        return reads.bgetop(value_triples(spark, sf_dir), asked, op).drop("status")

    query(f"bgetop_{op.lower()}_all", sql)(run)


_bgetop_all("NEXT", f"SELECT rid, i - k0 + 1 AS rn, s, p, o FROM (SELECT rid, k0, unnest(range(k0, k0 + n)) AS i FROM {_PLACED}) JOIN {_NUMBERED} ON k = i")
_bgetop_all("PREV", f"SELECT rid, k0 - i + 1 AS rn, s, p, o FROM (SELECT rid, k0, unnest(range(k0 - n + 1, k0 + 1)) AS i FROM {_PLACED} WHERE k0 <= (SELECT count(*) FROM events)) JOIN {_NUMBERED} ON k = i")
_bgetop_all("LOWEST", f"SELECT rid, rn, s, p, o FROM {_R_ALL} r JOIN {_ENDS.format('')} ON s = rs AND rn <= n")
_bgetop_all("HIGHEST", f"SELECT rid, rn, s, p, o FROM {_R_ALL} r JOIN {_ENDS.format('DESC')} ON s = rs AND rn <= n")


@query("getop_per_datastore_first", "SELECT s, p, o, seq, ds, rn FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY s) AS rn FROM (SELECT o_orderkey AS s, 'totalprice' AS p, o_totalprice AS o, o_orderkey AS seq, CAST(o_custkey % 5 AS INTEGER) AS ds FROM orders)) WHERE rn <= 4")
def getop_per_datastore_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s"), F.lit("totalprice").alias("p"), F.col("o_totalprice").alias("o"), F.col("o_orderkey").alias("seq"), P.datastore(lambda s, p: s, F.col("o_custkey"), F.lit("totalprice"), 5).alias("ds"))
    return reads.first_per_datastore(rows, 4)


# Queues and flushes.
def _store(spark) -> TripleStore:
    return TripleStore.open(spark, Config(datastore_prefix=f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", datastores_per_server=3))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("s"), F.lit("acctbal").alias("p"), F.col("c_acctbal").alias("o"), F.col("c_custkey").alias("seq"))


@query(
    "flush_order_results",
    """SELECT 0 AS op_order, 'PUT' AS op, c_name AS s, 'acctbal' AS p, CAST(NULL AS DOUBLE) AS o, 'SUCCESS' AS status FROM customer
       UNION ALL SELECT 1, 'GET', c_name, 'acctbal', c_acctbal, 'SUCCESS' FROM customer UNION ALL SELECT 1, 'GET', 'nobody', 'acctbal', NULL, 'ERROR'
       UNION ALL SELECT 3, 'DELETE', c_name, 'acctbal', NULL, 'SUCCESS' FROM customer WHERE c_custkey % 2 = 0""",
)
def flush_order_results(spark, sf_dir):
    store, rows = _store(spark), _customers(spark, sf_dir)
    store.bdelete(rows.filter(F.col("seq") % 2 == 0))
    store.bget(rows.select("s", "p").unionByName(spark.range(1).select(F.lit("nobody").alias("s"), F.lit("acctbal").alias("p"))))
    store.bput(rows)
    return store.flush()


@query("read_before_flush", "SELECT c_name AS s, 'acctbal' AS p, CAST(NULL AS DOUBLE) AS o, 'ERROR' AS status FROM customer")
def read_before_flush(spark, sf_dir):
    store, rows = _store(spark), _customers(spark, sf_dir)
    store.bput(rows)
    store.bget(rows)
    return store.flush_gets().select("s", "p", "o", "status")


@query("store_reopen", "SELECT c_name AS s, 'acctbal' AS p, c_acctbal AS o, 'SUCCESS' AS status FROM customer")
def store_reopen(spark, sf_dir):
    """Put, sync, open anew, and read all of it back."""
    store, rows = _store(spark), _customers(spark, sf_dir)
    store.bput(rows)
    store.sync()
    again = TripleStore.open(spark, store.config)
    again.bget(rows)
    return again.flush_gets().select("s", "p", "o", "status")


# Histograms of events.value by event_type.
_FIRST = 100
_STATS = f"""v AS (SELECT event_type AS name, value AS o, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
    f AS (SELECT name, min(o) AS lo, max(o) AS hi, stddev_samp(o) AS sd, count(*) AS n FROM v WHERE rn <= {_FIRST} GROUP BY name)"""


def _hist_sql(bins: str, step: str) -> str:
    return f"""WITH {_STATS}, b AS (SELECT *, CAST({bins} AS INTEGER) AS bins FROM f), w AS (SELECT *, {step} AS step FROM b),
        e AS (SELECT name, unnest(generate_series(0, bins - 1)) AS bucket, lo, step, bins FROM w),
        x AS (SELECT name, bucket, bins, lo + bucket * step AS edge FROM e),
        y AS (SELECT x.name, x.bucket, x.edge, coalesce(z.edge, CAST('infinity' AS DOUBLE)) AS next FROM x LEFT JOIN x z ON z.name = x.name AND z.bucket = x.bucket + 1)
        SELECT y.name, CAST(y.bucket AS INTEGER) AS bucket, round(y.edge, 6) AS edge, count(v.o) AS count FROM y LEFT JOIN v ON v.name = y.name AND v.o >= y.edge AND v.o < y.next GROUP BY ALL"""


def _values(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("o"), F.col("event_id").alias("seq"))


def _hist(name: str, generator, bins: str, step: str = "(hi - lo) / bins"):
    @query(name, _hist_sql(bins, step))
    def run(spark, sf_dir):
        out = H.histogram(_values(spark, sf_dir), ["name"], _FIRST, generator)
        return out.select("name", "bucket", F.round("edge", 6).alias("edge"), "count")


_hist("hist_10_buckets", "10_BUCKETS", "10", "ceil((hi - lo) / 10)")
_hist("hist_sqrt", "SQUARE_ROOT_CHOICE", "floor(sqrt(n))")
_hist("hist_sturges", "STURGES_FORMULA", "floor(log2(n) + 2)")
_hist("hist_rice", "RICE_RULE", "floor(cbrt(n) + 2)")
_hist("hist_scott_fixed", "SCOTTS_NORMAL_REFERENCE_RULE", "ceil((hi - lo) / (3.5 * sd / cbrt(n)))")
_hist("hist_log2", "UNIFORM_LOG2", "ceil((hi - lo) * ln(2) / ln(hi - lo))")
_hist("hist_log10", "UNIFORM_LOG10", "ceil((hi - lo) * ln(10) / ln(hi - lo))")


@query("hist_custom_edges", "SELECT event_type AS name, CASE WHEN value < 50 THEN 0 WHEN value < 100 THEN 1 ELSE 2 END AS bucket, count(*) AS count FROM events WHERE value >= 0 GROUP BY 1, 2")
def hist_custom_edges(spark, sf_dir):
    return H.histogram(_values(spark, sf_dir), ["name"], _FIRST, H.fixed([0, 50, 100])).filter("count > 0").select("name", "bucket", "count")


@query("hist_not_ready", "SELECT event_type AS name, count(*) AS total, CASE WHEN count(*) >= 1000000000 THEN 'SUCCESS' ELSE 'ERROR' END AS status FROM events GROUP BY 1")
def hist_not_ready(spark, sf_dir):
    return H.status(_values(spark, sf_dir), ["name"], 1_000_000_000)


@query("hist_upper_bound", "SELECT event_type AS name, max(value) AS top FROM events GROUP BY 1")
def hist_upper_bound(spark, sf_dir):
    return H.edges(_values(spark, sf_dir), ["name"], _FIRST, "10_BUCKETS").select("name", "top")


@query("hist_global", "WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM (SELECT value FROM events ORDER BY event_id LIMIT 100)) SELECT CAST(len(list_filter(list_transform(range(0, 10), lambda i: lo + i * ceil((hi - lo) / 10)), lambda e: e <= value)) - 1 AS INTEGER) AS bucket, count(*) AS count FROM events, s WHERE value >= lo GROUP BY 1")
def hist_global(spark, sf_dir):
    return H.histogram(_values(spark, sf_dir).drop("name"), [], 100, "10_BUCKETS").filter("count > 0").select("bucket", "count")


@query(
    "hist_per_datastore",
    """WITH v AS (SELECT CAST(user_id % 3 AS INTEGER) AS ds, event_type AS name, value AS o, row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY event_id) AS rn FROM events),
       f AS (SELECT ds, name, min(o) AS lo, max(o) AS hi FROM v WHERE rn <= 20 GROUP BY 1, 2)
       SELECT v.ds, v.name, CAST(len(list_filter(list_transform(range(0, 10), lambda i: lo + i * ceil((hi - lo) / 10)), lambda e: e <= o)) - 1 AS INTEGER) AS bucket, count(*) AS count FROM v JOIN f ON v.ds = f.ds AND v.name = f.name WHERE o >= lo GROUP BY ALL""",
)
def hist_per_datastore(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("ds"), F.col("event_type").alias("name"), F.col("value").alias("o"), F.col("event_id").alias("seq"))
    return H.histogram(rows, ["ds", "name"], 20, "10_BUCKETS").filter("count > 0").select("ds", "name", "bucket", "count")


@query("hist_lookup", "SELECT name, CASE WHEN name = 'nothing' THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM (SELECT DISTINCT event_type AS name FROM events UNION ALL SELECT 'nothing')")
def hist_lookup(spark, sf_dir):
    values = _values(spark, sf_dir)
    asked = values.select("name").distinct().unionByName(spark.range(1).select(F.lit("nothing").alias("name")))
    return H.lookup(H.histogram(values, ["name"], _FIRST), asked, ["name"]).select("name", "status").distinct()


# Hashes of (c_name, 'acctbal').
_C = "list_transform(range(1, length(c_name || 'acctbal') + 1), lambda i: CAST(ascii(substr(c_name || 'acctbal', i, 1)) AS UBIGINT))"


def _hash_sql(step: str, seed: int) -> str:
    return f"SELECT c_custkey AS id, CAST(list_reduce(list_prepend(CAST({seed} AS UBIGINT), {_C}), lambda h, x: {step}) % 5 AS INTEGER) AS ds FROM customer"


def _hash(name: str, kind: str, sql: str | None):
    @query(name, sql)
    def run(spark, sf_dir):
        return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), P.datastore(kind, F.col("c_name"), F.lit("acctbal"), 5).alias("ds"))


_W = "4294967295"
_hash("hash_sum_mod", "SUM_MOD_DATASTORES", _hash_sql("h + x", 0))
_hash("hash_ber", "UTHASH_BER", _hash_sql(f"(h * 33 + x) & {_W}", 0))
_hash("hash_sax", "UTHASH_SAX", _hash_sql(f"xor(h, ((h << 5) + (h >> 2) + x) & {_W})", 0))
_hash("hash_fnv", "UTHASH_FNV", _hash_sql(f"(xor(h, x) * 16777619) & {_W}", 2166136261))
_WORD = "list_concat(list_transform(range(0, 8), lambda i: CAST((o_orderkey >> (8 * i)) & 255 AS UBIGINT)), list_transform(range(1, 11), lambda i: CAST(ascii(substr('totalprice', i, 1)) AS UBIGINT)))"


@query("hash_sax_long", f"SELECT o_orderkey AS id, CAST(list_reduce(list_prepend(CAST(0 AS UBIGINT), {_WORD}), lambda h, x: xor(h, ((h << 5) + (h >> 2) + x) & {_W})) % 5 AS INTEGER) AS ds FROM orders")
def hash_sax_long(spark, sf_dir):
    """Keys whose subject is a native number: its machine word is hashed."""
    rows = order_triples(spark, sf_dir)
    return rows.select(F.col("s").alias("id"), P.datastore("UTHASH_SAX", F.col("s"), F.col("p"), 5, s_type="INT64").alias("ds"))


_hash("hash_jen", "UTHASH_JEN", None)
_hash("hash_sfh", "UTHASH_SFH", None)


def _oat_sql() -> str:
    each = lambda v: f"list_transform(range(1, length({v}) + 1), lambda i: CAST(ascii(substr({v}, i, 1)) AS UBIGINT))"
    step = f"xor((((h + x) & {_W}) * 1025) & {_W}, ((((h + x) & {_W}) * 1025) & {_W}) >> 6)"
    fold = lambda seed, v: f"list_reduce(list_prepend(CAST({seed} AS UBIGINT), {each(v)}), lambda h, x: {step})"
    last = lambda h: f"(xor(({h} * 9) & {_W}, (({h} * 9) & {_W}) >> 11) * 32769) & {_W}"
    return f"""WITH a AS (SELECT c_custkey, {fold(0, 'c_name')} AS h FROM customer), b AS (SELECT c_custkey, {last('h')} AS h0 FROM a),
        c AS (SELECT c_custkey, {fold('h0', "'acctbal'")} AS h FROM b) SELECT c_custkey AS id, CAST(({last('h')}) % 5 AS INTEGER) AS ds FROM c"""


_hash("hash_oat", "UTHASH_OAT", _oat_sql())


@query("ds_distribution", f"SELECT ds, count(*) AS triples FROM ({_hash_sql(f'xor(h, ((h << 5) + (h >> 2) + x) & {_W})', 0)}) GROUP BY 1")
def ds_distribution(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(P.datastore("UTHASH_SAX", F.col("c_name"), F.lit("acctbal"), 5).alias("ds")).groupBy("ds").agg(F.count(F.lit(1)).alias("triples"))


_RATIOS = [(1, 1), (2, 1), (3, 2), (2, 3)]


def _rank_sql(c: int, s: int) -> str:
    many = s >= c
    back = "id" if many else f"(id // {s}) * {c} + id % {s}"
    there = "id" if many else f"(id // {c}) * {s} + id % {c}"
    none = "false" if many else f"id % {c} >= {s}"
    return f"""SELECT CAST(id AS INTEGER) AS rank, {c} AS client, {s} AS server, CASE WHEN id % {c} < {s} THEN 1 ELSE 0 END AS is_server,
        CAST(CASE WHEN {back} >= 64 THEN -1 ELSE {back} END AS INTEGER) AS server_rank, CAST(CASE WHEN {none} THEN -1 ELSE {there} END AS INTEGER) AS server_id,
        CAST(CASE WHEN {none} THEN -1 ELSE ({there}) * 3 + 1 END AS INTEGER) AS datastore_id,
        CAST({'id' if c <= s else f'(id // {c}) * {s} + least(id % {c}, {s})'} AS INTEGER) AS servers FROM range(64) t(id)"""


@query("rank_arithmetic", " UNION ALL ".join(_rank_sql(c, s) for c, s in _RATIOS))
def rank_arithmetic(spark, sf_dir):
    rank, size, out = F.col("rank"), F.lit(64), None
    for c, s in _RATIOS:
        part = spark.range(64).select(F.col("id").cast("int").alias("rank")).select(
            "rank", F.lit(c).alias("client"), F.lit(s).alias("server"), P.is_server(rank, size, c, s).alias("is_server"), P.server_rank(rank, size, c, s).alias("server_rank"),
            P.server_id(rank, size, c, s).alias("server_id"), P.datastore_id(rank, F.lit(1), size, c, s, 3).alias("datastore_id"), P.server_count(rank, c, s).alias("servers"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# Encodings.
@query(
    "elen_int_encode",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN '0' ELSE CASE WHEN length(o_orderkey::VARCHAR) = 1 THEN ':' || o_orderkey
       ELSE '::' || length(o_orderkey::VARCHAR) || o_orderkey END END AS code FROM orders""",
)
def elen_int_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), E.encode_int(F.col("o_orderkey")).alias("code"))


@query("elen_int_roundtrip", "SELECT o_orderkey AS id, -o_orderkey * 1234567 AS value FROM orders")
def elen_int_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), E.encode_int(-F.col("o_orderkey") * 1234567).alias("code"))
    return rows.select("id", E.decode_int(F.col("code")).cast("long").alias("value"))


@query("elen_double_roundtrip", "SELECT c_custkey AS id, round(c_acctbal, 2) AS value FROM customer")
def elen_double_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), E.encode_float(F.col("c_acctbal"), 14).alias("code"))
    return rows.select("id", F.round(E.decode_float(F.col("code")), 2).alias("value"))


@query("elen_small_roundtrip", "SELECT c_custkey AS id, CAST((c_custkey % 1999 - 999) / 1000.0 AS DOUBLE) AS value FROM customer")
def elen_small_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), E.encode_small((F.col("c_custkey") % 1999 - 999) / 1000, 3).alias("code"))
    return rows.select("id", E.strict(E.decode_small, F.col("code")).alias("value"))


@query("elen_large_roundtrip", "SELECT c_custkey AS id, round(c_acctbal, 2) AS value FROM customer")
def elen_large_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), E.encode_large(F.col("c_acctbal"), 2).alias("code"))
    return rows.select("id", F.round(E.strict(E.decode_large, F.col("code")), 2).alias("value"))


_TYPES = {"s": "INT64", "p": "BYTE", "o": "DOUBLE"}
_REVERSED = {"BYTE": (F.reverse, F.reverse)}


@query(
    "transform_own",
    """SELECT CASE WHEN o_orderkey = 0 THEN '0' WHEN length(o_orderkey::VARCHAR) = 1 THEN ':' || o_orderkey ELSE '::' || length(o_orderkey::VARCHAR) || o_orderkey END AS s,
       'ecirplatot' AS p FROM orders""",
)
def transform_own(spark, sf_dir):
    """Stored forms: built-in for the subject, the caller's own for texts."""
    return transforms.encoded(order_triples(spark, sf_dir), _TYPES, _REVERSED).select("s", "p")


@query("transform_roundtrip", "SELECT o_orderkey AS s, 'totalprice' AS p, round(o_totalprice, 2) AS o FROM orders")
def transform_roundtrip(spark, sf_dir):
    back = transforms.decoded(transforms.encoded(order_triples(spark, sf_dir), _TYPES, _REVERSED), _TYPES, _REVERSED)
    return back.select("s", "p", F.round("o", 2).alias("o"))


@query("generated_triples", "SELECT 'subject-' || r || '-' || i AS s, 'predicate-' || r || '-' || i AS p, 'object-' || r || '-' || i AS o, i AS seq FROM range(3) a(r), range(1000) b(i)")
def generated_triples(spark, sf_dir):
    return generate.fixed(spark, 1000, 0).unionByName(generate.fixed(spark, 1000, 1)).unionByName(generate.fixed(spark, 1000, 2))


@query("elen_order_agrees", "SELECT CAST(0 AS BIGINT) AS differing")
def elen_order_agrees(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.round(F.col("c_acctbal") * 100).cast("long")).alias("v"))
    rows = rows.withColumn("code", E.encode_int(F.col("v")).cast("binary"))
    # Sorted by code, no value is below the one before it.
    placed = reads.cut(rows.repartitionByRange("code").withColumn("part", F.spark_partition_id()))
    from pyspark.sql.window import Window

    inner = placed.withColumn("b", F.lag("v").over(Window.partitionBy("part").orderBy("code"))).filter("v < b").select(F.lit(1).alias("x"))
    ends = placed.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    outer = ends.withColumn("b", F.lag("hi").over(Window.orderBy("part"))).filter("lo < b").select(F.lit(1).alias("x"))
    return inner.unionByName(outer).agg(F.count("x").alias("differing"))


@query("key_encode", """SELECT c_custkey AS id, hex(encode(c_name) || encode('acctbal')) || 'FF' || lpad(hex(length(c_name)), 2, '0') || repeat('0', 14) || '07' || repeat('0', 14) || '0707' AS key FROM customer""")
def key_encode(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.hex(E.encode_key(F.col("c_name"), F.lit("acctbal"))).alias("key"))


@query("key_decode", "SELECT c_custkey AS id, c_name AS s, 'acctbal' AS p, 7 AS s_type, 7 AS p_type FROM customer")
def key_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), E.decode_key(E.encode_key(F.col("c_name"), F.lit("acctbal"))).alias("k"))
    return rows.select("id", F.col("k.s").cast("string").alias("s"), F.col("k.p").cast("string").alias("p"), "k.s_type", "k.p_type")


# Composite queries.
@query("app_trajectory", "SELECT user_id, ts, event_id, value FROM events WHERE user_id BETWEEN 1 AND 5")
def app_trajectory(spark, sf_dir):
    ids = spark.range(1, 6).select(F.col("id").alias("user_id"))
    return apps.trajectory(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ids, "user_id", "ts")


_BOX = {"l_quantity": (10.0, 30.0), "l_discount": (0.02, 0.06), "l_tax": (0.01, 0.05)}


@query(
    "app_energy_band",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS energy
       FROM lineitem WHERE l_extendedprice >= 20000 AND l_extendedprice < 30000
       AND l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0.01 AND 0.05""",
)
def app_energy_band(spark, sf_dir):
    found = apps.energy_band(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), 20000, 30000, _BOX)
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("energy"))


@query(
    "app_energy_hist_then_band",
    """WITH v AS (SELECT event_id, value AS o, least(floor((value - 0) / 50), 9) AS b FROM events WHERE value >= 0),
       m AS (SELECT b FROM v GROUP BY b ORDER BY count(*) DESC, b LIMIT 1) SELECT event_id AS seq, o FROM v JOIN m ON v.b = m.b""",
)
def app_energy_hist_then_band(spark, sf_dir):
    values = _values(spark, sf_dir).drop("name")
    counts = H.histogram(values, [], 100, H.fixed([50.0 * i for i in range(10)]))
    return apps.modal_band(values, counts, F.col("o")).select("seq", "o")


@query("app_lowest_cells", "SELECT c_custkey AS s, 'acctbal' AS p, c_acctbal AS o FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def app_lowest_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), F.lit("acctbal").alias("p"), F.col("c_acctbal").alias("o"))
    return reads.extreme_objects(rows, "acctbal", 20)


@query("app_highest_cells", "SELECT c_custkey AS s, 'acctbal' AS p, c_acctbal AS o FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def app_highest_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), F.lit("acctbal").alias("p"), F.col("c_acctbal").alias("o"))
    return reads.extreme_objects(rows, "acctbal", 20, highest=True)


@query("app_momentum", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt(1 + l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS momentum FROM lineitem")
def app_momentum(spark, sf_dir):
    value = apps.momentum(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(value, 6).alias("momentum"))


@query("stream_put_equals_batch", "SELECT CAST(user_id AS VARCHAR) AS s, event_type AS p, arg_max(value, event_id) AS o, max(event_id) AS seq FROM events GROUP BY 1, 2")
def stream_put_equals_batch(spark, sf_dir):
    static = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, so that it may be a file or a folder of parts
    rows = stream.select(F.col("user_id").cast("string").alias("s"), F.col("event_type").alias("p"), F.col("value").alias("o"), F.col("event_id").alias("seq"))
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = puts.latest_stream(rows, ["s", "p"], f"{at}/out", f"{at}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out/v={_last(spark, f'{at}/out')}")


def _last(spark, path: str) -> int:
    """The number of the last version under ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return max(int(n[2:]) for n in names if n.startswith("v="))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
