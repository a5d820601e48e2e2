"""A store of triples on partitioned, sorted Parquet, with queued operations and flushes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.functions.partitioning import datastore
from triplane.operators import histogram as hist
from triplane.operators import reads
from triplane.operators.triples import ERROR, SUCCESS, delete_status, latest

from .config import Config

SCHEMA = "s string, p string, o double, seq long"
RESULT = ["op_order", "op", "s", "p", "o", "status"]


class TripleStore:
    """Triples (s, p, o, seq) under ``prefix/basename+postfix``, in folders ``ds=<datastore>`` sorted by key.

    Puts, gets and deletes are queued; ``flush`` runs them in the order PUT, GET, DELETE and returns a row for each. The
    put log holds every put, so histograms count overwritten values too. Written tables are read-only: sync writes the
    new puts and the new triples beside the old ones, then one manifest file of the next number that names them all. The
    highest number holds, so a failed sync loses nothing, and puts and triples never disagree.
    """

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.n = max(1, config.datastores_per_server)
        self.path = self._path(config.datastore_basename)
        self._open()

    @classmethod
    def open(cls, spark: SparkSession, config: Config | None = None) -> TripleStore:
        return cls(spark, config or Config())

    @staticmethod
    def open_one(spark: SparkSession, path: str) -> DataFrame:
        """The triples of one datastore's folder."""
        return spark.read.parquet(path)

    def _path(self, basename: str) -> str:
        return f"{self.config.datastore_prefix}/{basename}{self.config.datastore_postfix}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _manifest(self) -> tuple[int, list[list[str]]]:
        """Number and lines (kind, value, ...) of the last manifest; 0 and none for a new store."""
        at = f"{self.path}/state"
        if not self._exists(at):
            return 0, []
        rows = self.spark.read.schema("value string, v long").text(at)
        last = rows.agg(F.max("v")).first()[0]
        return last or 0, [r.value.split("\t") for r in rows.filter(F.col("v") == last).collect()]  # a few lines

    def _open(self) -> None:
        self.version, lines = self._manifest()
        of = lambda kind: [x[1] for x in lines if x[0] == kind]
        self.put_paths, self.batches = of("puts"), {x[1]: int(x[2]) for x in lines if x[0] == "batch"}
        self.log = self._table(self.put_paths)
        self.current = self._table(of("triples"))
        self.fresh = self._table([])
        self.puts: list[DataFrame] = []
        self.gets: list[DataFrame] = []
        self.deletes: list[DataFrame] = []

    def _table(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths).select("s", "p", "o", "seq") if paths else self.spark.createDataFrame([], SCHEMA)

    def __enter__(self) -> TripleStore:
        return self

    def __exit__(self, *error) -> None:
        if not error[0]:
            self.sync()

    # Queued operations.
    def bput(self, rows: DataFrame) -> None:
        """Queue puts (s, p, o, seq); rows without s, p or o are refused with their flush."""
        self.puts.append(rows.select("s", "p", F.col("o").cast("double").alias("o"), F.col("seq").cast("long").alias("seq")))

    def bget(self, requests: DataFrame) -> None:
        self.gets.append(requests.select("s", "p"))

    def bdelete(self, requests: DataFrame) -> None:
        self.deletes.append(requests.select("s", "p"))

    def flush_puts(self) -> DataFrame:
        rows = self._all(self.puts, SCHEMA)
        self.puts = []
        good = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("s") != "") & (F.col("p") != "")
        self.log, self.fresh = self.log.unionByName(rows.filter(good)), self.fresh.unionByName(rows.filter(good))
        self.current = latest(self.current.unionByName(rows.filter(good)), ["s", "p"]).select("s", "p", "o", "seq")
        return rows.select(F.lit(0).alias("op_order"), F.lit("PUT").alias("op"), "s", "p", F.lit(None).cast("double").alias("o"), F.when(good, SUCCESS).otherwise(ERROR).alias("status"))

    def flush_gets(self) -> DataFrame:
        rows = reads.bget(self.current, self._all(self.gets, "s string, p string"))
        self.gets = []
        return rows.select(F.lit(1).alias("op_order"), F.lit("GET").alias("op"), "s", "p", "o", "status")

    def flush_deletes(self) -> DataFrame:
        asked = self._all(self.deletes, "s string, p string")
        self.deletes = []
        rows = delete_status(self.current, asked)
        self.current = self.current.join(asked.distinct(), ["s", "p"], "left_anti")
        return rows.select(F.lit(3).alias("op_order"), F.lit("DELETE").alias("op"), "s", "p", F.lit(None).cast("double").alias("o"), "status")

    def flush(self) -> DataFrame:
        """All queued operations: puts, then gets (which see them), then deletes."""
        return reduce(DataFrame.unionByName, [self.flush_puts(), self.flush_gets(), self.flush_deletes()]).select(*RESULT)

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    # Reads at once.
    def get(self, s: str, p: str) -> DataFrame:
        return reads.get(self.current, s, p)

    def getop(self, op: str, s=None, p=None, n: int = 1) -> DataFrame:
        return reads.getop(self.current, op, s, p, n)

    def by_datastore(self) -> DataFrame:
        """Triples with ds, the datastore that their key belongs to."""
        return self.current.withColumn("ds", datastore(self.config.hash, F.col("s"), F.col("p"), self.n))

    def histogram(self, by: tuple[str, ...] = ("p",)) -> DataFrame:
        """Histograms of the tracked predicates (all, where none is named) over every put there was."""
        names = self.config.histogram_track_predicates
        log = self.log.filter(F.col("p").isin(*names)) if names else self.log
        log = log.withColumn("ds", datastore(self.config.hash, F.col("s"), F.col("p"), self.n)) if "ds" in by else log
        return hist.histogram(log, list(by), self.config.histogram_first_n, self.config.histogram_bucket_gen_name)

    # Durable state.
    def sync(self, batch: tuple[str, int] | None = None) -> DataFrame:
        """Flush what is queued, write the state, and give a SYNC row for each datastore. ``batch``: a stream's name and the number of its batch that is in."""
        self.flush()
        number = uuid.uuid4().hex
        puts, triples = f"{self.path}/puts-{number}", f"{self.path}/triples-{number}"
        self.fresh.write.parquet(puts)
        dealt = self.by_datastore().repartition("ds", F.pmod(F.xxhash64("s"), F.lit(8))).sortWithinPartitions("ds", "s", "p")
        dealt.write.partitionBy("ds").parquet(triples)
        self.put_paths.append(puts)
        self.batches |= dict([batch] if batch else [])
        lines = [f"triples\t{triples}", *(f"puts\t{x}" for x in self.put_paths), *(f"batch\t{k}\t{n}" for k, n in self.batches.items())]
        self.version += 1
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{self.path}/state/v={self.version}")
        self.log, self.current, self.fresh = self._table(self.put_paths), self._table([triples]), self._table([])
        return self.spark.range(self.n).select(F.col("id").cast("int").alias("ds"), F.lit("SYNC").alias("op"), F.lit(SUCCESS).alias("status"))

    def change_datastore_name(self, basename: str) -> DataFrame:
        """Sync, then point to another dataset: nothing of the old one is read any more."""
        out = self.sync()
        self.path = self._path(basename)
        self._open()
        return out

    def change_hash(self, name: str, basename: str) -> DataFrame:
        """Sync, then take another hash and dataset; data is not moved."""
        from dataclasses import replace

        self.config = replace(self.config, hash=name)
        return self.change_datastore_name(basename)

    def stats(self) -> DataFrame:
        """Triples of each datastore."""
        return self.by_datastore().groupBy("ds").agg(F.count(F.lit(1)).alias("triples"))
