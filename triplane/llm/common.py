"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes, from which an Arrow batch to Python is closed: bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set here only where it is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Tables cut in each open scratch of a thread, the innermost last.
_OPEN = threading.local()


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jvm_path) if at_exit else fs.delete(jvm_path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and any executor can read it again.

    The table is deleted when the scratch around it ends, or else with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, at_exit=True)
    out = spark.read.schema(df.schema).parquet(path)
    for tables in getattr(_OPEN, "stack", [])[-1:]:
        tables[path] = out
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables cut within it when it ends, but for those given to the function it yields; these go to the scratch around it.

    What leaves a scratch must not read, not even in a lazy plan, a table that was not kept.
    """
    _OPEN.stack = stack = getattr(_OPEN, "stack", [])
    tables: dict[str, DataFrame] = {}
    stack.append(tables)
    kept: list[DataFrame] = []
    try:
        yield lambda *t: kept.extend(t)
    finally:
        stack.remove(tables)
        for path, table_ in tables.items():
            if not any(table_ is k for k in kept):
                _delete(spark, path)
            elif stack:
                stack[-1][path] = table_


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are at most BATCH_ROWS rows and about BATCH_BYTES long; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def per_text(df: DataFrame, text: str, keep: list[str], setup, schema: str) -> DataFrame:
    """Columns ``keep`` of ``df`` as they are, and those of ``schema`` made from the whole texts of column ``text``.

    ``setup()`` runs once in a task and returns a function from a list of texts (null: empty) to a list for each column.
    """
    small_batches(df.sparkSession)
    full = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(schema).fields])
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        f = setup()
        for batch in batches:
            values = f(["" if x is None else x for x in batch.column(text).to_pylist()])
            arrays = [pa.array(v, field.type) for v, field in zip(values, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *made.names])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, full)


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``rows`` (doc_id, ...), those of the smallest hashes of doc_id over the whole table.

    The count of rows gives a threshold first, so that about ``most`` rows reach the one task that sorts, however many there are.
    """
    rows = cut(rows)
    n = rows.count()
    if n > most:
        share = min(1.0, (1.2 * most + 100) / n)
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(share * ((1 << 63) - 1)))
        rows = rows.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id").limit(most)
    return rows


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows kept from training: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
