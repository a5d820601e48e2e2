"""Puts from a stream, and histograms whose edges stay once they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.operators.triples import latest


def put_stream(source: DataFrame, store, checkpoint: str):
    """Put every micro-batch of a streaming ``source`` (s, p, o, seq) into a store and sync it; returns the running query.

    The store's manifest keeps the number of the last batch of this ``checkpoint``: a batch that comes again is passed over.
    """

    def put(batch: DataFrame, number: int) -> None:
        if number > store.batches.get(checkpoint, -1):
            store.bput(batch)
            store.sync((checkpoint, number))

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(source: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Keep the latest row of each key under ``path``: each micro-batch is one new table, merged from the one before it."""
    spark = source.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = [spark.read.parquet(f"{path}/v={number - 1}")] if number else []
        rows = batch
        for b in before:
            rows = rows.unionByName(b)
        latest(rows, keys).write.mode("overwrite").parquet(f"{path}/v={number}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(source: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by..., bucket, count of a stream of values (by..., o) under edges that are already made (a static table)."""
    at = F.size(F.filter("edges", lambda e: e <= F.col("o"))) - 1
    return source.join(edges.select(*by, "edges"), by).withColumn("bucket", at).filter("bucket >= 0").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("count"))
