"""Exact duplicates by deterministic block naming, with DataFrame operations alone.

A text is cut into blocks of fixed size. Distinct blocks are sorted and get integer names; then adjacent names
are paired and distinct pairs are sorted and named in turn, until each document has one name. Equal names mean
equal texts: blocks are grouped by their bytes, never by a digest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

BLOCK_BYTES = 4096


def _pieces(bytes_col, block_bytes: int, f):
    last = F.greatest(F.ceil(F.length(bytes_col) / F.lit(block_bytes)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: f(F.substring(bytes_col, i * block_bytes + 1, F.lit(block_bytes))))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort distinct keys and number them; written once, so that the numbers hold for good."""
    return cut(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (rows equal in doc_id and text are one): doc_id, text_sha256, n_blocks, name.

    Texts are equal just where (n_blocks, name) are. Null text counts as empty; a null doc_id is kept as it is.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    blocks = rows.select(F.explode(_pieces(F.col("b"), block_bytes, lambda x: x)).alias("block")).withColumn("h", F.xxhash64("block"))
    # The digest only routes blocks; grouping and sorting compare their bytes, after a combine on the map side.
    names = _named(blocks.groupBy("h", "block").agg(F.lit(1).alias("one")).select("h", "block"), ["h", "block"]).select("h", "name")
    listed = cut(
        rows.select("doc_id", F.sha2("b", 256).alias("sha"), _pieces(F.col("b"), block_bytes, F.xxhash64).alias("hs")).dropDuplicates(["doc_id", "sha"])
    )
    parts = listed.select("doc_id", "sha", F.size("hs").alias("n_blocks"), F.posexplode("hs").alias("idx", "h"))
    clash = names.groupBy("h").count().filter("count > 1").select("h")
    if clash.isEmpty():
        parts = parts.join(names, "h").drop("h")
    else:  # blocks that share a digest but differ: these few are matched by their bytes
        texts = _named(blocks.join(clash, "h").groupBy("h", "block").agg(F.lit(1).alias("one")).select("h", "block"), ["h", "block"])
        texts = texts.withColumn("name", -1 - F.col("name"))
        full = rows.withColumn("sha", F.sha2("b", 256)).select("doc_id", "sha", F.posexplode(_pieces(F.col("b"), block_bytes, lambda x: x)).alias("idx", "block"))
        full = full.withColumn("h", F.xxhash64("block")).join(texts, ["h", "block"]).select("doc_id", "sha", "idx", F.col("name").alias("by_bytes")).dropDuplicates(["doc_id", "sha", "idx"])
        single = names.join(clash, "h", "left_anti")
        parts = parts.join(single, "h", "left").join(full, (parts.doc_id.eqNullSafe(full.doc_id)) & (parts.sha == full.sha) & (parts.idx == full.idx), "left").select(
            parts.doc_id, parts.sha, parts.n_blocks, parts.idx, F.coalesce("name", "by_bytes").alias("name")
        )
    parts = cut(parts)
    done = [parts.filter("n_blocks = 1").drop("idx")]
    most, width = parts.agg(F.max("n_blocks")).first()[0] or 0, 1
    parts = parts.filter("n_blocks > 1")
    while width < most:
        width *= 2
        even = F.col("idx") % 2 == 0
        pairs = cut(
            parts.groupBy("doc_id", "sha", "n_blocks", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name") + 1)), F.lit(0)).alias("b")
            )
        )
        pair_names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        parts = pairs.join(pair_names, ["a", "b"]).drop("a", "b")
        if width < most:
            parts = cut(parts)
        done.append(parts.filter(F.col("n_blocks") <= width).drop("idx"))
        parts = parts.filter(F.col("n_blocks") > width)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("sha", "text_sha256")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id (largest doc_id with that text), group_size, kept, text_sha256: one row per document.

    Null text counts as empty; rows equal in doc_id and text count once; further columns are ignored; an empty
    table gives an empty result. Where every doc_id of a group is null, keep_id is null and one such row is kept.
    """
    with scratch(docs.sparkSession) as keep:
        named = cut(block_names(docs, block_bytes))
        # Written, so that both sides of the join are plain shuffles and Spark can split a name that very many documents have.
        groups = cut(named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        keep(named, groups)
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row, the one of the largest doc_id, for each text; the columns stay.

    Null text counts as empty. Of rows equal in doc_id and text one stays, whichever Spark reads first, whatever their other columns hold;
    where every doc_id of a text is null, one row of it stays. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep_table:
        keep = cut(exact_duplicates(docs, block_bytes).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))
        keep_table(keep)
    rows = docs.withColumn("_row_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    out = rows.join(keep, (rows._row_sha == keep._sha) & rows.doc_id.eqNullSafe(keep._id), "left_semi")
    return out.dropDuplicates(["doc_id", "_row_sha"]).drop("_row_sha")
