"""Registered queries of this subpackage, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe import encode_decode
from .chat import chat_format
from .common import table
from .exact_dedup import exact_duplicates
from .fingerprint import fingerprints
from .html_text import main_text
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import quality
from .suffix_dedup import without_repeats
from .toxicity import toxicity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query(
    "op4_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
       g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
       SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
)
def op4(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_packing")
def op2(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_near_dedup")
def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_html")
def op5(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


@query("op6_bpe")
def op6(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_fingerprints")
def op7(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


@query(
    "op8_chat",
    r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
         UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
       g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss FROM c GROUP BY conv_id),
       e AS (SELECT conv_id, sum(CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 ELSE 17 + length(role) END
         + CASE WHEN regexp_matches(concat_ws(' ', role, text), '<s>|</s>|\[!?INST\]|\[/INST\]|\[!?OUT\]|\[!?ROLE:|\[/ROLE\]')
           THEN 1 + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')) ELSE length(text) END) AS formatted_chars
         FROM c GROUP BY conv_id)
       SELECT g.conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
         CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g JOIN e ON g.conv_id = e.conv_id""",
)
def op8(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat_format(rows.unionByName(own))


@query("op9_quality")
def op9(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))


@query("pipeline")  # no SQL: ORACLE_SQL of corpus_pipeline is None
def pipeline(spark, sf_dir):
    import corpus_pipeline  # it imports this subpackage's operators

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
