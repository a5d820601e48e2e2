"""Layered configuration: defaults, then a file, then a file that the environment names, then single variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Options of a store; frozen, so an open store keeps them."""

    client_ratio: int = 1
    server_ratio: int = 1
    datastores_per_server: int = 1
    hash: str = "UTHASH_SAX"
    datastore_prefix: str = "/tmp/triples"
    datastore_basename: str = "datastore"
    datastore_postfix: str = ""
    start_async_puts_at: int = 0
    histogram_first_n: int = 10
    histogram_bucket_gen_name: str = "10_BUCKETS"
    histogram_track_predicates: tuple[str, ...] = ()
    histogram_read_existing: bool = True
    histogram_write_at_exit: bool = True

    def updated(self, values: Mapping[str, str]) -> Config:
        """With the given upper-case keys; unknown ones are passed over."""
        got = {}
        for f in fields(self):
            raw = values.get(f.name.upper())
            if raw is not None:
                old = getattr(self, f.name)
                got[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(old, bool) else int(raw) if isinstance(old, int) else tuple(raw.replace(",", " ").split()) if isinstance(old, tuple) else raw
        return replace(self, **got)


def parse(lines) -> dict[str, str]:
    """``KEY value`` lines; lines that start with # are comments, and a key's last line holds."""
    out = {}
    for line in lines:
        words = line.strip().split(None, 1)
        if words and not words[0].startswith("#"):
            out[words[0]] = words[1].strip() if len(words) > 1 else ""
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a configuration file, in line with :func:`parse` but for repeated keys."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("l")).filter((F.col("l") != "") & ~F.col("l").startswith("#"))
    return rows.select(F.regexp_extract("l", r"^(\S+)", 1).alias("key"), F.trim(F.regexp_replace("l", r"^\S+", "")).alias("value"))


def load(spark: SparkSession, path: str | None = None, prefix: str = "TRIPLANE_", environment: Mapping[str, str] = os.environ) -> Config:
    """Defaults < ``path`` < the file named by <prefix>CONFIG < variables <prefix><KEY>."""
    config = Config()
    for at in (path, environment.get(f"{prefix}CONFIG")):
        if at:
            config = config.updated(parse(r.value for r in spark.read.text(at).coalesce(1).collect()))  # a configuration file
    return config.updated({k[len(prefix) :]: v for k, v in environment.items() if k.startswith(prefix)})
