"""What a content hash lets a run skip: cache hits and misses, upsert, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as X

VERSION = 2
DEEP_LIMIT = 15


def strategy_for(n_files: int, level: str = "flush") -> str:
    """What a run of so many files and this budget level does: deep, fingerprint or local."""
    if level == "critical":
        return "local"
    return "deep" if n_files <= DEEP_LIMIT and level == "flush" else "fingerprint"


def usable(cache: DataFrame, model: str, version: int = VERSION) -> DataFrame:
    """Entries that this version and model wrote; none of others'."""
    return cache.where((F.col("version") == version) & (F.col("model") == model))


def partition(files: DataFrame, cache: DataFrame, strategy: str) -> DataFrame:
    """files with hash and hit: the same content was scanned before, by a deep scan or in the same way.

    files: path, content; cache: path, hash, strategy. Files without content (unreadable) are on neither side."""
    rows = files.where(F.col("content").isNotNull()).withColumn("hash", X.content_hash(F.col("content")))
    entry = cache.select("path", F.col("hash").alias("_hash"), F.col("strategy").alias("_strategy"))
    met = rows.join(entry, "path", "left")
    hit = (F.col("hash") == F.col("_hash")) & ((F.col("_strategy") == "deep") | (F.col("_strategy") == strategy))
    return met.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_hash", "_strategy")


def cached_issues(partitioned: DataFrame, cache: DataFrame) -> DataFrame:
    """The issues of the hits."""
    hits = partitioned.where("hit").select("path")
    return cache.join(hits, "path", "left_semi").select(F.explode("issues").alias("i")).select("i.*")


#: The columns of a cache but the issues, whose fields are the caller's; see `schema`.
COLUMNS = "version int, model string, path string, hash string, strategy string, scanned_at string"


def schema(fields: str = "file string, line double, type string, severity string, description string, status string, source string") -> str:
    """The schema of a cache whose issues have these fields."""
    return f"{COLUMNS}, issues array<struct<{', '.join(':'.join(f.split()) for f in fields.split(', '))}>>"


def upsert(cache: DataFrame, scanned: DataFrame, issues: DataFrame, existing: DataFrame, strategy: str, scanned_at: str, model: str = "") -> DataFrame:
    """The cache after a run: entries of scanned files are new (clean files too), of files that are gone drop out.

    scanned: path, hash; issues: file and the fields of an issue; existing: path. Every entry has the version and the model
    of this run: what another one wrote is to be left out before, by `usable`."""
    fields = [c for c in issues.columns]
    per = issues.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct(*fields)).alias("issues"))
    fresh = scanned.select("path", "hash").join(per, "path", "left")
    kind = per.schema["issues"].dataType.simpleString()
    fresh = fresh.select("path", "hash", F.lit(strategy).alias("strategy"), F.lit(scanned_at).alias("scanned_at"), F.coalesce("issues", F.array().cast(kind)).alias("issues"))
    kept = cache.join(scanned.select("path"), "path", "left_anti")
    entries = kept.select("path", "hash", "strategy", "scanned_at", "issues").unionByName(fresh).join(existing.select("path"), "path", "left_semi")
    return entries.select(F.lit(VERSION).alias("version"), F.lit(model).alias("model"), "path", "hash", "strategy", "scanned_at", "issues")
