"""Sinks: versioned tables with a pointer written last, and JSON where JSON is the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import pool, publishing
from folioscope.operators.profile import EXTRACTOR_VERSION, stale_items


#: Files that a small table becomes where its documents may be small.
SEVERAL = 64


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists on the file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def commit_version(df: DataFrame, root: str, version: str) -> None:
    """Write a table version, then the pointer row that makes it current (K3, K6).

    Spark's committer makes the data all or nothing; a failure before the pointer leaves the
    earlier version current.
    """
    df.write.parquet(f"{root}/data/version={version}")
    spark = df.sparkSession
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("committed_at")
    )
    pointer.write.mode("append").parquet(f"{root}/pointer")


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version named by the newest pointer row."""
    if not _exists(spark, f"{root}/pointer"):
        return None
    newest = spark.read.parquet(f"{root}/pointer").agg(
        F.max_by("version", F.struct("committed_at", "version")).alias("v")
    )
    return newest.first()["v"]


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/data/version={version}")


def commit_pool(root: str, incoming: DataFrame, completed_at, version: str, **limits) -> DataFrame:
    """Merge a retrieval into the pool and advance the checkpoint last (K3)."""
    spark = incoming.sparkSession
    existing = read_current(spark, root)
    if existing is None:
        existing = incoming.limit(0)
    merged = pool.merge_pool(existing, incoming, completed_at, **limits)
    commit_version(merged, root, version)
    return spark.read.parquet(f"{root}/data/version={version}")


def write_snapshot_once(splits: DataFrame, root: str, snapshot_id: str) -> bool:
    """Write a frozen snapshot; the same id again must hold the same rows (K4)."""
    spark = splits.sparkSession
    path = f"{root}/snapshot_id={snapshot_id}"
    if not _exists(spark, path):
        splits.write.mode("errorifexists").parquet(path)
        return True
    columns = sorted(splits.columns)
    digest = lambda df: hashing.set_digest(df, hashing.content_hash(columns)).first()["digest"]
    if digest(splits) != digest(spark.read.parquet(path).select(*splits.columns)):
        raise ValueError("snapshot id already exists with other content")
    return False


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines, for contracts that are JSON (K5, K9)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_documents(
    rows: DataFrame, path: str, field: str, version: int | None, most: int = 10_000,
    least: int | None = None,
) -> None:
    """Rows as JSON documents that list about ``most`` of them under ``field``, a file each (K9).

    The readers' counterpart: ledgers and corpora under ``events``, histories under ``entries``,
    manifests, weight sets and examples under their own names. Times become UTC text. With ``least``,
    documents of a small table list fewer rows, down to that many, to be ``SEVERAL`` files.
    """
    kinds = dict(rows.dtypes)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    shown = rows.select(*[stamp(c) if kinds[c] == "timestamp" else F.col(c) for c in rows.columns])
    count = rows.count()
    size = most if least is None else min(most, max(least, -(-count // SEVERAL)))
    parts = max(1, -(-count // size))
    part = F.pmod(F.xxhash64(*[c for c in shown.columns if not kinds[c].startswith("map")]), F.lit(parts))
    documents = shown.groupBy(part.alias("_part")).agg(
        F.collect_list(F.struct(*shown.columns)).alias(field))
    head = [] if version is None else [F.lit(version).alias("schema_version")]
    write = documents.select(*head, field).write.option("maxRecordsPerFile", 1)
    write.option("ignoreNullFields", False).json(path)


def write_published(rows: DataFrame, path: str, version: int = publishing.PUBLISHABLE_VERSION):
    """Published rows under one schema version (K1)."""
    write_json(publishing.published_payload(rows, version), path)


def exported_profile(profiles: DataFrame, version: int) -> DataFrame:
    """Profile columns of an export version; older versions drop the newer ones (K2)."""
    newer = {
        1: ["watched_authors", "watched_institutions", "source_library_synced_at", "preference_facets"],
        2: ["source_library_synced_at", "preference_facets"],
        3: ["preference_facets"],
        4: [],
    }
    return profiles.drop(*newer[version]).withColumn("schema_version", F.lit(version))


def write_profiles(profiles: DataFrame, path: str, version: int = 4) -> None:
    write_json(exported_profile(profiles, version), path)


def save_digests(digests: DataFrame, items: DataFrame, cache_path: str) -> None:
    """Append digests that the cache lacks, by content and extractor (K7)."""
    spark = digests.sparkSession
    fresh = digests.filter(F.col("extractor_version") == EXTRACTOR_VERSION)
    if _exists(spark, cache_path):
        missing = stale_items(items, spark.read.parquet(cache_path)).select("content_hash")
        fresh = fresh.join(missing.distinct(), "content_hash", "left_semi")
    fresh.write.mode("append").parquet(cache_path)


def stage_history(history: DataFrame, published: DataFrame, published_at, path: str) -> None:
    """Next history beside the current one, to be promoted after publication succeeds (K8)."""
    pool.next_history(history, published, published_at).write.parquet(path)
