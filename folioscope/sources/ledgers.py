"""An append-only ledger on storage whose appends open only the files they may collide with.

Rows lie in parts by key hash. Beside each version of the ledger lies a membership filter: bitmaps of 2^15 bits
for about ``BLOCK_KEYS`` keys each, 16 bits a key. An append tests its keys against the filters, opens the
parts a key may be in, and compares whole rows there. A filter may name a part without need (about one key in 400),
but never misses one. What is opened therefore depends on the batch, not on the length of the ledger; the
filters themselves are read, about a hundredth of the rows they stand for.

The newest pointer row lists the versions that count and is written last, so an append that fails is not seen.
Each append adds a version; ``compact`` makes them one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import ledger, scale
from folioscope.session import materialized
from folioscope.sources import writers

#: Bits of a bitmap, as Spark's bitmap functions make it.
BLOCK_BITS = 32768
#: Keys of a bitmap, and bits set for each.
BLOCK_KEYS = 2048
PROBES = 4
#: Rows of a part, which is one file.
PART_ROWS = 1_000_000
_POINTER = """version string, versions array<struct<version: string, power: int, parts: int, rows: bigint>>,
  committed_at timestamp"""
_FILTER = "version string, power int, parts int, block bigint, bits binary"
VERSION, PART = "ledger_version", "ledger_part"


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def _probes(key: str) -> Column:
    """The bits of a key inside its bitmap: pieces of 15 bits of a second hash."""
    second = F.xxhash64(F.lit("probe"), F.col(key).cast("string"))
    return F.array(*[F.shiftrightunsigned(second, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)])


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def manifest(spark: SparkSession, root: str) -> list:
    """The versions that count, oldest first, each with its number of bitmaps (a power of two), parts and rows."""
    if not writers._exists(spark, f"{root}/pointer"):
        return []
    newest = spark.read.schema(_POINTER).parquet(f"{root}/pointer").agg(
        F.max_by("versions", F.struct("version", "committed_at")).alias("versions")).first()
    return newest["versions"] or []


def _point(spark: SparkSession, root: str, versions: list) -> None:
    rows = [(versions[-1][0], [tuple(v) for v in versions])]
    pointer = spark.createDataFrame(rows, _POINTER.rpartition(",")[0])
    pointer.withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/pointer")


def _write(rows: DataFrame, count: int, root: str, version: str, key: str, part_rows: int) -> tuple:
    """Write one version's rows and filter; its entry in the manifest."""
    power = max(0, (-(-count // BLOCK_KEYS) - 1).bit_length())
    parts = 1 << max(0, (-(-count // part_rows) - 1).bit_length())
    if count:
        placed = rows.withColumn(PART, F.pmod(_hash(key), F.lit(parts)).cast("int"))
        placed.repartition(parts, PART).write.mode("overwrite").partitionBy(PART).parquet(
            f"{root}/data/{VERSION}={version}")
        bits = rows.select(
            F.pmod(_hash(key), F.lit(1 << power)).alias("block"), F.explode(_probes(key)).alias("at"))
        filters = bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).select(
            F.lit(version).alias("version"), F.lit(power).alias("power"), F.lit(parts).alias("parts"), "block", "bits")
        filters.write.mode("overwrite").parquet(f"{root}/filters/{version}")
    return (version, power, parts, count)


def may_hold(batch: DataFrame, root: str, key: str = "event_id") -> list[str]:
    """Folders of the parts that may hold a key of the batch."""
    spark = batch.sparkSession
    stored = [v for v in manifest(spark, root) if v["rows"]]
    if not stored:
        return []
    filters = spark.read.schema(_FILTER).parquet(*[f"{root}/filters/{v['version']}" for v in stored])
    hashed = _hash(key)
    places = F.array(*[
        F.struct(F.lit(p).alias("power"), F.pmod(hashed, F.lit(1 << p)).alias("block"))
        for p in sorted({v["power"] for v in stored})])
    keys = batch.select(key).distinct().select(
        hashed.alias("hash"), _probes(key).alias("probes"), F.inline(places))
    met = scale.hot_key_join(keys, filters, ["power", "block"], rows=10_000)
    held = met.filter(F.forall("probes", lambda at: _is_set(F.col("bits"), at)))
    opened = held.select("version", F.pmod("hash", "parts").cast("int").alias("part")).distinct().collect()
    return sorted(f"{root}/data/{VERSION}={r['version']}/{PART}={r['part']}" for r in opened)


def append_status(batch: DataFrame, root: str, key: str = "event_id") -> DataFrame:
    """What an append would do with each key of the batch, as ``operators.ledger.append_status`` says, from the
    parts that may hold one."""
    folders = may_hold(batch, root, key)
    rows = batch.sparkSession.read.schema(batch.schema).option("basePath", f"{root}/data")
    stored = rows.parquet(*folders).select(*batch.columns) if folders else batch.limit(0)
    return materialized(ledger.append_status(stored, batch, key), "append-status")


def append(
    batch: DataFrame, root: str, version: str, key: str = "event_id", part_rows: int = PART_ROWS
) -> DataFrame | None:
    """Append the batch's new keys as a version and return what became of each key.

    Versions ascend as text; one that the ledger already counts is a replay: nothing is read or written, and the
    result is None. A key whose row differs from the stored one, or differs inside the batch, is an error, and
    nothing is appended. Rows without a key are one key in each batch, which equals no stored row. Columns named
    as the versions or parts are refused.
    """
    spark = batch.sparkSession
    if {VERSION, PART} & set(batch.columns):
        raise ValueError(f"{VERSION} and {PART} are the names of the ledger's folders")
    if done(spark, root, version):
        return None
    versions = manifest(spark, root)
    status = append_status(batch, root, key)
    if status.filter("conflict").limit(1).count():
        raise ValueError(f"{key} conflicts with a stored event")
    rows = ledger.appended_rows(status).select(*batch.columns)
    entry = _write(rows, rows.count(), root, version, key, part_rows)
    _point(spark, root, [*versions, entry])
    return status


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """Every row of the ledger; a ledger nothing was appended to has the columns of ``schema`` and no rows."""
    folders = [f"{root}/data/{VERSION}={v['version']}" for v in manifest(spark, root) if v["rows"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*folders).select(*schema.names)


def compact(spark: SparkSession, root: str, schema, key: str = "event_id", part_rows: int = PART_ROWS) -> None:
    """Rewrite the ledger as one version with parts and filters of full size; readers see it when it is whole.

    Folders of the versions it replaces stay until they are removed by hand.
    """
    versions = manifest(spark, root)
    if len(versions) < 2:
        return
    version = f"{versions[-1]['version'].partition('-')[0]}-whole{len(versions)}"
    count = sum(v["rows"] for v in versions)
    entry = _write(read(spark, root, schema), count, root, version, key, part_rows)
    _point(spark, root, [entry])


def done(spark: SparkSession, root: str, version: str) -> bool:
    """Whether the ledger already counts that version."""
    versions = manifest(spark, root)
    return bool(versions) and versions[-1]["version"].partition("-")[0] >= version
