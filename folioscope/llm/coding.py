"""Token ids in binary shards: frequency ranks in a byte-aligned code with separate control bytes.

An id is replaced by its rank in the corpus (the most frequent id is 0) and written in one to four
little-endian bytes. Two bits per id, four ids to a control byte, say how many; control bytes and
data bytes stand apart, so a shard is decoded by table lookups over whole arrays.

Shard, little-endian: magic ``FSTK``, version, documents n, ids m, data bytes d (all uint32), then
n doc ids (int64), n lengths (uint32), ceil(m / 4) control bytes, d data bytes, and the end mark.
The ranking is written beside the shards. A shard is one file, made by Spark's own writer and read
by its binary file source, so any store Spark reaches will do. Shards hold consecutive doc ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import chunks, table
from folioscope.llm.tokens import encoder, vocabulary_path
from folioscope.operators.scale import range_buckets
from folioscope.session import materialized, work_dir

NAME = "op2_token_id_output"
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: About so many ids are written to a shard; a longer document is a shard of its own.
SHARD_IDS = 1_000_000

MAGIC = b"FSTK"
#: Ends a shard; the writer puts it behind each record.
END_MARK = "FSTE"
_HEADER = np.dtype([("magic", "S4"), ("version", "<u4"), ("docs", "<u4"), ("ids", "<u4"), ("data", "<u4")])

#: How many bytes each of the four ids of a control byte takes.
_SIZES = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 ranks."""
    if not len(ranks):
        return b"", b""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int8) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    used = np.arange(4) < size[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[used]
    return control.sum(axis=1, dtype=np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks again: sizes from the table, places from a running sum, bytes put together."""
    if not count:
        return np.empty(0, np.uint32)
    sizes = _SIZES[control].reshape(-1)[:count].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    out = data[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(sizes > i)
        if len(more):
            out[more] |= data[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """The bytes of a shard, without its end mark."""
    control, data = encode_ranks(ranks)
    head = np.array([(MAGIC, 1, len(doc_ids), len(ranks), len(data))], _HEADER)
    return b"".join((head.tobytes(), doc_ids.astype("<i8").tobytes(),
                     lengths.astype("<u4").tobytes(), control, data))


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, lengths and ranks of a shard's bytes."""
    head = np.frombuffer(raw, _HEADER, 1)[0]
    end = END_MARK.encode()
    if head["magic"] != MAGIC or head["version"] != 1 or raw[-len(end):] != end:
        raise ValueError("not a whole token shard")
    n, m = int(head["docs"]), int(head["ids"])
    at = _HEADER.itemsize
    doc_ids = np.frombuffer(raw, "<i8", n, at)
    lengths = np.frombuffer(raw, "<u4", n, at + 8 * n)
    at += 12 * n
    control = np.frombuffer(raw, np.uint8, -(-m // 4), at)
    data = np.frombuffer(raw, np.uint8, int(head["data"]), at + len(control))
    return doc_ids, lengths, decode_ranks(control, data, m)


def in_id_order(docs: DataFrame) -> DataFrame:
    """Rows sorted by ``doc_id`` inside partitions that hold disjoint ranges of it."""
    parts = max(1, docs.rdd.getNumPartitions())
    return docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")


def token_groups(docs: DataFrame, path: str, end_id: int, shard_ids: int) -> DataFrame:
    """Consecutive documents with their ids, up to ``shard_ids`` a row, and the row's id counts."""

    def run(batches):
        coder = encoder(path, False)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def row():
            doc_ids = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            counts = np.bincount(ids)
            present = np.flatnonzero(counts)
            packed = pa.compress(ids.astype("<u2").tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_pydict({
                "first": pa.array([doc_ids[0]], pa.int64()), "last": pa.array([doc_ids[-1]], pa.int64()),
                "total": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([doc_ids.astype("<i8").tobytes()], pa.binary()),
                "lengths": pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
                "ids": pa.array([packed], pa.binary()),
                "present": pa.array([present.astype("<u2").tobytes()], pa.binary()),
                "counts": pa.array([counts[present].astype("<u4").tobytes()], pa.binary())})

        for part in chunks(batches, "text"):
            ids, offsets = coder.encode(part.column(1))
            ends = offsets[1:] + np.arange(1, part.num_rows + 1)
            whole = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(whole), bool)
            keep[ends - 1] = False
            whole[keep] = ids
            doc_ids = part.column(0).to_numpy(zero_copy_only=False)
            start = 0
            while start < part.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + shard_ids - size, side="right")))
                held.append((doc_ids[start:stop], np.diff(ends[start:stop], prepend=before),
                             whole[before : ends[stop - 1]]))
                size += int(ends[stop - 1] - before)
                start = stop
                if size >= shard_ids or start < part.num_rows:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(
        run, "first bigint, last bigint, total bigint, doc_ids binary, lengths binary, "
             "ids binary, present binary, counts binary")


def id_ranking(groups: DataFrame) -> DataFrame:
    """``(id, seen, rank)`` over all documents, most frequent first, equal counts by id. At most
    as many rows as the vocabulary has ids."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for present, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(present, "<u2")] += np.frombuffer(counts, "<u4")
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": ids.astype(np.int64), "seen": total[ids]})

    seen = groups.select("present", "counts").mapInArrow(run, "id bigint, seen bigint")
    return seen.groupBy("id").agg(F.sum("seen").alias("seen")).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("seen"), "id")) - 1)


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
    id_column: str = "doc_id", text: str = "text",
) -> None:
    """Write all documents, in ascending order of their ids, to ``folder/shards`` and the ranking
    to ``folder/ranking``. Null and empty texts have the end id alone. A row without an id cannot
    be found again and is an error; rows that repeat an id stand next to each other, ordered by
    text. An empty table writes no shard."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = read.withColumn("doc_id", F.coalesce(
        "doc_id", F.raise_error(F.lit("a document has no id")).cast("long")))
    groups = materialized(token_groups(in_id_order(named), path, end_id, shard_ids), "token-groups")
    ranking = id_ranking(groups)
    ranking.write.parquet(f"{folder}/ranking")
    order = spark.read.parquet(f"{folder}/ranking").select("id", "rank").toPandas()
    ranks = np.zeros(1 << 16, np.uint32)
    ranks[order["id"].to_numpy()] = order["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, packed, total = (batch.column(k)[i].as_py() for k in range(4))
                ids = np.frombuffer(pa.decompress(packed, total * 2, codec="zstd", asbytes=True), "<u2")
                shard = write_shard(np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<u4"),
                                    shared.value[ids])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.binary())})

    shards = groups.select("doc_ids", "lengths", "ids", "total").mapInArrow(run, "shard binary")
    # The text writer puts out the bytes of a string as they are, and one record a file.
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", END_MARK).text(f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``(shard, first, last, doc_id, n_tokens, start_in_shard, ids_crc32[, ids])`` for every
    document of the shards; ``first`` and ``last`` are the ids at the ends of its shard."""
    order = spark.read.parquet(f"{folder}/ranking").select("id", "rank").toPandas()
    ids_of = np.zeros(len(order), np.uint32)
    ids_of[order["rank"].to_numpy(dtype=np.int64)] = order["id"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(ids_of)

    def run(batches):
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                if not raw:
                    continue
                doc_ids, lengths, ranks = read_shard(raw)
                ids = shared.value[ranks].astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                out = {
                    "shard": [shard] * len(doc_ids),
                    "first": np.full(len(doc_ids), doc_ids[0]), "last": np.full(len(doc_ids), doc_ids[-1]),
                    "doc_id": doc_ids, "n_tokens": lengths.astype(np.int64),
                    "start_in_shard": starts, "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    bounds = pa.array(np.concatenate(([0], ends)), pa.int32())
                    out["ids"] = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = ("shard string, first bigint, last bigint, doc_id bigint, n_tokens bigint, "
              "start_in_shard bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").load(f"{folder}/shards").select("path", "content")
    return files.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def with_starts(read: DataFrame) -> DataFrame:
    """``start``: the number of ids in all documents before, by a prefix scan over shards.

    Shards have a row each; their running sum is taken inside ranges of shards and over the sums
    of the ranges.
    """
    sizes = materialized(
        read.groupBy("shard", "first", "last").agg(F.sum("n_tokens").alias("total")), "token-sizes")
    ranged = range_buckets(sizes, ["first", "last", "shard"])
    sums = ranged.groupBy("_bucket").agg(F.sum("total").alias("_sum"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("first", "last", "shard").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = ranged.join(offsets, "_bucket").select(
        "shard", (F.col("_before") + F.coalesce(F.sum("total").over(inside), F.lit(0))).alias("_start"))
    return read.join(starts, "shard").withColumn(
        "start", (F.col("_start") + F.col("start_in_shard")).cast("long"))


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards of all documents, read them back, and say what stands where."""
    folder = work_dir(spark, "token-shards")
    write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary_path(VOCABULARY))
    read = materialized(read_tokens(spark, folder, with_ids=False), "token-documents")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
