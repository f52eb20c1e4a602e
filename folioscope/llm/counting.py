"""Token counts from flat token files that have no index: a separator scan.

Files are little-endian uint16 ids and nothing else; a document ends with the separator id and may
run on into the next file of its stream. Tasks find the separators of a file with one vectorised
comparison. What a file leaves open is settled by a prefix scan over the files' sums: where
its ids start in the stream, and where the last document before it ended.

A stream is the rows of one input split in their order, so a table becomes token files without a
shuffle. The nth separator of a stream ends the document n rows after the stream's first. Spark's
text writer ends each file with ``FILE_END``, two bytes that are no id of the stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import chunks
from folioscope.llm.tokens import encoder, vocabulary_path
from folioscope.session import materialized, work_dir

NAME = "op9_token_counts"
VOCABULARY = "byte_bpe_50k.json"
SEPARATOR = 50256
#: Ids in a file; files are cut there whatever document it hits.
FILE_IDS = 1_000_000
FILE_END = "\0\0"
#: Separators are looked for in blocks of so many ids.
BLOCK_IDS = 1 << 16


def scanned(spark: SparkSession, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A Parquet table's rows with the file and row they stand in: ``(file, row, doc_id, text)``.
    Write another DataFrame first, so that its rows have places."""
    df = spark.read.parquet(path)
    return df.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))


def write_flat(
    docs: DataFrame, folder: str, path: str, separator: int = SEPARATOR, file_ids: int = FILE_IDS
) -> None:
    """Write the texts of ``scanned`` rows as flat token files, each in a folder ``part=<stream
    and number>``. Null and empty texts are a separator alone; an empty table writes no file. A
    text that spells out the separator's name stays ordinary text."""

    def run(batches):
        coder = encoder(path, False)
        stream, number, following, held, size = None, 0, None, [], 0

        def cut(ids):
            nonlocal number
            name = f"{stream[0] & (2**64 - 1):016x}-{stream[1]:014d}-{number:08d}"
            number += 1
            return pa.RecordBatch.from_pydict({
                "ids": pa.array([ids.astype("<u2").tobytes()], pa.binary()), "part": [name]})

        def rest():
            nonlocal held, size
            if size:
                yield cut(np.concatenate(held))
            held, size = [], 0

        for part in chunks(batches, "text"):
            files = part.column(0).to_numpy(zero_copy_only=False)
            rows = part.column(1).to_numpy(zero_copy_only=False)
            ids, offsets = coder.encode(part.column(2))
            ends = offsets[1:] + np.arange(1, part.num_rows + 1)
            whole = np.full(int(ends[-1]), separator, np.int32)
            keep = np.ones(len(whole), bool)
            keep[ends - 1] = False
            whole[keep] = ids
            # A new stream where the file changes or rows don't follow one another.
            new = np.ones(part.num_rows, bool)
            new[1:] = (files[1:] != files[:-1]) | (rows[1:] != rows[:-1] + 1)
            if stream is not None:
                new[0] = files[0] != stream[0] or rows[0] != following
            begins = np.flatnonzero(new).tolist()
            if not begins or begins[0]:
                begins = [0, *begins]
            for a, b in zip(begins, [*begins[1:], part.num_rows]):
                if new[a]:
                    yield from rest()
                    stream, number = (int(files[a]), int(rows[a])), 0
                held.append(whole[ends[a - 1] if a else 0 : ends[b - 1]])
                size += len(held[-1])
                if size >= file_ids:
                    flat = np.concatenate(held)
                    full = size // file_ids * file_ids
                    for at in range(0, full, file_ids):
                        yield cut(flat[at : at + file_ids])
                    held, size = [flat[full:]], size - full
            following = int(rows[-1]) + 1
        yield from rest()

    coded = docs.select("file", "row", "text").mapInArrow(run, "ids binary, part string")
    coded.select(F.col("ids").cast("string"), "part").write.partitionBy("part").option(
        "lineSep", FILE_END).text(folder)


def separators(ids: np.ndarray, separator: int, block: int = BLOCK_IDS) -> np.ndarray:
    """Places of the separator, looked for block by block."""
    found = [np.flatnonzero(ids[at : at + block] == separator) + at for at in range(0, len(ids), block)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def scan_files(spark: SparkSession, folder: str, separator: int = SEPARATOR) -> DataFrame:
    """A row per file: ``(stream, number, ids, ends)``, the number of ids and, in order, the
    places behind its separators."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                if not raw.endswith(FILE_END.encode()):
                    raise ValueError(f"{path} is not a whole token file")
                ids = np.frombuffer(raw, "<u2", len(raw) // 2 - 1)
                name, number = path.rsplit("part=", 1)[1].split("/")[0].rsplit("-", 1)
                yield pa.RecordBatch.from_pydict({
                    "stream": [name], "number": pa.array([int(number)], pa.int64()),
                    "ids": pa.array([len(ids)], pa.int64()),
                    "ends": pa.array([separators(ids, separator) + 1], pa.list_(pa.int64()))})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(
        run, "stream string, number bigint, ids bigint, ends array<bigint>")


def document_sizes(files: DataFrame) -> DataFrame:
    """``(stream, nth, start, n_tokens)``: for each separator its document's start in the stream
    and its tokens without the separator. ``files`` is what ``scan_files`` gives, written."""
    order = Window.partitionBy("stream").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("ids").over(order), F.lit(0))
    sums = files.select("stream", "number", "ids", F.size("ends").alias("count"),
                        F.try_element_at("ends", F.lit(-1)).alias("last"))
    placed = sums.withColumn("begin", begins).withColumn(
        "nth", F.coalesce(F.sum("count").over(order), F.lit(0)))
    placed = placed.withColumn(
        "open", F.coalesce(F.max(F.col("begin") + F.col("last")).over(order), F.lit(0)))
    ended = files.select("stream", "number", "ends").join(
        placed.select("stream", "number", "begin", "nth", "open"), ["stream", "number"])
    spans = F.transform("ends", lambda end, at: F.struct(
        at.alias("at"), (F.col("begin") + end).alias("end"),
        F.when(at == 0, F.col("open")).otherwise(F.col("begin") + F.get("ends", at - 1)).alias("start")))
    each = ended.select("stream", "nth", F.explode(spans).alias("doc"))
    return each.select(
        "stream", (F.col("nth") + F.col("doc.at")).alias("nth"), F.col("doc.start").alias("start"),
        (F.col("doc.end") - F.col("doc.start") - 1).alias("n_tokens"))


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat files."""
    docs = scanned(spark, f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "flat-tokens")
    write_flat(docs, folder, vocabulary_path(VOCABULARY))
    files = materialized(scan_files(spark, folder), "flat-separators")
    sizes = document_sizes(files).select(
        F.split_part("stream", F.lit("-"), F.lit(1)).alias("file"),
        (F.split_part("stream", F.lit("-"), F.lit(2)).cast("long") + F.col("nth")).alias("row"),
        "n_tokens")
    names = docs.select(
        F.lower(F.lpad(F.hex("file"), 16, "0")).alias("file"), "row", "doc_id")
    return names.join(sizes, ["file", "row"]).select("doc_id", "n_tokens")
