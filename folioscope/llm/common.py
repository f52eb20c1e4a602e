"""What several operators of this subpackage share: Arrow passes over texts, order, sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts are handled in runs of about so many bytes, whatever the size of an Arrow batch.
CHUNK_BYTES = 8_000_000
#: Words are hashed over about so many of their bytes at a time; each byte takes some 40 meanwhile.
HASH_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case aside, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered_names(df: DataFrame) -> DataFrame:
    """The same columns under ``_0``, ``_1``, ..., which no name of an operator meets; ``toDF`` brings
    the names back."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice come to about ``CHUNK_BYTES``; a longer text
    stands alone. Nulls count nothing. At the end the worker gives back what Arrow holds unused, as it
    waits for later stages beside the executor."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + CHUNK_BYTES, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one row and ``n + 1`` offsets into them; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def arrow_pass(
    df: DataFrame, column: str, schema: str | StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """Run ``work`` over slices of the rows (``chunks``), inside the tasks, without a shuffle."""

    names = df.columns

    def run(batches):
        for part in chunks((b.rename_columns(names) for b in batches), column):
            out = work(part)
            if out is not None:
                yield out

    # Spark reads the columns by name here, and a dot in one would look like a field.
    return numbered_names(df).mapInArrow(run, schema)


def words_of(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Maximal runs of member bytes inside each text: starts, ends and each text's first word.

    ``member`` is a 256-entry table. A run never crosses from one text into the next.
    """
    inside = member[raw]
    if not inside.any():
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial in its bytes, then scrambled."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    total = np.cumsum(lengths)
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + HASH_BYTES, side="right")))
        part = lengths[a:b]
        first = total[a:b] - part - done
        place = np.arange(int(total[b - 1] - done)) - np.repeat(first, part)
        bytes_ = raw[place + np.repeat(starts[a:b], part)].astype(np.uint64) + np.uint64(1)
        out[a:b] = mix(np.add.reduceat(bytes_ * powers[place], first) + part.astype(np.uint64))
        a = b
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words (across texts too; the caller masks)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i, factor in enumerate(np.cumprod(np.full(n, _BASE, np.uint64))):
        total += words[i : i + count] * factor
    return mix(total + np.uint64(n))


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to a-z."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


def member_table(ranges) -> np.ndarray:
    """True for bytes in any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def with_text_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Bring ``n_chars`` back in step with a changed text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length(text).cast("long"))
