"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Documents longer than a sequence are cut; all pieces are then packed. Pieces of equal length are
interchangeable, so documents and gaps (free space of open sequences) are kept as runs: a size and
a range of ranks. A run table has a row for each length at most, however many documents there are,
and a length that holds a third of all rows is one row.

Superstep: runs are dealt by size into ranges. Each task sweeps its range from the longest documents
down; a run's successor is the shortest gap it fits in. Documents that want the same gap are served
by rank, longer ones first and then by number. Placed documents shorten their gap, which goes on to
the range of its new size; a gap that nothing of a range fits in goes on to the next lower range.
When a whole superstep places nothing, as many sequences as the remaining tokens need at least are
opened with the longest documents left. Ends when no document is left.

Every row finds its place by length and rank, numbered in blocks so that no length meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import chunks, table
from folioscope.llm.tokens import encoder, vocabulary_path
from folioscope.session import materialized

NAME = "op5_best_fit_packing"
CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Width of a range of sizes, as a share of the capacity.
RANGES = 8
#: Rows numbered in one block, and ranks looked up together.
BLOCK_ROWS = 2_000
RANK_BLOCK = 10_000

_RUNS = "kind string, visits bigint, size bigint, count bigint, first bigint"
_PLACED = "length bigint, rank_from bigint, rank_to bigint, each bigint, sequence bigint, base bigint"
_STEP = _RUNS + ", " + _PLACED


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    drops_space: bool = True, with_ids: bool = False, id_column: str = "doc_id", text: str = "text",
    kept: int | None = None,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids, then ``end_id``, cut
    into pieces of ``capacity``. Null and empty texts are one piece with the end id alone. Other
    columns are not read; rows that repeat an id are documents of their own. ``kept`` bounds what
    the encoder keeps, and then only up to the end of a task."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encoder(path, drops_space, kept).encode(batch.column(1))
        rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
        for row, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            whole = np.append(ids[a:b], end_id).astype("<u4")
            for piece, at in enumerate(range(0, len(whole), capacity)):
                part = whole[at : at + capacity]
                rows["row"].append(row)
                rows["piece"].append(piece)
                rows["start"].append(at)
                rows["length"].append(len(part))
                rows["crc"].append(zlib.crc32(part.tobytes()))
                if with_ids:
                    rows["ids"].append(part.astype(np.int32))
        columns = [
            batch.column(0).take(pa.array(rows["row"], pa.int64())),
            pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()),
            pa.array(rows["length"], pa.int64()), pa.array(rows["crc"], pa.int64()),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        yield from map(work, chunks(batches, "text"))
        if kept:
            encoder(path, drops_space, kept).forget()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def sweep(runs: pd.DataFrame, capacity: int, width: int) -> pd.DataFrame:
    """One range of a superstep: best fit of the range's document runs into the gaps that visit
    it, longest documents first. Returns the new runs and what was placed."""
    docs = runs[runs["kind"] == "doc"].sort_values("size", ascending=False)
    gaps: list[tuple[int, int, int]] = sorted(
        runs.loc[runs["kind"] == "gap", ["size", "first", "count"]].itertuples(index=False, name=None))
    here = int(runs["visits"].iloc[0])
    moved: list[tuple[int, int, int]] = []
    state, placed = [], []
    for length, first, count in docs[["size", "first", "count"]].itertuples(index=False, name=None):
        while count:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                break
            size, opened, number = gaps.pop(at)
            each = size // length
            full = min(number, count // each)
            rest = 0 if full == number else min(count - full * each, each)
            if full:
                placed.append((length, first, first + full * each, each, opened, capacity - size))
            if rest:
                placed.append((length, first + full * each, first + full * each + rest, rest,
                               opened + full, capacity - size))
            count -= full * each + rest
            first += full * each + rest
            for left, begin, many in (
                (size - each * length, opened, full),
                (size - rest * length, opened + full, 1 if rest else 0),
                (size, opened + full + (1 if rest else 0), number - full - (1 if rest else 0)),
            ):
                if many and left:
                    if left // width >= here:
                        insort(gaps, (left, begin, many))
                    else:
                        moved.append((left, begin, many))
        if count:
            state.append(("doc", here, length, count, first))
    # Gaps that nothing here fits go on downwards; at the bottom they stay.
    state += [("gap", max(here - 1, -1), size, many, begin) for size, begin, many in gaps]
    state += [("gap", size // width, size, many, begin) for size, begin, many in moved]
    columns = [c.split()[0] for c in _STEP.split(", ")]
    none = (None,) * 6
    rows = [(*s, *none) for s in state] + [(None,) * 5 + p for p in placed]
    return pd.DataFrame(rows, columns=columns, dtype=object)


def opened(docs: DataFrame, bins: int, next_bin: int, capacity: int) -> DataFrame:
    """Open ``bins`` sequences with the longest documents left (a running count over the runs)."""
    longest = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(longest), F.lit(0))
    return docs.withColumn("_before", before).withColumn(
        "_new", F.least(F.col("count"), F.greatest(F.lit(0), F.lit(bins) - F.col("_before")))
    ).withColumn("_bin", F.lit(next_bin) + F.col("_before"))


def place(lengths: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """Where each rank of each length goes, for ``lengths(length, count)``: rows of ``_PLACED``.
    Rank r of a row's range is in sequence ``sequence + (r - rank_from) div each`` at
    ``base + (r - rank_from) mod each * length``."""
    width = -(-(capacity + 1) // ranges)
    docs = materialized(lengths.select(
        F.lit("doc").alias("kind"), F.floor(F.col("length") / width).alias("visits"),
        F.col("length").alias("size"), F.col("count"), F.lit(0).cast("long").alias("first"),
    ), "packing-runs")
    gaps, next_bin, parts = docs.limit(0), 0, []
    while True:
        left = docs.agg(F.sum(F.col("size") * F.col("count")), F.sum("count")).first()
        if not left[0]:
            break
        bins = min(-(-left[0] // capacity), left[1])
        opening = materialized(opened(docs, bins, next_bin, capacity), "packing-opened")
        next_bin += bins
        new = opening.filter("_new > 0")
        parts.append(new.select(
            F.col("size").alias("length"), F.col("first").alias("rank_from"),
            (F.col("first") + F.col("_new")).alias("rank_to"), F.lit(1).cast("long").alias("each"),
            F.col("_bin").alias("sequence"), F.lit(0).cast("long").alias("base")))
        space = F.lit(capacity) - F.col("size")
        fresh = new.filter(space > 0).select(
            F.lit("gap").alias("kind"), F.floor(space / width).alias("visits"),
            space.cast("long").alias("size"), F.col("_new").alias("count"), F.col("_bin").alias("first"))
        docs = opening.filter("count > _new").select(
            "kind", "visits", "size", (F.col("count") - F.col("_new")).alias("count"),
            (F.col("first") + F.col("_new")).alias("first"))
        # Gaps start again from the range of their size.
        gaps = gaps.withColumn("visits", F.floor(F.col("size") / width)).unionByName(fresh)
        while True:
            waiting = gaps.filter("visits >= 0")
            step = docs.unionByName(waiting).groupBy("visits").applyInPandas(
                lambda runs: sweep(runs, capacity, width), _STEP)
            resting = gaps.filter("visits < 0").select("*", *[
                F.lit(None).cast("long").alias(c.split()[0]) for c in _PLACED.split(", ")])
            state = materialized(step.unionByName(resting), "packing-step")
            parts.append(state.filter("length is not null").select(
                *[c.split()[0] for c in _PLACED.split(", ")]))
            runs = state.filter("kind is not null").select(*[c.split()[0] for c in _RUNS.split(", ")])
            docs, gaps = runs.filter("kind = 'doc'"), runs.filter("kind = 'gap'")
            alive = state.agg(
                F.count(F.when((F.col("kind") == "gap") & (F.col("visits") >= 0), 1)),
                F.count(F.when(F.col("kind") == "doc", 1))).first()
            if not alive[0] or not alive[1]:
                break
    done = parts[0] if parts else docs.select(
        *[F.lit(None).cast("long").alias(c.split()[0]) for c in _PLACED.split(", ")]).limit(0)
    for part in parts[1:]:
        done = done.unionByName(part)
    return done


def numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """Pieces with their rank among those of equal length, numbered in hashed blocks."""
    blocks = max(1, -(-rows // BLOCK_ROWS))
    keys = [c for c in pieces.columns if c != "ids"]
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    counts = blocked.groupBy("length", "_block").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy(*keys)
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, ["length", "_block"])
        .withColumn("rank", F.col("_before") + F.col("_inside") - 1)
        .drop("_block", "_inside", "_before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All rows of ``pieces`` (a written table with ``length`` of 1 to ``capacity``) with
    ``sequence_id`` and ``offset``. An empty table stays empty."""
    lengths = pieces.groupBy("length").agg(F.count("*").alias("count"))
    placed = materialized(place(lengths, capacity), "packing-placed")
    placed = placed.withColumn("_part", F.explode(F.sequence(
        F.floor(F.col("rank_from") / RANK_BLOCK), F.floor((F.col("rank_to") - 1) / RANK_BLOCK))))
    ranked = numbered(pieces, pieces.count()).withColumn("_part", F.floor(F.col("rank") / RANK_BLOCK))
    found = ranked.join(placed, ["length", "_part"]).filter(
        (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    inside = F.col("rank") - F.col("rank_from")
    return found.select(
        *pieces.columns,
        (F.col("sequence") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + inside % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: whole sequences from packed pieces that carry ``ids``. A
    sequence holds at most ``capacity`` tokens, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"), F.col("_parts.doc_id").alias("doc_ids"))


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    docs = table(spark, sf_dir, "documents")
    pieces = materialized(token_pieces(docs, vocabulary_path(VOCABULARY)), "packing-pieces")
    return pack(pieces)
