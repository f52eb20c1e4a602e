"""Benchmark decontamination: windows of test items found in training texts, verified, removed.

The windows of a block of benchmark items are hashed and broadcast. Tasks hash every window of
their texts with numpy, look the hashes up, and compare the words themselves before a hit counts.
No row is shuffled. A block holds at most ``BLOCK_BYTES`` of item text, so what is broadcast has a
bound; a larger benchmark is scanned in several blocks and all of them count.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and everything beyond ASCII. A window is
``n`` consecutive words of an item; an item of fewer words, but not none, is one window.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import (
    arrow_pass,
    free_name,
    lower_table,
    member_table,
    numbered_names,
    run_hashes,
    table,
    text_bytes,
    with_text_size,
    word_hashes,
    words_of,
)
from folioscope.session import materialized

NAME = "op3_benchmark_decontamination"
WINDOW = 10
#: Most item text whose windows are broadcast at once.
BLOCK_BYTES = 2_000_000

#: Fixed values of the contract: the bytes words are made of.
WORD_BYTES = ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_LOW = lower_table()
_MEMBER = member_table(WORD_BYTES)
_FILTER_BITS = 20

_SPAN = "array<struct<first:int,last:int,from:int,to:int>>"
_ARROW_SPAN = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "from", "to")]))


class WindowSet:
    """The distinct windows of some items: hashes for the search, words for the check."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        owners: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            raw, offsets = text_bytes(pa.array([text], pa.string()))
            low = _LOW[raw]
            starts, ends, _ = words_of(low, offsets, _MEMBER)
            words = [low[a:b].tobytes() for a, b in zip(starts, ends)]
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners[size][b" ".join(words[i : i + size])].add(item)
        self.owners = {k: {w: tuple(sorted(i)) for w, i in v.items()} for k, v in owners.items()}
        self.filters = {}
        for size, windows in self.owners.items():
            hashes = np.array([_window_hash(w) for w in windows], np.uint64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[size] = (seen, np.sort(hashes))


def _window_hash(window: bytes) -> int:
    raw = np.frombuffer(window, np.uint8)
    starts, ends, _ = words_of(raw, np.array([0, len(raw)]), _MEMBER)
    return int(run_hashes(word_hashes(raw, starts, ends), len(starts))[0])


def find_hits(raw: np.ndarray, offsets: np.ndarray, known: WindowSet):
    """For each text: the number of words, the verified windows as (word, size, items)."""
    low = _LOW[raw]
    starts, ends, word_from = words_of(low, offsets, _MEMBER)
    hashes = word_hashes(low, starts, ends)
    found: list[tuple[int, int, tuple[str, ...]]] = []
    for size, (seen, ordered) in known.filters.items():
        windows = run_hashes(hashes, size)
        likely = np.flatnonzero(seen[windows >> np.uint64(64 - _FILTER_BITS)])
        if not len(likely):
            continue
        place = np.minimum(np.searchsorted(ordered, windows[likely]), len(ordered) - 1)
        likely = likely[ordered[place] == windows[likely]]
        text = np.searchsorted(word_from, likely, side="right") - 1
        for at in likely[likely + size <= word_from[text + 1]].tolist():
            words = b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(at, at + size))
            items = known.owners[size].get(words)
            if items:
                found.append((at, size, items))
    return starts, ends, word_from, found


def scan(docs: DataFrame, known, text: str = "text") -> DataFrame:
    """Every row and, last, ``_words`` (its number of words), ``_spans`` (runs of hit words: word
    numbers and code points, ends exclusive) and ``_items`` (sorted ids of items that occur).

    ``known`` is a broadcast ``WindowSet``. Null and empty texts have no words. Rows are taken
    one by one: repeated ids and other columns pass through. Where the table has columns of these
    names, underscores go in front of the new ones.
    """
    names = [free_name(docs, name) for name in ("_words", "_spans", "_items")]
    kinds = ("bigint", _SPAN, "array<string>")
    schema = T.StructType([
        *docs.schema, *[T._parse_datatype_string(f"{n} {k}")[0] for n, k in zip(names, kinds)]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column(text))
        starts, ends, word_from, found = find_hits(raw, offsets, known.value)
        spans, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
        by_text = defaultdict(list)
        for at, size, owners in sorted(found):
            row = int(np.searchsorted(word_from, at, side="right")) - 1
            # Texts without words share their first word with the next text.
            by_text[row].append((at, at + size))
            items[row].update(owners)
        for row, windows in by_text.items():
            runs = []
            for a, b in windows:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            first = int(word_from[row])
            body = raw[offsets[row] : offsets[row + 1]]
            points = np.cumsum((body & 0xC0) != 0x80)
            for a, b in runs:
                left, right = starts[a] - offsets[row], ends[b - 1] - offsets[row]
                spans[row].append({
                    "first": a - first, "last": b - first,
                    "from": int(points[left]) - 1, "to": int(points[right - 1]),
                })
        columns = [
            *batch.columns, pa.array(np.diff(word_from), pa.int64()),
            pa.array(spans, _ARROW_SPAN), pa.array([sorted(i) for i in items], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return arrow_pass(docs, text, schema, work)


def item_blocks(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> list[DataFrame]:
    """The benchmark in blocks of about ``block_bytes`` of text, by a hash of the item id."""
    sized = benchmark.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-sized // block_bytes))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    if blocks == 1:
        return [rows]
    # Halved, as hashing spreads unevenly.
    blocks *= 2
    return [rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) for i in range(blocks)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
    item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` and, last, ``_words``, ``_spans`` and ``_items`` (see ``scan``).

    An empty benchmark leaves every text clean. Items without words or text have no windows; items
    with the same id count once. Columns of the benchmark never meet those of ``docs``.
    """
    spark = docs.sparkSession
    names = [*docs.columns, *[free_name(docs, name) for name in ("_words", "_spans", "_items")]]
    text = f"_{docs.columns.index(text)}"
    docs, out = numbered_names(docs), None
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    for block in blocks:
        known = spark.sparkContext.broadcast(
            WindowSet([(r.item, r.text) for r in block.collect()], n))
        if out is None:
            out = scan(docs, known, text)
            continue
        before = out.withColumnsRenamed({"_spans": "_spans0", "_items": "_items0"}).drop("_words")
        out = scan(before, known, text).withColumns({
            "_spans": merged_runs(F.concat("_spans0", "_spans")),
            "_items": F.sort_array(F.array_union("_items0", "_items")),
        }).drop("_spans0", "_items0")
        if len(blocks) > 1:
            out = materialized(out, "decontamination")
    return out.toDF(*names)


def merged_runs(spans):
    """Overlapping or touching runs of words put together, in order."""
    def fold(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"),
            last["from"].alias("from"), F.greatest(last["to"], span["to"]).alias("to"))
        before = F.slice(done, 1, F.size(done) - 1)
        return F.when((F.size(done) > 0) & (span["first"] <= last["last"]),
                      F.concat(before, F.array(joined))).otherwise(F.concat(done, F.array(span)))

    # try_element_at keeps the empty start from raising.
    def safe(done, span):
        return F.when(F.size(done) == 0, F.array(span)).otherwise(fold(done, span))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPAN), safe)


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``contamination`` with hit words cut out of their texts, all columns of the input."""
    added, spans = found.columns[-3:], found.columns[-2]

    def cut(state, span):
        kept = F.substring(F.col(text), state["at"] + 1, span["from"] - state["at"])
        return F.struct(F.concat(state["text"], kept).alias("text"), span["to"].alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    tail = lambda s: F.concat(s["text"], F.substring(F.col(text), s["at"] + 1, F.char_length(text)))
    cleaned = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.aggregate(spans, start, cut, tail))
    return with_text_size(found.withColumn(text, cleaned), text).drop(*added)


def drop_documents(found: DataFrame) -> DataFrame:
    """Rows of ``contamination`` without a hit, all columns of the input."""
    return found.filter(F.size(found.columns[-2]) == 0).drop(*found.columns[-3:])


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items that occur, their digest, and whether any did."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(
        "_spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]).cast("long"))
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM item, LATERAL unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM doc, sizes, LATERAL unnest(range(1, len(w) - size + 2)) t(i) WHERE len(w) >= size),
hits AS (SELECT doc_id, i, d.size, item FROM doc_windows d JOIN windows USING (size, win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit
  FROM hits, LATERAL unnest(range(0, size)) t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items,
    sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
