"""N-gram Jaccard join: the product of the document by n-gram incidence matrix with its transpose,
computed only where a pair can still reach the threshold.

Rows of the matrix are the distinct shingle sets (equal sets are one row, whatever their number).
Columns are n-grams in one global order, frequent ones last. Two sets at or over the threshold
share a column among the first ``n - ceil(t n) + 1`` of each (the prefix), so only these blocks of
columns are multiplied: a join on the column adds up overlaps per pair of rows, and pairs whose
overlap plus what is left behind the prefixes stays below the size-derived bound are discarded.
What remains is verified on whole sets.

Near copies would fill such a product with all pairs of a group. So each row is first compared with
one row of its few least columns, that with the fewest rare columns, which in such a group is the
text the others come from. Connected rows get one component, and the product runs only between
different components and only where both rows share enough columns with others. No link between
different components is lost by that, and groups of thousands of copies cost a few pairs a row.

Copies with too many edits to link to that text still share nearly all their columns with each
other, so columns tell nothing about them; what they do not have in common with that text does.
Rows near a head with many followers are kept as differences (columns of one of both sets alone).
Sets ``a`` and ``b`` with differences ``d`` and ``e`` from one head overlap in
``(|a| + |b| - |d| - |e|) / 2 + |d & e|`` columns, so pairs of such rows are joined on prefixes of
their differences, rare ones first, and the product leaves them out.

Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import (
    arrow_pass,
    chunks,
    lower_table,
    member_table,
    run_hashes,
    table,
    text_bytes,
    word_hashes,
    words_of,
)
from folioscope.llm.components import components
from folioscope.session import materialized

NAME = "op8_ngram_jaccard_join"
SHINGLE = 4
#: Least similarity, as a fraction.
THRESHOLD = (85, 100)
#: A row is compared with one row for each of so many of its columns, those with the least hashes.
STAR_COLUMNS = 4
#: Rows are kept as differences from heads that so many rows are compared with.
FOLLOWERS = 2
#: Frequent columns that go last in the order. Any set of columns gives the same links; these
#: keep the product small. So many hashes are broadcast at most (8 bytes each).
FREQUENT_COLUMNS = 200_000
#: Ids are broadcast up to so many rows (16 bytes each and a hash table); beyond it they are shuffled.
BROADCAST_ROWS = 2_000_000
#: Tasks count columns over about so many incidences at a time and report what recurs.
COUNT_BLOCK = 2_000_000
RECURS = 4

#: Fixed values of the contract: the bytes that separate words.
SPACE_BYTES = (0x20, *range(0x09, 0x0E))

_LOW = lower_table()
_MEMBER = ~member_table((b, b) for b in SPACE_BYTES)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes in order; fewer than ``n`` words are one shingle."""
    raw, offsets = text_bytes(column)
    low = _LOW[raw]
    starts, ends, first = words_of(low, offsets, _MEMBER)
    words = word_hashes(low, starts, ends)
    runs = run_hashes(words, n)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        else:
            yield run_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """A row per document ``(id, size, digest)`` and, beside them, rows ``(column, seen)`` with
    the columns that recur inside a task; equal sets of a task count once."""

    def run(batches):
        blocks, held, known = [], 0, set()

        def counted():
            values, seen = np.unique(np.concatenate(blocks), return_counts=True)
            often = seen >= RECURS
            return pa.RecordBatch.from_pydict({
                "id": pa.nulls(int(often.sum()), pa.int64()),
                "size": pa.nulls(int(often.sum()), pa.int64()),
                "digest": pa.nulls(int(often.sum()), pa.binary()),
                "column": values[often].view(np.int64), "seen": seen[often].astype(np.int64)})

        for part in chunks(batches, "text"):
            sizes, digests = [], []
            for values in shingle_sets(_column(part, "text"), n):
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                if digests[-1] not in known and len(values):
                    known.add(digests[-1])
                    blocks.append(values)
                    held += len(values)
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "id": _column(part, "id"), "size": pa.array(sizes, pa.int64()),
                "digest": pa.array(digests, pa.binary()), "column": none, "seen": none})
            if held >= COUNT_BLOCK:
                yield counted()
                blocks, held, known = [], 0, set()
        if blocks:
            yield counted()

    return docs.select("id", "text").mapInArrow(
        run, "id bigint, size bigint, digest binary, column bigint, seen bigint")


def prefixes(docs: DataFrame, frequent, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Each document's size, digest, the first columns of its set in the global order, how many of
    its columns are not frequent, and the few columns of its set with the smallest hashes."""
    part, whole = threshold

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = frequent.value
        sizes, digests, lists, rare, least = [], [], [], [], []
        for values in shingle_sets(_column(batch, "text"), n):
            size = len(values)
            least.append(values[:STAR_COLUMNS].view(np.int64))
            rare.append(size)
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            sizes.append(size)
            if size and len(last):
                at = np.minimum(np.searchsorted(last, values), len(last) - 1)
                often = last[at] == values
                values = np.concatenate([values[~often], values[often]])
                rare[-1] -= int(often.sum())
            keep = size - -(-part * size // whole) + 1 if size else 0
            lists.append(values[:keep].view(np.int64))
        def packed(arrays):
            counts = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
            return pa.ListArray.from_arrays(counts, pa.array(np.concatenate(arrays)))

        return pa.RecordBatch.from_pydict({
            "id": _column(batch, "id"), "size": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()), "columns": packed(lists),
            "rare": pa.array(rare, pa.int64()), "least": packed(least)})

    schema = ("id bigint, size bigint, digest binary, columns array<bigint>, rare bigint, "
              "least array<bigint>")
    return arrow_pass(docs.select("id", "text"), "text", schema, work)


def verified(
    pairs: DataFrame, texts: DataFrame, n: int, threshold: tuple[int, int]
) -> DataFrame:
    """Pairs ``(a, b)`` whose whole sets reach the threshold, with the sizes of their overlap.

    Texts travel, not sets: they pack to half the size. Where an id has several texts, any pair
    of them counts.
    """
    part, whole = threshold

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(shingle_sets(_column(batch, "text_a"), n), shingle_sets(_column(batch, "text_b"), n))
        sizes = np.array([(len(np.intersect1d(x, y, True)), len(x) + len(y)) for x, y in rows], np.int64)
        common, both = sizes[:, 0], sizes[:, 1]
        good = (common > 0) & (whole * common >= part * (both - common))
        return pa.RecordBatch.from_pydict({
            "a": _column(batch, "a"), "b": _column(batch, "b"), "overlap": common,
        }).filter(pa.array(good))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    found = arrow_pass(joined, "text_a", "a bigint, b bigint, overlap bigint", work)
    return found.groupBy("a", "b").agg(F.max("overlap").alias("overlap"))


def differences(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``(head, id, size, head_size, columns)`` of pairs ``(a, b)`` of a head and a row: the columns
    that one of both sets has alone. Pairs that have less than half of their columns in common leave."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(shingle_sets(_column(batch, "text_a"), n), shingle_sets(_column(batch, "text_b"), n))
        sizes, lists = [], []
        for x, y in rows:
            sizes.append((len(x), len(y)))
            lists.append(np.setxor1d(x, y, True).view(np.int64))
        head_size, size = np.array(sizes, np.int64).T
        count = np.array([len(x) for x in lists], np.int64)
        ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        return pa.RecordBatch.from_pydict({
            "head": _column(batch, "a"), "id": _column(batch, "b"), "size": size, "head_size": head_size,
            "columns": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))),
        }).filter(pa.array(3 * count <= size + head_size))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    schema = "head bigint, id bigint, size bigint, head_size bigint, columns array<bigint>"
    return arrow_pass(joined, "text_a", schema, work).dropDuplicates(["id"])


def difference_pairs(apart: DataFrame, groups: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs ``(a, b)`` of rows of ``differences`` that have one head, lie in different components of
    ``groups`` and can reach the threshold. ``groups`` must hold the links between rows and heads."""
    part, whole = threshold
    rows = apart.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "head", "id", "size", "head_size", F.coalesce("component", "id").alias("component"),
        F.size("columns").cast("long").alias("apart"), F.explode("columns").alias("column"))
    met = rows.groupBy("head", "column").agg(
        F.count("*").alias("seen"), (F.min("component") < F.max("component")).alias("mixed"))
    order = Window.partitionBy("id").orderBy("seen", "column")
    blocks = materialized(
        rows.join(met, ["head", "column"]).withColumn("place", F.row_number().over(order))
        .filter("mixed").drop("seen", "mixed"), "jaccard-differences-blocks")
    # Of a pair, the row with fewer differences is looked up by its prefix. Its partner differs at least
    # as much, and is not linked to the head if the row is; both bound the prefix for all partners.
    own, spare = F.col("apart"), whole - part
    half = F.floor(spare * F.col("size") / F.lit(2 * part)) + 1
    linked = (whole + part) * own <= spare * (F.col("size") + F.col("head_size"))
    near = F.floor(
        ((whole + part) * own + spare * (F.col("size") - F.col("head_size"))) / F.lit(2 * (whole + part))) + 1
    cut = F.when(linked, F.least(half, near)).otherwise(half)
    names = ("id", "size", "component", "apart", "place")
    left, right = (
        side.select("head", "column", *[F.col(c).alias(f"{c}_{x}") for c in names])
        for side, x in ((blocks.filter(F.col("place") <= cut), "a"), (blocks, "b")))
    both = F.col("size_a") + F.col("size_b")
    # So many differences must agree, and at least one of them in the prefixes that this leaves.
    agree = F.ceil(part * both / F.lit(part + whole)) - (both - F.col("apart_a") - F.col("apart_b")) / 2
    first = (F.col("apart_a") < F.col("apart_b")) | (
        (F.col("apart_a") == F.col("apart_b")) & (F.col("id_a") < F.col("id_b")))
    fits = (whole * F.least("size_a", "size_b")) >= (part * F.greatest("size_a", "size_b"))
    return (
        left.join(right, ["head", "column"])
        .filter(first & (F.col("component_a") != F.col("component_b")) & fits
                & (F.col("place_a") <= F.col("apart_a") - agree + 1)
                & (F.col("place_b") <= F.col("apart_b") - agree + 1))
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, marked for broadcast only where a count says it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def link_documents(
    docs: DataFrame, n: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included. Null texts and
    texts without words have no shingles and no links. Equal sets always link; rows that repeat an
    id are links of each other's texts. A row without an id is returned with what its text gives,
    and is nobody's representative. Other columns are not read.
    """
    spark = docs.sparkSession
    part, whole = threshold
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    seen = materialized(signatures(texts, n), "jaccard-signatures")
    rows = seen.filter(F.col("size").isNotNull()).select("id", "size", "digest")
    often = (
        seen.filter(F.col("size").isNull()).groupBy("column").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "column").limit(FREQUENT_COLUMNS).select("column")
    )
    frequent = spark.sparkContext.broadcast(
        np.sort(often.toPandas()["column"].to_numpy(np.int64).view(np.uint64)))
    classes = materialized(
        rows.filter("size > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id")),
        "jaccard-classes")
    # Copies leave; of each class its representative stays.
    copies = materialized(
        rows.filter("size > 0").join(classes.withColumnRenamed("id", "kept"), "digest")
        .filter("id <> kept").select("id", "digest").distinct(), "jaccard-copies")
    first = (
        prefixes(texts, frequent, n, threshold).filter("size > 0 and id is not null")
        .join(few(copies), ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])
        if repeats_ids(rows) else
        prefixes(texts, frequent, n, threshold).filter("size > 0 and id is not null")
        .join(few(copies), ["id", "digest"], "left_anti"))
    first = materialized(
        first.select("id", "size", "columns", "rare", "least"), "jaccard-prefixes")
    fits = (whole * F.least("size_a", "size_b")) >= (part * F.greatest("size_a", "size_b"))

    def documents_of(pairs: DataFrame, name: str) -> DataFrame:
        ids = materialized(
            pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
        return materialized(texts.join(few(ids), "id", "left_semi"), f"{name}-texts")

    # Stars: a row against the one with the fewest rare columns of those that share one of its
    # least columns; in a group of near copies that is the text they come from. What stars miss,
    # the product finds.
    stars = first.select("id", "size", "rare", F.explode("least").alias("column"))
    heads = stars.groupBy("column").agg(
        F.min(F.struct("rare", "size", "id")).alias("head"), F.count("*").alias("rows")).filter("rows > 1")
    heads = heads.select("column", F.col("head.id").alias("a"), F.col("head.size").alias("size_a"))
    near = materialized(
        stars.select("column", F.col("id").alias("b"), F.col("size").alias("size_b"))
        .join(heads, "column").filter(fits & (F.col("a") != F.col("b")))
        .groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("met"))
        .filter(F.col("met") >= F.least(F.lit(2), "size_a")).select("a", "b"), "jaccard-stars")
    star_links = materialized(
        verified(near, documents_of(near, "jaccard-stars"), n, threshold), "jaccard-star-links")

    # Rows near a head with many followers, as differences from it. An id with several sets is
    # none of them, as texts are looked up by ids.
    led = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("rows")).filter(F.col("rows") >= FOLLOWERS)
    led = materialized(
        first.join(led, "id").select("id", "rows", F.explode("columns").alias("column")).groupBy("column")
        .agg(F.max(F.struct("rows", (-F.col("id")).alias("least"))).alias("head"))
        .select("column", F.col("head.rows").alias("rows"), (-F.col("head.least")).alias("head")), "jaccard-heads")
    told = (
        first.select("id", F.size("columns").alias("prefix"), F.explode("columns").alias("column"))
        .join(few(led), "column").groupBy("id", "prefix", "head").agg(F.count("*").alias("met"), F.max("rows").alias("rows"))
        .filter(8 * F.col("met") >= F.col("prefix")).groupBy("id")
        .agg(F.max(F.struct("met", "rows", (-F.col("head")).alias("least"))).alias("best"))
        .select((-F.col("best.least")).alias("a"), F.col("id").alias("b")))
    told = materialized(told, "jaccard-told")
    asked = materialized(
        told.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-told-ids")
    alone = materialized(
        rows.filter("size > 0").join(few(asked), "id", "left_semi").groupBy("id")
        .agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low = high").select("id"),
        "jaccard-told-alone")
    for side in "ab":
        told = told.join(few(alone.select(F.col("id").alias(side))), side, "left_semi")
    apart = materialized(differences(told, documents_of(told, "jaccard-differences"), n), "jaccard-differences")
    head_links = apart.filter(
        ((whole + part) * F.size("columns") <= (whole - part) * (F.col("size") + F.col("head_size")))
        & (F.col("id") != F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b"))
    near_links = materialized(star_links.select("a", "b").unionByName(head_links), "jaccard-near-links")
    groups = materialized(components(near_links, "jaccard-groups"), "jaccard-groups")
    alike = difference_pairs(apart, groups, threshold)

    # The blocked product, between components only and without pairs of one head.
    earlier = F.expr("concat(array(cast(null as bigint)), slice(columns, 1, size(columns) - 1))")
    entry = F.explode(F.arrays_zip("columns", earlier.alias("before"), F.sequence(
        F.lit(1), F.size("columns")).alias("place")))
    grouped = (
        first.join(groups.withColumnRenamed("node", "id"), "id", "left")
        .join(few(apart.select("id", "head")), "id", "left").select(
            "id", "size", F.coalesce("component", "id").alias("component"), "head", entry.alias("entry"))
        .select("id", "size", "component", "head", F.col("entry.columns").alias("column"), "entry.before",
                "entry.place"))
    mixed = grouped.groupBy("column").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        (F.min("head") < F.max("head")).alias("several"), F.count("head").alias("led"), F.count("*").alias("rows")
    ).filter("low < high and (led < rows or several)").select(
        "column", F.coalesce("several", F.lit(False)).alias("several"))
    # How many columns a row shares with other components at all; no pair can agree in more.
    blocks = materialized(grouped.join(mixed, "column").withColumn(
        "shared", F.count("*").over(Window.partitionBy("id", "size"))), "jaccard-blocks")
    sided = lambda rows, side: rows.select("column", *[
        F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "component", "head", "shared", "before", "place")])
    prefix = lambda size: size - F.ceil(part * size / F.lit(whole)) + 1
    rest = lambda side: F.col(f"size_{side}") - prefix(F.col(f"size_{side}"))
    left = lambda side: F.col(f"size_{side}") - F.col(f"place_{side}")
    needed = F.ceil(part * (F.col("size_a") + F.col("size_b")) / F.lit(part + whole))
    # A pair counts at its first common column. One behind another common column is not the first;
    # at the first, no more can agree than what either set has from there on. Of the set whose prefix
    # ends first, all common columns up to there are shared; behind it no more can agree than it has left.
    meets = (
        (F.col("component_a") != F.col("component_b")) & fits
        & ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False)) & (1 + F.least(left("a"), left("b")) >= needed)
        & (F.least("shared_a", "shared_b") + F.greatest(rest("a"), rest("b")) >= needed))
    free, led_rows = blocks.filter("head is null"), blocks.filter("head is not null and several")
    with_free = sided(free, "a").join(sided(blocks, "b"), "column").filter(
        (F.col("head_b").isNotNull() | (F.col("id_a") < F.col("id_b"))) & meets)
    of_heads = sided(led_rows, "a").join(sided(led_rows, "b"), "column").filter(
        (F.col("id_a") < F.col("id_b")) & (F.col("head_a") != F.col("head_b")) & meets)
    met = with_free.unionByName(of_heads).select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    pairs = materialized(met.unionByName(alike).distinct(), "jaccard-pairs")
    far_links = verified(pairs, documents_of(pairs, "jaccard-pairs"), n, threshold)
    linked = components(
        near_links.unionByName(far_links.select("a", "b")), "jaccard-components")

    ids = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component"))
    # An id with several texts ties their classes together.
    ties = (
        rows.filter("size > 0 and id is not null").join(ids, "digest").groupBy("id")
        .agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
        .select("a", "b"))
    if ties.limit(1).count():
        joined = components(ties, "jaccard-ties").withColumnRenamed("component", "root")
        ids = ids.join(joined.withColumnRenamed("node", "component"), "component", "left").select(
            "digest", F.coalesce("root", "component").alias("component"))
    return rows.join(ids, "digest", "left").select(
        F.col("id").alias(id_column), F.col("size").alias("n_shingles"),
        F.coalesce(F.when(F.col("size") > 0, F.col("component")), "id").alias("component_id"))


def repeats_ids(rows: DataFrame) -> bool:
    """Whether an id has rows with equal sets; their prefixes must count once."""
    return rows.filter("size > 0 and id is not null").groupBy("id", "digest").count().filter(
        "count > 1").limit(1).count() > 0


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the size of its shingle set and its component."""
    return link_documents(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s
  FROM doc, LATERAL unnest(range(1, len(w) - least(4, len(w)) + 2)) t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM reach LEFT JOIN size USING (doc_id) GROUP BY ALL
"""
