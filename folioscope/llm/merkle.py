"""Merkle manifest of a dataset: leaf digests, subtrees per group, one root, and a proof per row.

A row's leaf is the hash of its columns. The leaves of a group stand in the order of the id; every
``FAN`` neighbouring nodes become their parent until one is left, the group's subroot, and the
subroots become the root in the same way.

A level is a pair of windows with fixed offsets. A node lives in the row of its first leaf, so a
node's neighbours on a level stand ``FAN ** level`` rows before and behind it: lag and lead
columns, masked by the slot in the run and by the run's length, give its siblings, and the row of
slot 0 hashes its parent. All other rows find the siblings of their ancestors in the last row that
has some. A window holds one block of ``FAN ** LEVELS`` leaves, whole subtrees, whatever the size
of a group is; what the blocks leave becomes the next pass, ``FAN ** LEVELS`` times smaller.

Rows that repeat an id stand in the order of their leaves; null ids come first. A null group is a
group of its own and comes first; null columns have a mark of their own. An empty table has no
rows. Other columns than those named are not read, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import table
from folioscope.operators.scale import position_within
from folioscope.session import materialized

NAME = "op11_merkle_dataset_manifest"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels of one pass: a window holds at most ``FAN ** LEVELS`` rows.
LEVELS = 7
#: Up to so many rows of block roots go to all tasks (digests and at most seven steps, under 40 MB).
BROADCAST_ROWS = 30_000


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its length in bytes, a colon and itself; null is a dash."""
    texts = [v.cast("string") for v in values]
    return digest(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _level(nodes: DataFrame, block: Window, level: int) -> DataFrame:
    """Add the step of ``level`` (siblings left and right) to the rows its nodes live in, and put
    their parents' digests into the rows of slot 0. ``_c`` nodes are on the level."""
    step = FAN ** level
    here = F.col("position") % step == 0
    slot = F.floor(F.col("position") / step) % FAN
    count = F.ceil(F.col("n") / step)
    grows = here & (count > 1)
    empty = F.lit("")
    before = [F.when(slot >= i, F.lag("_d", step * i).over(block)) for i in range(FAN - 1, 0, -1)]
    behind = [F.when(slot + i < FAN, F.lead("_d", step * i).over(block)) for i in range(1, FAN)]
    joined = lambda parts: F.concat(*[F.coalesce(p, empty) for p in parts])
    nodes = nodes.withColumns({"_l": joined(before), "_r": joined(behind)})
    nodes = nodes.withColumn(f"_s{level}", F.when(grows, F.struct(F.col("_l").alias("left"), F.col("_r").alias("right"))))
    parent = F.when(slot == 0, digest(F.col("_d"), F.col("_r")))
    return nodes.withColumn("_d", F.when(grows, parent).otherwise(F.when(here, F.col("_d")))).drop("_l", "_r")


def _climb(nodes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One pass over ``nodes(*groups, position, n, digest)``: adds ``steps`` (siblings on each
    level of the pass that has more than one node) and, in the rows of a block's first node, the
    block's digest ``top``."""
    block = Window.partitionBy(*groups, "block").orderBy("position")
    rows = nodes.withColumn("block", F.floor(F.col("position") / FAN ** LEVELS).cast("long")).withColumn("_d", F.col("digest"))
    for level in range(LEVELS):
        rows = _level(rows, block, level)
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = F.array(*[F.last(f"_s{i}", ignorenulls=True).over(so_far) for i in range(LEVELS)])
    # A level without a second node in the group has no step in any of its rows.
    steps = F.filter(steps, lambda s: s.isNotNull())
    return rows.withColumn("steps", steps).select(
        *nodes.columns, "block", "steps",
        F.when(F.col("position") % FAN ** LEVELS == 0, F.col("_d")).alias("top"))


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only where a count says it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def climb(leaves: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Trees over ``leaves(*groups, position, n, digest, ...)``, positions from 0 in each group of
    ``n``: all rows with ``steps``, their siblings up to the root of the group as ``array<struct<left, right>>``,
    and ``root``. Group columns may hold null."""
    passed = materialized(_climb(leaves, groups), "merkle-pass")
    tops = materialized(passed.filter("top is not null").select(
        *groups, F.col("block").alias("position"), F.ceil(F.col("n") / FAN ** LEVELS).cast("long").alias("n"),
        F.col("top").alias("digest")), "merkle-tops")
    if tops.filter("n > 1").isEmpty():
        above = tops.select(*groups, "position", F.expr("array()").cast(passed.schema["steps"].dataType).alias("steps"),
                            F.col("digest").alias("root"))
    else:
        above = climb(tops, groups).select(*groups, "position", "steps", "root")
    above = above.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                         F.col("position").alias("_block"), F.col("steps").alias("_above"), "root")
    # Keys are blocks, so no group is larger than a block; null groups meet by null-safe equality.
    match = F.col("block") == F.col("_block")
    for i, group in enumerate(groups):
        match = match & F.col(group).eqNullSafe(F.col(f"_g{i}"))
    joined = passed.join(_few(materialized(above, "merkle-above")), match)
    return joined.withColumn("steps", F.concat("steps", "_above")).select(*leaves.columns, "steps", "root")


def manifest(
    leaves: DataFrame, group: str = "group", id_column: str = "id", digest_column: str = "leaf", keep: Sequence[str] = ()
) -> DataFrame:
    """All rows of a written table of leaves: those three columns and the ones to ``keep``, with
    ``position`` and ``n`` in their group, ``subroot``, ``root`` and ``steps`` up to the root."""
    taken = [group, id_column, digest_column, *keep]
    added = {"position", "n", "subroot", "root", "steps"}
    if len({*taken, *added}) < len(taken) + len(added):
        raise ValueError(f"columns {taken} must differ from each other and from {sorted(added)}")
    inner = ["group", "id", "digest", *[f"_k{i}" for i in range(len(keep))]]
    keys = leaves.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(taken, inner)])
    placed = position_within(keys, ["group"], ["id", "digest"]).withColumn("position", F.col("position") - 1)
    placed = materialized(placed, "merkle-positions")
    sizes = placed.groupBy("group").agg(F.count("*").alias("n")).select(F.col("group").alias("_group"), "n")
    same = F.col("group").eqNullSafe(F.col("_group"))
    sized = placed.join(_few(materialized(sizes, "merkle-sizes")), same).drop("_group")
    trees = materialized(climb(sized, ["group"]).withColumnRenamed("root", "subroot"), "merkle-trees")
    subroots = materialized(
        trees.filter("position = 0").select(F.col("group").alias("id"), F.col("subroot").alias("digest")), "merkle-subroots")
    # Groups are numbered like rows: null first, then by the bytes of their names.
    numbered = position_within(subroots.withColumn("_all", F.lit(0)), ["_all"], ["id"])
    numbered = numbered.withColumns({"position": F.col("position") - 1, "n": F.lit(subroots.count()).cast("long")})
    whole = climb(numbered.select("id", "position", "n", "digest")).select(
        F.col("id").alias("_group"), F.col("steps").alias("_above"), "root")
    out = trees.join(_few(materialized(whole, "merkle-root")), same)
    return out.withColumn("steps", F.concat("steps", "_above")).select(
        *[F.col(i).alias(c) for c, i in zip(taken, inner)], "position", "n", "subroot", "root", "steps")


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings of a proof, left to right and level by level."""
    return digest(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"]))))


def folded(steps: Column, start: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, start, lambda at, s: digest(s["left"], at, s["right"]))


def verified(rows: DataFrame, tampered: str = "tampered") -> DataFrame:
    """``folded_root`` from the column ``tampered`` and the proof, and whether it is the root."""
    return rows.withColumn("folded_root", folded(F.col("steps"), F.col(tampered))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; half of them checked after line ends were deleted."""
    docs = table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(F.coalesce(odd, F.lit(False)), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    leaves = materialized(docs.select(
        "doc_id", "source", leaf(fields).alias("leaf"), leaf([*fields[:-1], text]).alias("tampered")), "merkle-leaves")
    rows = verified(manifest(leaves, "source", "doc_id", "leaf", ["tampered"]))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


#: Steps of CRC-32 (fixed polynomial) over the bytes of the id's digits: take a byte in, shift eight times.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
    4294967295)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF_SQL = " || ".join(map(_field_sql, FIELDS[:-1]))
SQL = f"""
WITH RECURSIVE base AS (
    SELECT doc_id, source, sha256({_LEAF_SQL} || {_field_sql('text')}) AS leaf,
           sha256({_LEAF_SQL} || {_field_sql(f"CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS tampered
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n
    FROM base),
low(level, source, place, n, digest) AS (
    SELECT 0, source, place, n, leaf FROM leaves
    UNION ALL
    SELECT level + 1, source, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
    FROM low WHERE n > 1 GROUP BY level, source, place // 3, n),
subroots AS (
    SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM low WHERE n = 1),
high(level, place, n, digest) AS (
    SELECT 0, place, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
    FROM high WHERE n > 1 GROUP BY level, place // 3, n),
low_steps AS (
    SELECT a.level, a.source, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM low a JOIN low b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.place // 3 = b.place // 3
    WHERE a.n > 1 GROUP BY a.level, a.source, a.place),
high_steps AS (
    SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM high a JOIN high b ON a.level = b.level AND a.place // 3 = b.place // 3
    WHERE a.n > 1 GROUP BY a.level, a.place),
fold(source, leaf_place, level, place, digest, proof) AS (
    SELECT source, place, 0, place, tampered, '' FROM leaves
    UNION ALL
    SELECT f.source, f.leaf_place, f.level + 1, f.place // 3, sha256(s.l || f.digest || s.r), f.proof || s.l || s.r
    FROM fold f JOIN low_steps s
      ON f.level = s.level AND f.source IS NOT DISTINCT FROM s.source AND f.place = s.place),
low_done AS (SELECT source, leaf_place, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof
             FROM fold GROUP BY source, leaf_place),
rise(source, leaf_place, level, place, digest, proof) AS (
    SELECT d.source, d.leaf_place, 0, s.place, d.digest, d.proof
    FROM low_done d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT f.source, f.leaf_place, f.level + 1, f.place // 3, sha256(s.l || f.digest || s.r), f.proof || s.l || s.r
    FROM rise f JOIN high_steps s ON f.level = s.level AND f.place = s.place),
done AS (SELECT source, leaf_place, arg_max(digest, level) AS folded, arg_max(proof, level) AS proof
         FROM rise GROUP BY source, leaf_place)
SELECT l.doc_id, l.leaf, s.digest AS subroot, h.digest AS root, sha256(d.proof) AS proof_sha256,
       d.folded AS folded_root, d.folded = h.digest AS verified
FROM leaves l JOIN done d ON l.source IS NOT DISTINCT FROM d.source AND l.place = d.leaf_place
JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
CROSS JOIN (SELECT digest FROM high WHERE n = 1) h
"""
