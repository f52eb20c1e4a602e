"""Building blocks that keep ranking, numbering and joining balanced under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialized

BROADCAST_ROWS = 20_000
SAMPLE_PER_BUCKET = 16
#: Rows that one task may well hold; larger inputs get more buckets and more salts.
ROWS_PER_TASK = 1_000_000


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side of narrow rows is small enough to ship to every executor."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only behind a count; a larger side keeps the planner's shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def hot_key_join(
    wide: DataFrame,
    narrow: DataFrame,
    keys: Sequence[str],
    rows: int = BROADCAST_ROWS,
    sized_by: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner equi-join that survives one key holding a third of ``wide``.

    A narrow side within ``rows`` is broadcast; ``sized_by`` is a cheaper table known to be no
    smaller, counted in its place. Beyond it, keys with more than ``rows_per_task`` rows in ``wide``
    are spread over as many salts as their count asks for, and only their rows of ``narrow`` are
    repeated, once per salt.
    """
    if fits_broadcast(narrow if sized_by is None else sized_by, rows):
        return wide.join(F.broadcast(narrow), list(keys))
    hot = materialized(
        wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .filter((F.col("_rows") > rows_per_task) & F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts")),
        "hot-keys",
    )
    if hot.isEmpty():
        return wide.join(narrow, list(keys))
    # At most one hot key per ``rows_per_task`` rows of ``wide``; its size is checked all the same.
    salts = small_side(hot, rows)
    many = F.coalesce("_salts", F.lit(1))
    salted = wide.join(salts, list(keys), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*wide.columns), many).cast("int")
    ).drop("_salts")
    spread = narrow.join(salts, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), many - 1))
    ).drop("_salts")
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def spread_rows(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Deal a table whose rows are dear to work on, one task per ``rows_per_task`` rows and per core at least.

    The rows are counted first, so ``df`` is best read from files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)))


def left_join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on one string key in which rows without a key spread over all tasks.

    ``right`` must not repeat a key. Null keys would hash to one partition; here each
    gets a key of its own that nothing on the right can have.
    """
    alone = F.concat(F.lit("\0"), F.hex(F.xxhash64(*left.columns)))
    keyed = left.withColumn("_spread", F.coalesce(F.col(key), alone))
    joined = keyed.join(right.withColumnRenamed(key, "_spread"), "_spread", "left")
    return joined.drop("_spread")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int, name: str = "rank"
) -> DataFrame:
    """First ``most`` rows of every group, ranked.

    The rank filter sits on the window, so Spark trims each task to ``most`` rows per group
    before the shuffle and no group ever arrives whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= most)


def top_rows(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """Global first ``most`` rows: a per-task top-k followed by one merge."""
    return df.orderBy(*order).limit(most)


def _sql_literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "string":
        return f"CAST(X'{value.encode().hex()}' AS STRING)"
    return f"CAST('{value!r}' AS {kind})" if isinstance(value, float) else f"CAST({value} AS {kind})"


def _key_sample(keys: DataFrame, order: Sequence[str], slots: int) -> tuple[int, list]:
    """Row count and at most ``slots`` keys in order, in one pass.

    Keys are dealt to slots by hash and each slot keeps the one with the smallest hash, so a task
    sends one row per slot whatever it reads, and the sample is the same in every run.
    """
    spread = F.xxhash64(*order)
    kept = (
        keys.groupBy(F.pmod(spread, F.lit(slots)).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min_by(F.struct(*order), spread).alias("_key"))
        .orderBy("_key")
        .select("_rows", "_key")
        .collect()
    )
    return sum(row["_rows"] for row in kept), [row["_key"] for row in kept]


def range_buckets(
    df: DataFrame, order: Sequence[str], name: str = "_bucket", rows_per_bucket: int = ROWS_PER_TASK
) -> DataFrame:
    """Tag rows with order-preserving buckets cut at sampled keys.

    There is a bucket for every ``rows_per_bucket`` rows, and at least one per shuffle partition.
    Count and sample come from one pass; only inputs beyond ``rows_per_bucket`` rows a partition are
    passed once more, for the larger sample they need. The cut points become one constant, so a row's
    bucket depends on its key alone and is found by binary search. A group of any size is spread
    over as many buckets as its share of the rows.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    kinds = dict(df.dtypes)
    plain = [
        F.unix_micros(c).alias(c) if kinds[c] == "timestamp" else F.col(c).alias(c) for c in order
    ]
    keys = df.select(*plain)
    total, ordered = _key_sample(keys, order, buckets * SAMPLE_PER_BUCKET)
    if total > buckets * rows_per_bucket:
        buckets = -(-total // rows_per_bucket)
        _, ordered = _key_sample(keys, order, buckets * SAMPLE_PER_BUCKET)
    step = max(1, len(ordered) // buckets)
    cuts = [tuple(row) for row in ordered[step::step]]
    if not cuts:
        return df.withColumn(name, F.lit(0))
    types = [t for _, t in keys.dtypes]
    constant = F.expr(
        "array("
        + ",".join(
            "struct(" + ",".join(_sql_literal(v, t) for v, t in zip(cut, types, strict=True)) + ")"
            for cut in cuts
        )
        + ")"
    )
    key = F.struct(*plain)
    halves = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    bucket = F.aggregate(
        F.array(*[F.lit(h) for h in halves]),
        F.lit(0),
        lambda at, half: F.when(
            F.coalesce(F.get(constant, at + half - 1) <= key, F.lit(False)), at + half
        ).otherwise(at),
    )
    return df.withColumn(name, bucket)


def position_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "position",
    rows_per_bucket: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact 1-based position per group, ascending, for groups of any size.

    Rows are numbered inside order-preserving buckets and shifted by the sizes of the earlier
    buckets of their group; the order must identify rows.
    """
    bucketed = range_buckets(df, [*groups, *order], rows_per_bucket=rows_per_bucket)
    sizes = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_inside", F.row_number().over(inside))
    match = F.col("_bucket") == F.col("_b")
    for i, group in enumerate(groups):
        match = match & F.col(group).eqNullSafe(F.col(f"_g{i}"))
    joined = numbered.join(offsets, match)
    position = (F.col("_inside") + F.col("_before")).cast("long")
    return joined.select(*df.columns, position.alias(name))


def exact_medians(df: DataFrame, groups: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Exact medians of several measures per group, NULLs skipped.

    Equal values are counted together before any shuffle and written once, then located by bucket counts, so
    neither a hot group nor a long list of values meets in one task.
    """
    measures = list(values)
    long = df.select(
        *groups,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("measure"), values[m].cast("double").alias("value"))
                    for i, m in enumerate(measures)
                ]
            )
        ).alias("_m"),
    ).select(*groups, F.col("_m.measure").alias("_measure"), F.col("_m.value").alias("_value"))
    counted = (
        long.filter(F.col("_value").isNotNull())
        .groupBy(*groups, "_measure", "_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    counted = materialized(counted, "value-counts")
    keys = [*groups, "_measure"]
    bucketed = range_buckets(counted, [*keys, "_value"])
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_rows").alias("_size"))
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_size").over(per_key)
    located = (
        sizes.withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        .withColumn("_low", ((total + 1) / 2).cast("long"))
        .withColumn("_high", (total / 2).cast("long") + 1)
        .filter(
            (F.col("_high") > F.col("_before"))
            & (F.col("_low") <= F.col("_before") + F.col("_size"))
        )
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = bucketed.join(located, [*keys, "_bucket"]).withColumn(
        "_end", F.col("_before") + F.sum("_rows").over(inside)
    )
    start = F.col("_end") - F.col("_rows")
    low_hit = (F.col("_low") > start) & (F.col("_low") <= F.col("_end"))
    high_hit = (F.col("_high") > start) & (F.col("_high") <= F.col("_end"))
    median = (F.max(F.when(low_hit, F.col("_value"))) + F.max(F.when(high_hit, F.col("_value")))) / 2
    per_measure = ends.groupBy(*keys).agg(median.alias("_median"))
    return per_measure.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("_measure") == i, F.col("_median"))).alias(m)
            for i, m in enumerate(measures)
        ]
    )
