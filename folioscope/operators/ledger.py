"""Append-only feedback ledgers: idempotent appends, lineage and as-of attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import scale
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
EVENT_TYPES = ["impression", "outcome", "correction"]
OUTCOMES = [
    "interested", "save_for_later", "read", "worthwhile", "not_worthwhile", "not_interested",
]
POSITIVE_OUTCOMES = ["interested", "worthwhile"]
REASON_CODES = [
    "topic-mismatch", "incremental", "weak-evidence", "poor-clarity", "no-practical-relevance",
]
SUBMITTED_ACTIONS = ["interested", "not_interested", "save_for_later", "read"]
ACTIONS_PER_SUBMISSION = 100
# -------------------------------------------------------------------------------------------


def append_status(ledger: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """What an append would do with each incoming key.

    One row per key: ``added`` (0 or 1), ``duplicates`` and ``conflict``. Retries are counted
    together before the shuffle, so a key sent a million times costs one row.
    """
    columns = [c for c in ledger.columns if c in batch.columns]
    body = hashing.content_hash([c for c in columns if c != key])
    incoming = batch.select(key, body.alias("_h"), F.struct(*columns).alias("_row"))
    per_key = incoming.groupBy(key).agg(
        F.min("_h").alias("_low"),
        F.max("_h").alias("_high"),
        F.count(F.lit(1)).alias("copies"),
        F.any_value("_row").alias("_row"),
    )
    # The stored side is only scanned: it meets the batch's keys first, and matches alone are hashed.
    known = scale.hot_key_join(
        ledger.select(*columns), per_key.select(key), [key], rows=100_000, sized_by=batch.select(key)
    ).select(key, body.alias("_known"))
    joined = per_key.join(known, key, "left")
    conflict = (F.col("_low") != F.col("_high")) | (
        F.col("_known").isNotNull() & (F.col("_known") != F.col("_low"))
    )
    fresh = F.col("_known").isNull().cast("long")
    return joined.select(
        key,
        conflict.alias("conflict"),
        F.when(conflict, 0).otherwise(fresh).cast("long").alias("added"),
        F.when(conflict, 0).otherwise(F.col("copies") - fresh).cast("long").alias("duplicates"),
        "_row",
    )


def appended_rows(status: DataFrame) -> DataFrame:
    """The rows an append adds."""
    return status.filter(F.col("added") == 1).select("_row.*")


def append(ledger: DataFrame, batch: DataFrame, key: str = "event_id", fail_fast: bool = True):
    """Ledger after an idempotent append; a changed row under a known key is an error."""
    status = append_status(ledger, batch, key)
    if fail_fast and status.filter("conflict").limit(1).count():
        raise ValueError(f"{key} conflicts with a stored event")
    return ledger.unionByName(appended_rows(status).select(*ledger.columns))


def append_counts(status: DataFrame) -> DataFrame:
    """Totals of one append."""
    return status.agg(
        F.sum("added").alias("added"),
        F.sum("duplicates").alias("duplicates"),
        F.sum(F.col("conflict").cast("long")).alias("conflicts"),
    )


def unprocessed(submissions: DataFrame, processed: DataFrame, key: str = "submission") -> DataFrame:
    """Submissions not consumed before."""
    return submissions.join(processed.select(key).distinct(), key, "left_anti")


def effective(events: DataFrame) -> DataFrame:
    """Events that no later event supersedes."""
    gone = events.select(F.col("supersedes_event_id").alias("event_id")).filter(
        F.col("event_id").isNotNull()
    )
    return events.join(gone.distinct(), "event_id", "left_anti")


def lineage_violations(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Corrections whose target is unknown, of another paper, or later than they are."""
    target = (events if known is None else known).select(
        F.col("event_id").alias("supersedes_event_id"),
        F.col("paper_id").alias("_paper"),
        F.col("occurred_at").alias("_at"),
    )
    corrections = events.filter(F.col("supersedes_event_id").isNotNull())
    checked = corrections.join(target, "supersedes_event_id", "left")
    reason = (
        F.when(F.col("_paper").isNull(), "unknown event")
        .when(F.col("_paper") != F.col("paper_id"), "different paper")
        .when(F.col("occurred_at") < F.col("_at"), "precedes its target")
    )
    return (
        checked.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("event_id", "paper_id", "supersedes_event_id", "reason")
    )


def _attributable(events: DataFrame) -> DataFrame:
    """Impressions (``_late`` 0) and effective outcomes (``_late`` 1) as narrow rows, from one scan of
    the events and one of their corrections."""
    shown = F.col("event_type") == "impression"
    spoken = F.col("outcome").isNotNull()
    kinds = F.array_compact(F.array(F.when(shown, 0), F.when(spoken, 1)))
    rows = events.filter(shown | spoken).select(
        "paper_id", "batch_id", "event_id", "outcome", F.col("occurred_at").alias("_at"),
        F.col("displayed_rank").alias("_rank"), F.explode(kinds).alias("_late"),
    )
    gone = events.filter(F.col("supersedes_event_id").isNotNull()).select(
        F.col("supersedes_event_id").alias("_gone")).distinct()
    taken_back = (F.col("event_id") == F.col("_gone")) & (F.col("_late") == 1)
    return rows.join(gone, taken_back, "left_anti")


def _carried(rows: DataFrame) -> DataFrame:
    """What earlier buckets leave to each (paper, batch, bucket): the last impression of the paper, of
    any batch and of the same one, in one struct.

    Buckets follow the order of papers, so a paper is in several buckets only where a cut falls
    inside it: papers with a carry are fewer than buckets, and a paper or batch has one row a bucket.
    """
    several = (
        rows.groupBy("paper_id").agg(F.min("_bucket").alias("_first"), F.max("_bucket").alias("_last"))
        .filter(F.col("_first") < F.col("_last")).select(F.col("paper_id").alias("_paper"))
    )
    spread = rows.join(F.broadcast(several), F.col("paper_id").eqNullSafe(F.col("_paper"))).drop("_paper")
    lasts = materialized(
        spread.groupBy("paper_id", "batch_id", "_bucket").agg(F.max("_mark").alias("_mark")), "last-impressions")
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    before = lambda *keys: F.max("_mark").over(earlier(*keys))
    same = lasts.withColumn("_same0", before("paper_id", "batch_id"))
    any_batch = lasts.groupBy("paper_id", "_bucket").agg(F.max("_mark").alias("_mark")).withColumn(
        "_any0", before("paper_id")).select(
        F.col("paper_id").alias("_p"), F.col("_bucket").alias("_b"), "_any0")
    both = same.join(any_batch, F.col("paper_id").eqNullSafe(F.col("_p")) & (F.col("_bucket") == F.col("_b")))
    return both.select(
        F.col("paper_id").alias("_p"), F.col("batch_id").alias("_n"), F.col("_bucket").alias("_b"),
        F.struct(F.col("_any0").alias("any"), F.col("_same0").alias("same")).alias("_carry"),
    )


def attribute_outcomes(events: DataFrame) -> DataFrame:
    """Each effective outcome with the latest impression of its paper at or before it.

    The impression of the same batch wins; an outcome whose batch has none, or that names no
    batch, takes the latest of any batch. ``displayed_rank`` is NULL when nothing was shown.

    One sorted pass: rows are cut into buckets in the order of (paper, time), running maxima answer
    inside a bucket, and one carry per (paper, batch, bucket) holds what came before it.
    """
    rows = materialized(_attributable(events), "attributable")
    rows = scale.range_buckets(rows, ["paper_id", "_at", "_late", "event_id"])
    # Rows are ordered by time, so the latest impression so far is the greatest one so far.
    rows = rows.withColumn("_mark", F.when(F.col("_late") == 0, F.struct("_at", "event_id", "_rank")))
    so_far = lambda *keys: F.max("_mark").over(
        Window.partitionBy(*keys, "_bucket").orderBy("_at", "_late", "event_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Both windows stand on one shuffle by paper and bucket.
    inside = rows.withColumn("_any", so_far("paper_id")).withColumn("_same", so_far("paper_id", "batch_id"))
    carried = _carried(rows)
    match = F.col("_bucket") == F.col("_b")
    for own, theirs in (("paper_id", "_p"), ("batch_id", "_n")):
        match = match & F.col(own).eqNullSafe(F.col(theirs))
    joined = inside.filter(F.col("_late") == 1).join(carried, match, "left")
    latest, same = F.coalesce("_any", "_carry.any"), F.coalesce("_same", "_carry.same")
    hit = F.when(F.col("batch_id").isNull(), latest).otherwise(F.coalesce(same, latest))
    return joined.withColumn("_hit", hit).select(
        "event_id", "paper_id", "batch_id", "outcome", F.col("_at").alias("occurred_at"),
        F.col("_hit.event_id").alias("impression_id"), F.col("_hit._rank").alias("displayed_rank"),
    )


def position_outcomes(events: DataFrame) -> DataFrame:
    """Impressions, explicit outcomes and positive outcomes per displayed rank."""
    shown = (
        events.filter((F.col("event_type") == "impression") & F.col("displayed_rank").isNotNull())
        .groupBy("displayed_rank")
        .agg(F.count(F.lit(1)).alias("impression_count"))
    )
    spoken = (
        attribute_outcomes(events)
        .filter(F.col("displayed_rank").isNotNull())
        .groupBy("displayed_rank")
        .agg(
            F.count(F.lit(1)).alias("explicit_outcome_count"),
            F.count_if(F.col("outcome").isin(POSITIVE_OUTCOMES)).alias("positive_outcome_count"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return shown.join(spoken, "displayed_rank", "left").select(
        F.col("displayed_rank").cast("int").alias("displayed_rank"), "impression_count",
        zero("explicit_outcome_count"), zero("positive_outcome_count"),
    )


def impressions(shown: DataFrame, occurred_at: Column, order: Sequence[str]) -> DataFrame:
    """Impression events of published batches; rank is the place inside the batch.

    ``shown`` needs ``batch_id`` and ``paper_id``; ``order`` ends in a unique column.
    """
    ranked = scale.position_within(shown, ["batch_id"], order, "displayed_rank")
    seed = F.concat_ws("|", "batch_id", F.col("displayed_rank").cast("string"), "paper_id")
    return ranked.select(
        hashing.short_id("impression-", seed).alias("event_id"),
        F.lit("impression").alias("event_type"),
        "paper_id",
        occurred_at.alias("occurred_at"),
        F.lit(None).cast("string").alias("outcome"),
        "batch_id",
        F.col("displayed_rank").cast("int").alias("displayed_rank"),
        F.array().cast("array<string>").alias("reason_codes"),
        F.lit(None).cast("string").alias("supersedes_event_id"),
    )


def clamped_weights(
    steps: DataFrame, key: str, *, start: float = 1.0, floor: float = 0.25
) -> DataFrame:
    """Ordered fold of gains and floored losses per key, in event order.

    ``steps`` carries ``occurred_at``, ``event_id`` and ``delta``; a loss never takes a weight
    below ``floor``. A run of steps acts as ``w -> max(a, w + b)``, and such maps compose, so the
    fold splits over buckets: with suffix sums, the answer is the larger of ``start + sum`` and
    ``floor + what follows`` the most telling loss.
    """
    rows = scale.range_buckets(
        steps.select(key, "occurred_at", "event_id", "delta"), [key, "occurred_at", "event_id"]
    )
    after = (
        Window.partitionBy(key, "_bucket")
        .orderBy("occurred_at", "event_id")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    marked = rows.withColumn("_tail", F.coalesce(F.sum("delta").over(after), F.lit(0.0)))
    per_bucket = marked.groupBy(key, "_bucket").agg(
        F.sum("delta").alias("_b"),
        F.max(F.when(F.col("delta") < 0, F.lit(floor) + F.col("_tail"))).alias("_a"),
    )
    later = (
        Window.partitionBy(key).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    )
    placed = per_bucket.withColumn("_rest", F.coalesce(F.sum("_b").over(later), F.lit(0.0)))
    return placed.groupBy(key).agg(
        F.greatest(F.lit(start) + F.sum("_b"), F.max(F.col("_a") + F.col("_rest"))).alias("weight")
    )
