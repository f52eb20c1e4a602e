"""The bounded candidate pool and the suppression history."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.moments import days_before, instant
from folioscope.operators import scale

# ---- fixed values -------------------------------------------------------------------------
RETENTION_DAYS = 30
POOL_LIMIT = 1000
OVERLAP_HOURS = 12
FIRST_WINDOW_DAYS = 7
SUPPRESSION_DAYS = 14
HISTORY_DAYS = 30
# -------------------------------------------------------------------------------------------


def latest_revisions(candidates: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Newest revision per paper; among equal updates the first seen stays."""
    seen = F.lit(0).cast("long") if arrival is None else arrival.cast("long")
    return scale.latest_by(
        candidates.withColumn("_seen", seen), ["paper_id"], [F.col("updated"), -F.col("_seen")]
    ).drop("_seen").select(*candidates.columns)


def merge_pool(
    existing: DataFrame,
    incoming: DataFrame,
    completed_at,
    *,
    retention_days: int | None = RETENTION_DAYS,
    limit: int | None = POOL_LIMIT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pool after a retrieval: old rows out, newest revisions in, newest ``limit`` kept.

    Rows out of retention go before the shuffle; ``by`` keeps one pool per group, such as per
    reader.
    """
    if retention_days is not None and retention_days < 0:
        raise ValueError("retention must not be negative")
    both = existing.withColumn("_seen", F.lit(0)).unionByName(incoming.withColumn("_seen", F.lit(1)))
    if retention_days is not None:
        both = both.filter(F.col("updated") >= days_before(instant(completed_at), retention_days))
    newest = scale.latest_by(both, [*by, "paper_id"], [F.col("updated"), -F.col("_seen")]).select(
        *existing.columns
    )
    if limit is None:
        return newest
    order = [F.col("updated").desc(), F.col("paper_id").desc()]
    if by:
        return scale.top_per_group(newest, by, order, limit, "_rank").drop("_rank")
    return scale.top_rows(newest, order, limit)


def retrieval_start(now, checkpoint=None) -> Column:
    """Start of the window: the checkpoint less the overlap, or a week back without one."""
    if checkpoint is None:
        return days_before(instant(now), FIRST_WINDOW_DAYS)
    return instant(checkpoint) - F.expr(f"INTERVAL {OVERLAP_HOURS} HOURS")


def retrieve(
    candidates: DataFrame,
    categories: Sequence[str],
    now,
    *,
    checkpoint=None,
    ceiling: int = POOL_LIMIT,
) -> DataFrame:
    """Candidates of the wanted categories inside the window, newest first per category."""
    if not categories:
        raise ValueError("at least one category is required")
    share = max(1, math.ceil(ceiling / len(categories)))
    window = candidates.filter(
        F.col("published").between(retrieval_start(now, checkpoint), instant(now))
        & F.arrays_overlap("categories", F.array(*map(F.lit, categories)))
    )
    wanted = F.array_intersect("categories", F.array(*map(F.lit, categories)))
    order = [F.col("published").desc(), F.col("paper_id").desc()]
    best = scale.top_per_group(
        window.withColumn("_category", F.explode(wanted)), ["_category"], order, share, "_rank"
    )
    return latest_revisions(best.drop("_category", "_rank"))


def seen_ids(seen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every paper ever retrieved."""
    return seen.select("paper_id").unionByName(candidates.select("paper_id")).distinct()


def excluded_ids(history: DataFrame, now, days: int = SUPPRESSION_DAYS) -> DataFrame:
    """Papers published within the suppression window."""
    if not 1 <= days <= HISTORY_DAYS:
        raise ValueError("suppression lasts between 1 and 30 days")
    recent = history.filter(F.col("published_at") >= days_before(instant(now), days))
    return recent.select("paper_id").distinct()


def suppress(candidates: DataFrame, history: DataFrame, now, days: int = SUPPRESSION_DAYS):
    """Candidates not published lately."""
    return candidates.join(excluded_ids(history, now, days), "paper_id", "left_anti")


def next_history(history: DataFrame, published: DataFrame, published_at) -> DataFrame:
    """History after a publication, kept apart until it succeeds."""
    at = instant(published_at)
    kept = history.filter(F.col("published_at") >= days_before(at, HISTORY_DAYS))
    new = published.select("paper_id", "revision", at.alias("published_at")).dropDuplicates(
        ["paper_id"]
    )
    return kept.join(new.select("paper_id"), "paper_id", "left_anti").unionByName(
        new.select(*history.columns)
    )
