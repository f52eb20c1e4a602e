"""Label ledgers, their resolution at a cutoff, and label import from a library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing, identity
from folioscope.functions.moments import instant
from folioscope.operators import ledger, scale
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
KINDS = ["label", "pairwise", "unlabel"]
LABELS = ["positive", "negative"]
REASON_PREFIX = "ranking-reason:"
# -------------------------------------------------------------------------------------------

ORDER = ("occurred_at", "event_id")


def event_hash(events: DataFrame) -> Column:
    """Content hash of a ledger row, used by the snapshot digest."""
    return hashing.content_hash(sorted(events.columns))


def at_cutoff(events: DataFrame, cutoff) -> DataFrame:
    return events.filter(F.col("occurred_at") <= instant(cutoff))


def resolved_labels(events: DataFrame, cutoff) -> DataFrame:
    """Latest effective label per paper, as of the cutoff (W2); unlabelled papers drop out."""
    judged = at_cutoff(events, cutoff).filter(F.col("kind") != "pairwise")
    columns = ["paper_id", "kind", "label", "occurred_at", "event_id", "source", "reason_codes"]
    latest = scale.latest_by(
        judged.select(*columns), ["paper_id"], [F.col(c) for c in ORDER]
    )
    return latest.filter(F.col("kind") == "label").select(
        "paper_id", "label", F.col("occurred_at").alias("resolved_at"), "event_id", "source",
        "reason_codes",
    )


def pairwise_judgments(events: DataFrame, cutoff) -> DataFrame:
    """Every pairwise preference up to the cutoff."""
    return at_cutoff(events, cutoff).filter(F.col("kind") == "pairwise").select(
        "paper_id", "compared_paper_id", F.col("occurred_at").alias("resolved_at"), "event_id",
    )


def label_conflicts(events: DataFrame, cutoff) -> DataFrame:
    """Papers carrying more than one label at their latest instant."""
    judged = at_cutoff(events, cutoff).filter(F.col("kind") != "pairwise")
    label = F.when(F.col("kind") == "label", F.col("label"))
    per_instant = judged.groupBy("paper_id", "occurred_at").agg(
        F.size(F.collect_set(label)).cast("long").alias("labels")
    )
    latest = scale.latest_by(per_instant, ["paper_id"], [F.col("occurred_at")])
    return latest.filter(F.col("labels") > 1).select("paper_id", "occurred_at", "labels")


def snapshot_header(events: DataFrame, cutoff, row_hash: Column | None = None) -> DataFrame:
    """Revision, digest and conflict count of a snapshot in one row."""
    seen = at_cutoff(events, cutoff)
    digest = hashing.set_digest(seen, event_hash(events) if row_hash is None else row_hash)
    counts = seen.agg(F.count(F.lit(1)).alias("revision"))
    conflicts = label_conflicts(events, cutoff).agg(F.count(F.lit(1)).alias("conflict_count"))
    one = F.lit(1).alias("_one")
    return (
        counts.select("*", one)
        .join(digest.select("*", one), "_one")
        .join(conflicts.select("*", one), "_one")
        .select("revision", "digest", instant(cutoff).alias("cutoff_at"), "conflict_count")
    )


def latest_by_item(events: DataFrame, source: str) -> DataFrame:
    """Latest imported event of every source item."""
    imported = events.filter(
        (F.col("source") == source) & F.col("source_item_key").isNotNull()
        & (F.col("source_item_key") != "")
    )
    return scale.latest_by(imported, ["source_item_key"], [F.col(c) for c in ORDER])


def positive_items(events: DataFrame, source: str) -> DataFrame:
    """Items whose current imported label is positive; they boost a profile."""
    latest = latest_by_item(events, source)
    return latest.filter((F.col("kind") == "label") & (F.col("label") == "positive")).select(
        F.col("source_item_key").alias("key")
    )


def check_mapping(positive: Sequence[str], negative: Sequence[str], prefix: str) -> None:
    """Both sides named, and no collection on both."""
    if not positive or not negative or set(positive) & set(negative) or not prefix.strip():
        raise ValueError("label collections must be named on both sides and disjoint")


def collection_label(positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Label from collection membership; ``both`` marks an impossible item (P10)."""
    hit = lambda names: F.arrays_overlap("collections", F.array(*map(F.lit, names)))
    return (
        F.when(hit(positive) & hit(negative), "both")
        .when(hit(positive), "positive")
        .when(hit(negative), "negative")
    )


def reason_codes(prefix: str = REASON_PREFIX) -> Column:
    """Sorted reasons from prefixed tags."""
    tagged = F.filter("tags", lambda t: F.lower(t).startswith(prefix.lower()))
    codes = F.transform(tagged, lambda t: identity.strip(F.substring(t, len(prefix) + 1, 1 << 30)))
    return F.array_sort(F.filter(codes, lambda c: c != ""))


def label_changes(
    items: DataFrame,
    events: DataFrame,
    positive: Sequence[str],
    negative: Sequence[str],
    observed_at,
    *,
    source: str = "library",
    prefix: str = REASON_PREFIX,
) -> DataFrame:
    """Label and unlabel events that bring the ledger up to the library's collections.

    ``items`` has ``item_key``, ``identifiers``, ``collections``, ``tags``. Every item and every
    earlier imported item comes out once with an ``action``: label, unlabel, same, skipped
    (labelled but without an identity) or both (an error).
    """
    check_mapping(positive, negative, prefix)
    current = (
        items.withColumn("new_label", collection_label(positive, negative))
        .filter(F.col("new_label").isNotNull())
        .select(
            "item_key",
            "new_label",
            identity.identity_from_tags(F.col("tags"), F.col("identifiers")).alias("new_paper"),
            reason_codes(prefix).alias("new_reasons"),
        )
    )
    latest = latest_by_item(events, source).select(
        F.col("source_item_key").alias("item_key"), "event_id", "kind", "label", "paper_id",
        "reason_codes",
    )
    both = current.join(latest, "item_key", "full_outer")
    active = F.col("new_label").isNotNull() & F.col("new_paper").isNotNull()
    same = (
        (F.col("kind") == "label")
        & (F.col("paper_id") == F.col("new_paper"))
        & (F.col("label") == F.col("new_label"))
        & (F.col("reason_codes") == F.col("new_reasons"))
    )
    action = (
        F.when(F.col("new_label") == "both", "both")
        .when(active & F.coalesce(same, F.lit(False)), "same")
        .when(active, "label")
        .when(F.col("event_id").isNotNull() & (F.col("kind") != "unlabel"), "unlabel")
        .when(F.col("new_label").isNotNull(), "skipped")
        .otherwise("same")
    )
    skipped = F.col("new_label").isin("positive", "negative") & F.col("new_paper").isNull()
    label_seed = F.concat_ws(
        "|", "item_key", "new_paper", "new_label", "new_reasons",
        F.coalesce("event_id", F.lit("")),
    )
    unlabel_seed = F.concat_ws("|", "item_key", "event_id", F.lit("unlabel"))
    is_label = F.col("action") == "label"
    return (
        both.withColumn("action", action)
        .withColumn("skipped", skipped)
        .select(
            "item_key",
            "action",
            "skipped",
            F.when(is_label, hashing.short_id(f"{source}-", label_seed))
            .when(F.col("action") == "unlabel", hashing.short_id(f"{source}-", unlabel_seed))
            .alias("new_event_id"),
            F.when(is_label, F.col("new_paper")).otherwise(F.col("paper_id")).alias("paper_id"),
            F.when(is_label, F.col("new_label")).alias("label"),
            F.when(is_label, F.col("new_reasons"))
            .otherwise(F.array().cast("array<string>"))
            .alias("reason_codes"),
            F.col("event_id").alias("supersedes_event_id"),
            instant(observed_at).alias("occurred_at"),
            F.lit(source).alias("source"),
        )
    )


def change_events(changes: DataFrame) -> DataFrame:
    """Ledger rows of the label and unlabel actions."""
    return changes.filter(F.col("action").isin("label", "unlabel")).select(
        F.col("new_event_id").alias("event_id"), F.col("action").alias("kind"), "paper_id",
        "occurred_at", "source", "label", F.lit(None).cast("string").alias("compared_paper_id"),
        "reason_codes", F.array().cast("array<string>").alias("applicable_dimensions"),
        F.lit(None).cast("string").alias("private_rationale"), "supersedes_event_id",
        F.col("item_key").alias("source_item_key"),
    )


def import_labels(items, events, positive, negative, observed_at, **options):
    """Ledger after the import, and its counts."""
    changes = materialized(
        label_changes(items, events, positive, negative, observed_at, **options), "label-changes"
    )
    if changes.filter(F.col("action") == "both").limit(1).count():
        raise ValueError("an item cannot be both positive and negative")
    status = ledger.append_status(events, change_events(changes))
    counts = changes.agg(
        F.count_if(F.col("action") == "unlabel").alias("unlabeled_events"),
        F.count_if("skipped").alias("skipped_items"),
    )
    added = ledger.appended_rows(status).select(*events.columns)
    return events.unionByName(added), counts


def resolve_candidates(wanted: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled papers found in a candidate table by exact identity, and those not found."""
    asked = wanted.select(
        F.col("paper_id").alias("asked"), identity.preprint_identity(F.col("paper_id")).alias("_id")
    )
    newest = scale.latest_by(candidates, ["paper_id"], [F.col("updated")])
    ids = asked.filter(F.col("_id").isNotNull()).select(F.col("_id").alias("paper_id")).distinct()
    found = newest.join(ids, "paper_id", "left_semi")
    unsupported = asked.filter(F.col("_id").isNull()).select(F.col("asked").alias("paper_id"))
    missing = ids.join(candidates.select("paper_id"), "paper_id", "left_anti")
    return found, unsupported.unionByName(missing)
