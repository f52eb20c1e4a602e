"""Stored term counts of profiles, kept up to date by signed deltas.

Counts are whole numbers, so a retraction takes away exactly what was once added. They are kept by
the date of the seed item, as the decay of a date depends on the day a profile is read, not on the
day an item was counted. An update tokenizes only families that changed: a seed item with all that
hangs below it.

Rows without a profile or a key belong to no family and are left out. Items are told apart by
(profile, key); rows that repeat one are counted as often as they come. Extra columns are part of an
item's content: a change there recounts its family and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing, moments, text
from folioscope.operators import profile, scale
from folioscope.session import materialized

#: All signal weights are whole multiples of it.
UNIT = 0.25
FAMILY = ["profile_id", "key"]
COUNTED = ["profile_id", "kind", "date", "term"]


def _units(weight: Column) -> Column:
    return F.round(weight / UNIT).cast("long")


def _owned(items: DataFrame) -> DataFrame:
    return items.filter(F.col("profile_id").isNotNull() & F.col("key").isNotNull())


def count_terms(
    items: DataFrame, curated: DataFrame | None = None, families: DataFrame | None = None
) -> DataFrame:
    """``(profile_id, kind, date, term, units)`` of all families, or of the listed ones.

    ``term`` rows hold weight units of a term; ``collection`` rows hold members of a collection,
    whose name is looked up when the counts are read.
    """
    seeds, children = _owned(items).filter(profile.is_seed()), profile.live_children(_owned(items))
    if families is not None:
        seeds = scale.hot_key_join(seeds, families, FAMILY)
        children = scale.hot_key_join(
            children, families.withColumnRenamed("key", "parent_key"), ["profile_id", "parent_key"]
        )
    roots = profile.roots_with_decay(seeds, None, curated)
    own = roots.select("profile_id", "date", F.explode(profile.own_signals()).alias("s")).select(
        "profile_id", "date", "s.term", _units(F.col("s.w")).alias("units")
    )
    # Children are summed per parent and term first; the join meets distinct terms of a parent.
    below = (
        children.select(
            "profile_id", F.col("parent_key").alias("key"), F.explode(profile.child_signals()).alias("s")
        )
        .groupBy(*FAMILY, F.col("s.term").alias("term"))
        .agg(F.sum(_units(F.col("s.w"))).alias("units"))
        .join(roots.select(*FAMILY, "date"), FAMILY)
        .select("profile_id", "date", "term", "units")
    )
    members = roots.select("profile_id", "date", F.explode("collections").alias("term")).select(
        "profile_id", F.lit("collection").alias("kind"), "date", "term", F.lit(1).cast("long").alias("units")
    )
    terms = own.unionByName(below).withColumn("kind", F.lit("term"))
    return merged(terms.unionByName(members))


def family_digests(items: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """One digest per family, over the seed's rows, its children and its curated flag."""
    keys = profile.digest_keys(_owned(items)).withColumnRenamed("item_key", "key")
    flag = F.lit("0")
    if curated is not None:
        flags = curated.select(*FAMILY).distinct().withColumn("_flag", F.lit("1"))
        keys, flag = keys.join(flags, FAMILY, "left"), F.coalesce("_flag", F.lit("0"))
    return hashing.set_digest(keys, F.sha2(F.concat("content_hash", flag), 256), FAMILY)


def changed_families(before: DataFrame, after: DataFrame) -> DataFrame:
    """Families whose digests differ, new and vanished ones included."""
    side = lambda df, name: df.select(*FAMILY, F.col("digest").alias(name))
    both = side(before, "old").unionByName(side(after, "new"), allowMissingColumns=True)
    met = both.groupBy(*FAMILY).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return met.filter(~F.col("old").eqNullSafe(F.col("new"))).select(*FAMILY)


def deltas(
    before: DataFrame,
    after: DataFrame,
    *,
    curated_before: DataFrame | None = None,
    curated_after: DataFrame | None = None,
    digests_before: DataFrame | None = None,
) -> DataFrame:
    """Signed counts that lead from one state of a library to the next.

    ``digests_before`` is a stored ``family_digests(before)``; without it ``before`` is hashed again.
    """
    old = family_digests(before, curated_before) if digests_before is None else digests_before
    families = materialized(
        changed_families(old, family_digests(after, curated_after)), "changed-families"
    )
    taken = count_terms(before, curated_before, families).withColumn("units", -F.col("units"))
    return merged(taken.unionByName(count_terms(after, curated_after, families)))


def merged(counts: DataFrame) -> DataFrame:
    """Counts of equal keys added up; what comes to nothing leaves.

    Stored counts and any number of appended deltas may be read together: every reader adds up.
    """
    summed = counts.groupBy(*COUNTED).agg(F.sum("units").alias("units"))
    return summed.filter(F.col("units") != 0)


def updated(stored: DataFrame, signed: DataFrame) -> DataFrame:
    """Stored counts after an update. A count below zero means that the deltas belong to another state."""
    after = merged(stored.select(*COUNTED, "units").unionByName(signed.select(*COUNTED, "units")))
    known = F.when(F.col("units") > 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("deltas retract what was never counted: "), F.coalesce("term", F.lit(""))))
        .cast("boolean")
    )
    return after.filter(known)


def weights_of(
    counts: DataFrame, collections: DataFrame | None = None, *, observed_at=None
) -> DataFrame:
    """The weights of ``profile.term_weights``, read from counts instead of texts."""
    observed = None if observed_at is None else moments.instant(observed_at)
    weight = F.col("units") * UNIT
    dated = counts.withColumn("recent", weight * moments.date_decay(F.col("date"), observed)).withColumn(
        "weight", weight
    )
    parts = dated.filter(F.col("kind") == "term").select("profile_id", "term", "weight", "recent")
    if collections is not None:
        w = profile.SIGNAL_WEIGHTS["collection"] / UNIT
        labelled = F.lower(F.trim("name")).isin(profile.LABEL_COLLECTIONS)
        names = collections.filter(~labelled).select(
            "profile_id", F.col("key").alias("collection"),
            F.explode(text.profile_tokens(F.col("name"))).alias("term"),
        )
        held = (
            dated.filter(F.col("kind") == "collection")
            .groupBy("profile_id", F.col("term").alias("collection"))
            .agg(F.sum(F.col("weight") * w).alias("weight"), F.sum(F.col("recent") * w).alias("recent"))
        )
        parts = parts.unionByName(
            held.join(names, ["profile_id", "collection"]).select("profile_id", "term", "weight", "recent")
        )
    return parts.groupBy("profile_id", "term").agg(
        F.sum("weight").alias("weight"), F.round(F.sum("recent"), 9).alias("recent_weight")
    )
