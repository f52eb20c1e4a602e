"""Profile counts changed by signed deltas equal a full rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import profile, profile_counts
from folioscope.session import materialized
from test_documents import ITEM, NOW, item

WORDS = "machine learning vision quantum neural language retrieval graph proof sampling".split()
PAIR = "profile_id string, key string"


def family(rng, key):
    """A seed item and what hangs below it."""
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [item(
        key, some(3), tags=[(some(1), rng.random() < 0.5), ("internal:hidden", True)],
        collections=rng.sample(["C", "D"], rng.randrange(3)),
        date=rng.choice([None, "", "2026-08-01", "2020", "May 1999"]), trashed=rng.random() < 0.1)]
    for i in range(rng.randrange(4)):
        kind = rng.choice(["note", "annotation"])
        rows.append(item(f"{key}-{i}", kind=kind, parent=key, note=some(2) if kind == "note" else None,
                         mark=some(1), comment=rng.choice([None, "", some(2)]), trashed=rng.random() < 0.1))
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def library(spark, families):
    return spark.createDataFrame([row for rows in families.values() for row in rows], ITEM)


def close_weights(left, right):
    got, want = ({(r.profile_id, r.term): (r.weight, r.recent_weight) for r in df.collect()} for df in (left, right))
    assert got.keys() == want.keys()
    for key, (weight, recent) in want.items():
        assert got[key][0] == weight and got[key][1] == pytest.approx(recent, abs=2e-9)


def test_deltas_equal_a_rebuild_over_many_updates(spark):
    rng = random.Random(11)
    families = {f"s{i}": family(rng, f"s{i}") for i in range(12)}
    families["s0"] += [families["s0"][0]]  # a repeated row counts twice
    curated = {"s1", "s2"}
    flags = lambda names: spark.createDataFrame([("me", n) for n in sorted(names)], PAIR)
    collections = spark.createDataFrame(
        [("me", "C", "Positive"), ("me", "D", "Retrieval models")], "profile_id string, key string, name string")
    before = library(spark, families)
    stored = materialized(profile_counts.count_terms(before, flags(curated)), "test-counts")
    for step in range(3):
        old_curated, before = set(curated), library(spark, families)
        for key in rng.sample(sorted(families), 3):
            families[key] = family(rng, key)
        del families[rng.choice(sorted(families))]
        families[f"n{step}"] = family(rng, f"n{step}")
        moved = sorted(families)[step]
        families[moved] = families[moved] + [item(f"{moved}-late{step}", kind="note", parent=moved, note="late words")]
        curated = set(rng.sample(sorted(families), 3))
        after = library(spark, families)
        signed = profile_counts.deltas(
            before, after, curated_before=flags(old_curated), curated_after=flags(curated))
        stored = materialized(profile_counts.updated(stored, signed), "test-counts")
        assert rows_of(stored) == rows_of(profile_counts.count_terms(after, flags(curated)).select(stored.columns))
        close_weights(
            profile_counts.weights_of(stored, collections, observed_at=NOW),
            profile.term_weights(after, collections, observed_at=NOW, curated=flags(curated)))


def test_only_changed_families_are_counted(spark):
    rng = random.Random(5)
    families = {f"s{i}": family(rng, f"s{i}") for i in range(6)}
    before = library(spark, families)
    assert profile_counts.deltas(before, before).count() == 0
    families["s3"] = families["s3"] + [item("s3-x", kind="note", parent="s3", note="machine")]
    after = library(spark, families)
    digests = profile_counts.family_digests(before)
    changed = profile_counts.changed_families(digests, profile_counts.family_digests(after))
    live = not families["s3"][0][13 - 2]
    assert [r.key for r in changed.collect()] == (["s3"] if live else [])
    signed = profile_counts.deltas(before, after, digests_before=digests).collect()
    assert [(r.term, r.units) for r in signed] == ([("machine", 6)] if live else [])


def test_empty_libraries_and_rows_without_keys(spark):
    none = spark.createDataFrame([], ITEM)
    rows = [item("a", "machine"), (None, *item("b", "vision")[1:]), ("me", None, *item("c", "proof")[2:])]
    items = spark.createDataFrame(rows, ITEM).withColumn("units", F.lit("extra")).withColumn("term", F.lit(1))
    assert profile_counts.count_terms(none).count() == 0
    added = profile_counts.deltas(none.withColumn("units", F.lit("")).withColumn("term", F.lit(1)), items)
    assert [(r.profile_id, r.kind, r.term, r.units) for r in added.collect()] == [("me", "term", "machine", 1)]
    gone = profile_counts.deltas(items, items.limit(0))
    assert profile_counts.updated(added, gone).count() == 0
    with pytest.raises(Exception, match="never counted"):
        profile_counts.updated(added.limit(0), gone).collect()
