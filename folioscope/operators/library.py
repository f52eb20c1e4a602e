"""Incremental library sync and the projections read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing, identity
from folioscope.operators import scale
from folioscope.operators.profile import is_seed


def merge_changes(
    current: DataFrame,
    incoming: DataFrame,
    key: str = "key",
    *,
    deleted: DataFrame | None = None,
    complete: bool = False,
    content: Column | None = None,
) -> DataFrame:
    """Full outer comparison of a table with an incoming batch.

    One row per key with ``written``, ``unchanged`` and ``deleted`` flags and the surviving
    ``row``. A complete batch also deletes what it does not mention (E4).
    """
    columns = current.columns
    body = hashing.content_hash(columns) if content is None else content
    old = current.select(key, body.alias("_old_hash"), F.struct(*columns).alias("_old"))
    new = incoming.select(key, body.alias("_new_hash"), F.struct(*columns).alias("_new"))
    merged = old.join(new, key, "full_outer")
    if deleted is not None:
        gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
        merged = merged.join(gone, key, "left")
    else:
        merged = merged.withColumn("_gone", F.lit(None).cast("boolean"))
    arrived = F.col("_new_hash").isNotNull()
    same = F.coalesce(F.col("_old_hash") == F.col("_new_hash"), F.lit(False))
    dropped = F.coalesce("_gone", F.lit(False)) | (F.lit(complete) & ~arrived)
    return merged.select(
        key,
        (arrived & ~same).alias("written"),
        (arrived & same).alias("unchanged"),
        dropped.alias("deleted"),
        F.when(~dropped, F.coalesce("_new", "_old")).alias("row"),
    )


def surviving(changes: DataFrame) -> DataFrame:
    """The table after the batch."""
    return changes.filter(F.col("row").isNotNull()).select("row.*")


def change_counts(changes: DataFrame) -> DataFrame:
    """Written, unchanged and deleted totals."""
    return changes.agg(
        F.count_if("written").alias("items_written"),
        F.count_if("unchanged").alias("items_unchanged"),
        F.count_if("deleted").alias("items_deleted"),
    )


def sync_library(
    items: DataFrame,
    collections: DataFrame,
    batch_items: DataFrame,
    batch_collections: DataFrame,
    *,
    deleted: DataFrame | None = None,
    complete: bool = False,
) -> dict[str, DataFrame]:
    """Items and collections after one batch, with counts (C11).

    Items compare by content, collections by version.
    """
    item_changes = merge_changes(items, batch_items, deleted=deleted, complete=complete)
    collection_changes = merge_changes(
        collections, batch_collections, complete=complete,
        content=F.col("version").cast("string"),
    )
    return {
        "items": surviving(item_changes),
        "collections": surviving(collection_changes),
        "counts": change_counts(item_changes),
        "collection_counts": collection_changes.agg(
            F.count_if("written").alias("collections_written")
        ),
    }


def label_sources(items: DataFrame) -> DataFrame:
    """What a label import reads from the library."""
    filled = lambda c: F.filter(c, lambda v: v.isNotNull() & (v != ""))
    return items.filter(is_seed()).select(
        F.col("key").alias("item_key"),
        filled(F.col("identifiers")).alias("identifiers"),
        filled(F.col("collections")).alias("collections"),
        filled(F.transform("tags", lambda t: t["tag"])).alias("tags"),
    )


def memberships(items: DataFrame) -> DataFrame:
    """Collection keys of every item, in long form."""
    return items.select("key", F.explode(F.array_distinct("collections")).alias("collection_key"))


def parents(items: DataFrame) -> DataFrame:
    """Parent of every child item."""
    return items.filter(F.col("parent_key").isNotNull()).select("key", "parent_key")


def children_of_seeds(items: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Seed items beside their live children, one row per pair."""
    children = items.filter(
        F.col("parent_key").isNotNull() & ~F.coalesce(F.col("trashed"), F.lit(False))
    ).select(
        *keys, F.col("parent_key").alias("key"), F.col("key").alias("child_key"), "note_text",
        "annotation_text", "annotation_comment",
    )
    return items.filter(is_seed()).select(*keys, "key", "title").join(
        children, [*keys, "key"], "left"
    )


def known_identifiers(items: DataFrame) -> DataFrame:
    """Folded identifiers of the library's seed items."""
    ids = F.filter("identifiers", lambda v: v.isNotNull() & (v != ""))
    return items.filter(is_seed()).select(F.explode(F.transform(ids, F.lower)).alias("identifier")).distinct()


def exclude_known(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates whose identifiers the library does not hold."""
    aliases = candidates.select(
        "paper_id",
        F.explode(
            F.array_compact(F.array(F.concat(F.lit("arxiv:"), "paper_id"), F.lower("doi")))
        ).alias("identifier"),
    )
    held = scale.hot_key_join(aliases, known_identifiers(items), ["identifier"])
    return candidates.join(held.select("paper_id").distinct(), "paper_id", "left_anti")


def normalized_items(raw: DataFrame, clean) -> DataFrame:
    """Raw library records as normalized items (S2, I16); ``clean`` turns markup into text.

    ``raw`` carries one struct ``data`` per item, as read with the raw item schema. Every text of
    a row goes through one vectorized call.
    """
    d = lambda name: F.col(f"data.{name}")
    texts = F.transform(
        F.array(
            d("title"), d("abstractNote"), d("date"), d("note"), d("annotationText"),
            d("annotationComment"), d("DOI"), d("ISBN"), d("url"), d("extra"), d("parentItem"),
        ),
        lambda v: F.coalesce(v, F.lit("")),
    )
    tags = F.transform(F.coalesce(d("tags"), F.array()), lambda t: F.coalesce(t["tag"], F.lit("")))
    creators = F.transform(
        F.coalesce(d("creators"), F.array()),
        lambda c: F.coalesce(
            F.nullif(c["name"], F.lit("")), F.concat_ws(" ", c["firstName"], c["lastName"])
        ),
    )
    cleaned = raw.select(
        F.coalesce("key", "data.key").alias("key"),
        F.coalesce("version", "data.version", F.lit(0)).alias("version"),
        d("itemType").alias("item_type"),
        clean(texts).alias("_t"),
        clean(tags).alias("_tags"),
        F.transform(
            F.coalesce(d("tags"), F.array()), lambda t: F.coalesce(t["type"], F.lit(0)) == 0
        ).alias("_manual"),
        clean(creators).alias("_creators"),
        F.coalesce(d("collections"), F.array().cast("array<string>")).alias("collections"),
        F.coalesce(d("deleted").cast("boolean"), F.lit(False)).alias("trashed"),
    )
    t = lambda i: F.nullif(F.col("_t")[i], F.lit(""))
    kept = lambda c: F.filter(c, lambda v: v.isNotNull() & (v != ""))
    plain = F.array_compact(F.array(t(6), t(7)))
    preprints = F.concat(*[identity.preprints_in_text(F.col("_t")[i]) for i in (8, 9)])
    pairs = F.arrays_zip("_tags", "_manual")
    return cleaned.select(
        "key",
        F.col("version").cast("long").alias("version"),
        "item_type",
        t(10).alias("parent_key"),
        F.coalesce(t(0), F.lit("")).alias("title"),
        kept(F.col("_creators")).alias("creators"),
        F.filter(
            F.transform(pairs, lambda p: F.struct(p["_tags"].alias("tag"), p["_manual"].alias("manual"))),
            lambda p: p["tag"] != "",
        ).alias("tags"),
        kept(F.col("collections")).alias("collections"),
        F.array_distinct(F.concat(plain, preprints)).alias("identifiers"),
        F.coalesce(t(1), F.lit("")).alias("abstract"),
        t(2).alias("date"),
        "trashed",
        t(3).alias("note_text"),
        t(4).alias("annotation_text"),
        t(5).alias("annotation_comment"),
    )


def malformed_items(items: DataFrame) -> DataFrame:
    """Normalized items without a key, a type or a usable version."""
    bad = (
        F.coalesce(F.trim("key"), F.lit("")) == ""
    ) | (F.coalesce(F.trim("item_type"), F.lit("")) == "") | (F.col("version") < 0)
    return items.filter(bad)
